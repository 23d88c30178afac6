import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrail.operators import trees
from vitrail.sources import captures, png, snapshots
from vitrail.sources.snapshots import OWN


def snapshot(**more):
    box = {"id": "c", "role": "checkbox", "label": "Keep", "bounds": [10, 10, 50, 12], "states": {"checked": "mixed", "enabled": False}, "relationships": {"labelled_by": ["r"]}}
    secret = {"id": "p", "role": "edit", "label": "Code", "bounds": [5, 40, 60, 12], "states": {"protected": True}, "value": {"status": "value", "value": "PasswordHiddenSentinel"}, "text": {"status": "value", "lines": [{"content": "HiddenTextSentinel", "rectangles": [[5, 40, 60, 12]]}]}}
    root = {"id": "r", "role": "window", "label": "Main <1>", "bounds": [0, 0, 120, 80], "children": [box, secret]}
    return {"format": OWN.format, "version": 3, "image": {"size": [120, 80], "coordinate_space": "image-pixels"}, "root": root} | more


def picture(w=120, h=80):
    return png.encode(np.arange(w * h * 3, dtype=np.int64).reshape(h, w, 3) % 251)


def with_chunk(data, name=OWN.chunk, times=1):
    base = picture()
    return base[:-12] + png.chunk(name, data) * times + base[-12:]


def broken():
    good = OWN.pack(snapshot())
    raw = json.dumps(snapshot()).encode()
    head = lambda n: OWN.lead + struct.pack(">I", n)
    whole = with_chunk(good)
    yield "valid", whole, "ok"
    yield "missing", picture(), "missing"
    yield "old name", with_chunk(good, b"vtRm"), "missing"
    yield "two", with_chunk(good, times=2), "error"
    yield "checksum", whole.replace(good[-6:], good[-6:-1] + bytes([good[-1] ^ 1])), "error"
    yield "truncated", whole[:-5], "error"
    yield "cut chunk", whole[:-40], "error"
    yield "after the end", whole + b"x", "error"
    for k in range(8, 12):
        yield f"byte {k}", with_chunk(good[:k] + b"\x09" + good[k + 1 :]), "error"
    yield "long", with_chunk(head(1) + zlib.compress(b"x" * 1_000_000)), "error"
    yield "short", with_chunk(head(100) + zlib.compress(b"{}")), "error"
    yield "over the limit", with_chunk(head((64 << 20) + 1) + zlib.compress(b"{}")), "error"
    yield "trailing", with_chunk(good + b"x"), "error"
    yield "cut stream", with_chunk(head(len(raw)) + zlib.compress(raw)[:-4]), "error"
    yield "size", snapshots.embed(picture(119), snapshot()), "error"
    yield "not a picture", b"GIF89a", "error"


def test_every_malformed_container_is_told_apart(spark):
    cases = list(broken())
    files = spark.createDataFrame([(n, bytearray(c)) for n, c, _ in cases], "path string, content binary")
    got = {r.path: r.status for r in captures.read(files).collect()}
    assert got == {n: s for n, _, s in cases}


def test_embedding_replaces_and_keeps_pixels(spark):
    first = snapshots.embed(picture(), snapshot())
    again = snapshots.embed(first, snapshot(warnings=["x"]))
    assert snapshots.embed(again, snapshot(warnings=["x"])) == again
    assert snapshots.read(again)["warnings"] == ["x"]
    assert (png.decode(again) == png.decode(picture())).all()
    files = spark.createDataFrame([("a", bytearray(picture()))], "path string, content binary")
    told = spark.createDataFrame([("a", json.dumps(snapshot()))], "path string, snapshot string")
    row = captures.embed(files, told).first()
    assert snapshots.read(bytes(row.content)) == snapshot()
    shape = captures.pixels(files).first()
    assert (shape.width, shape.height, shape.channels) == (120, 80, 3)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rnd = np.random.default_rng(kind)
    pixels = rnd.integers(0, 256, (9, 7, 3))
    rows, up = [], np.zeros((7, 3), np.int64)
    for y in range(9):
        row = pixels[y].astype(np.int64)
        left = np.vstack([np.zeros((1, 3), np.int64), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), np.int64), up[:-1]])
        base = left + up - corner
        a, b, c = abs(base - left), abs(base - up), abs(base - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        up = row
    head = struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)
    data = png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(b"".join(rows))) + png.chunk(b"IEND", b"")
    assert (png.decode(data) == pixels).all()


@pytest.mark.parametrize("change", [{"version": 2}, {"format": "x"}, {"image": {"size": [0, 1], "coordinate_space": "image-pixels"}}])
def test_envelope_rules(change):
    with pytest.raises(ValueError):
        snapshots.validate(snapshot(**change))


def test_node_rules():
    for spoil in (lambda c: c.update(id="r"), lambda c: c.update(bounds=[0, 0, -1, 1]), lambda c: c.update(bounds=[0, 0, True, 1]), lambda c: c["relationships"].update(x=["gone"]), lambda c: c.pop("role")):
        s = snapshot()
        spoil(s["root"]["children"][0])
        with pytest.raises(ValueError):
            snapshots.validate(s)
    deep = snapshot()
    at = deep["root"]
    for k in range(70):
        at["children"] = [{"id": f"d{k}", "role": "group", "bounds": [0, 0, 1, 1]}]
        at = at["children"][0]
    with pytest.raises(ValueError):
        snapshots.validate(deep)
    with pytest.raises(ValueError):
        snapshots.validate(snapshot(), strict=True)


def test_capture_to_outline_without_secrets(spark):
    files = spark.createDataFrame([("a.png", bytearray(snapshots.embed(picture(), snapshot())))], "path string, content binary")
    read = captures.read(files)
    nodes = captures.nodes(read)
    said = trees.describe(F.col("label"), F.col("role"), checked=F.col("checked"), enabled=F.col("enabled"), protected=F.col("protected"), value=F.col("value"))
    html = trees.outline(trees.visible(nodes.withColumn("x", F.col("x"))).withColumn("said", said), "said").first().html
    assert html == "<ul><li>Main &lt;1&gt;, window<ul><li>Keep, checkbox, mixed, disabled</li><li>Code, edit, password field</li></ul></li></ul>"
    assert captures.edges(read).collect()[0][1:] == ("c", "labelled_by", "r")
    every = str(nodes.collect())
    assert "Sentinel" not in every


def test_word_table(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("capture\tpage_num\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext\na\t1\t1\t1\t1\t5\t6\t20\t10\t91.5\tHello\na\t1\t1\t1\t1\tx\t6\t20\t10\t91\tbad\n")
    rows = captures.words_tsv(spark, str(path)).collect()
    assert (rows[0].x, rows[0].conf, rows[0].text) == (5, 91.5, "Hello") and rows[1].x is None


def test_capture_names(spark):
    df = spark.createDataFrame([("a:b*", 1), ("ab", 1), ("  . ", 2), ("x" * 300, 3), ("é" * 100, 4)], "title string, s int").withColumn("at", F.timestamp_seconds(F.lit(0)))
    names = sorted(r.file for r in captures.capture_names(df, "title", "at").collect())
    assert "ab 1970-01-01 00-00-00.000.png" in names and "ab 1970-01-01 00-00-00.000 (2).png" in names
    assert "Window 1970-01-01 00-00-00.000.png" in names
    assert max(len(n) for n in names) == 100 + 28 and any(n.startswith("é" * 90 + " ") for n in names)
