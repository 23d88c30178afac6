"""Captures from PNG files as tables: envelopes, control trees, relationships, pixels; and back into files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.sources import png, snapshots
from vitrail.sources.snapshots import OWN, Container

CAPTURES = "capture string, path string, width int, height int, snapshot string, status string, error string"
NODES = (
    "capture string, id string, parent string, depth int, ord int, preorder int, role string, label string, description string, help string, role_description string, "
    "x double, y double, w double, h double, enabled boolean, focused boolean, selected boolean, protected boolean, offscreen boolean, read_only boolean, checked string, "
    "expansion string, value_status string, value string, text string, access_key string, accelerator_key string, unredacted boolean"
)
EDGES = "capture string, src string, relation string, dst string"


def binary_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Files as (path, content). Whole pictures are rows, so batches to Python stay short."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 100:
        spark.conf.set(key, "100")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read(files: DataFrame, of: Container = OWN) -> DataFrame:
    """Files (path, content) to captures; status is ok, missing or error, never an exception. of: the container's format."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = h = said = error = None
                try:
                    w, h = png.size_of(content)
                    snapshot = snapshots.read(content, of)
                    if snapshot["image"]["size"] != [w, h]:
                        raise ValueError("the picture's size is not the snapshot's")
                    said, status = json.dumps(snapshot, ensure_ascii=False, separators=(",", ":")), "ok"
                except snapshots.Missing:
                    status = "missing"
                except (ValueError, KeyError, TypeError) as e:
                    status, error = "error", str(e)
                rows.append((path.rsplit("/", 1)[-1], path, w, h, said, status, error))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=["capture", "path", "width", "height", "snapshot", "status", "error"])

    return files.select("path", "content").mapInArrow(parse, CAPTURES)


def _flat(capture: str, snapshot: dict) -> Iterator[tuple]:
    open_text = bool((snapshot.get("capture_policy") or {}).get("debug_unredacted", False))
    for k, (n, parent, depth, place) in enumerate(snapshots.walk(snapshot["root"])):
        states, value = n.get("states") or {}, n.get("value") or {}
        hidden = bool(states.get("protected", False)) and not open_text
        keys = n.get("shortcuts") or {}
        x, y, w, h = map(float, n["bounds"])
        said = value.get("value")
        text = "\n".join(line.get("content", "") for line in (n.get("text") or {}).get("lines", []))
        yield (
            capture, n["id"], parent and parent["id"], depth, place, k + 1, n["role"], n.get("label", ""), n.get("description", ""), n.get("help", ""), n.get("role_description", ""),
            x, y, w, h, states.get("enabled", True), states.get("focused", False), states.get("selected", False), states.get("protected", False), states.get("offscreen", False), states.get("read_only", False),
            states.get("checked"), states.get("expansion"), value.get("status"), None if hidden or said is None else str(said), None if hidden else text, keys.get("access_key"), keys.get("accelerator_key"), open_text,
        )


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _exploded(captures: DataFrame, schema: str, rows_of) -> DataFrame:
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(c, json.loads(s))]
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(list(zip(*rows)) or [()] * len(fields), fields)], names=[n for n, _ in fields])

    return captures.where("status = 'ok'").select("capture", "snapshot").mapInArrow(run, schema)


def nodes(captures: DataFrame) -> DataFrame:
    """Controls in preorder. Values and texts of protected controls are dropped here unless the capture says it is unredacted."""
    return _exploded(captures, NODES, _flat)


def edges(captures: DataFrame) -> DataFrame:
    """Relationships between controls."""
    of = lambda c, s: [(c, n["id"], r, t) for n, *_ in snapshots.walk(s["root"]) for r, targets in (n.get("relationships") or {}).items() for t in targets]
    return _exploded(captures, EDGES, of)


def pixels(files: DataFrame) -> DataFrame:
    """Pictures as rows: path, width, height, channels, data (raster order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = png.decode(content)
                yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([n], pa.int32()) for n in (a.shape[1], a.shape[0], a.shape[2])), pa.array([a.tobytes()], pa.binary())], names=["path", "width", "height", "channels", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, channels int, data binary")


def crops(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """Parts of pictures as PNG in base64: path, id, png. pictures: of `pixels`; boxes: path, id, x, y, w, h (cut at the picture's sides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for w, h, channels, raw, x, y, bw, bh in zip(*(batch.column(k).to_pylist() for k in range(2, 10))):
                part = np.frombuffer(raw, np.uint8).reshape(h, w, channels)[max(0, y) : max(0, y + bh), max(0, x) : max(0, x + bw)]
                made.append(base64.b64encode(png.encode(part)).decode() if part.size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["path", "id", "png"])

    kind = boxes.schema["id"].dataType.simpleString()
    met = boxes.join(pictures, "path").select("path", "id", "width", "height", "channels", "data", "x", "y", "w", "h")
    return met.mapInArrow(run, f"path string, id {kind}, png string")


def export_json(read_captures: DataFrame, path: str) -> None:
    """Snapshots of sound captures as JSON lines below a new path; a path that exists (an input, say) is refused by the writer."""
    read_captures.where("status = 'ok'").select("snapshot").write.mode("errorifexists").text(path)


def encoded(pictures: DataFrame, side: int) -> DataFrame:
    """Square grey pictures (path, grey: values in raster order) as PNG files: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [png.encode(np.repeat(np.array(g, np.uint8).reshape(-1, side, 1), 3, axis=2)) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return pictures.select("path", "grey").mapInArrow(run, "path string, content binary")


def embed(files: DataFrame, told: DataFrame, of: Container = OWN) -> DataFrame:
    """Pictures with the snapshots (path, snapshot as JSON) in place of any they held: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [snapshots.embed(c, json.loads(s), of) for c, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return files.join(told, "path").select("path", "content", "snapshot").mapInArrow(run, "path string, content binary")


def words_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A recogniser's word table (TSV with its usual columns), numbers that don't parse as nulls."""
    schema = "capture string, page_num int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string"
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(schema).csv(path)
    return rows.select("capture", F.col("page_num").alias("page"), F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line"), F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), "conf", "text")


def capture_names(titles: DataFrame, title: str, at: str, then: str | None = None) -> DataFrame:
    """File names for captures: title, local time to the millisecond, and (n) from the second of equal names on."""
    from pyspark.sql import Window as W

    from vitrail.functions.text import safe_name

    base = F.concat(safe_name(F.col(title)), F.lit(" "), F.date_format(at, "yyyy-MM-dd HH-mm-ss.SSS"))
    numbered = titles.withColumn("_base", base).withColumn("_n", F.row_number().over(W.partitionBy("_base").orderBy(at, *([then] if then else []))))
    return numbered.withColumn("file", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(""), F.lit(".png"))).drop("_base", "_n")
