"""Near copies of whole texts by SimHash: five-word shingles, Jaccard 0.8 or more, confirmed exactly.

Words are those of `simhash`. The shingles of a text form a set; a text of fewer words than a shingle has one of all its words,
and texts without words (null, empty) are copies of each other. Texts of the same words are one node, named by a 64-bit hash.

A node's fingerprint is the SimHash of its set, WORDS words of 64 bits from as many hashes of each shingle. Two sets with Jaccard 0.8 have a
cosine of 0.889 at least, so each bit differs with probability 0.152 at most: 38.8 of 256 bits on average, and more than RADIUS in 6 of a
million pairs. As so wide a radius rules out bands of the fingerprint, the blocks that are compared come from BANDS bands of ROWS minima
of permuted shingle hashes (a pair at 0.8 shares none with probability (1 - 0.8^4)^24 = 3 in a million). Within a block fingerprints are
compared bit-sliced, as in `simhash`: planes of bits, carry-save counters, blocks abandoned when all their lanes exceed the radius. What is
left, and whose sets are near in size, is confirmed on the sets themselves, so nothing below the limit ever links.

No block is capped, and no table of all its pairs is made. First each member is held against its block's smallest node, all rows of a
batch at once, which takes in clusters of copies in linear work. Then only blocks that still hold several components are looked at (large
ones in chunks of which each pair meets in a task of its own): rows with a near partner in another component get their sets, and a
task confirms pairs in place, each in the first block that both are in, and gives out the links that join what was apart. So rows
grow with the texts, whatever the size of a group, and the components are those of all pairs. Tables without texts are written to as many
files as their rows ask for, not one for each shuffle partition.

Defined results: those above; repeated rows are copies, the smallest doc_id of a component stays (a null one loses, ties go by the row's
JSON), extra columns pass through under their own names, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.bpe import forget_pieces, map_texts
from vitrail.llm.common import attach_groups, blank_null, broadcast_in_slices, files_for, fresh, materialize, short_batches
from vitrail.llm.simhash import BROADCAST_PRINTS, BYTE_BITS, LOWER, SEED, connect, in_chunks, lanes, one_of_each, pairs_in_runs, planes_of, set_lanes, whole_runs, within

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Fingerprint bits beyond which a pair is no candidate.
RADIUS = 64
WORDS = 4
#: Nodes of one block that are compared in one go; larger blocks are divided.
RUN = 2048
#: Rows whose planes a task holds, with one block more: a row's shifted planes take half a kilobyte for each distance.
COMPARED = 16_000
#: Pairs of one node that are confirmed together, about; and rows with their sets that a task holds, with one block more.
PAIRS, HELD = 500, 2_000
#: Shingles whose permuted hashes are held at once.
BLOCK = 2048
_RANDOM = np.random.default_rng(5)
_ODD = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Factors and shifts that make several hashes of one.
_TURN = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Weights that make one key of a band's minima.
_FOLD = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of a text's words, and the sorted distinct hashes of its shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1 if words else np.zeros(1, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(ends)) - 1 :].tolist())
    return digest(joined, SEED), np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of the bands (signed), and the SimHash fingerprint of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[k : k + BLOCK, None] * _ODD + _ADD).min(axis=0), out=least)
    keys = ((least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) * _MIX) ^ np.arange(BANDS, dtype=np.uint64)
    turned = hashes[:, None] * _TURN
    turned ^= turned >> np.uint64(32)
    turned *= _MIX
    turned ^= turned >> np.uint64(29)
    raw = turned.view(np.uint8).reshape(len(hashes), -1)
    seen = np.bincount((raw + np.arange(0, 2048 * WORDS, 256)).ravel(), minlength=2048 * WORDS).reshape(8 * WORDS, 256)
    return keys.view(np.int64), np.packbits((2 * (seen @ BYTE_BITS) > len(hashes)).ravel()).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    shared = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return shared / (len(a) + len(b) - shared)


def with_signatures(docs: DataFrame, text: str, node: str, print_: str, bands: str, size: str) -> DataFrame:
    """Add each text's node, fingerprint (binary), band keys (array<bigint>) and the size of its set."""

    def make():
        forget_pieces()

        def work(texts: list[str]) -> dict:
            nodes, prints, keys, sizes = [], [], [np.zeros(0, np.int64)], []
            for t in texts:
                name, own = shingles(t)
                band, bits = signature(own)
                nodes.append(name)
                prints.append(bits)
                keys.append(band)
                sizes.append(len(own))
            at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
            named = pa.array(np.array(nodes, np.uint64).view(np.int64))
            return {node: named, print_: pa.array(prints, pa.binary()), bands: pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys))), size: pa.array(sizes, pa.int64())}

        return work

    return map_texts(docs, text, make, {node: "bigint", print_: "binary", bands: "array<bigint>", size: "bigint"})


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted nodes' texts: node, bands, set (both packed). docs: row, text; wanted: node, row, bands, materialised."""
    short_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()]
            own = [shingles(t)[1].tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(own, pa.binary())], names=["node", "bands", "set"])

    met = broadcast_in_slices(docs, wanted, "row", BROADCAST_PRINTS // 16, "inner")  # a row of `wanted` is as long as sixteen prints
    return met.select("node", "bands", "text").mapInArrow(make, "node bigint, bands binary, set binary")


def _with_set(pairs: DataFrame, end: str, other: str, sets: DataFrame) -> DataFrame:
    """Pairs with the set of one of their ends. An end with many pairs is salted, so that its pairs and copies of its set meet in several tasks."""
    uses = pairs.groupBy(end).agg(F.ceil(F.count("*") / F.lit(PAIRS)).cast("int").alias("parts"))
    side = sets.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set")).join(uses, end)
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    salted = pairs.join(uses, end).withColumn("salt", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
    return salted.join(side, [end, "salt"]).drop("salt")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def confirmed(pairs: DataFrame, sets: DataFrame, files: int | None = None) -> DataFrame:
    """Those of the pairs (a, b) whose sets are near copies."""
    pairs = materialize(pairs.distinct(), "overlap-pairs", files=files)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([jaccard(x, y) >= LEAST for x, y in zip(_unpacked(batch.column(2)), _unpacked(batch.column(3)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], names=["a", "b"])

    rows = _with_set(_with_set(pairs, "a", "b", sets), "b", "a", sets).select("a", "b", "a_set", "b_set")
    return materialize(rows.mapInArrow(check, "a bigint, b bigint"), "overlap-links", files=files)


def _pairs(batch: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in batch], names=["a", "b"])


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes that allow the limit."""
    return np.minimum(a, b) >= LEAST * np.maximum(a, b)


def _near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, size, fp, centre, around, middle) those whose fingerprints are near the one of their block's centre."""
    for batch in batches:
        node, size, centre, around = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        if len(node):
            alive = lanes((node != centre) & _alike(size, around))
            hit = set_lanes(within(planes_of(_prints(batch.column(2))), planes_of(_prints(batch.column(5))), alive, RADIUS))
            yield _pairs([node[hit], centre[hit]])


#: Columns of a block's rows, sorted by key: a chunk's key, the block's, and the row's own.
MEMBER = ["key", "block", "node", "size", "root", *(f"w{k}" for k in range(WORDS))]


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (MEMBER) those that have a near partner with another root under their key."""
    for columns in whole_runs(batches, COMPARED):
        keys, _, _, sizes, roots, *words = columns
        some = np.zeros(len(keys), bool)
        for a, b in pairs_in_runs(keys, np.column_stack(words).view(np.uint64), RADIUS, roots, sizes, LEAST):
            some[a] = some[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=MEMBER)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (MEMBER, bands, set) the confirmed pairs that join what is apart under their key."""
    for keys, blocks, nodes, sizes, roots, *words, bands, packed in whole_runs(batches, HELD):
        prints, bands = np.column_stack(words).view(np.uint64), np.frombuffer(b"".join(bands), np.int64).reshape(-1, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        label, out = np.unique(roots, return_inverse=True)[1], []
        for a, b in pairs_in_runs(keys, prints, RADIUS, label, sizes, LEAST):
            first = (bands[a] == bands[b]).argmax(axis=1)
            here = bands[a, first] == blocks[a]  # a pair that meets in several blocks is confirmed in one
            for x, y in zip(a[here].tolist(), b[here].tolist()):
                if label[x] != label[y] and jaccard(sets[x], sets[y]) >= LEAST:
                    label[label == label[y]] = label[x]
                    out.append((nodes[x], nodes[y]))
        yield _pairs(list(np.array(out, np.int64).reshape(-1, 2).T))


def components_of(single: DataFrame, docs: DataFrame, run: int = RUN) -> DataFrame:
    """Components of near copies: node, root for every node that has a link.

    single: node, size, fp, bands, row (of one document that stands for it), one row a node, materialised; docs: row, text.
    """
    # keys alone are grouped; sizes and fingerprints join what shares a block
    keyed = materialize(single.select("node", F.explode("bands").alias("key")), "overlap-keys")
    total = keyed.count()
    files = files_for(total)
    blocks = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "overlap-blocks", files=files)
    met = materialize(attach_groups(keyed, blocks, "key", "n", total).join(single.select("node", "size", "fp"), "node"), "overlap-met", files=files)
    centres = materialize(met.groupBy("key", "n").agg(F.min_by(F.struct("node", "size", "fp"), "node").alias("c")), "overlap-centres", files=files)
    wanted = materialize(single.select("node", "row", "bands").join(met.select("node").distinct(), "node"), "overlap-wanted")
    sets = materialize(sets_of(docs, wanted), "overlap-sets")
    stars = attach_groups(met.drop("n"), centres, "key", "n", total).select("node", "size", "fp", F.col("c.node").alias("centre"), F.col("c.size").alias("around"), F.col("c.fp").alias("middle"))
    joined = materialize(connect(confirmed(stars.mapInArrow(_near_centre, "a bigint, b bigint"), sets, files), files), "overlap-stars", files=files)
    # what is left: pairs of a block whose ends are not connected yet
    rooted = materialize(met.drop("n").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "overlap-rooted", files=files)
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("weight")).where("low <> high")
    # a chunk holds `run` rows and `run` thousand shingles at most, about
    mixed = materialize(several.select("key", F.greatest("n", F.ceil(F.col("weight") / 1000)).alias("n")), "overlap-mixed", files=files)
    if mixed.isEmpty():
        return joined
    words = [F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("bigint").alias(f"w{k}") for k in range(WORDS)]
    left = attach_groups(rooted, mixed, "key", "n", rooted.count()).withColumn("block", F.col("key"))
    in_order = lambda rows: rows.repartition("key").sortWithinPartitions("key", "node")
    rows = in_chunks(left, "key", "node", "n", run).select("key", "block", "node", "size", "root", *words)
    near = materialize(in_order(rows).select(*MEMBER).mapInArrow(_with_partner, ", ".join(f"{c} bigint" for c in MEMBER)), "overlap-near", files=files)
    short_batches(near.sparkSession)
    more = materialize(in_order(near.join(sets, "node")).select(*MEMBER, "bands", "set").mapInArrow(_joining, "a bigint, b bigint"), "overlap-joining", files=files)
    return connect(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), files) if not more.isEmpty() else joined


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, most_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """One document of each component (the smallest doc_id; a null one loses), in the documents' own columns.

    Documents alone in their component pass where they are; the others meet whole, one for each component and task.
    """
    node, fp, bands, size, first, row = fresh(docs, "node", "fp", "bands", "size", "first", "row")
    keyed = materialize(with_signatures(docs, text, node, fp, bands, size).withColumn(row, F.monotonically_increasing_id()), "overlap-documents")
    named = keyed.select(F.col(node).alias("node"), F.col(fp).alias("fp"), F.col(bands).alias("bands"), F.col(size).alias("size"), F.col(row).alias("row"))
    files = files_for(BANDS * keyed.count())
    single = materialize(named.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("row").alias("row"), F.count("*").alias("docs")), "overlap-nodes", files=files)
    texts = keyed.select(F.col(row).alias("row"), blank_null(text).alias("text"))
    linked = materialize(components_of(single, texts, run), "overlap-components", files=files)
    # nodes with more than one document, or with a link
    many = single.where("docs > 1").select("node").join(linked, "node", "left_anti").select("node", F.col("node").alias("root"))
    groups = materialize(linked.unionByName(many).select(F.col("node").alias(node), F.struct("root").alias(first)), "overlap-groups", files=files)
    return one_of_each(broadcast_in_slices(keyed.drop(fp, bands, size, row), groups, node, most_prints), docs.columns, first, doc_id)
