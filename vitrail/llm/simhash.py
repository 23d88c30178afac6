"""SimHash near-duplicates: bit-sliced comparison of fingerprints, then components of the links.

Words are runs of characters other than [\\x20\\x09-\\x0D] after lower-casing A-Z; shingles of consecutive words, repeats
included, are hashed with XXH64 (UTF-8, seed 42), and a fingerprint bit is 1 if more than half of the hashes set it.
Two fingerprints link when they differ in `radius` bits or fewer.

Links are found among distinct fingerprints, each named by itself, so copies cost nothing. Two fingerprints within the radius
agree in at least one of radius + 1 bands of bits; those that agree in a band lie together, sorted by it. There
they are compared bit-sliced: one plane of bits for each fingerprint bit, 64 fingerprints in a machine word. All pairs at
one distance in the sorted order are compared at once by shifting the planes; differing bits are added into vertical
counters with carry-save steps, and the comparison is abandoned as soon as every lane exceeds the radius.
A band shared by more than RUN fingerprints is divided by a second band of the remaining bits (which must agree again
somewhere), a larger cell by a third, and what is larger still into chunks of which each pair meets in a task of its own: no bucket is
capped and none is gathered.
A run gives the links of a spanning forest, not all pairs. Components follow from alternating star contraction over the
links, until nothing changes, with every round written to the shared folder; links and components stay on the executors.

Defined results: a null text counts as empty; a text of fewer words than a shingle is one shingle of all its words; a text
without words has fingerprint zero and links like any other. Repeated rows share a component. A null doc_id is never
the smallest of a component that has another. Extra columns are ignored by `components` and kept by `drop_near_copies`; of rows alike
in doc_id it keeps the largest by the hash of the row's JSON, whatever the order of arrival. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.bpe import map_texts
from vitrail.llm.common import attach_groups, broadcast_in_slices, fresh, materialize
from vitrail.session import remove, shared_path

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Fingerprints of one band value that are compared in one go; larger buckets are divided.
RUN = 2048
#: Distances in the sorted order that are compared in one go; then rows are regrouped.
REGROUP = 16
#: Bands by which a bucket larger than RUN is divided, before it is cut into chunks.
DEPTH = 3
#: Fingerprints of groups (with the group's id) that are broadcast at once.
BROADCAST_PRINTS = 4_000_000
#: The bits of each byte value, most significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes split at exactly these six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(n, 8)
    seen = np.bincount((raw + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((2 * (seen @ BYTE_BITS) > n).ravel()).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add each text's fingerprint as a signed 64-bit integer (the same bits)."""

    def make():
        def work(texts: list[str]) -> dict:
            return {out: pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))}

        return work

    return map_texts(docs, text, make, {out: "bigint"})


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes, a row of words for each bit: lane k of a plane is the bit of fingerprint k (of one word, or of a row of words)."""
    words = prints.reshape(len(prints), -1)
    n = -(-len(words) // 64) * 64
    padded = np.zeros((n, words.shape[1]), np.uint64)
    padded[: len(words)] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which lane k holds what lane k + by held; lanes past the end hold 0."""
    words, bits = divmod(by, 64)
    out = np.zeros_like(planes)
    width = planes.shape[-1] - words
    if width > 0:
        out[..., :width] = planes[..., words:] >> np.uint64(bits)
        if bits and width > 1:
            out[..., : width - 1] |= planes[..., words + 1 :] << np.uint64(64 - bits)
    return out


def within(planes: np.ndarray, other: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of `alive` whose two fingerprints differ in `radius` bits or fewer.

    As many counter planes as the radius has digits, and an overflow plane, count the differing bits of each lane; a full
    adder takes two planes of differences with the lowest counter, and carries ripple up. Blocks of planes end when no lane is left.
    """
    counters = [np.zeros_like(alive) for _ in range(radius.bit_length())]
    over, left, block = np.zeros_like(alive), alive, max(8, len(planes) // 8)
    for k in range(0, len(planes), 2):
        a, b = planes[k] ^ other[k], planes[k + 1] ^ other[k + 1]
        half = a ^ b
        carry = (a & b) | (half & counters[0])
        counters[0] ^= half
        for c in counters[1:]:
            c ^= carry
            carry &= ~c  # a counter that a carry turned off carries on
        over |= carry
        if k % block == block - 2:
            left = alive & ~(over | _exceeds(counters, radius))
            if not left.any():
                break
    return left


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is larger than the radius, compared from the highest digit."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def lanes(on: np.ndarray) -> np.ndarray:
    """Truth values as a plane of lanes."""
    padded = np.zeros(-(-len(on) // 64) * 64, np.uint8)
    padded[: len(on)] = on
    return np.packbits(padded, bitorder="little").view(np.uint64)


def set_lanes(plane: np.ndarray) -> np.ndarray:
    """Numbers of the lanes that are set."""
    return np.flatnonzero(np.unpackbits(plane.view(np.uint8), bitorder="little"))


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Join the labels of pairs; also says which pairs joined what was apart."""
    up, kept = {}, []

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        x, y = sorted((root(x), root(y)))
        if x != y:
            up[y] = x
            kept.append(k)
    if up:
        new = np.arange(len(label))
        for x in up:
            new[x] = root(x)
        label = new[label]
    return label, kept


def pairs_in_runs(keys: np.ndarray, prints: np.ndarray, radius: int, label: np.ndarray, sizes: np.ndarray | None = None, share: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) of rows with one key, different labels and near fingerprints; rows are sorted by key.

    All rows at one distance from one another are compared at once, REGROUP distances in one go. Whoever takes the pairs may change the labels in place;
    runs that are shorter, or of one label throughout, drop out. Of given sizes, the smaller must have that share of the larger.
    """
    if not len(keys):
        return
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.concatenate([begins, [len(keys)]]))
    room = np.repeat(begins + length, length) - np.arange(len(keys))  # rows from here to the run's end
    apart = 1
    while True:
        open_run = (length > apart) & (np.minimum.reduceat(label, begins) != np.maximum.reduceat(label, begins))
        at = np.flatnonzero(np.repeat(open_run, length))  # runs stay whole, so places in them stay consecutive
        if not len(at):
            return
        planes = planes_of(prints[at])
        steps = np.arange(apart, apart + REGROUP)
        other = np.minimum(at + steps[:, None], len(keys) - 1)
        live = (room[at] > steps[:, None]) & (label[at] != label[other])
        if sizes is not None:
            live &= np.minimum(sizes[at], sizes[other]) >= share * np.maximum(sizes[at], sizes[other])
        if live.any():
            shifted = np.stack([_shifted(planes, k) for k in steps.tolist()], axis=1)
            hit = within(planes[:, None], shifted, np.stack([lanes(x) for x in live]), radius)
            for k, own in zip(steps.tolist(), hit):
                if own.any():
                    a = set_lanes(own)
                    new = label[at[a]] != label[at[a] + k]
                    if new.any():
                        yield at[a][new], at[a][new] + k
        apart += REGROUP


def links_of_runs(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints with the same key; rows are sorted by key."""
    label, a_out, b_out = np.arange(len(keys)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pairs_in_runs(keys, prints, radius, label):
        label[:], kept = _settle(label, a, b)
        a_out.append(a[kept])
        b_out.append(b[kept])
    return prints[np.concatenate(a_out)], prints[np.concatenate(b_out)]


def whole_runs(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive batches sorted by their first column, cut between its values, of about `least` rows each."""
    kept: list[np.ndarray] = []
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = [np.concatenate(x) for x in zip(kept, own)] if kept else own
        if len(kept[0]) >= least:
            whole = int(np.searchsorted(kept[0], kept[0][-1]))  # the last key may go on in the next batch
            yield [x[:whole] for x in kept]
            kept = [x[whole:] for x in kept]
    if kept:
        yield kept


def in_chunks(rows: DataFrame, key: str, node: str, size: str, run: int) -> DataFrame:
    """Rows of buckets (column `size`) larger than `run` cut into chunks: each pair of a bucket's chunks meets under a key of its own."""
    chunks = F.when(F.col(size) > run, F.ceil(F.col(size) / F.lit(max(1, run // 2)))).otherwise(F.lit(1)).cast("int")
    cut = rows.withColumn("_chunks", chunks).withColumn("_own", F.pmod(F.xxhash64(node), F.col("_chunks")).cast("int"))
    cut = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    split = F.when(F.col("_chunks") > 1, F.xxhash64(key, F.least("_own", "_with"), F.greatest("_own", "_with"))).otherwise(F.col(key))
    return cut.withColumn(key, split).drop("_chunks", "_own", "_with")


def _masks(parts: int, depth: int) -> list[list[int]]:
    """For each way to choose a band at every level before, the masks of the bands that the remaining bits are cut into."""
    free = [list(range(64))]
    for level in range(depth + 1):
        cut = [[bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)] for bits in free]
        if level < depth:
            free = [sorted(set(bits) - set(band)) for bits, bands in zip(free, cut) for band in bands]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [[signed(sum(1 << b for b in band)) for band in bands] for bands in cut]


def links(prints: DataFrame, radius: int = 3, run: int = RUN) -> DataFrame:
    """Links (a, b) that connect what fingerprints within the radius connect.

    prints: the distinct fingerprints, column fp, materialised.
    """
    if not 0 < radius < 8:
        raise ValueError("radius must lie between 1 and 7")
    parts = radius + 1
    cells = prints.select("fp", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("way"))
    ready: list[DataFrame] = []
    for level in range(DEPTH):
        table = F.array(*(F.array(*(F.lit(m).cast("bigint") for m in masks)) for masks in _masks(parts, level)))
        bands = F.transform(F.element_at(table, F.col("way") + 1), lambda m: F.col("fp").bitwiseAND(m))
        split = cells.select("fp", "key", "way", F.posexplode(bands).alias("band", "value"))
        keyed = materialize(split.select("fp", F.xxhash64("key", "band", "value").alias("key"), (F.col("way") * parts + F.col("band")).alias("way")), f"simhash-bands-{level}")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        busy = materialize(sizes.where(F.col("n") > run), f"simhash-busy-{level}")
        ready.append(keyed.join(busy, "key", "left_anti").select("fp", "key"))
        if busy.isEmpty():
            break
        cells = keyed.join(busy.select("key"), "key", "left_semi")
    else:
        ready.append(in_chunks(keyed.join(busy, "key"), "key", "fp", "n", run).select("fp", "key"))
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)

    def run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_runs(batches):
            yield _as_batch(links_of_runs(keys, fps.view(np.uint64), radius))

    return rows.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(run_links, "a bigint, b bigint")


def _as_batch(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], names=["a", "b"])


def connect(pairs: DataFrame, files: int | None = None) -> DataFrame:
    """Components of links (a, b): one row (node, root) per linked node, root the smallest node of its component.

    Large-star and small-star contraction in turn: each round joins nodes with the smallest neighbour, which partial sums
    find before any shuffle, and a hub's rows are split by the skew join. Rounds go on until a round changes nothing; a
    round's tables are removed when the next one is written. files: how many files a round writes (else one for each partition).
    """
    spark = pairs.sparkSession
    now = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = before = last = None
    while state is None or state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a link (a, b) with b > a goes to (b, m); what points at itself says nothing
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        path = shared_path(spark, "star")
        now = materialize(small.where("a <> b").distinct(), "star", path, files)
        if last:
            remove(spark, last)
        before, last, state = state, path, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def components_of(prints: DataFrame, radius: int, doc_id: str) -> DataFrame:
    """For each distinct fingerprint in `prints` (doc_id, fp; materialised): fp, docs, first (smallest doc_id reachable), of (documents of its component)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("docs")), "simhash-distinct")
    nodes = materialize(connect(links(distinct.select("fp"), radius)), "simhash-components")
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp")
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"), F.sum("docs").alias("all"))
    grouped = linked.select("fp", "root", "docs").join(firsts, "root").select("fp", "docs", "first", F.col("all").alias("of"))
    alone = distinct.join(nodes.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "docs", F.col("least").alias("first"), F.col("docs").alias("of"))
    return materialize(grouped.unionByName(alone), "simhash-firsts")


def components(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprints(narrow, "text", "fp", shingle).select("doc_id", "fp"), "simhash-prints")
    total = prints.count()
    firsts = components_of(prints, radius, "doc_id")
    met = attach_groups(prints, firsts, "fp", "docs", total)
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", most_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """One document of each component (the smallest doc_id; a null one loses), in the documents' own columns.

    Documents alone in their component pass where they are; the others meet whole, one for each component and task.
    """
    fp, first = fresh(docs, "fp", "first")
    keyed = materialize(with_fingerprints(docs, text, fp, shingle), "simhash-documents")
    prints = keyed.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(fp).alias("fp"))
    firsts = components_of(prints, radius, "doc_id")
    groups = firsts.where(F.col("of") > 1).select(F.col("fp").alias(fp), F.struct("first").alias(first))
    marked = broadcast_in_slices(keyed, groups, fp, most_prints)
    return one_of_each(marked, docs.columns, first, doc_id)


def one_of_each(marked: DataFrame, columns: list[str], group: str, doc_id: str) -> DataFrame:
    """Rows without a group as they are, and of each group the row with the smallest doc_id (a null one loses; ties: by the row's JSON)."""
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    best = F.max_by(whole, F.struct(F.coalesce(-F.col(doc_id).cast("bigint"), F.lit(-(2**63))), F.xxhash64(F.to_json(whole))))
    kept = marked.where(F.col(group).isNotNull()).groupBy(group).agg(best.alias("_row")).select("_row.*")
    return marked.where(F.col(group).isNull()).select(columns).unionByName(kept)
