"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that no cut divides. Groups are ordered by the digest of their text, those that fill a
shard alone before the others: an order that is the same on every run, needs no sampling, and spreads the corpus over the shards. The smallest feasible capacity of a
shard is found by binary search, each candidate checked greedily, and the cuts are then made under that capacity.

The search runs on the driver over a bounded summary: total sizes of blocks of digests. A block hides where
groups end within it. One greedy walk that may cut at block ends only, and one that may cut anywhere within a
block, bound the capacity from above and below; blocks that a cut of either walk can fall into are divided by further
digits of the digest, until both bounds agree. So the capacity is exact and no list of all groups leaves the executors.

Only DataFrame functions run on the rows: no Python on the executors.

Defined results: a null text has no bytes and shares a group with other nulls and with empty texts; a row's size is its
bytes plus eight; a group larger than a fair share makes the largest shard and the others share the rest; fewer groups
than shards leave shards empty; an empty table gives no rows. Repeated rows are rows of one group, each with its own
slot. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrail.llm.common import blank_null, materialize

#: Hexadecimal digits by which blocks are divided: 4096 blocks at first, and as many for each block divided.
DIGITS = 3
#: Rows of a shard that are numbered together, about: larger shards are numbered in more parts, so that none gathers in one task.
PART_ROWS = 100_000


class Blocks:
    """Consecutive blocks of ordered groups: where each begins, its size, and whether it is a single group."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        """rows: first and last digest, size, and the digits by which the block was divided off."""
        self.rows = sorted(rows)
        self.ends = [0]
        for _, _, size, _ in self.rows:
            self.ends.append(self.ends[-1] + size)

    def walk(self, shards: int, capacity: int, anywhere: bool) -> list[int]:
        """Where a greedy walk ends each shard. anywhere: it may cut within blocks of several groups."""
        at, out = 0, []
        for _ in range(shards):
            k = bisect_right(self.ends, at + capacity) - 1
            inside = anywhere and k < len(self.rows) and self.rows[k][0] != self.rows[k][1]
            at = at + capacity if inside else max(at, self.ends[k])
            out.append(min(at, self.ends[-1]))
        return out

    def smallest(self, shards: int, least: int, anywhere: bool) -> int:
        """The smallest capacity, `least` or more, with which a walk gets to the end."""
        low, high = least, max(least, self.ends[-1])
        while low < high:
            mid = (low + high) // 2
            if self.walk(shards, mid, anywhere)[-1] == self.ends[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, shards: int, low: int, high: int) -> set[int]:
        """Blocks of several groups in which a cut can fall with a capacity between both."""
        first, last, out = [0, *self.walk(shards, low, False)], [0, *self.walk(shards, high, True)], set()
        for a, b in zip(first[:-1], last[:-1]):
            k = max(0, bisect_right(self.ends, a + low) - 1)
            while k < len(self.rows) and self.ends[k] <= b + high:
                if self.rows[k][0] != self.rows[k][1]:
                    out.add(k)
                k += 1
        return out

    def cuts(self, shards: int, capacity: int) -> list[str]:
        """The digest at which each shard but the first begins: shards near a fair share, none above the capacity."""
        k, out = 0, []
        for left in range(shards, 1, -1):
            last = bisect_right(self.ends, self.ends[k] + capacity) - 1
            fair = self.ends[k] + (self.ends[-1] - self.ends[k]) / left
            near = max(k, min(last, bisect_right(self.ends, fair) - 1))
            if near < last and (near == k or self.ends[near + 1] - fair < fair - self.ends[near]):
                near += 1
            if near < last and self._steps(near, capacity) > left - 1:
                near = last
            k = near
            out.append(self.rows[k][0] if k < len(self.rows) else "g")  # behind every digest
        return out

    def _steps(self, k: int, capacity: int) -> int:
        """Shards that the groups from block k on need."""
        n = 0
        while k < len(self.rows):
            k, n = bisect_right(self.ends, self.ends[k] + capacity) - 1, n + 1
        return n


def _blocks(rows: DataFrame, digits: int) -> list[tuple[str, str, int, int]]:
    got = rows.groupBy(F.substring("digest", 1, digits).alias("block")).agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.sum("size").alias("n")).collect()
    return [(r.a, r.b, r.n, digits) for r in got]


def minimax(rows: DataFrame, shards: int) -> tuple[int, list[str], list[str]]:
    """The smallest capacity, the digests of groups that fill a shard alone, and the digests at which the other shards begin.

    A group as large as a fair share of what is left stands alone, at the head of the order; no partition does better. The
    other groups are cut, in their order, under the smallest capacity of their own.

    rows: digest (hexadecimal text), size (positive); read several times, so materialised.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return 0, [], ["g"] * (shards - 1)
    heads = rows.groupBy("digest").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "digest").limit(shards + 1).collect()
    alone: list[str] = []
    for r in heads[: shards - 1]:
        if r.n * (shards - len(alone)) < total:
            break
        alone.append(r.digest)
        total -= r.n
    left = shards - len(alone)
    if len(heads) == len(alone):
        return heads[0].n, alone, ["g"] * (left - 1)
    rows = rows.where(~F.col("digest").isin(alone)) if alone else rows
    blocks = Blocks(_blocks(rows, DIGITS))
    least = max(heads[len(alone)].n, -(-total // left))
    while True:
        low, high = blocks.smallest(left, least, True), blocks.smallest(left, least, False)
        unclear = blocks.doubtful(left, low, high) if low < high else set()
        if not unclear:
            return max(high, heads[0].n), alone, blocks.cuts(left, high)
        parts = [r for k, r in enumerate(blocks.rows) if k not in unclear]
        for digits in {blocks.rows[k][3] for k in unclear}:
            names = sorted({blocks.rows[k][0][:digits] for k in unclear if blocks.rows[k][3] == digits})
            parts += _blocks(rows.where(F.substring("digest", 1, digits).isin(names)), digits + DIGITS)
        blocks = Blocks(parts)


def slots(rows: DataFrame, shard: str, shards: int, spread: Column, order: list[Column], out: str = "slot", part_rows: int = PART_ROWS) -> DataFrame:
    """Number the rows of each shard (0 to shards - 1) from 0 without gaps.

    Rows are numbered within parts of a shard (by the hash `spread`), of which a shard has one for each `part_rows` of its rows; a part's
    first number is the count of rows in the parts before it. The table of first numbers, which is broadcast, has as many rows as there
    are parts: the shards and one more for each `part_rows` rows.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(shard).count().collect()}  # a row for each shard
    parts = F.array(*(F.lit(max(1, -(-sizes.get(k, 0) // part_rows))) for k in range(shards)))
    parted = rows.withColumn("__part", F.pmod(spread, F.get(parts, F.col(shard))).cast("int"))
    counts = parted.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    numbered = parted.withColumn("__k", F.row_number().over(W.partitionBy(shard, "__part").orderBy(*order)))
    joined = numbered.join(F.broadcast(firsts), [shard, "__part"])
    return joined.withColumn(out, (F.col("__first") + F.col("__k") - 1).cast("bigint")).drop("__part", "__k", "__first")


def assign(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law has none)."""
    body = blank_null(text)
    rows = materialize(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            (F.octet_length(body) + 8).cast("bigint").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
            F.substring(F.sha2(body, 256), 1, 32).alias("digest"),
        ),
        "shard-rows",
    )
    _, alone, cuts = minimax(rows, shards)
    shard = sum(((F.col("digest") >= cut).cast("int") for cut in cuts), F.lit(len(alone)))
    for k, digest in enumerate(alone):
        shard = F.when(F.col("digest") == digest, k).otherwise(shard)
    placed = slots(rows.withColumn("shard", shard), "shard", shards, F.xxhash64("doc_id", "digest"), [F.col("doc_id"), F.col("digest")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
