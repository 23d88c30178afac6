"""Best-fit packing of documents into sequences: pattern packing by non-negative least squares.

A plan is made from the histogram of piece lengths alone (as many bins as a sequence has tokens, whatever the corpus): patterns
of at most three documents that fill a sequence are enumerated over coarse lengths, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what remains is packed best-fit, longest first, into the
room left. The plan says which ranks of each length go to which sequences. The rows then find their places by joining
with it: pieces are ranked within their length, in parts so that no length gathers in one task. Places are looked up by length and block
of ranks. What is broadcast is bounded by the plan: at most one place for each coarse pattern's lengths and each step of best fit, and
LOOKUPS more for each length; first ranks number one for each length and each PART_ROWS pieces.

Defined results: a null text counts as empty, and an empty document is its end token alone. Only documents longer than
a sequence are cut, into full pieces and a last one that may be shorter. Repeated rows are packed each for itself; a null
doc_id is packed as any other. An empty table gives no rows. Extra columns are ignored by `pack` and by `pack_rows`.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from vitrail.llm.bpe import CODECS, map_texts, shown
from vitrail.llm.common import materialize

#: Coarse lengths of a full sequence, from which patterns are made.
UNITS = 160
#: Chunks in one worker's table of ids; at the bound it is emptied and fills anew.
CACHE_CHUNKS = 600_000
LONG_CHUNK = 64
#: Pieces of one length that are ranked together, about: a more frequent length is ranked in more parts.
PART_ROWS = 100_000
#: Blocks of ranks into which a length's pieces are cut to look up their places.
LOOKUPS = 32
#: A chunk that the vocabulary's pattern cuts into letters and then punctuation, whatever the Unicode version.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!#-&(-/:-@\[-`{-~]*)")


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


class WordCodec:
    """A tokenizer that drops white space, in one worker, with the ids of the chunks between blanks it has met.

    No token crosses white space, so a text's ids are its chunks' ids in a row.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        pieces = [x.get("pattern", {}).get("Regex", "") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # the short way below is right for a vocabulary that lower-cases and cuts at letters; others take the long one
        self.plain = any(r"[\p{L}]+" in x for x in pieces) and "Lowercase" in json.dumps(told["normalizer"])
        self.model = self.tokenizer.model
        self.met: dict[bytes, bytes] = {}
        CODECS.add(self)

    def _chunk(self, raw: bytes) -> bytes:
        chunk = raw.decode()
        if self.plain and (found := PLAIN.fullmatch(chunk)):
            ids = [t.id for part in found.groups() if part for t in self.model.tokenize(shown(part.lower().encode()))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        if len(raw) <= LONG_CHUNK:
            if len(self.met) >= CACHE_CHUNKS:
                self.met.clear()
            self.met[raw] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        met, chunk = self.met.get, self._chunk
        return b"".join([x if (x := met(c)) is not None else chunk(c) for c in text.encode().split()])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600, close: float = 1e-4) -> np.ndarray:
    """The x >= 0 for which |a x - b| is smallest, by growing a set of positive entries (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = close * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= tolerance:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            gram = own.T @ own
            trial = np.linalg.solve(gram + 1e-9 * np.trace(gram) / len(at) * np.eye(len(at)), own.T @ b)
            if (trial > 0).all():
                x = np.zeros(n)
                x[at] = trial
                break
            low = at[trial <= 0]
            step = np.min(x[low] / np.maximum(x[low] - trial[trial <= 0], 1e-300))
            x[at] += step * (trial - x[at])
            passive &= x > 1e-12
            x[~passive] = 0
    return x


def patterns_of(units: int = UNITS) -> list[tuple[int, ...]]:
    """Every way to fill a sequence with one, two or three coarse lengths, longest first."""
    two = [(units - k, k) for k in range(1, units // 2 + 1)]
    three = [(units - j - k, j, k) for k in range(1, units // 3 + 1) for j in range(k, (units - k) // 2 + 1)]
    return [(units,), *two, *three]


class Plan:
    """Sequences to be made: kinds of sequences, each a list of lengths and how often it is made."""

    def __init__(self, size: int):
        self.size = size
        self.kinds: list[tuple[list[int], int]] = []

    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, count, first sequence, offset): these ranks go to consecutive sequences."""
        used: dict[int, int] = {}
        out, sequence = [], 0
        for lengths, n in self.kinds:
            offset = 0
            for length in lengths:
                out.append((length, used.get(length, 0), n, sequence, offset))
                used[length] = used.get(length, 0) + n
                offset += length
            sequence += n
        return out


def _draw(left: np.ndarray, low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Take n pieces with lengths in (low, high], longest first: (length, count)."""
    out = []
    for length in range(high, low, -1):
        if n and left[length]:
            k = int(min(n, left[length]))
            left[length] -= k
            n -= k
            out.append((length, k))
    return out


def make_plan(histogram: dict[int, int], size: int, units: int = UNITS) -> Plan:
    """Pack pieces of the given lengths (length: count; 1 to size) into sequences of `size` tokens."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan, kinds = Plan(size), []
    units = min(units, size)
    unit = np.maximum(1, -(-np.arange(size + 1) * units // size))  # coarse length of each length, rounded up
    coarse = np.bincount(unit[1:], left[1:], units + 1)[1:]
    patterns = [p for p in patterns_of(units) if all(coarse[u - 1] for u in p)]
    if patterns:
        # weights by the root of the counts: bins with few pieces matter as well
        scale = 1 / np.sqrt(np.maximum(coarse, 1))
        a = np.zeros((units, len(patterns)))
        for k, p in enumerate(patterns):
            for u in p:
                a[u - 1, k] += 1
        repeats = nnls(a * scale[:, None], coarse * scale)
        edges = [0, *(int(np.flatnonzero(unit[1:] == u).max()) + 1 if (unit[1:] == u).any() else 0 for u in range(1, units + 1))]
        for k in np.argsort(-repeats, kind="stable"):
            n = int(repeats[k] + 1e-6)
            for u in set(patterns[k]):  # rounding may ask for more than there is
                n = min(n, int(left[edges[u - 1] + 1 : edges[u] + 1].sum()) // patterns[k].count(u))
            if n <= 0:
                continue
            drawn = [_draw(left, edges[u - 1], edges[u], n) for u in patterns[k]]
            while n:  # sequences of equal lengths are one kind
                take = min(d[0][1] for d in drawn)
                kinds.append(([d[0][0] for d in drawn], take))
                drawn = [[(d[0][0], d[0][1] - take), *d[1:]] if d[0][1] > take else d[1:] for d in drawn]
                n -= take
    _best_fit(left, kinds, size)
    plan.kinds = kinds
    return plan


def _best_fit(left: np.ndarray, kinds: list[tuple[list[int], int]], size: int) -> None:
    """Pack what is left, longest first, each into the fullest sequence that has room; equal cases go together."""
    rooms: dict[int, list[int]] = {}
    for k, (lengths, _) in enumerate(kinds):
        rooms.setdefault(size - sum(lengths), []).append(k)
    order = sorted(r for r in rooms if r)

    def add(k: int) -> None:
        room = size - sum(kinds[k][0])
        if room not in rooms:
            rooms[room] = []
        if room and not rooms[room]:
            at = bisect_left(order, room)
            if at == len(order) or order[at] != room:
                order.insert(at, room)
        rooms[room].append(k)

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                fits = size // length
                if n >= fits:
                    kinds.append(([length] * fits, n // fits))
                    n -= n // fits * fits
                else:
                    kinds.append(([length] * n, 1))
                    n = 0
                add(len(kinds) - 1)
                continue
            room = order[at]
            k = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            lengths, count = kinds[k]
            take = min(n, count)
            if take < count:
                kinds[k] = (lengths, count - take)
                rooms[room].append(k)
                if not rooms[room][1:]:
                    order.insert(bisect_left(order, room), room)
                kinds.append(([*lengths, length], take))
                add(len(kinds) - 1)
            else:
                kinds[k] = ([*lengths, length], count)
                add(k)
            n -= take
        left[length] = 0


def _lookups(plan: Plan, step: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """A plan's places, one row for each block of ranks that a place has a share in: (length, block, low, n, sequence, offset)."""
    return [(length, block, low, n, sequence, offset) for length, low, n, sequence, offset in plan.places() for block in range(low // step[length], (low + n - 1) // step[length] + 1)]


def tokenized(docs: DataFrame, path: str, size: int, end: int, doc_id: str, text: str, keep_ids: bool) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (packed)."""

    def make() -> Callable[[list[str]], dict]:
        own, tail = word_codec(path), np.array([end], "<u4").tobytes()

        def work(texts: list[str]) -> dict:
            rows = []
            for t in texts:
                ids = own.encode(t) + tail
                rows.append([{"length": len(p) // 4, "crc": zlib.crc32(p)} | ({"ids": p} if keep_ids else {}) for p in (ids[k : k + 4 * size] for k in range(0, len(ids), 4 * size))])
            fields = [("length", pa.int32()), ("crc", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])]
            return {"pieces": pa.array(rows, pa.list_(pa.struct(fields)))}

        return work

    kind = "array<struct<length:int,crc:bigint" + (",ids:binary" if keep_ids else "") + ">>"
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cut = map_texts(own, "text", make, {"pieces": kind}).select("doc_id", F.posexplode("pieces").alias("piece", "p"))
    made = cut.select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(size).cast("bigint")).alias("start"),
        F.col("p.length").cast("bigint").alias("length"),
        F.col("p.crc").alias("ids_crc32"),
        *([F.col("p.ids").alias("ids")] if keep_ids else []),
    )
    return made


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids also its packed ids."""
    pieces = materialize(tokenized(docs, path, size, end, doc_id, text, keep_ids), "pack-pieces")
    counted = pieces.groupBy("length").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counted.collect()}  # a row for each length, `size` at most
    plan = make_plan(total, size)
    spark = docs.sparkSession
    # a length's pieces are ranked in parts, a part's first rank is the count of those before it
    steps = [(length, -(-n // PART_ROWS), -(-n // LOOKUPS)) for length, n in total.items()]
    known = F.broadcast(spark.createDataFrame(steps, "length bigint, parts int, step bigint"))
    parted = pieces.join(known, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int"))
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("k", F.row_number().over(order)).join(F.broadcast(first), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("k") - 1).withColumn("block", F.floor(F.col("rank") / F.col("step")))
    places = F.broadcast(spark.createDataFrame(_lookups(plan, {length: step for length, _, step in steps}), "length bigint, block bigint, low bigint, n bigint, sequence bigint, offset bigint"))
    here = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n"))
    placed = ranked.join(places, ["length", "block"]).where(here)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else [])
    )
