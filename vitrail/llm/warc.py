"""WARC archives of pages, and their capture index by external merging.

Writing: each page becomes a record in the WARC/1.1 format. Of records with equal payloads of at least `revisit_from` bytes the one with the
smallest page_id carries the payload (response), the others point to it (revisit). Records are made by DataFrame
functions and written by Spark's text sink: two line ends close a record, so they are the sink's separator. Files are rolled by
bytes: records are written class by class of their size, with as many to a file as keep it below FILE_BYTES. Digests that several
records share are broadcast, in slices where there are many, so that no payload moves.

Reading: archives are read as whole files and cut by Content-Length. The files of a task give one run: their captures sorted by URL key
and timestamp, kept as blocks of BLOCK captures. Splitters, drawn from a sample of the blocks' first captures, divide the order into ranges
(by key, timestamp, id and place, so that one host or URL may hold any share of the captures), and blocks are cut at them. In each range
the blocks come in the order of their first captures, and a loser tree merges the runs from them: a block is taken in when the merge
reaches its first capture and dropped when it is used up, so that one block of each run is held at most. The ranges one after another are
the globally ordered capture histories.

Defined results: a null payload counts as empty; a null or empty URL has an empty key and sorts first; control characters in a
URL are percent-encoded; a null page_id is written as null, is always a response and is never referred to. Rows that
repeat a page_id with the same payload are each written, as responses if that id is the smallest. Payloads of any length that a
row can hold are written and read whole. An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.llm.common import broadcast_in_slices, materialize
from vitrail.session import interim, remove, shared_path

END = "\r\n"
CLOSE = END + END
#: Bytes and records of one archive file, at most (a longer record is a file of its own); a file is read whole by one task.
FILE_BYTES = 64 << 20
FILE_RECORDS = 2_000
#: Sizes of payloads, a record's other lines left out, up to which records are written together.
CLASSES = (FILE_BYTES // FILE_RECORDS, FILE_BYTES // 64, FILE_BYTES // 4, 1 << 31)
#: Captures of one block of a run, and blocks of one Arrow batch.
BLOCK = 1_000
ARROW_BLOCKS = 16
#: Captures merged by one task, about, and first captures of blocks that splitters are drawn from, for each range.
RANGE_ROWS = 250_000
SAMPLES = 20
REVISIT_FROM = 100
#: Digests of shared payloads that are broadcast at once.
BROADCAST_DIGESTS = 1_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:vitrail:page:"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _rows(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).alias("url"), body.alias("body"), F.octet_length(body).alias("bytes"), F.sha2(body, 256).alias("digest"))


def shared_digests(keys: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Digests (binary) of payloads that several records share, with the smallest page_id: digest, first. keys: id, bytes, digest."""
    long = keys.where((F.col("bytes") >= revisit_from) & F.col("id").isNotNull())
    groups = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return groups.select(F.unhex("digest").alias("key"), "first")


def records(own: DataFrame, shared: DataFrame, first_date: str = "2024-01-01 00:00:00", revisit_from: int = REVISIT_FROM, most_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Each page's WARC record as text, without the line ends that close it. own: id, url, body, bytes, digest; shared: of `shared_digests`.

    A capture's date is `first_date` plus page_id seconds: the table has no dates of its own.
    """
    keyed = own.withColumn("key", F.when(F.col("bytes") >= revisit_from, F.unhex("digest")))
    marked = broadcast_in_slices(keyed, shared, "key", most_digests).withColumn("again", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace(F.col("url"), "[\r\n]", "%0A"), r"[\x00-\x20\x7F]", "%20")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(first_date).cast("timestamp")) + F.coalesce(F.col("id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(CLOSE))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("body")))
    return marked.withColumn("block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{END}WARC-Type: "),
            F.when(F.col("again"), "revisit").otherwise("response"),
            F.lit(END),
            _header("WARC-Record-ID", name(F.col("id"))),
            _header("WARC-Date", date),
            _header("WARC-Target-URI", F.when(safe != "", safe)),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            _header("WARC-Refers-To", F.when(F.col("again"), name(F.col("first")))),
            _header("WARC-Profile", F.when(F.col("again"), _PROFILE)),
            _header("Content-Type", F.lit("application/http; msgtype=response")),
            _header("Content-Length", F.octet_length("block").cast("string")),
            F.lit(END),
            F.col("block"),
        ).alias("value")
    )


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = REVISIT_FROM,
    file_records: int = FILE_RECORDS, classes: tuple[int, ...] = CLASSES, **how,
) -> None:
    """Write the pages' records as archive files below `path`."""
    own = _rows(pages, page_id, url, payload)
    with interim(pages.sparkSession):
        keys = materialize(own.select("id", "bytes", "digest"), "warc-digests")
        shared = materialize(shared_digests(keys, revisit_from), "warc-shared")
        kind = sum(((F.col("bytes") > most).cast("int") for most in classes[:-1]), F.lit(0))
        for k in sorted(r[0] for r in keys.groupBy(kind.alias("kind")).count().collect()) or [0]:  # a row for each class
            most = max(1, min(file_records, FILE_BYTES // classes[k]))
            made = records(own.where(kind == k), shared, revisit_from=revisit_from, **how)
            made.write.mode("append").option("lineSep", CLOSE).option("maxRecordsPerFile", most).text(path)


def cut(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of an archive file: first byte, length up to the closing line ends, headers, block."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        if not content.startswith(b"WARC/", at) or head < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:head].decode("utf-8").split(END)[1:]
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(headers["content-length"])
        block = content[head + 4 : head + 4 + size]
        end = head + 4 + size
        if len(block) != size or content[end : end + 4] != CLOSE.encode():
            raise ValueError(f"the record at byte {at} is cut off")
        yield at, end - at, headers, block
        at = end + 4


def url_key(url: str) -> str:
    """A key that sorts captures of a host, and of its subdomains, together: reversed host, then path and query."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.split("#", 1)[0].strip())
    host, slash, path = re.fullmatch(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host = re.sub(r":(80|443)$", "", host.rsplit("@", 1)[-1]).lower()
    name, _, port = host.partition(":")
    turned = ",".join(reversed(name.split("."))) + (f":{port}" if port else "")
    return f"{turned})/{path}" if turned or path else ""


FIELDS = {
    "url_key": "string", "captured": "string", "page_id": "bigint", "record_type": "string", "payload_bytes": "bigint",
    "payload_digest": "string", "refers_to": "bigint", "url": "string", "file": "string", "first_byte": "bigint", "record_bytes": "bigint",
}
_KINDS = {"string": pa.string(), "bigint": pa.int64()}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def _page(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def captures(file: str, content: bytes) -> list[tuple]:
    """The captures of one archive file, sorted: one run of the index. Payload digests are verified."""
    out = []
    for at, size, headers, block in cut(content):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = headers["warc-payload-digest"].removeprefix("sha256:")
        length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        kind = headers["warc-type"]
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != told or len(payload) != length):
            raise ValueError(f"{file}, byte {at}: the payload is not what its digest says")
        url = headers.get("warc-target-uri")
        out.append((url_key(url or ""), headers["warc-date"], _page(headers["warc-record-id"]), kind, length, told, _page(headers.get("warc-refers-to")), url, file, at, size))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    """Order of captures: key, timestamp, page_id (nulls first), place."""
    return (row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[8], row[9])


class LoserTree:
    """Merge sorted iterators: the inner nodes hold the losers, so that each step plays one path to the root."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.top = self._build()

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _build(self) -> int:
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return winners[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.top] is not None:
            yield self.heads[self.top][2]
            at = self.top
            self.heads[at] = self._next(at)
            node = (at + self.k) // 2
            while node >= 1:
                if self._less(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.top = at


class BlockMerge:
    """Merge sorted runs that come as blocks in the order of their first rows: one block of each run is held at most."""

    def __init__(self, key: Callable):
        self.key, self.open = key, {}
        self.held = 0

    def take(self, run: str, rows: list[tuple]) -> Iterator[tuple]:
        """Rows that come before the new block's first one; then the block is taken in."""
        first = self.key(rows[0])
        yield from self._until(first)
        self.open[run] = rows[::-1]  # the block before it is used up: its rows come before this one's
        self.held = max(self.held, len(self.open))

    def rest(self) -> Iterator[tuple]:
        yield from self._until(None)

    def _until(self, limit: tuple | None) -> Iterator[tuple]:
        def head(rows: list[tuple]) -> Iterator[tuple]:
            while rows and (limit is None or self.key(rows[-1]) < limit):
                yield rows.pop()

        yield from LoserTree([head(rows) for rows in self.open.values()], self.key)
        self.open = {run: rows for run, rows in self.open.items() if rows}


def _batch(rows: list[tuple], names: dict[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, names.values())], names=list(names))


_CAPTURE = f"struct<{', '.join(f'{k}: {v}' for k, v in FIELDS.items())}>"
_BLOCKS = f"run string, rows array<{_CAPTURE}>"


def _blocks(run: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A sorted run as rows of BLOCK captures each."""
    kind = pa.list_(pa.struct([(k, _KINDS[v]) for k, v in FIELDS.items()]))
    for k in range(0, len(rows), BLOCK):
        own = [dict(zip(FIELDS, r)) for r in rows[k : k + BLOCK]]
        yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([own], kind)], names=["run", "rows"])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted runs of the archive files below `path`, one for the files of a task, as blocks: run, rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, name = [], None
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                file = file.as_py().rsplit("/", 1)[-1]
                name = name or file
                rows += captures(file, content.as_py())
        yield from _blocks(name, sorted(rows, key=_order))

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # a row is a whole file
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        return materialize(files.select("path", "content").mapInArrow(parse, _BLOCKS), "warc-runs")
    finally:
        spark.conf.set(key, before)


def _rows_of(block: pa.StructScalar | pa.ListScalar) -> list[tuple]:
    return [tuple(r.values()) for r in block.as_py()]


def splitters(index_runs: DataFrame, ranges: int) -> list[tuple]:
    """Captures (as their order) that cut the whole order into about equal ranges, from a sample of the blocks' first captures."""
    first = index_runs.select(F.get("rows", F.lit(0)).alias("c")).orderBy(F.xxhash64("c")).limit(ranges * SAMPLES)  # SAMPLES for each range at most
    seen = sorted(_order(tuple(r.c)) for r in first.collect())
    return sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if len(seen) >= ranges else []


def merge(index_runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one order by URL key, timestamp and page_id: partition after partition, each merged from runs."""
    spark = index_runs.sparkSession
    total = index_runs.agg(F.sum(F.size("rows"))).first()[0] or 0
    ranges = max(1, -(-total // range_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK))))
    cuts = splitters(index_runs, ranges)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _rows_of(block)
                orders = [_order(r) for r in rows]
                ends = [0, *(bisect_left(orders, c) for c in cuts), len(rows)]
                for k, (a, b) in enumerate(zip(ends, ends[1:])):
                    for made in _blocks(run, rows[a:b]):
                        yield made.append_column("part", pa.array([k], pa.int32()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, ready = BlockMerge(_order), []
        for batch in batches:
            for run, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                ready += merged.take(run, _rows_of(block))
                while len(ready) >= 10_000:
                    yield _batch(ready[:10_000], FIELDS)
                    ready = ready[10_000:]
        yield _batch([*ready, *merged.rest()], FIELDS)

    first = F.get("rows", F.lit(0))
    order = [first["url_key"], first["captured"], first["page_id"].isNotNull(), first["page_id"], first["file"], first["first_byte"]]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_BLOCKS:
        spark.conf.set(key, str(ARROW_BLOCKS))
    dealt = index_runs.mapInArrow(divide, f"{_BLOCKS}, part int").repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order)
    return dealt.select("run", "rows").mapInArrow(join, SCHEMA)


def archive(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the pages' archives, read them back and merge their indexes: the captures in order, columns of FIELDS.

    Archives without a path of their own are removed when their runs are written.
    """
    spark = pages.sparkSession
    at = path or shared_path(spark, "warc")
    write(pages, at, **how)
    index = runs(spark, at)
    if not path:
        remove(spark, at)
    return merge(index)
