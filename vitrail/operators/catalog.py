"""The icon catalogue: identity, blocked fuzzy matching, group assignment, names, traces, upserts.

Tables are DataFrames: groups(id, background, canonical_hash), bitmaps(hash, group_id, background, width, height, dx, dy, match_kind,
...), traces(group_id, algorithm, status, hints, generated_hash), names(hash, name), source_images(hash, image).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.session import materialize, ship

#: What a match may differ by.
FOREGROUND = 40
LEAST_OVERLAP = 0.97
MEAN_ERROR = 3.0
P95_ERROR = 12.0
SAMPLE_ERROR = 13


def insert_ignore(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows and those new ones whose key is not known; of new rows with one key the first by the other columns (nulls first)."""
    row = F.struct(*(F.col(c) for c in new.columns if c not in keys))
    one = new.groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, "_r.*") if len(new.columns) > len(keys) else new.distinct()
    return known.unionByName(one.join(known.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(known: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by `seq`; new rows go before known ones of the same seq."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    last = F.max_by(F.struct(*rest), F.struct(seq, "_new")).alias("_r")
    return both.groupBy(*keys).agg(last).select(*keys, "_r.*")


def evolve(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """A table of an earlier layout with the columns it lacks: name -> (type, default); nulls take the default as well."""
    for name, (kind, value) in defaults.items():
        given = F.lit(value).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), given) if name in df.columns else given)
    return df


#: Columns that the bitmap table gained, with their defaults.
BITMAP_DEFAULTS = {"match_kind": ("string", "unrecorded"), "fingerprint": ("binary", None), "sample": ("binary", None)}


def values_of_groups(names: DataFrame, bitmaps: DataFrame, value: str) -> DataFrame:
    """Sorted distinct names (or source images) of each group."""
    return names.join(bitmaps.select("hash", "group_id"), "hash").groupBy("group_id").agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def traces_of(traces: DataFrame, groups: DataFrame, algorithm: str, background: Column) -> DataFrame:
    """Vector traces by one algorithm in groups on a background."""
    wanted = groups.where(F.col("background") == background).select(F.col("id").alias("group_id"))
    return traces.where((F.col("algorithm") == algorithm) & (F.col("status") == "vector")).join(wanted, "group_id", "left_semi")


def edited(traces: DataFrame, files: DataFrame) -> DataFrame:
    """Stored drawings against the digests of what was generated: group_id, algorithm, state (kept, edited, missing)."""
    joined = traces.where("status = 'vector'").join(files.select("group_id", "algorithm", F.sha2("svg", 256).alias("now")), ["group_id", "algorithm"], "left")
    state = F.when(F.col("now").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("generated_hash")), "edited").otherwise("kept")
    return joined.select("group_id", "algorithm", state.alias("state"))


def stale_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """Groups whose summary (columns group_id, digest) is new or changed."""
    return after.join(before, ["group_id", "digest"], "left_anti").select("group_id")


def fingerprint_limit(qw: Column, qh: Column, kw: Column, kh: Column) -> Column:
    """How far the mean values of two pictures that match can be apart, given that a shift and a difference in size each hide borders."""
    wide = lambda a, b: F.greatest(F.lit(0), a - b)
    q = (1 + wide(qw, kw)) / qw + (1 + wide(qh, kh)) / qh
    k = (1 + wide(kw, qw)) / kw + (1 + wide(kh, qh)) / kh
    return 10 + 255 * (q + k)


def block_candidates(icons: DataFrame) -> DataFrame:
    """Pairs (a, b; a before b) on one background whose sizes differ by a pixel at most and whose means can match.

    The bands of both sizes are exploded on one side, so this is an equi-join. icons: id, bg, width, height, mean.
    """
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = icons.select(F.col("id").alias("a"), "bg", F.col("width").alias("aw"), F.col("height").alias("ah"), F.col("mean").alias("am"))
    left = left.withColumn("width", F.explode(F.transform(near, lambda d: F.col("aw") + d))).withColumn("height", F.explode(F.transform(near, lambda d: F.col("ah") + d)))
    right = icons.select(F.col("id").alias("b"), "bg", "width", "height", F.col("mean").alias("bm"))
    pairs = left.join(right, ["bg", "width", "height"]).where("a < b")
    return pairs.where(F.abs(F.col("am") - F.col("bm")) <= fingerprint_limit(F.col("aw"), F.col("ah"), F.col("width"), F.col("height"))).select("a", "b", "bg")


def _windows(q: tuple[int, int], k: tuple[int, int]):
    """Shifts by up to a pixel, rows first, with both windows, where no more than a row and a column is lost."""
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            h = min(q[0] - max(0, dy), k[0] - max(0, -dy))
            w = min(q[1] - max(0, dx), k[1] - max(0, -dx))
            if h >= min(q[0], k[0]) - 1 and w >= min(q[1], k[1]) - 1:
                yield dy, dx, (slice(max(0, dy), max(0, dy) + h), slice(max(0, dx), max(0, dx) + w)), (slice(max(0, -dy), max(0, -dy) + h), slice(max(0, -dx), max(0, -dx) + w))


def flatten(rgba: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Colours composited on a background; pictures without alpha as they are."""
    if rgba.shape[-1] < 4:
        return rgba.astype(np.float32)
    alpha = rgba[..., 3:].astype(np.float32) / 255
    return rgba[..., :3] * alpha + np.asarray(background, np.float32) * (1 - alpha)


def sample_may_match(query: np.ndarray, known: np.ndarray) -> bool:
    """Whether every second pixel of a known picture leaves a match possible at some shift."""
    for dy, dx, a, b in _windows(query.shape[:2], known.shape[:2]):
        rows = np.arange(b[0].start + b[0].start % 2, b[0].stop, 2)
        cols = np.arange(b[1].start + b[1].start % 2, b[1].stop, 2)
        if not len(rows) or not len(cols):
            continue
        error = np.abs(query[np.ix_(rows + dy, cols + dx)] - known[np.ix_(rows, cols)]).mean(axis=2)
        if np.count_nonzero(error > SAMPLE_ERROR) <= 0.05 * error.size * 4 + 2:
            return True
    return False


def match(query: np.ndarray, known: np.ndarray, background: np.ndarray) -> tuple[float, int, float, float] | None:
    """The best shift of two flattened pictures: (mean error, steps, dx, dy), or nothing.

    All nine shifts by up to a pixel are one array: the query with a missing margin, seen through windows of the known picture's size.
    """
    (h, w), (kh, kw) = query.shape[:2], known.shape[:2]
    if max(abs(h - kh), abs(w - kw)) > 1 or h * w < 9:
        return None
    margin = np.pad(query.astype(float), ((1, 3), (1, 3), (0, 0)), constant_values=np.nan)
    seen = np.lib.stride_tricks.sliding_window_view(margin, (kh, kw), axis=(0, 1))[:3, :3].transpose(0, 1, 3, 4, 2)
    there = ~np.isnan(seen[..., 0])
    sizes = there.any(axis=3).sum(axis=2), there.any(axis=2).sum(axis=2)
    error = np.abs(seen - known).mean(axis=-1)
    ink = np.linalg.norm(seen - background, axis=-1) > FOREGROUND, there & (np.linalg.norm(known - background, axis=-1) > FOREGROUND)
    overlap = (ink[0] & ink[1]).sum(axis=(2, 3)) / np.maximum(1, (ink[0] | ink[1]).sum(axis=(2, 3)))
    mean, tail = np.nanmean(error, axis=(2, 3)), np.nanpercentile(error, 95, axis=(2, 3))
    good = (sizes[0] >= min(h, kh) - 1) & (sizes[1] >= min(w, kw) - 1) & (overlap >= LEAST_OVERLAP) & (mean <= MEAN_ERROR) & (tail <= P95_ERROR)
    found = [(float(mean[y, x]), abs(y - 1) + abs(x - 1), x - 1.0, y - 1.0) for y, x in np.argwhere(good).tolist()]
    return min(found, key=lambda m: m[:2], default=None)


def _measured(icons: DataFrame) -> DataFrame:
    """One row for each distinct picture (the first by seq), with the means of its channels on its background: adds mr, mg, mb."""
    first = F.min_by(F.struct(*(c for c in icons.columns if c != "hash")), "seq").alias("i")
    once = icons.groupBy("hash").agg(first).select("hash", "i.*").select("seq", "hash", "background", "width", "height", "channels", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 7)))
            means = np.array([_flat(*r).mean(axis=(0, 1)) for r in rows], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(means[:, k]) for k in range(3))], names=[*batch.schema.names, "mr", "mg", "mb"])

    kinds = ", ".join(f"{n} {t}" for n, t in once.dtypes)
    ship(icons.sparkSession)
    return once.mapInArrow(run, f"{kinds}, mr double, mg double, mb double")


def _flat(background: str, width: int, height: int, channels: int, pixels: bytes) -> np.ndarray:
    return flatten(np.frombuffer(pixels, np.uint8).reshape(height, width, channels), np.array(list(bytes.fromhex(background[1:])), np.float32))


#: Pictures of a chunk: so many at most, and of so many pixels together.
CHUNK = 2048, 1 << 21
#: Parts of a hot background while its pictures learn their chunks.
SALTS = 32


def _dealt(once: DataFrame) -> DataFrame:
    """Pictures in groups (background, wide, high, cell, q, k) so that two that can match meet in one: one of them as `late`, one not.

    An equi-join on background, size and a band of the mean, as wide as the means of a matching pair can be apart at that size; sizes differ by a
    pixel at most. A key's pictures are cut into chunks by their digests, and each chunk of late ones meets each of the others, so no background gathers in a task.
    """
    band = lambda w, h: 10 + 765 * (1 / F.greatest(w - 1, F.lit(1)) + 1 / F.greatest(h - 1, F.lit(1)))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    mean = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    own = once.withColumn("m", mean).drop("mr", "mg", "mb")
    cell = F.floor(F.col("m") / band(F.col("wide"), F.col("high")))
    late = own.withColumn("wide", F.col("width")).withColumn("high", F.col("height")).withColumn("cell", cell)
    early = own.withColumn("wide", F.explode(F.transform(near, lambda d: F.col("width") + d))).withColumn("high", F.explode(F.transform(near, lambda d: F.col("height") + d)))
    early = early.withColumn("cell", F.explode(F.transform(near, lambda d: cell + d)))
    key = ["background", "wide", "high", "cell"]
    room = F.greatest(F.lit(64), F.least(F.lit(CHUNK[0]), F.floor(F.lit(CHUNK[1]) / F.greatest(F.col("wide") * F.col("high"), F.lit(1)))))
    chunks = lambda side, name: side.groupBy(key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / room).alias(name))
    parts = chunks(late, "qs").join(chunks(early, "ks"), key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def met(side: DataFrame, is_late: bool) -> DataFrame:
        q, k = ("qs", "ks") if is_late else ("ks", "qs")
        one = side.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")).join(parts, [*key, "salt"])
        one = one.withColumn("i", F.pmod(F.xxhash64("hash", F.lit(1)), F.col(q))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1)))
        return one.select(*key, *(F.col(c).alias(n) for c, n in zip("ij" if is_late else "ji", "qk")), F.lit(is_late).alias("late"), "seq", "hash", "width", "height", "channels", "pixels")

    return met(late, True).unionByName(met(early, False))


def near_pairs(query: np.ndarray, known: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pictures of one size each, the pairs that `match` can accept: places in `query` and `known`, and a lower bound of the mean error; by query, then bound.

    before: whether a known picture (column) comes before a query (row). At a shift, the means of channels (sums of them in an even grid of at most 8 x 8 blocks, on
    what lies within both pictures at any shift) differ by no more in total than the whole error: first their squares, as a product of matrices, then their sums.
    """
    (n, h, w), (m, kh, kw) = query.shape[:3], known.shape[:3]
    rows, cols = min(h, kh) - 2, min(w, kw) - 2
    if rows < 1 or cols < 1:
        i, j = np.nonzero(before)
        return i, j, np.zeros(len(i))
    cuts = [np.linspace(0, size, min(size, 8) + 1).astype(int) for size in (rows, cols)]
    most = 255 * float(np.diff(cuts[0]).max() * np.diff(cuts[1]).max())

    def sums(grey: np.ndarray, dy: int, dx: int) -> np.ndarray:
        inner = grey[:, 1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + cols]
        return np.add.reduceat(np.add.reduceat(inner, cuts[0][:-1], axis=1), cuts[1][:-1], axis=2).reshape(len(grey), -1)

    grey_q, grey_k = query.mean(axis=3), known.mean(axis=3)
    k = sums(grey_k, 0, 0)
    centre = k.mean(axis=0)
    k -= centre
    kk = (k * k).sum(axis=1)
    found = []
    for dy, dx, a, _ in _windows((h, w), (kh, kw)):
        pixels = (a[0].stop - a[0].start) * (a[1].stop - a[1].start)
        total = MEAN_ERROR * pixels * 1.001
        q = sums(grey_q, dy, dx) - centre
        qq = (q * q).sum(axis=1)
        limit = min(total, most) * total + 1e-4 * float(qq.max() + kk.max())
        for at in range(0, n, 256):
            part = q[at : at + 256]
            i, j = np.nonzero((qq[at : at + 256, None] + kk - 2 * (part @ k.T) <= limit) & before[at : at + 256])
            for some in range(0, len(i), 1 << 16):
                x, y = i[some : some + (1 << 16)], j[some : some + (1 << 16)]
                apart = np.abs(part[x] - k[y]).sum(axis=1, dtype=float)
                good = apart <= total + 1e-5 * most * len(centre)
                found.append((x[good] + at, y[good], apart[good] / pixels))
    i, j, low = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 3
    by = np.lexsort((low, j, i))
    i, j, low = i[by], j[by], low[by]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, low = i[first], j[first], low[first]
    by = np.lexsort((low, i))
    return i[by], j[by], low[by]


def _stacks(rows: pa.Table, background: np.ndarray) -> list[tuple[list[tuple], np.ndarray]]:
    """Flattened pictures of one size and number of channels each, with what orders them: whether there is a seq, seq, hash."""
    sizes: dict[tuple[int, int, int], list[int]] = {}
    for k, size in enumerate(zip(*(rows.column(c).to_pylist() for c in ("height", "width", "channels")))):
        sizes.setdefault(size, []).append(k)
    names = [(s is not None, s, h) for s, h in zip(rows.column("seq").to_pylist(), rows.column("hash").to_pylist())]
    raw = rows.column("pixels").to_pylist()
    return [([names[k] for k in ks], flatten(np.frombuffer(b"".join(raw[k] for k in ks), np.uint8).reshape(len(ks), *size), background)) for size, ks in sizes.items()]


def _best_of(rows: pa.Table) -> pa.Table:
    """The best match of each late picture of a group among the others that come before it: hash, error, steps, up, dx, dy."""
    background = np.array(list(bytes.fromhex(rows.column("background")[0].as_py()[1:])), np.float32)
    late = rows.column("late").combine_chunks()
    best: dict[str, tuple] = {}
    known = _stacks(rows.filter(pc.invert(late)), background)
    for names, pictures in _stacks(rows.filter(late), background):
        for others, shown in known:
            place = {name: k for k, name in enumerate(sorted({*names, *others}))}
            before = np.array([place[o] for o in others]) < np.array([place[name] for name in names])[:, None]
            for i, j, low in zip(*(c.tolist() for c in near_pairs(pictures, shown, before))):
                to = names[i][2]
                if to in best and low > best[to][0] + 1e-3:
                    continue
                if sample_may_match(pictures[i], shown[j]) and (found := match(pictures[i], shown[j], background)):
                    one = (*found[:2], others[j][2], *found[2:])
                    best[to] = min(best.get(to, one), one)
    kinds = (pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64(), pa.float64())
    made = [(to, *one) for to, one in best.items()]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 6, kinds)], names=["hash", "error", "steps", "up", "dx", "dy"])


def _matched(once: DataFrame) -> DataFrame:
    """The best match of each picture in each group that it meets others in: hash, error, steps, up, dx, dy."""
    ship(once.sparkSession)
    return _dealt(once).groupBy("background", "wide", "high", "cell", "q", "k").applyInArrow(_best_of, "hash string, error double, steps int, up string, dx double, dy double")


def assign_groups(icons: DataFrame) -> DataFrame:
    """Group icons as they arrive: one row per distinct picture with its group, offset and how it was matched.

    In the order of `seq` a picture joins the group of the best match among all that arrived before it on its background (least error, then
    shift, then hash), offsets adding up; without one it founds a group. What it joins depends on pictures alone and not on groups, so pairs
    are matched in parallel, each picture keeps its best one, and groups are the roots of these links, found by doubling them until all
    lead to a founder. A bridge never merges two groups.

    icons: seq, hash, background ('#rrggbb'), width, height, channels, pixels (bytes in raster order). Copies are removed first.
    """
    once = materialize(_measured(icons), "icons")
    best = F.min(F.struct("error", "steps", "up", "dx", "dy")).alias("m")
    links = materialize(_matched(once).groupBy("hash").agg(best).select("hash", "m.up", "m.dx", "m.dy"), "icon-links")
    while True:
        higher = links.select(F.col("hash").alias("up"), F.col("up").alias("top"), F.col("dx").alias("ux"), F.col("dy").alias("uy"))
        further = links.join(higher, "up", "left")
        zero = F.lit(0.0)
        step = further.select("hash", F.coalesce("top", "up").alias("up"), (F.col("dx") + F.coalesce("ux", zero)).alias("dx"), (F.col("dy") + F.coalesce("uy", zero)).alias("dy"), F.col("top").isNotNull().alias("moved"))
        step = materialize(step, "icon-links")
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    joined = once.join(links, "hash", "left")
    kind = F.when(F.col("up").isNull(), "new").otherwise("bitmap")
    return joined.select("hash", F.coalesce("up", "hash").alias("group_id"), "background", "width", "height", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"), kind.alias("match_kind"))


def trace_states(groups: DataFrame, traces: DataFrame, files: DataFrame, algorithm: str) -> DataFrame:
    """What is to be done for each group's drawing by an algorithm: group_id, todo ('none', 'trace' where there is none yet, 'again' where a vector's file is lost).

    groups: id. traces: group_id, algorithm, status. files: group_id, algorithm.
    """
    own = traces.where(F.col("algorithm") == algorithm).select("group_id", "status")
    there = files.where(F.col("algorithm") == algorithm).select("group_id", F.lit(True).alias("there")).distinct()
    joined = groups.select(F.col("id").alias("group_id")).join(own, "group_id", "left").join(there, "group_id", "left")
    todo = F.when(F.col("status").isNull(), "trace").when((F.col("status") == "vector") & F.col("there").isNull(), "again").otherwise("none")
    return joined.select("group_id", todo.alias("todo"))


def eligible_artwork(nodes: DataFrame) -> DataFrame:
    """Drawings of a scene that are traced, and which of them share one trace: adds key. nodes: capture, ord, kind, leaf, opaque, approximated, w, h,
    background, pixels."""
    wanted = nodes.where(F.col("leaf") & F.col("kind").isin("raster", "capture-artwork") & ~F.col("opaque") & ~F.col("approximated") & (F.greatest("w", "h") <= 96))
    return wanted.withColumn("key", F.sha2(F.concat_ws("|", F.col("w").cast("string"), F.col("h").cast("string"), "background", F.hex("pixels")), 256))


#: The catalogue's tables and the columns that their files are parted by.
TABLES = {"groups": ["background"], "bitmaps": ["background"], "traces": ["algorithm"], "names": [], "source_images": []}


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Write the catalogue's tables below a path, parted so that a look-up on one background reads that background alone."""
    for name, by in TABLES.items():
        if name in tables:
            tables[name].write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The catalogue's tables; those never written are empty. schemas: of each table asked for."""
    out = {}
    for name, schema in schemas.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out
