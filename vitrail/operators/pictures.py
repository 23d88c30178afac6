"""Picture statistics as relational plans, and picture kernels (numpy) on Arrow batches.

A picture is an array of grey values in raster order, or rows of pixels (id, py, px, v).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrail.functions.kernels import label


def dominant(pixels: DataFrame, by: list[str], value: str = "v", step: int = 16) -> DataFrame:
    """The most frequent coarse value of each group (ties: the smaller) and the exact median of its members."""
    coarse = pixels.withColumn("coarse", F.floor(F.col(value) / step))
    counted = coarse.groupBy(*by, "coarse").agg(F.count("*").alias("n"), F.median(value).alias("median"))
    best = F.max_by(F.struct("coarse", "n", "median"), F.struct("n", -F.col("coarse")))
    return counted.groupBy(*by).agg(best.alias("b")).select(*by, "b.coarse", "b.n", "b.median")


def border(pixels: DataFrame, side: int) -> DataFrame:
    last = side - 1
    return pixels.where((F.col("py") == 0) | (F.col("py") == last) | (F.col("px") == 0) | (F.col("px") == last))


def border_background(pixels: DataFrame, side: int) -> DataFrame:
    """Background of each picture from its border: the dominant exact value if it holds max(3, 5 %), else the median."""
    edge = border(pixels, side)
    counted = edge.groupBy("id", "v").agg(F.count("*").alias("n"))
    best = counted.groupBy("id").agg(F.max_by(F.struct("v", "n"), F.struct("n", -F.col("v"))).alias("b"), F.sum("n").alias("all"))
    joined = best.join(edge.groupBy("id").agg(F.median("v").alias("median")), "id")
    repeated = F.col("b.n") >= F.greatest(F.lit(3), 0.05 * F.col("all"))
    return joined.select("id", F.when(repeated, F.col("b.v").cast("double")).otherwise(F.col("median")).alias("background"))


def ink(pixels: DataFrame, side: int) -> DataFrame:
    """The value farthest from the border's median (ties: the first in raster order), and the box of pixels over 45 away from the picture's median."""
    middle = border(pixels, side).groupBy("id").agg(F.median("v").alias("edge")).join(pixels.groupBy("id").agg(F.median("v").alias("middle")), "id")
    joined = pixels.join(middle, "id")
    far = F.abs(F.col("v") - F.col("edge"))
    away = F.abs(F.col("v") - F.col("middle")) > 45
    seen = lambda c: F.when(away, F.col(c))
    return joined.groupBy("id").agg(
        F.max_by("v", F.struct(far, -F.col("py"), -F.col("px"))).alias("ink"),
        F.min(seen("px")).alias("x"), F.min(seen("py")).alias("y"), (F.max(seen("px")) - F.min(seen("px")) + 1).alias("w"), (F.max(seen("py")) - F.min(seen("py")) + 1).alias("h"),
    )


def percentiles(pixels: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Exact linear-interpolated percentiles, mean, population deviation and spread."""
    v = F.col(value)
    return pixels.groupBy(*by).agg(
        F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.88).alias("p88"), F.percentile(v, 0.95).alias("p95"),
        F.mean(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("ptp"),
    )


def palette_assign(pixels: DataFrame, palette: list[int], value: str = "v") -> DataFrame:
    """Each pixel's nearest palette entry by squared distance (ties: the first): adds `entry`."""
    nearest = F.array_min(F.array(*(F.struct(((F.col(value) - p) * (F.col(value) - p)).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(palette))))
    return pixels.withColumn("entry", nearest["k"])


def palette_histogram(pixels: DataFrame, palette: list[int]) -> DataFrame:
    """Pixels of each palette entry in each picture, zeros included: id, entry, n."""
    counts = palette_assign(pixels, palette).groupBy("id").agg(*(F.count_if(F.col("entry") == k).alias(str(k)) for k in range(len(palette))))
    return counts.unpivot("id", [str(k) for k in range(len(palette))], "entry", "n").withColumn("entry", F.col("entry").cast("int"))


def complexity(pixels: DataFrame, above: int = 127) -> DataFrame:
    """Corners and perimeter of each picture's mask v > above: id, corners, perimeter.

    A corner lies where an odd number of the four cells around a grid point is set; two where opposite cells alone are.
    """
    own = pixels.select("id", "py", "px", (F.col("v") > above).cast("int").alias("m"))
    touched = own.where("m = 1").select("id", F.explode(F.array(*(F.struct((F.col("py") + dy).alias("gy"), (F.col("px") + dx).alias("gx"), F.lit(1 << (2 * dy + dx)).alias("bit")) for dy in (0, 1) for dx in (0, 1)))).alias("g"))
    points = touched.groupBy("id", "g.gy", "g.gx").agg(F.sum("g.bit").alias("cells"))
    n = F.bit_count("cells")
    corners = F.when(n.isin(1, 3), 1).when(F.col("cells").isin(6, 9), 2).otherwise(0)
    sides = own.where("m = 1").select("id", F.explode(F.array(*(F.struct(F.lit(v).alias("vertical"), (F.col("py") + (0 if v else d)).alias("sy"), (F.col("px") + (d if v else 0)).alias("sx")) for v in (0, 1) for d in (0, 1)))).alias("s"))
    open_sides = sides.groupBy("id", "s").count().where("count = 1").groupBy("id").agg(F.count("*").alias("perimeter"))
    return points.groupBy("id").agg(F.sum(corners).cast("bigint").alias("corners")).join(open_sides, "id")


def tile_means(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """Mean absolute difference of two pictures by square tile: id, ty, tx, error."""
    cell = [F.floor(F.col("py") / tile).alias("ty"), F.floor(F.col("px") / tile).alias("tx")]
    met = a.join(b.select("id", "py", "px", F.col("v").alias("other")), ["id", "py", "px"])
    return met.groupBy("id", *cell).agg(F.mean(F.abs(F.col("v") - F.col("other"))).alias("error"))


def digest(background: Column, width: Column, height: Column, grey: Column) -> Column:
    """A picture's identity: digest of its background, size and values."""
    return F.sha2(F.concat_ws("|", background.cast("string"), width.cast("string"), height.cast("string"), F.array_join(grey.cast("array<string>"), ",")), 256)


def fingerprint(grey: Column) -> Column:
    """The mean value, rounded half to even."""
    total = F.aggregate(grey, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.bround(total / F.size(grey).cast("double"), 0).cast("int")


def components(tiles: DataFrame, side: int, least: int = 128, eight: bool = False) -> DataFrame:
    """Connected components of v >= least: id, component (from 1, in raster order), x, y, w, h, pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, grey in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                labels = label(np.array(grey).reshape(-1, side) >= least, eight)
                for k in range(1, int(labels.max(initial=0)) + 1):
                    ys, xs = np.nonzero(labels == k)
                    out.append((i, k, xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=["id", "component", "x", "y", "w", "h", "pixels"])

    return tiles.select("id", "grey").mapInArrow(run, "id bigint, component bigint, x bigint, y bigint, w bigint, h bigint, pixels bigint")


#: Ranges of ids whose drawings are numbered apart.
RANGES = 4096


def shared_definitions(tiles: DataFrame) -> DataFrame:
    """How often each drawing occurs; repeated ones get a number by first appearance: id, uses, definition (null if drawn once)."""
    keyed = tiles.withColumn("key", digest(F.col("bg"), F.lit(8), F.lit(8), F.transform("grey", lambda v: F.floor(v / 128))))
    groups = keyed.groupBy("key").agg(F.count("*").alias("uses"), F.min("id").alias("first"))
    repeated = groups.where("uses > 1")
    # numbers follow `first`: within ranges of it, behind the counts of the ranges before
    low, high = tiles.agg(F.min("id"), F.max("id")).first()
    span = (high or 0) - (low or 0) + 1
    ranged = repeated.withColumn("range", F.floor((F.col("first") - F.lit(low or 0)) * RANGES / F.lit(span)))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # RANGES rows at most
    before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    numbered = ranged.withColumn("k", F.row_number().over(W.partitionBy("range").orderBy("first")) - 1).join(F.broadcast(before), "range")
    numbered = numbered.select("key", (F.col("before") + F.col("k")).alias("definition"))
    return keyed.select("id", "key").join(groups.select("key", "uses"), "key").join(numbered, "key", "left").select("id", "uses", "definition")
