"""Rectangle joins by tiles: equi-joins on (capture, tile) in place of nested loops.

Boxes are exploded to the tiles they touch; a pair is kept in one tile only, the one with the top left corner of the
pair's intersection, so no distinct is needed. Both sides carry whole-number boxes x, y, w, h and the capture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrail.functions.geometry import Box, contains, exact, overlap

TILE = 128
#: Tiles for lines of text: one column as wide as any line, so that a long text isn't repeated for every 128 pixels of its line.
LINE_TILE = (1 << 40, 32)


def _sides(tile: int | tuple[int, int]) -> tuple[int, int]:
    return (tile, tile) if isinstance(tile, int) else tile


def tiled(df: DataFrame, box: Box, tile: int | tuple[int, int] = TILE, grow: int = 0) -> DataFrame:
    """One row for each tile that the box, grown by `grow` on every side, touches; adds tx and ty. Empty boxes vanish."""
    cells = lambda low, size, side: F.sequence(F.floor((low - grow) / side), F.floor((low + size + grow - 1) / side))
    wide, high = _sides(tile)
    some = df.where((box.w + 2 * grow > 0) & (box.h + 2 * grow > 0))
    return some.withColumn("tx", F.explode(cells(box.x, box.w, wide))).withColumn("ty", F.explode(cells(box.y, box.h, high)))


def _sided(df: DataFrame, side: str, keep: list[str], capture: str) -> DataFrame:
    return df.select(F.col(capture).alias(f"{side}capture"), *(F.col(c).alias(f"{side}{c}") for c in [*keep, "x", "y", "w", "h"]))


def box_pairs(left: DataFrame, right: DataFrame, keep_left: list[str], keep_right: list[str], capture: str = "capture", tile: int | tuple[int, int] = TILE, grow: int = 0) -> DataFrame:
    """Pairs of boxes of one capture that intersect when the left one is grown by `grow`.

    Columns: capture, a_* of the left and b_* of the right side (kept columns and boxes).
    """
    a = tiled(_sided(left, "a_", keep_left, capture), Box.of("a_"), tile, grow)
    b = tiled(_sided(right, "b_", keep_right, capture), Box.of("b_"), tile)
    p, q = Box.of("a_"), Box.of("b_")
    b = b.withColumnRenamed("b_capture", "a_capture")
    wide, high = _sides(tile)
    first = lambda u, v, side: F.floor(F.greatest(u - grow, v) / side)
    here = (F.col("tx") == first(p.x, q.x, wide)) & (F.col("ty") == first(p.y, q.y, high))
    meet = (p.x - grow < q.right) & (q.x < p.right + grow) & (p.y - grow < q.bottom) & (q.y < p.bottom + grow)
    return a.join(b, ["a_capture", "tx", "ty"]).where(here & meet).drop("tx", "ty").withColumnRenamed("a_capture", "capture")


def pairs_by_place(boxes: DataFrame, key: str, measure: Callable[[Box, Box], Column], least: float, name: str, capture: str = "capture", tile: int | tuple[int, int] = TILE) -> DataFrame:
    """Pairs of intersecting boxes of one capture whose measure exceeds `least`: capture, a_ and b_ `key` (the lesser first), and the measure as `name`.

    Boxes of one place and size are joined and measured as one, and their pairs are listed last: what a tile compares grows with its places and
    not with the boxes there. measure: of two boxes, the same whichever comes first. Boxes of equal keys are no pair.
    """
    places = boxes.groupBy(F.col(capture).alias("capture"), *"xywh").agg(F.collect_list(key).alias("keys"))
    a, b = (F.struct(*(F.col(f"{side}_{c}") for c in "xywh")) for side in "ab")
    pairs = box_pairs(places, places, ["keys"], ["keys"], tile=tile).where(a <= b)
    good = pairs.withColumn(name, measure(Box.of("a_"), Box.of("b_"))).where(F.col(name) > least).select("capture", name, "a_keys", "b_keys", (a == b).alias("same"))
    each = good.withColumn("p", F.explode("a_keys")).withColumn("q", F.explode("b_keys")).where((F.col("p") < F.col("q")) | (~F.col("same") & (F.col("p") > F.col("q"))))
    return each.select("capture", F.least("p", "q").alias(f"a_{key}"), F.greatest("p", "q").alias(f"b_{key}"), name)


def containing_pairs(outer: DataFrame, inner: DataFrame, keep_outer: list[str], keep_inner: list[str], slack: int = 2, capture: str = "capture", tile: int | tuple[int, int] = TILE) -> DataFrame:
    """Pairs (a_ outer, b_ inner) where the outer box, widened by `slack`, contains the inner one.

    The inner box is looked up by the tile of its top left corner alone: one row for each inner box.
    """
    a = tiled(_sided(outer, "a_", keep_outer, capture), Box.of("a_"), tile, max(slack, 0) + 1)
    b = _sided(inner, "b_", keep_inner, capture).withColumn("tx", F.floor(F.col("b_x") / _sides(tile)[0])).withColumn("ty", F.floor(F.col("b_y") / _sides(tile)[1]))
    b = b.withColumnRenamed("b_capture", "a_capture")
    return a.join(b, ["a_capture", "tx", "ty"]).where(contains(Box.of("a_"), Box.of("b_"), slack)).drop("tx", "ty").withColumnRenamed("a_capture", "capture")


def smallest_container(outer: DataFrame, inner: DataFrame, key: str, owner: str, slack: int = 2, where: Column | None = None, capture: str = "capture") -> DataFrame:
    """For each contained inner box: capture, `key`, and `owner`, the id of the smallest outer box (then smallest id)."""
    pairs = containing_pairs(outer, inner, [owner], [key], slack, capture)
    if where is not None:
        pairs = pairs.where(where)
    best = F.min(F.struct((F.col("a_w") * F.col("a_h")).alias("area"), F.col(f"a_{owner}").alias("id")))
    return pairs.groupBy("capture", F.col(f"b_{key}").alias(key)).agg(best["id"].alias("owner"), best["area"].alias("area"))


def without_covered(boxes: DataFrame, covers: DataFrame, key: str, share: float, capture: str = "capture") -> DataFrame:
    """Rows of `boxes` that no cover overlaps by more than `share` of their area."""
    pairs = box_pairs(boxes, covers, [key], [], capture)
    hit = pairs.where(overlap(Box.of("a_"), Box.of("b_")) > exact(share) * Box.of("a_").area).select("capture", F.col(f"a_{key}").alias(key)).distinct()
    return boxes.join(hit.withColumnRenamed("capture", capture), [capture, key], "left_anti")


def first_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
