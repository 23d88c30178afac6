"""Queries of the detection rules over tables of marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.operators import detect
from vitrail.plans import inputs
from vitrail.plans.markings import marks, sql

Query = Callable[[SparkSession, str], DataFrame]


def _over(rule: Callable[..., DataFrame], *names: str) -> Query:
    """A rule over derived tables of these names."""
    return lambda spark, sf_dir: rule(*(marks(spark, sf_dir, n) for n in names))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.shapes(marks(spark, sf_dir, "parts").withColumn("mask", F.lit("palette")))


def column_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels with strokes every 37 pixels, of many lengths and tones."""
    panels = detect.embedded_panels(marks(spark, sf_dir, "parts"))
    starts = panels.select("capture", (F.col("y") + 2).alias("first"), F.explode(F.sequence(F.col("x") + 10, F.col("x") + F.col("w"), F.lit(37))).alias("line"))
    strokes = starts.select("capture", F.lit("v").alias("axis"), "line", "first", (F.col("line") % 40 + 10).alias("length"), (F.col("line") % 40 + 205).alias("low"), (F.col("line") % 7).alias("spread"), F.lit("c").alias("color"))
    return detect.column_dividers(panels, strokes)


def window_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = marks(spark, sf_dir, "parts")
    k = F.floor(F.col("id") / 4)
    dark = parts.where("mask = 'title-blue'").select("capture", "id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.col("y") + F.col("h") + 35 + k % 60 + j * (1 + k % 2))).alias("line"))
    return detect.window_surfaces(parts, dark)


def checkboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("id") / 4)
    patches = marks(spark, sf_dir, "parts").select("capture", (F.col("id") % 500).alias("id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), (k % 40).alias("spread"), (k * 7 % 60).alias("outer"), (k * 11 % 60).alias("inner"), (k * 3 % 256).alias("face"), F.col("corners").alias("dark"))
    return detect.checkboxes(patches)


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("id") / 4)
    whole = lambda v: v.cast("int")
    return marks(spark, sf_dir, "parts").select(
        "capture", "width", "height", whole(5 + k % 25).alias("x"), whole(5 + k * 3 % 80).alias("y"), whole(8 + k * 5 % 50).alias("w"), whole(6 + k * 7 % 45).alias("h"), F.col("fill").alias("blue"), (k % 40 / 1000.0).alias("neutral")
    )


def header_illustration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.header_illustration(_ink(spark, sf_dir).withColumn("blue", F.col("blue") - 0.5))


def titlebar_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.titlebar_icon(_ink(spark, sf_dir))


def input_underlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules below addresses in the cards: each card's text lies at its own place, rules below it at several lengths."""
    cards = detect.white_cards(marks(spark, sf_dir, "parts"))
    texts = cards.select("capture", F.lit(1).alias("id"), (F.col("x") + 25 + F.col("id") % 7).alias("x"), (F.col("y") + 30).alias("y"), F.lit(90).alias("w"), F.lit(12).alias("h"), F.when(F.col("id") % 5 > 0, "a@b").otherwise("name").alias("text"))
    rules = cards.select("capture", (F.col("x") + 15).alias("first"), (F.col("w") - 20 - F.col("id") % 200).alias("length"), F.lit("c").alias("color"), F.explode(F.sequence(F.col("y") + 40, F.col("y") + 70, F.lit(3))).alias("line"))
    return detect.input_underlines(rules, texts, cards)


def close_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks moved to the upper right corner, where a window's cross is."""
    parts = marks(spark, sf_dir, "parts")
    moved = parts.withColumn("x", 1145 + F.col("x") % 44).withColumn("y", F.col("y") % 24).withColumn("tips", F.lit(4) - F.col("tips") % 2)
    return detect.close_icon(moved)


def backdrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = detect.white_cards(marks(spark, sf_dir, "parts"))
    samples = cards.select("capture", "width", "height", (F.col("id") % 30).alias("header"), (F.col("id") % 25).alias("ptp"), "color")
    return detect.backdrop(samples, cards)


def radios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.radios(marks(spark, sf_dir, "parts").withColumn("centre", F.col("fill")))


def beveled_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("id") / 4)
    dark = marks(spark, sf_dir, "parts").where("mask <> 'saturated'").select(
        "capture", "width", "height", "id", F.lit(790 - k % 80).alias("line"), F.col("x").alias("first"), (150 + k * 3 % 300).alias("length"), (F.lit(790) - k % 80 - 40 - k % 90).alias("top"), (F.lit(792) - k % 80).alias("bottom"),
        (150.0 + k % 60).alias("inside"), (170.0 + k * 3 % 80).alias("upper"), (90.0 + k % 80).alias("rail"),
    )
    texts = dark.where("id % 3 <> 0").select("capture", "id", (F.col("first") + 30).alias("x"), (F.col("top") + 20).alias("y"), F.lit(60).alias("w"), F.lit(12).alias("h"), F.lit(0.9).alias("conf"), F.when(F.col("id") % 5 > 0, "Apply").otherwise("2 b").alias("text"))
    return detect.beveled_buttons(dark, texts)


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as controls of four roles."""
    role = F.expr("CASE id % 4 WHEN 0 THEN 'listitem' WHEN 1 THEN 'treeitem' WHEN 2 THEN 'headeritem' ELSE 'menubar' END")
    return inputs.boxes(spark, sf_dir).select("capture", F.col("id").cast("string").alias("id"), role.alias("role"), "x", "y", (F.col("w") * 2).alias("w"), "h")


def icon_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.icon_slots(_controls(spark, sf_dir).where("role <> 'menubar' OR y > 700 - capture"))


def coloured_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.coloured_icons(marks(spark, sf_dir, "parts"), _controls(spark, sf_dir).where("role = 'headeritem'"))


def sort_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _controls(spark, sf_dir).withColumn("h", F.col("h") * 3)
    return detect.sort_marks(marks(spark, sf_dir, "parts"), cells)


def tab_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = inputs.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("capture"), k.alias("id"))
    bands = orders.withColumn("band", F.explode(F.array(F.lit("top"), F.lit("bottom")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    lean = F.when(F.col("band") == "top", F.col("id") % 9).otherwise(0)
    left = F.when((F.col("id") + F.col("j")) % 7 > 0, lean + F.col("j"))
    edges = bands.select("capture", "id", "band", left.alias("left"), (80 - lean + F.col("j")).alias("right"))
    return detect.tab_corners(edges)


def title_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed grey rows of pictures."""
    columns = inputs.pixels(spark, sf_dir).where("py = 0").select(F.col("id").alias("capture"), F.col("px").alias("x"), "v")
    return detect.title_gradient(columns, 1).select("capture", "x", F.round("v", 6).alias("v"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = detect.table_columns(marks(spark, sf_dir, "headers"), marks(spark, sf_dir, "separators")).withColumn("top", F.lit(40)).withColumn("bottom", F.lit(400))
    cells = columns.select("capture", (F.col("k") * 100).alias("base"), (F.col("x") + 2).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("j"))
    texts = cells.select("capture", (F.col("base") + F.col("j")).alias("id"), "x", (50 + F.col("j") * 30).alias("y"), (20 + F.col("j") * 9).alias("w"), (12 - (F.col("base") + F.col("j")) % 8).alias("h"))
    return detect.table_cells(columns, texts)


QUERIES: dict[str, Query] = {
    "detect_shapes": shapes,
    "detect_white_card": _over(detect.white_card, "parts"),
    "detect_window_shell": _over(detect.window_shell, "parts", "lines"),
    "detect_multicolor_marks": _over(detect.multicolor_marks, "parts"),
    "detect_input_underlines": input_underlines,
    "detect_embedded_panels": _over(detect.embedded_panels, "parts"),
    "detect_column_dividers": column_dividers,
    "detect_footer_surface": _over(detect.footer_surface, "lines"),
    "detect_header_illustration": header_illustration,
    "detect_titlebar_icon": titlebar_icon,
    "detect_focused_controls": _over(detect.focused_controls, "parts"),
    "detect_disabled_buttons": _over(detect.disabled_buttons, "runs"),
    "detect_backdrop": backdrop,
    "detect_title_gradient": title_gradient,
    "detect_radios": radios,
    "detect_close_icon": close_icon,
    "detect_window_surfaces": window_surfaces,
    "detect_close_controls": _over(detect.close_controls, "parts", "texts"),
    "detect_group_frames": _over(detect.group_frames, "runs"),
    "detect_checkboxes": checkboxes,
    "detect_dropdowns": _over(detect.dropdowns, "runs", "texts"),
    "detect_footer_buttons": _over(detect.footer_buttons, "runs", "texts"),
    "detect_beveled_buttons": beveled_buttons,
    "detect_tabs": _over(detect.tabs, "runs", "rails"),
    "detect_structure": _over(detect.structure, "lines", "white"),
    "detect_table_columns": _over(detect.table_columns, "headers", "separators"),
    "detect_table_cells": table_cells,
    "detect_dark_panels": _over(detect.dark_panels, "parts", "texts"),
    "detect_coloured_icons": coloured_icons,
    "detect_photos": _over(detect.photos, "parts"),
    "detect_icon_slots": icon_slots,
    "detect_sort_marks": sort_marks,
    "detect_tab_corners": tab_corners,
}


def _row(kind: str, confidence: str, x: str = "x", y: str = "y", w: str = "w", h: str = "h", color: str = "color") -> str:
    return f"capture, {kind} AS kind, ({x})::INTEGER AS x, ({y})::INTEGER AS y, ({w})::INTEGER AS w, ({h})::INTEGER AS h, {color} AS color, ({confidence})::DOUBLE AS confidence"


def _first_near(of: str, dx: int, dy: int) -> str:
    return f"SELECT * FROM {of} a WHERE NOT EXISTS (SELECT 1 FROM {of} b WHERE a.capture = b.capture AND abs(a.x - b.x) < {dx} AND abs(a.y - b.y) < {dy} AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))"


_CARDS = "cards AS (SELECT * FROM parts WHERE mask = 'white' AND w > 480 AND h > 240 AND fill > 0.78 AND x > 20 AND y > 40 AND x + w < 1180 AND y + h < 780 QUALIFY row_number() OVER (PARTITION BY capture ORDER BY w * h DESC, id) = 1)"
_PANELS = f"panels AS (SELECT {_row("'content-panel'", '0.92', 'x - 1', 'y - 1', 'w + 2', 'h + 2', "'#ffffff'")} FROM parts WHERE mask = 'white' AND w > 300 AND w < 960 AND h > 96 AND h < 440 AND x > 20 AND y > 200 AND x + w < 1180 AND y + h < 780 AND fill > 0.9 AND above < 245)"
_BARS = "bars AS (SELECT * FROM parts WHERE mask = 'title-blue' AND w >= 180 AND h BETWEEN 15 AND 110 AND w / h::DOUBLE >= 3 AND y + h < 780 AND fill > 0.65)"
_RUNS = "h AS (SELECT *, first + length AS r FROM runs WHERE axis = 'h')"


def _crosses(each: float, both: float, tips: int = 0) -> str:
    return f"SELECT * FROM parts WHERE mask = 'stroke' AND w BETWEEN 7 AND 18 AND h BETWEEN 7 AND 18 AND w / h::DOUBLE BETWEEN 0.8 AND 1.25 AND least(down, up) >= {each} AND \"both\" >= {both} AND tips >= {tips}"


def _closed(where: str, low: int, high: int) -> str:
    return f"SELECT t.*, b.line AS bottom FROM h t JOIN h b USING (capture, first, length, color) WHERE b.line - t.line BETWEEN {low} AND {high} AND {where} QUALIFY row_number() OVER (PARTITION BY t.capture, t.line, t.first, t.length, t.color, t.low, t.gap, t.inside, t.inner ORDER BY b.line) = 1"


_T = "t.inside BETWEEN 195 AND 215 AND t.length BETWEEN 80 AND 150 AND t.first > 660 AND t.low BETWEEN 175 AND 205 AND t.spread < 5 AND t.line >= 280 AND t.line < 680"
_KIND = """CASE WHEN least(w, h) <= 2 THEN 'line' WHEN w / h::DOUBLE BETWEEN 0.78 AND 1.28 AND w BETWEEN 7 AND 60 AND corners < 0.25 AND fill > 0.65 THEN 'circle'
  WHEN w / h::DOUBLE BETWEEN 0.78 AND 1.28 AND w BETWEEN 7 AND 60 AND corners < 0.25 AND fill > 0.12 AND ring > 0.72 THEN 'ring' WHEN fill >= 0.78 THEN 'rect' WHEN w >= 8 AND h >= 6 AND rim >= 0.68 AND fill < 0.65 THEN 'outline' ELSE 'unknown' END"""
_SURE = f"CASE {_KIND} WHEN 'line' THEN 0.85 WHEN 'circle' THEN 0.87 WHEN 'ring' THEN 0.87 WHEN 'rect' THEN least(0.98::DOUBLE, fill) WHEN 'outline' THEN 0.72 ELSE 0.25 END"
_CONTROLS = f"WITH {inputs.BOXES_SQL}, controls AS (SELECT capture, id::VARCHAR AS id, CASE id % 4 WHEN 0 THEN 'listitem' WHEN 1 THEN 'treeitem' WHEN 2 THEN 'headeritem' ELSE 'menubar' END AS role, x, y, w * 2 AS w, h FROM boxes)"
_IN = "b.x >= a.x AND b.y >= a.y AND b.x + b.w <= a.x + a.w AND b.y + b.h <= a.y + a.h"
_INK = "ink AS (SELECT capture, width, height, 5 + id // 4 % 25 AS x, 5 + id // 4 * 3 % 80 AS y, 8 + id // 4 * 5 % 50 AS w, 6 + id // 4 * 7 % 45 AS h, fill AS blue, id // 4 % 40 / 1000.0::DOUBLE AS neutral FROM parts)"
_COLUMNS = f"""WITH {sql("headers", "separators")},
s AS (SELECT *, row_number() OVER o AS k, lead(x) OVER o AS nx, count(*) OVER (PARTITION BY capture, row) AS n, max(x) OVER (PARTITION BY capture, row) - min(x) OVER (PARTITION BY capture, row) AS span FROM headers WINDOW o AS (PARTITION BY capture, row ORDER BY x)),
e AS (SELECT s.capture, s.row, s.k, s.x, s.n, CASE WHEN s.k < s.n THEN max(p.x) ELSE min(p.x) END AS "right" FROM s JOIN separators p ON s.capture = p.capture AND p.x > s.x + s.w AND (s.nx IS NULL OR p.x < s.nx) WHERE s.n >= 4 AND s.span >= 360 GROUP BY s.capture, s.row, s.k, s.x, s.n),
f AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY capture, row) = n),
columns_of AS (SELECT capture, row, k, coalesce(lag("right") OVER (PARTITION BY capture, row ORDER BY x), greatest(0, x - 3)) AS x, "right" FROM f)"""

ORACLE_SQL: dict[str, str] = {
    "detect_shapes": f"WITH {sql('parts')} SELECT {_row(_KIND, _SURE)} FROM parts",
    "detect_white_card": f"WITH {sql('parts')}, {_CARDS} SELECT {_row("'content-panel'", '0.9', color="'#ffffff'")} FROM cards",
    "detect_window_shell": f"""WITH {sql('parts', 'lines')}, {_CARDS}, g AS (SELECT capture, line, line - row_number() OVER (PARTITION BY capture ORDER BY line) AS g FROM lines WHERE axis = 'h' AND white > 0.8 AND line >= 1 AND line < 70),
i AS (SELECT capture, min(line) AS first, count(*) AS n FROM g GROUP BY capture, g), t AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY capture ORDER BY first) = 1)
SELECT {_row("'dialog-panel'", '0.95', color="'#ffffff'")} FROM cards UNION ALL SELECT {_row("'window-header'", '0.9', '1', 'first', '1198', 'n', "'#ffffff'")} FROM t WHERE first < 60 AND n BETWEEN 20 AND 55 AND capture IN (SELECT capture FROM cards)""",
    "detect_multicolor_marks": f"""WITH {sql('parts')}, q AS (SELECT * FROM parts WHERE mask = 'saturated' AND w BETWEEN 7 AND 30 AND h BETWEEN 7 AND 30 AND fill > 0.8),
n AS (SELECT a.capture, a.id, a.x, a.y, a.w, a.h, a.color, b.id AS other, b.color AS ink, CASE WHEN abs(b.x - a.x - a.w - 1) <= 2 AND abs(b.y - a.y) <= 2 THEN 1 WHEN abs(b.x - a.x) <= 2 AND abs(b.y - a.y - a.h - 1) <= 2 THEN 2 WHEN abs(b.x - a.x - a.w - 1) <= 2 AND abs(b.y - a.y - a.h - 1) <= 2 THEN 3 END AS place
  FROM q a JOIN q b ON a.capture = b.capture AND a.id <> b.id AND abs(a.w - b.w) <= 2 AND abs(a.h - b.h) <= 2),
f AS (SELECT * FROM n WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY capture, id, place ORDER BY other) = 1)
SELECT {_row("'multicolor-mark'", '0.95', w='2 * w + 1', h='2 * h + 1')} FROM (SELECT capture, id, x, y, w, h, color FROM f GROUP BY ALL HAVING count(*) = 3 AND len(list_distinct(list_append(list(ink), color))) = 4)""",
    "detect_input_underlines": f"""WITH {sql('parts')}, {_CARDS}, r AS (SELECT capture, x + 15 AS first, w - 20 - id % 200 AS length, unnest(range(y + 40, y + 71, 3)) AS line, x + 25 + id % 7 AS tx, y, x AS cx, w AS cw, h AS ch, id FROM cards),
m AS (SELECT *, greatest(first, cx + 20) AS l, least(first + length, cx + cw - 20) - greatest(first, cx + 20) AS span FROM r WHERE id % 5 > 0 AND line BETWEEN y + 44 AND y + 63 AND line < y + ch - 5)
SELECT {_row("'input-underline'", '0.95', 'l', 'line', 'span', '1', "'c'")} FROM m WHERE span > 0.55 * cw AND abs(l - tx) < 25 AND l + span > tx + 90 + 0.1 * cw QUALIFY row_number() OVER (PARTITION BY capture ORDER BY line) = 1""",
    "detect_embedded_panels": f"WITH {sql('parts')}, {_PANELS} SELECT * FROM panels",
    "detect_column_dividers": f"""WITH {sql('parts')}, {_PANELS}, s AS (SELECT *, unnest(range(x + 10, x + w + 1, 37)) AS at_x FROM panels),
d AS (SELECT DISTINCT {_row("'column-divider'", '0.92', 't.at_x', 't.y + 2', '1', '24', "'c'").replace('capture,', 'a.capture,', 1)} FROM s t JOIN panels a ON a.capture = t.capture AND a.y = t.y AND t.at_x BETWEEN a.x + 16 AND a.x + a.w - 17 WHERE t.at_x % 40 + 10 >= 24 AND t.at_x % 40 + 205 BETWEEN 215 AND 240 AND t.at_x % 7 < 5)
{_first_near('d', 4, 1)}""",
    "detect_footer_surface": f"""WITH {sql('lines')}, r AS (SELECT * FROM lines WHERE axis = 'h') SELECT {_row("'footer-panel'", '0.95', '1', 'line', '1198', '800 - line - 1')} FROM (SELECT a.*, row_number() OVER (PARTITION BY a.capture ORDER BY a.line) AS rk FROM r a JOIN r b ON a.capture = b.capture AND a.line = b.line + 1 AND b.white > 0.95
  JOIN r e ON a.capture = e.capture AND e.line = 795 WHERE a.low BETWEEN 220 AND 248 AND a.spread < 5 AND a.flat > 0.95 AND a.line >= 440 AND a.line < 770 AND abs(e.low - a.low) < 5 AND e.flat > 0.95) WHERE rk = 1""",
    "detect_header_illustration": f"WITH {sql('parts')}, {_INK} SELECT {_row("'header-icon'", '0.68', color="CASE WHEN blue - 0.5 > 0.14 THEN 'window-stack' ELSE 'document' END")} FROM ink WHERE x BETWEEN 8 AND 25 AND y BETWEEN 40 AND 70 AND w BETWEEN 20 AND 50 AND h BETWEEN 18 AND 45",
    "detect_titlebar_icon": f"WITH {sql('parts')}, {_INK} SELECT {_row("'title-icon'", '0.7', 'x - 1', 'y - 1', 'w + 2', 'h + 2', "''")} FROM ink WHERE blue >= 0.18 AND neutral <= 0.012 AND x BETWEEN 7 AND 18 AND y BETWEEN 7 AND 17 AND w BETWEEN 9 AND 22 AND h BETWEEN 7 AND 17",
    "detect_focused_controls": f"""WITH {sql('parts')}, k AS (SELECT *, CASE WHEN w BETWEEN 660 AND 1080 AND h BETWEEN 18 AND 32 AND y > 30 AND y < 600 AND x > 35 THEN 'input-field' WHEN w > 144 AND w < 660 AND h BETWEEN 15 AND 30 AND x <= 60 AND y > 80 AND y < 600 THEN 'selected-row' END AS kind FROM parts WHERE mask = 'bright-blue')
SELECT {_row('kind', "CASE kind WHEN 'input-field' THEN 0.93 ELSE 0.95 END", "CASE kind WHEN 'selected-row' THEN greatest(1, x - 1) ELSE x END", 'y', "CASE kind WHEN 'selected-row' THEN least(1198, w + 1) ELSE w END", 'h', "'#0078d7'")} FROM k WHERE kind IS NOT NULL""",
    "detect_disabled_buttons": f"WITH {sql('runs')}, {_RUNS}, c AS ({_closed(_T, 19, 30)}), d AS (SELECT {_row("'disabled-button'", '0.9', 'first', 'line', 'length', 'bottom - line + 1')} FROM c) {_first_near('d', 3, 30)}",
    "detect_backdrop": f"WITH {sql('parts')}, {_CARDS} SELECT {_row("'decorative-background'", '0.7', '1', 'id % 30', '1198', '800 - id % 30 - 2')} FROM cards WHERE id % 30 >= 10 AND id % 25 >= 12",
    "detect_title_gradient": f"""WITH {inputs.TILES_SQL}, s AS (SELECT id, px, v, unnest(range(px - 4, px + 5)) AS t FROM pixels WHERE py = 0), m AS (SELECT id, CASE WHEN t < 0 THEN -t - 1 WHEN t > 7 THEN 15 - t ELSE t END AS x, v, exp(-0.5::DOUBLE * (px - t) * (px - t)) AS w FROM s)
SELECT id AS capture, x, round(sum(v * w) / sum(w), 6) AS v FROM m GROUP BY id, x""",
    "detect_radios": f"WITH {sql('parts')} SELECT {_row("CASE WHEN fill > 0.55 THEN 'radio-selected' ELSE 'radio' END", '0.87')} FROM parts WHERE w BETWEEN 9 AND 24 AND h BETWEEN 9 AND 24 AND w / h::DOUBLE BETWEEN 0.75 AND 1.33 AND corners < 0.45",
    "detect_close_icon": f"WITH {sql('parts').replace('parts AS', 'unmoved AS')}, parts AS (SELECT * REPLACE (1145 + x % 44 AS x, y % 24 AS y, 4 - tips % 2 AS tips) FROM unmoved) SELECT {_row("'close-icon'", '0.9')} FROM ({_crosses(0.38, 0.9, 4)}) WHERE x >= 1150 AND x + w <= 1196 AND y >= 4 AND y + h <= 36 QUALIFY row_number() OVER (PARTITION BY capture ORDER BY y, x) = 1",
    "detect_window_surfaces": f"""WITH {sql('parts')}, {_BARS}, d AS (SELECT *, unnest([y + h + 35 + id // 4 % 60 + j * (1 + id // 4 % 2) for j in range(0, 6)]) AS line FROM bars WHERE fill >= 0.85),
t AS (SELECT *, lead(line, 2) OVER (PARTITION BY capture, id ORDER BY line) AS third FROM d), f AS (SELECT capture, id, x, y, w, h, color, min(line) AS bottom FROM t WHERE third = line + 2 AND line >= y + h + 40 GROUP BY ALL)
SELECT {_row("'gradient-title'", '0.9')} FROM bars WHERE fill >= 0.85 UNION ALL SELECT {_row("'rect'", '0.9', 'greatest(0, x - 3)', 'y + h', 'least(1200, x + w + 3) - greatest(0, x - 3)', 'bottom - y - h')} FROM f WHERE bottom - y >= h + 60""",
    "detect_close_controls": f"""WITH {sql('parts', 'texts')}, {_BARS}, m AS ({_crosses(0.25, 0.6)}), t AS (SELECT * FROM texts WHERE h >= 7 AND conf >= 0.55),
k AS (SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM bars b WHERE b.capture = m.capture AND m.x >= b.x - 8 AND m.y >= b.y - 8 AND m.x + m.w <= b.x + b.w + 8 AND m.y + m.h <= b.y + b.h + 8 AND (m.x + m.w <= b.x + least(b.w, 70) OR m.x >= b.x + b.w - least(b.w, 80)))
  OR EXISTS (SELECT 1 FROM t WHERE t.capture = m.capture AND t.y <= 220 AND abs(2 * m.y + m.h - 2 * t.y - t.h) <= 2 * greatest(18, t.h) AND m.x >= greatest(t.x + t.w + 35, 600))),
r AS (SELECT p.* FROM parts p WHERE mask = 'red' AND w BETWEEN 8 AND 30 AND h BETWEEN 8 AND 30 AND w / h::DOUBLE BETWEEN 0.75 AND 1.3 AND y + h <= 220 AND EXISTS (SELECT 1 FROM t WHERE t.capture = p.capture AND t.x > p.x + p.w AND abs(2 * p.y + p.h - 2 * t.y - t.h) < 40)),
d AS (SELECT {_row("'close-icon'", '0.9')} FROM k UNION ALL SELECT {_row("'close-dot'", '0.9')} FROM r) {_first_near('d', 4, 4)}""",
    "detect_group_frames": f"""WITH {sql('runs')}, {_RUNS}, v AS (SELECT capture, width, height, line AS x, first AS y, length AS h, color, gap FROM runs WHERE axis = 'v'),
d AS (SELECT DISTINCT {_row("'outline'", '0.8', 'l.x', 'l.y', 'b.length', 'l.h', 'l.color').replace('capture,', 'l.capture,', 1)} FROM v l JOIN h b ON b.capture = l.capture AND b.line = l.y + l.h - 1 AND b.first = l.x AND b.color = l.color AND b.length >= 100
  JOIN v r ON r.capture = l.capture AND r.x + 1 = l.x + b.length AND r.y = l.y AND r.h = l.h AND r.color = l.color WHERE l.h BETWEEN 35 AND 130 AND l.x >= 12 AND l.y > 50 AND l.y < 775 AND l.gap >= 10) {_first_near('d', 4, 4)}""",
    "detect_checkboxes": f"""WITH {sql('parts')}, p AS (SELECT capture, id % 500 AS id, x, y, id // 4 % 40 AS spread, id // 4 * 7 % 60 AS outer_c, id // 4 * 11 % 60 AS inner_c, id // 4 * 3 % 256 AS face, corners AS dark FROM parts)
SELECT {_row("CASE WHEN dark > 0.07 THEN 'checkbox-selected' ELSE 'checkbox' END", '0.85', w='13', h='13', color="''")} FROM p WHERE spread <= 25 AND outer_c >= 30 AND inner_c >= 30 AND face < 220 QUALIFY row_number() OVER (PARTITION BY capture, id ORDER BY x, y, dark) = 1""",
    "detect_dropdowns": f"""WITH {sql('runs', 'texts')}, {_RUNS}, c AS (SELECT t.capture, x.id, t.line, t.first, t.length, t.color, min(b.line) AS bottom FROM h t JOIN texts x ON x.capture = t.capture AND t.line BETWEEN x.y - 8 AND x.y AND x.h BETWEEN 7 AND 20 AND x.x >= 20 AND x.y >= 30 AND x.x < 1100 AND x.x BETWEEN t.first AND t.first + 8 AND t.r > x.x + 80
  JOIN h b ON b.capture = t.capture AND b.first = t.first AND b.length = t.length AND b.color = t.color AND b.line - t.line BETWEEN 16 AND 30 WHERE t.length BETWEEN 100 AND 1190 AND t.line >= 1 AND t.r < 1192 AND t.gap >= 15 AND t.inner >= 10 GROUP BY ALL),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY capture, id ORDER BY line, first) = 1) SELECT DISTINCT {_row("'dropdown'", '0.8', 'first', 'line', 'length', 'bottom - line + 1')} FROM d""",
    "detect_footer_buttons": f"""WITH {sql('runs', 'texts')}, {_RUNS}, c AS ({_closed('t.line >= 735 AND t.line < 783 AND t.length BETWEEN 50 AND 150 AND t.first >= 2 AND t.r < 1198 AND t.gap >= 20 AND t.inner >= 10', 17, 33)}),
d AS (SELECT {_row("'outlined-button'", '0.8', 'first', 'line', 'length', 'bottom - line + 1')} FROM c), n AS ({_first_near('d', 3, 3)})
SELECT * FROM n a WHERE (SELECT count(*) FROM texts b WHERE b.conf >= 0.7 AND b.capture = a.capture AND {_IN}) = 1 QUALIFY row_number() OVER (PARTITION BY capture ORDER BY y, x) <= 12""",
    "detect_beveled_buttons": f"""WITH {sql('parts')}, k AS (SELECT capture, id, id // 4 AS k, x FROM parts WHERE mask <> 'saturated'), b AS (SELECT capture, id, k, x, 150 + k * 3 % 300 AS w, 790 - k % 80 - 40 - k % 90 AS y, 42 + k % 90 AS h, 150 + k % 60 AS ins, 170 + k * 3 % 80 AS upp, 90 + k % 80 AS rail FROM k),
t AS (SELECT capture, x + 30 AS x, y + 20 AS y, 60 AS w, 12 AS h FROM b WHERE id % 3 <> 0 AND id % 5 > 0),
g AS (SELECT * FROM b WHERE w BETWEEN 200 AND 540 AND 790 - k % 80 >= 520 AND 790 - k % 80 < 780 AND h BETWEEN 50 AND 120 AND y >= 480 AND ins > 170 AND upp > ins + 12 AND rail < ins - 45),
d AS (SELECT {_row("'beveled-button'", '0.85', color="''")} FROM g a WHERE (SELECT count(*) FROM t b WHERE b.capture = a.capture AND {_IN}) = 1) {_first_near('d', 8, 12)}""",
    "detect_tabs": f"""WITH {sql('runs', 'rails')}, {_RUNS}, a AS (SELECT * FROM h WHERE line BETWEEN 32 AND 64 AND first BETWEEN 5 AND 20 AND length BETWEEN 45 AND 150 AND low BETWEEN 195 AND 235 AND inside >= 250 AND EXISTS (SELECT 1 FROM rails s WHERE s.capture = h.capture AND s.x + 1 = h.r AND s.y - 1 = h.line AND s.length >= 16)),
o AS (SELECT a.*, n.first AS start, n.r AS stop FROM a JOIN h n ON n.capture = a.capture AND n.line - 2 = a.line AND n.length BETWEEN 40 AND 125 AND abs(n.first - a.r + 1) <= 2 AND abs(n.low - a.low) <= 3 QUALIFY row_number() OVER (PARTITION BY a.capture ORDER BY a.line, a.first, n.first, a.length, a.r, n.r, a.color) = 1)
SELECT {_row("'tab-active'", '0.85', 'first', 'line', 'length', '22')} FROM o UNION ALL SELECT {_row("'tab'", '0.85', 'r - 1', 'line + 2', 'stop - r + 2', '20')} FROM o""",
    "detect_structure": f"""WITH {sql('lines', 'white')}, g AS (SELECT capture, line, line - row_number() OVER (PARTITION BY capture ORDER BY line) AS g FROM lines WHERE axis = 'h' AND white > 0.8 AND line < 400),
i AS (SELECT capture, min(line) AS first, count(*) AS n FROM g GROUP BY capture, g QUALIFY row_number() OVER (PARTITION BY capture ORDER BY count(*) DESC, min(line)) = 1), s AS (SELECT * FROM i WHERE n >= 12 AND first <= 4),
z AS (SELECT DISTINCT l.capture, coalesce(s.first + s.n, 2) AS from_y FROM lines l LEFT JOIN s USING (capture)), v AS (SELECT capture, line, white, lag(white) OVER o AS lw, lead(white) OVER o AS rw FROM lines WHERE axis = 'v' WINDOW o AS (PARTITION BY capture ORDER BY line)),
vg AS (SELECT *, line - row_number() OVER (PARTITION BY capture ORDER BY line) AS g FROM v WHERE white > 0.85), vi AS (SELECT capture, min(line) AS first, max(line) AS last, count(*) AS n, arg_min(lw, line) AS lw, arg_max(rw, line) AS rw FROM vg GROUP BY capture, g)
SELECT {_row("'rect'", '0.9', '1', 'first', '1198', 'n', "'#ffffff'")} FROM s
UNION ALL SELECT {_row("'line'", '0.9', 'first', 'from_y', 'n', '800 - from_y - 2', "'#ffffff'")} FROM vi JOIN z USING (capture) WHERE n <= 3 AND lw < 0.25 AND rw < 0.25 AND first >= 2 AND last + 1 < 1198
UNION ALL SELECT {_row("'line'", '0.9', 'first', 'line', 'length', '1', "'#ffffff'")} FROM white JOIN z USING (capture) WHERE length >= 420 AND above < 0.15 AND below < 0.15 AND line > greatest(from_y, 2) AND line < 798""",
    "detect_table_columns": f"{_COLUMNS} SELECT * FROM columns_of",
    "detect_table_cells": f"""{_COLUMNS}, cells AS (SELECT capture, k * 100 AS base, x + 2 AS x, unnest(range(0, 9)) AS j FROM columns_of), texts AS (SELECT capture, base + j AS id, x, 50 + j * 30 AS y, 20 + j * 9 AS w, 12 - (base + j) % 8 AS h FROM cells),
held AS (SELECT c.capture, c.row, c.k, t.id, t.h, median(t.h) OVER (PARTITION BY c.capture, c.row, c.k) AS usual FROM columns_of c JOIN texts t ON t.capture = c.capture AND t.x >= c.x AND t.x + t.w <= c."right" AND t.y >= 40 AND t.y + t.h <= 400),
kept AS (SELECT * FROM held WHERE h >= 0.6 * usual), full_of AS (SELECT capture, row, k FROM kept GROUP BY ALL HAVING count(*) >= 6), good AS (SELECT capture, row FROM full_of GROUP BY ALL HAVING count(*) >= 2)
SELECT capture, row, k, id FROM kept JOIN good USING (capture, row)""",
    "detect_dark_panels": f"WITH {sql('parts', 'texts')} SELECT {_row("'rect'", '0.8')} FROM parts a WHERE mask = 'dark' AND w >= 200 AND w < 960 AND h >= 70 AND h < 480 AND fill > 0.7 AND (SELECT count(*) FROM texts b WHERE b.capture = a.capture AND b.x >= a.x - 2 AND b.y >= a.y - 2 AND b.x + b.w <= a.x + a.w + 2 AND b.y + b.h <= a.y + a.h + 2) >= 3",
    "detect_coloured_icons": f"{_CONTROLS}, {sql('parts')} SELECT DISTINCT {_row("'artwork'", '0.8', 'greatest(0, x - 1)', 'greatest(0, y - 1)', 'w + 2', 'h + 2')} FROM parts b WHERE mask = 'coloured' AND w BETWEEN 8 AND 36 AND h BETWEEN 8 AND 36 AND w / h::DOUBLE BETWEEN 0.6 AND 1.6 AND EXISTS (SELECT 1 FROM controls a WHERE role = 'headeritem' AND a.capture = b.capture AND {_IN})",
    "detect_photos": f"WITH {sql('parts')} SELECT {_row("'raster'", '0.8', color="''")} FROM parts WHERE mask = 'picture' AND w >= 140 AND h >= 100 AND w <= 960 AND fill >= 0.65 AND chroma >= 0.2 AND colors >= 24",
    "detect_icon_slots": f"""{_CONTROLS} SELECT capture, id, CASE WHEN role = 'listitem' THEN x ELSE greatest(0, x - 24) END AS x, CASE WHEN role = 'listitem' THEN y ELSE greatest(0, y - 4) END AS y, CASE WHEN role = 'listitem' THEN least(32, w) ELSE 36 END AS w, CASE WHEN role = 'listitem' THEN h ELSE h + 8 END AS h
FROM controls WHERE (role = 'listitem' AND h BETWEEN 14 AND 48 AND w > 80) OR (role = 'treeitem' AND h BETWEEN 12 AND 48) UNION ALL SELECT capture, 'menu', 0, 0, 40, least(45, min(y)) FROM controls WHERE role = 'menubar' AND y > 700 - capture GROUP BY capture HAVING min(y) >= 24""",
    "detect_sort_marks": f"""{_CONTROLS}, {sql('parts')}, cells AS (SELECT capture, x, y, w, h * 3 // 3 AS h FROM controls WHERE role = 'headeritem')
SELECT DISTINCT b.capture, (b.x - 1)::INTEGER AS x, (b.y - 1)::INTEGER AS y, (b.w + 2)::INTEGER AS w, (b.h + 2)::INTEGER AS h FROM cells a JOIN parts b ON a.capture = b.capture AND mask = 'stroke' AND b.w BETWEEN 6 AND 16 AND b.h BETWEEN 3 AND 10 AND {_IN} AND b.y + b.h < a.y + a.h""",
    "detect_tab_corners": """WITH o AS (SELECT o_custkey % 50 AS capture, o_orderkey AS id FROM orders), e AS (SELECT capture, id, b, j, CASE WHEN (id + j) % 7 > 0 THEN CASE WHEN b = 't' THEN id % 9 ELSE 0 END + j END AS l, 80 - CASE WHEN b = 't' THEN id % 9 ELSE 0 END + j AS r FROM o, (VALUES ('t'), ('b')) v(b), range(0, 3) n(j)),
m AS (SELECT capture, id, median(l) FILTER (b = 't') AS tl, median(r) FILTER (b = 't') AS tr, median(l) FILTER (b = 'b') AS bl, median(r) FILTER (b = 'b') AS br FROM e GROUP BY ALL)
SELECT capture, id, tl, tr, bl, br FROM m WHERE tl IS NOT NULL AND bl IS NOT NULL AND greatest(abs(tl - bl), abs(tr - br)) >= 3""",
}
