"""Tables of marks derived from the relational tables, with the same rows in DuckDB's SQL: components, runs, lines, texts, headers.

Every number is whole or a whole number of hundredths, so that both engines compare the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrail.plans.inputs import table

#: Components: one per order, of a mask by its key; squares of the mask 'saturated' come in fours.
_MASKS = "CASE k % 9 WHEN 0 THEN 'white' WHEN 1 THEN 'dark' WHEN 2 THEN 'stroke' WHEN 3 THEN 'title-blue' WHEN 4 THEN 'bright-blue' WHEN 5 THEN 'red' WHEN 6 THEN 'saturated' WHEN 7 THEN 'coloured' ELSE 'picture' END"
_W = "CASE k % 9 WHEN 0 THEN 400 + k * 31 % 600 WHEN 1 THEN 60 + k * 31 % 200 WHEN 2 THEN 5 + k % 16 WHEN 3 THEN 160 + k * 31 % 400 WHEN 4 THEN 100 + k * 31 % 900 WHEN 5 THEN 7 + k % 25 WHEN 6 THEN 6 + k % 20 WHEN 7 THEN 7 + k % 31 ELSE 120 + k * 31 % 700 END"
_H = "CASE k % 9 WHEN 0 THEN 200 + k * 17 % 400 WHEN 1 THEN 40 + k * 17 % 200 WHEN 2 THEN 6 + k % 16 WHEN 3 THEN 10 + k % 90 WHEN 4 THEN 14 + k % 20 WHEN 5 THEN 6 + k % 27 WHEN 6 THEN 6 + k % 20 WHEN 7 THEN 8 + k % 29 ELSE 80 + k * 17 % 300 END"
_FIGURES = """width, height, k % 9 AS rest, (50 + k * 13 % 51) / CAST(100 AS DOUBLE) AS fill, (k * 29 % 101) / CAST(100 AS DOUBLE) AS corners, (k * 37 % 101) / CAST(100 AS DOUBLE) AS rim, (k * 41 % 101) / CAST(100 AS DOUBLE) AS ring,
  (20 + k * 11 % 81) / CAST(100 AS DOUBLE) AS down, (20 + k * 23 % 81) / CAST(100 AS DOUBLE) AS up, (50 + k * 19 % 51) / CAST(100 AS DOUBLE) AS both, k % 5 AS tips, CAST(200 + k % 56 AS DOUBLE) AS above,
  (k * 7 % 101) / CAST(100 AS DOUBLE) AS chroma, k * 3 % 60 AS colors"""
_ORDERS = "SELECT o_custkey % 50 AS capture, o_orderkey AS k, 1200 AS width, 800 AS height, o_orderkey * 7919 % 1150 AS far, o_orderkey * 104729 % 780 AS deep FROM orders"
_PARTS = f"""parts AS (
  SELECT capture, k * 4 AS id, {_MASKS} AS mask, CASE WHEN k % 9 IN (0, 3, 4, 8) THEN far % 260 ELSE far END AS x, CASE WHEN k % 9 IN (0, 8) THEN deep % 300 WHEN k % 9 = 5 THEN deep % 200 ELSE deep END AS y, {_W} AS w, {_H} AS h, concat('c', CAST(k % 7 AS STRING)) AS color, {_FIGURES}
  FROM ({_ORDERS}) o WHERE k % 9 <> 6
  UNION ALL
  SELECT capture, k * 4 + i AS id, 'saturated' AS mask, far + (i % 2) * (7 + k % 20) + CASE WHEN i = 3 THEN k % 5 ELSE 0 END AS x, deep + CASE WHEN i >= 2 THEN 7 + k % 20 ELSE 0 END AS y, 6 + k % 20 AS w, 6 + k % 20 AS h, concat('c', CAST((k + i * (1 + k % 2)) % 7 AS STRING)) AS color, {_FIGURES}
  FROM ({_ORDERS}) o, (VALUES (0), (1), (2), (3)) v(i) WHERE k % 9 = 6)"""

#: Runs: frames whose lower row repeats the upper one, rails with a foot and a right rail, stray ones.
_RUN = "capture, width, height, 20 + deep AS line, far % 1000 AS first, 50 + k * 31 % 130 AS length, concat('c', CAST(k % 251 AS STRING)) AS color, k"
_REST = "170 + k % 80 AS low, k % 7 AS spread, k * 7 % 45 AS gap, CAST(180 + k * 13 % 75 AS DOUBLE) AS inside, k * 11 % 40 AS inner"
_RUNS = f"""runs AS (
  SELECT capture, width, height, 'h' AS axis, line, first, length, color, {_REST} FROM (SELECT {_RUN} FROM ({_ORDERS}) o) r
  UNION ALL SELECT capture, width, height, 'h', line + 16 + k % 16, first, length, color, 255, 0, 0, CAST(0 AS DOUBLE), 0 FROM (SELECT {_RUN} FROM ({_ORDERS}) o) r WHERE k % 3 <> 0
  UNION ALL SELECT capture, width, height, 'v', first, line, 36 + k % 90, color, {_REST} FROM (SELECT {_RUN} FROM ({_ORDERS}) o) r WHERE k % 2 = 0
  UNION ALL SELECT capture, width, height, 'h', line + 35 + k % 90, first, 100 + k % 70, color, 255, 0, 0, CAST(0 AS DOUBLE), 0 FROM (SELECT {_RUN} FROM ({_ORDERS}) o) r WHERE k % 2 = 0
  UNION ALL SELECT capture, width, height, 'v', first + 99 + k % 70, line, 36 + k % 90, color, {_REST} FROM (SELECT {_RUN} FROM ({_ORDERS}) o) r WHERE k % 4 = 0
  UNION ALL SELECT capture, width, height, 'h', 32 + k % 40, 3 + k % 20, 40 + k % 120, concat('t', CAST(k % 3 AS STRING)), 190 + k % 50, 0, 0, CAST(230 + k % 26 AS DOUBLE), 0 FROM ({_ORDERS}) o WHERE k % 5 = 0
  UNION ALL SELECT capture, width, height, 'h', 34 + k % 40, 42 + k % 20 + k % 120 + k % 4, 30 + k % 110, concat('t', CAST(k % 3 AS STRING)), 190 + k % 50 + k % 2 * 5, 0, 0, CAST(230 AS DOUBLE), 0 FROM ({_ORDERS}) o WHERE k % 5 = 0)"""
_RAILS = f"rails AS (SELECT capture, 42 + k % 20 + k % 120 AS x, 33 + k % 40 AS y, 10 + k % 20 AS length FROM ({_ORDERS}) o WHERE k % 5 = 0)"

#: Texts: a label near each order's run, in it or not.
_TEXTS = f"""texts AS (
  SELECT capture, k AS id, far % 1000 + k % 11 AS x, 20 + deep + k % 10 AS y, 20 + k % 60 AS w, 6 + k % 17 AS h, (30 + k * 17 % 71) / CAST(100 AS DOUBLE) AS conf,
    CASE WHEN k % 6 = 0 THEN concat('user', CAST(k % 9 AS STRING), '@mail') WHEN k % 6 = 1 THEN 'Apply' ELSE concat('Label ', CAST(k % 37 AS STRING)) END AS text FROM ({_ORDERS}) o)"""

#: Lines: a picture's rows and columns for every supplier; a white head, a grey foot, thin white columns.
_LINES = """lines AS (
  SELECT capture, 1200 AS width, 800 AS height, 'h' AS axis, line, (CASE WHEN line >= capture % 6 AND line < capture % 6 + 8 + capture * 7 % 60 THEN 95 WHEN line >= foot - 20 AND line < foot THEN 97 ELSE 10 END) / CAST(100 AS DOUBLE) AS white,
    CAST(0 AS DOUBLE) AS dark, (CASE WHEN line >= foot AND capture % 4 <> 0 THEN 97 ELSE 40 END) / CAST(100 AS DOUBLE) AS flat, CAST(CASE WHEN line >= foot THEN 215 + capture % 40 ELSE 255 END AS DOUBLE) AS low, CAST(capture % 6 AS DOUBLE) AS spread, concat('c', CAST(capture % 9 AS STRING)) AS color
  FROM (SELECT s_suppkey AS capture, 440 + s_suppkey * 37 % 330 AS foot, line FROM supplier, numbers) s
  UNION ALL
  SELECT s_suppkey, 1200, 800, 'v', line, (CASE WHEN (line * 7 + s_suppkey) % 97 < 2 AND line % 5 <> 0 THEN 90 WHEN line % 41 = 0 THEN 30 ELSE 10 END) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), '' FROM supplier, numbers)"""
_NUMBERS = "numbers AS (SELECT {0} AS line)"
_WHITE = f"white AS (SELECT capture, 20 + deep AS line, far % 400 AS first, 300 + k % 400 AS length, (k % 10) / CAST(20 AS DOUBLE) AS above, (k % 7) / CAST(20 AS DOUBLE) AS below FROM ({_ORDERS}) o)"

#: Headers and separators of a table for every order.
_ITEMS = "items AS (SELECT l_orderkey AS capture, l_linenumber AS n, MIN(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_HEADERS = "headers AS (SELECT capture, 1200 AS width, 0 AS row, CAST(n AS BIGINT) * 150 + p % 40 AS x, 30 + p % 50 AS w FROM items)"
_SEPARATORS = "separators AS (SELECT capture, CAST(n AS BIGINT) * 150 + 85 + p % 60 AS x FROM items WHERE p % 11 <> 0 UNION ALL SELECT capture, CAST(n AS BIGINT) * 150 + 92 + p % 60 FROM items)"

#: Name to its definition, after those it is made from.
_ALL = {"numbers": _NUMBERS, "parts": _PARTS, "runs": _RUNS, "rails": _RAILS, "texts": _TEXTS, "lines": _LINES, "white": _WHITE, "items": _ITEMS, "headers": _HEADERS, "separators": _SEPARATORS}
_NEEDS = {"lines": ("numbers",), "headers": ("items",), "separators": ("items",)}


def _defined(names: tuple[str, ...], numbers: str) -> str:
    wanted = [n for n in _ALL if n in names or any(n in _NEEDS.get(m, ()) for m in names)]
    return ", ".join(_ALL[n].format(numbers) if n == "numbers" else _ALL[n] for n in wanted)


def sql(*names: str) -> str:
    """The tables as common table expressions of DuckDB."""
    return _defined(names, "unnest(range(0, 800))").replace("AS STRING)", "AS VARCHAR)")


def marks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, as Spark's plan of the same definition."""
    views = {t: table(spark, sf_dir, t) for t in ("orders", "supplier", "lineitem")}
    text = f"WITH {_defined((name,), 'explode(sequence(0, 799))')} SELECT * FROM {name}"
    for view in views:
        text = text.replace(f"FROM {view}", f"FROM {{{view}}}")
    return spark.sql(text, **views)
