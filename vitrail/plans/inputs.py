"""Captures derived from the relational tables: boxes, words, control trees, tiles, catalogue rows and observations.

Each derivation is a DataFrame; the same rows in DuckDB's SQL stand beside it, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrail.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Boxes: one per order, in 50 captures of 1200 x 800 pixels.

BOXES_SQL = """boxes AS (
  SELECT (o_custkey % 50)::BIGINT AS capture, o_orderkey AS id, o_orderkey * 7919 % 1200 AS x, o_orderkey * 104729 % 800 AS y,
         10 + o_orderkey % 90 AS w, 8 + o_orderkey % 40 AS h FROM orders)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("capture"), k.alias("id"), (k * 7919 % 1200).alias("x"), (k * 104729 % 800).alias("y"), (10 + k % 90).alias("w"), (8 + k % 40).alias("h")
    )


# Words: the blank-separated words of every document line, with places, sizes and confidences like a recogniser's.

WORDS_SQL = """words AS (
  SELECT doc_id AS capture, (ln // 4)::BIGINT AS block, (ln % 4)::BIGINT AS par, ln AS line, k, text, length(text) * 7 AS w, (10 + length(text) % 5)::BIGINT AS h,
         sum(length(text) * 7 + 6) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(text) * 7 - 6 AS x, ln * 16 + length(text) % 3 AS y, (35 + length(text) * 13 % 66 - 4)::DOUBLE AS conf
  FROM (SELECT doc_id, ln, unnest(string_split(l, ' ')) AS text, generate_subscripts(string_split(l, ' '), 1) - 1 AS k
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "l"))
    each = lines.select("doc_id", F.col("ln").cast("bigint").alias("ln"), F.posexplode(F.split("l", " ")).alias("k", "text"))
    size = F.char_length("text")
    run = F.sum(size * 7 + 6).over(W.partitionBy("doc_id", "ln").orderBy("k"))
    return each.select(
        F.col("doc_id").alias("capture"),
        F.floor(F.col("ln") / 4).alias("block"),
        (F.col("ln") % 4).alias("par"),
        F.col("ln").alias("line"),
        F.col("k").cast("bigint").alias("k"),
        "text",
        (size * 7).cast("bigint").alias("w"),
        (10 + size % 5).cast("bigint").alias("h"),
        (run - size * 7 - 6).alias("x"),
        (F.col("ln") * 16 + size % 3).alias("y"),
        (35 + size * 13 % 66 - 4).cast("double").alias("conf"),
    )


# Trees: a window per customer, a list or pane per order, an item per order line, a text per item.

TREE_SQL = """lines AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY ALL),
ordered AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey * 7919 % 1200 AS ox, o_orderkey * 104729 % 800 AS oy, o_orderstatus AS s FROM orders),
tree AS (
  SELECT c_custkey AS capture, 'c' || c_custkey AS id, NULL::VARCHAR AS parent, 0 AS depth, 0::BIGINT AS ord, 'window' AS role, c_name AS label,
         0::BIGINT AS x, 0::BIGINT AS y, 1200::BIGINT AS w, 800::BIGINT AS h, false AS offscreen, true AS enabled, NULL::VARCHAR AS checked, NULL::VARCHAR AS val, false AS protected FROM customer
  UNION ALL
  SELECT c, 'o' || k, 'c' || c, 1, k, CASE WHEN k % 2 = 0 THEN 'list' ELSE 'pane' END, 'Order ' || k, ox, oy, 110 + k % 90, 68 + k % 40, k % 17 = 0, s <> 'F', NULL, s, false FROM ordered
  UNION ALL
  SELECT c, 'l' || k || '-' || n, 'o' || k, 2, n, 'listitem', 'Line ' || n, ox + n * 7, oy + n * 12 + k % 3 * 40, 60, 12, (k + n) % 23 = 0, true, CASE n % 4 WHEN 0 THEN 'checked' WHEN 1 THEN 'unchecked' WHEN 2 THEN 'mixed' END, NULL, false
  FROM lines JOIN ordered USING (k)
  UNION ALL
  SELECT c, 't' || k || '-' || n, 'l' || k || '-' || n, 3, 0, 'text', CASE WHEN n % 3 = 0 THEN 'Line ' || n ELSE 'Qty & more' END, ox + n * 7 + 2, oy + n * 12 + k % 3 * 40 + 1, 50, 10, false, true, NULL, 'v' || n, k % 13 = 0
  FROM lines JOIN ordered USING (k))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes: capture, id, parent, depth, ord, role, label, x, y, w, h, offscreen, enabled, checked, val, protected."""
    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    zero = F.lit(0).cast("bigint")
    names = ["capture", "id", "parent", "depth", "ord", "role", "label", "x", "y", "w", "h", "offscreen", "enabled", "checked", "val", "protected"]

    def node(df: DataFrame, *of) -> DataFrame:
        return df.select(*(c.alias(n) for c, n in zip(of, names)))

    c, k, n = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_linenumber").cast("bigint")
    windows = node(table(spark, sf_dir, "customer"), c, F.concat(F.lit("c"), c), none, F.lit(0), zero, F.lit("window"), F.col("c_name"), zero, zero, F.lit(1200).cast("bigint"), F.lit(800).cast("bigint"), no, yes, none, none, no)
    orders = table(spark, sf_dir, "orders")
    ox, oy, cust = k * 7919 % 1200, k * 104729 % 800, F.col("o_custkey")
    panes = node(
        orders, cust, F.concat(F.lit("o"), k), F.concat(F.lit("c"), cust), F.lit(1), k, F.when(k % 2 == 0, "list").otherwise("pane"), F.concat(F.lit("Order "), k),
        ox, oy, 110 + k % 90, 68 + k % 40, k % 17 == 0, F.col("o_orderstatus") != "F", none, F.col("o_orderstatus"), no,
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == k)
    at = F.concat(k.cast("string"), F.lit("-"), n.cast("string"))
    lx, ly = ox + n * 7, oy + n * 12 + k % 3 * 40
    sixty = lambda v: F.lit(v).cast("bigint")
    checked = F.when(n % 4 == 0, "checked").when(n % 4 == 1, "unchecked").when(n % 4 == 2, "mixed")
    items = node(lines, cust, F.concat(F.lit("l"), at), F.concat(F.lit("o"), k), F.lit(2), n, F.lit("listitem"), F.concat(F.lit("Line "), n), lx, ly, sixty(60), sixty(12), (k + n) % 23 == 0, yes, checked, none, no)
    texts = node(
        lines, cust, F.concat(F.lit("t"), at), F.concat(F.lit("l"), at), F.lit(3), zero, F.lit("text"), F.when(n % 3 == 0, F.concat(F.lit("Line "), n)).otherwise("Qty & more"),
        lx + 2, ly + 1, sixty(50), sixty(10), no, yes, none, F.concat(F.lit("v"), n), k % 13 == 0,
    )
    return windows.unionByName(panes).unionByName(items).unionByName(texts)


# Edges between controls: labelled_by from each order's pane to its first line, and some that dangle.

EDGES_SQL = """edges AS (
  SELECT o_custkey AS capture, 'o' || o_orderkey AS src, 'labelled_by' AS relation, 'l' || o_orderkey || '-1' AS dst FROM orders
  UNION ALL SELECT o_custkey, 'o' || o_orderkey, 'described_by', 'o' || (o_orderkey + 1) FROM orders WHERE o_orderkey % 3 = 0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    src = F.concat(F.lit("o"), k).alias("src")
    labels = orders.select(F.col("o_custkey").alias("capture"), src, F.lit("labelled_by").alias("relation"), F.concat(F.lit("l"), k, F.lit("-1")).alias("dst"))
    told = orders.where(k % 3 == 0).select(F.col("o_custkey").alias("capture"), src, F.lit("described_by").alias("relation"), F.concat(F.lit("o"), k + 1).alias("dst"))
    return labels.unionByName(told)


# Tiles: embeddings as 8 x 8 grey pictures on a background named by the label.

TILES_SQL = """pixels AS (
  SELECT vec_id AS id, label AS bg, k // 8 AS py, k % 8 AS px, v FROM (
    SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS k, least(greatest(floor((unnest(embedding)::DOUBLE + 0.5) * 255), 0), 255)::BIGINT AS v FROM embeddings))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel: id, bg, py, px, v (grey, 0 to 255)."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
    return each.select(F.col("vec_id").alias("id"), F.col("label").alias("bg"), F.floor(F.col("k") / 8).alias("py"), (F.col("k") % 8).cast("bigint").alias("px"), v.cast("bigint").alias("v"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per picture: id, bg, grey (64 values in raster order)."""
    grey = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("bg"), grey.alias("grey"))


# Observations: the number in an event's properties, present or missing for a reason.

OBSERVATIONS_SQL = """observations AS (
  SELECT event_id AS id, event_type AS property, CASE WHEN n % 7 = 0 THEN 'unsupported' WHEN n % 11 = 0 THEN 'redacted' WHEN n IS NULL THEN 'unknown' ELSE 'value' END AS status,
         CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN NULL ELSE n END AS val
  FROM (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS n FROM events))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(n % 7 == 0, "unsupported").when(n % 11 == 0, "redacted").when(n.isNull(), "unknown").otherwise("value")
    value = F.when((n % 7 == 0) | (n % 11 == 0), None).otherwise(n)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("property"), status.alias("status"), value.alias("val"))
