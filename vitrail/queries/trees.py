"""Queries over control trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.operators import trees
from vitrail.plans import inputs

def flatten_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.preorder(inputs.tree(spark, sf_dir)).select("capture", "id", F.col("preorder").cast("bigint").alias("preorder"), "new_id", "depth")


def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = trees.visible(inputs.tree(spark, sf_dir)).where("shown")
    return seen.select("capture", "id", "role", "x", "y", "w", "h")


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.faults(inputs.tree(spark, sf_dir), inputs.edges(spark, sf_dir))


def _described(df: DataFrame) -> DataFrame:
    said = trees.describe(F.col("label"), F.col("role"), protected=F.col("protected"), value=F.col("val"), checked=F.col("checked"), enabled=F.col("enabled"))
    return df.withColumn("description", said)


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(inputs.tree(spark, sf_dir)).select("capture", "id", "description")


def visible_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible controls of each capture with their description, in reading order."""
    seen = trees.visible(inputs.tree(spark, sf_dir), "preorder").where("shown")
    return _described(seen).select("capture", F.col("preorder").cast("bigint").alias("preorder"), "id", "description").orderBy("capture", "preorder")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.outline(_described(trees.visible(inputs.tree(spark, sf_dir))), "description")


def repeated_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.repeated_below(inputs.tree(spark, sf_dir))


def chrome_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.below_role(inputs.tree(spark, sf_dir), ("list",))


def prune_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.prune_dangling(inputs.edges(spark, sf_dir), inputs.tree(spark, sf_dir))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with every third order at 150 % inside a window of its own size."""
    tree = inputs.tree(spark, sf_dir)
    k = F.coalesce(F.regexp_extract("id", r"^[ol](\d+)", 1).try_cast("bigint"), F.lit(1))
    logical = (F.col("depth") == 1) & (k % 3 == 0)
    return tree.withColumn("w", F.when(logical, F.lit(800)).otherwise(F.col("w")).cast("bigint")).withColumn("h", F.when(logical, F.lit(533)).otherwise(F.col("h")).cast("bigint"))


def dpi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = trees.repair_scale(_scaled(spark, sf_dir))
    return fixed.select("capture", "id", *(F.round(c, 6).alias(c) for c in ("rx", "ry", "rw", "rh")), "recovered")


QUERIES = {
    "tree_flatten_preorder": flatten_preorder,
    "tree_visible_items": visible_items,
    "tree_validate": validate,
    "tree_describe": describe,
    "tree_visible_described": visible_described,
    "tree_outline": outline,
    "tree_repeated_below": repeated_below,
    "tree_chrome_set": chrome_set,
    "edges_prune_dangling": prune_dangling,
    "tree_dpi_repair": dpi_repair,
}

_WALK = f"""{inputs.TREE_SQL},
walk AS (
  SELECT t.*, [struct_pack(o := ord, i := id)] AS path FROM tree t WHERE depth = 0
  UNION ALL SELECT t.*, list_append(w.path, struct_pack(o := t.ord, i := t.id)) FROM tree t JOIN walk w ON t.capture = w.capture AND t.parent = w.id)"""
_SEEN = f"""{inputs.TREE_SQL},
seen AS (
  SELECT t.*, NULL::BIGINT AS vx, NULL::BIGINT AS vy, NULL::BIGINT AS vw, NULL::BIGINT AS vh FROM tree t WHERE depth = 0 AND NOT offscreen
  UNION ALL
  SELECT t.*, CASE WHEN s.role IN ('list', 'tree', 'table', 'datagrid') THEN s.x ELSE s.vx END, CASE WHEN s.role IN ('list', 'tree', 'table', 'datagrid') THEN s.y ELSE s.vy END,
         CASE WHEN s.role IN ('list', 'tree', 'table', 'datagrid') THEN s.w ELSE s.vw END, CASE WHEN s.role IN ('list', 'tree', 'table', 'datagrid') THEN s.h ELSE s.vh END
  FROM tree t JOIN seen s ON t.capture = s.capture AND t.parent = s.id
  WHERE NOT t.offscreen AND (CASE WHEN s.role IN ('list', 'tree', 'table', 'datagrid')
    THEN least(t.x + t.w, s.x + s.w) > greatest(t.x, s.x) AND least(t.y + t.h, s.y + s.h) > greatest(t.y, s.y)
    ELSE s.vx IS NULL OR (least(t.x + t.w, s.vx + s.vw) > greatest(t.x, s.vx) AND least(t.y + t.h, s.vy + s.vh) > greatest(t.y, s.vy)) END))"""
_SEEN_ONLY = "seen AS" + _SEEN.split("seen AS", 1)[1]
_SAID = """array_to_string(list_filter([label, role, CASE WHEN protected THEN 'password field' END, CASE WHEN NOT protected AND val IS DISTINCT FROM label THEN val END,
  checked, CASE WHEN NOT enabled THEN 'disabled' END], lambda p: p IS NOT NULL AND p <> ''), ', ')"""
_ESCAPED = f"replace(replace(replace(replace(replace({_SAID}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_NORMAL = "trim(regexp_replace(lower(replace({0}, '&', '')), '\\s+', ' ', 'g'))"
_CLOSURE = f"""{inputs.TREE_SQL},
above AS (SELECT capture, parent AS ancestor, id FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT a.capture, t.parent, a.id FROM above a JOIN tree t ON a.capture = t.capture AND a.ancestor = t.id WHERE t.parent IS NOT NULL)"""

ORACLE_SQL = {
    "tree_flatten_preorder": f"""WITH RECURSIVE {_WALK}, ranked AS (SELECT capture, id, depth, row_number() OVER (PARTITION BY capture ORDER BY path) AS preorder FROM walk)
SELECT capture, id, preorder, 'n' || preorder AS new_id, depth FROM ranked""",
    "tree_visible_items": f"WITH RECURSIVE {_SEEN} SELECT capture, id, role, x, y, w, h FROM seen",
    "tree_validate": f"""WITH {inputs.TREE_SQL}, {inputs.EDGES_SQL}
SELECT capture, 'duplicate id' AS fault, count(*) AS n FROM (SELECT capture, id FROM tree GROUP BY ALL HAVING count(*) > 1) GROUP BY capture
UNION ALL SELECT capture, 'unresolved relationship', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.capture = e.capture AND t.id = e.dst) GROUP BY capture
UNION ALL SELECT capture, 'bad rectangle', count(*) FROM tree WHERE w < 0 OR h < 0 OR x IS NULL GROUP BY capture
UNION ALL SELECT capture, 'too many nodes', count(*) - 5000 FROM tree GROUP BY capture HAVING count(*) > 5000""",
    "tree_describe": f"WITH {inputs.TREE_SQL} SELECT capture, id, {_SAID} AS description FROM tree",
    "tree_visible_described": f"""WITH RECURSIVE {_WALK}, ranked AS (SELECT capture, id, row_number() OVER (PARTITION BY capture ORDER BY path) AS preorder FROM walk),
{_SEEN_ONLY}
SELECT s.capture, preorder, s.id, {_SAID} AS description FROM seen s JOIN ranked r ON s.capture = r.capture AND s.id = r.id""",
    "tree_outline": f"""WITH RECURSIVE {_SEEN},
d3 AS (SELECT capture, parent AS id, string_agg('<li>' || {_ESCAPED} || '</li>', '' ORDER BY ord, id) AS inner_html FROM seen WHERE depth = 3 GROUP BY capture, parent),
d2 AS (SELECT capture, parent AS id, string_agg('<li>' || {_ESCAPED} || coalesce('<ul>' || inner_html || '</ul>', '') || '</li>', '' ORDER BY ord, id) AS inner_html FROM seen LEFT JOIN d3 USING (capture, id) WHERE depth = 2 GROUP BY capture, parent),
d1 AS (SELECT capture, parent AS id, string_agg('<li>' || {_ESCAPED} || coalesce('<ul>' || inner_html || '</ul>', '') || '</li>', '' ORDER BY ord, id) AS inner_html FROM seen LEFT JOIN d2 USING (capture, id) WHERE depth = 1 GROUP BY capture, parent)
SELECT capture, '<ul><li>' || {_ESCAPED} || coalesce('<ul>' || inner_html || '</ul>', '') || '</li></ul>' AS html FROM seen LEFT JOIN d1 USING (capture, id) WHERE depth = 0""",
    "tree_repeated_below": f"""WITH RECURSIVE {_CLOSURE}
SELECT DISTINCT t.capture, t.id FROM tree t JOIN above a ON a.capture = t.capture AND a.ancestor = t.id JOIN tree c ON c.capture = a.capture AND c.id = a.id
WHERE c.role IN ('listitem', 'text', 'button') AND {_NORMAL.format("t.label")} = {_NORMAL.format("c.label")} AND {_NORMAL.format("t.label")} <> ''""",
    "tree_chrome_set": f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT a.capture, a.id FROM above a JOIN tree t ON a.capture = t.capture AND a.ancestor = t.id WHERE t.role = 'list'",
    "edges_prune_dangling": f"WITH {inputs.TREE_SQL}, {inputs.EDGES_SQL} SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM tree t WHERE t.capture = e.capture AND t.id = e.dst)",
    "tree_dpi_repair": f"""WITH {inputs.TREE_SQL},
scaled AS (SELECT capture, id, parent, depth, role, x, y, CASE WHEN depth = 1 AND try_cast(substr(id, 2) AS BIGINT) % 3 = 0 THEN 800 ELSE w END AS w, CASE WHEN depth = 1 AND try_cast(substr(id, 2) AS BIGINT) % 3 = 0 THEN 533 ELSE h END AS h FROM tree),
p AS (SELECT *, depth = 1 AND abs(1200 - w * 1.5) <= 2 AND abs(800 - h * 1.5) <= 2 AS fix FROM scaled),
placed AS (
  SELECT capture, id, x, y, w, h, x::DOUBLE AS rx, y::DOUBLE AS ry, w::DOUBLE AS rw, h::DOUBLE AS rh FROM p WHERE depth = 0
  UNION ALL SELECT capture, id, x, y, w, h, CASE WHEN fix THEN 0 ELSE x END, CASE WHEN fix THEN 0 ELSE y END, CASE WHEN fix THEN 1200 ELSE w END, CASE WHEN fix THEN 800 ELSE h END FROM p WHERE depth = 1
  UNION ALL SELECT c.capture, c.id, c.x, c.y, c.w, c.h, CASE WHEN u.fix THEN c.x * 1.5 - u.x * 1.5 ELSE c.x END, CASE WHEN u.fix THEN c.y * 1.5 - u.y * 1.5 ELSE c.y END,
    CASE WHEN u.fix THEN c.w * 1.5 ELSE c.w END, CASE WHEN u.fix THEN c.h * 1.5 ELSE c.h END FROM p c JOIN p m ON c.capture = m.capture AND m.id = CASE WHEN c.depth = 3 THEN c.parent ELSE c.id END JOIN p u ON u.capture = m.capture AND m.parent = u.id WHERE c.depth >= 2)
SELECT capture, id, round(rx, 6) AS rx, round(ry, 6) AS ry, round(rw, 6) AS rw, round(rh, 6) AS rh, rx <> x OR ry <> y OR rw <> w OR rh <> h AS recovered FROM placed""",
}
