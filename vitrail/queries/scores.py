"""Queries over scores, observations, providers and drawn pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions import geometry, text
from vitrail.operators import native, score, trees
from vitrail.plans import inputs


def observation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by property: how many have a value, for what reasons the others have none."""
    rows = inputs.observations(spark, sf_dir).select("property", text.observation(F.col("status"), F.col("val")).alias("o"))
    return rows.groupBy("property", F.col("o.status").alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("o.value"), F.lit(0)).alias("total"))


def field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundred of observations as one control's properties: its states, and the reasons for those it lacks."""
    rows = inputs.observations(spark, sf_dir).withColumn("control", F.floor(F.col("id") / 100))
    one = rows.groupBy("control", "property").agg(F.max_by(F.struct("status", "val"), "id").alias("o"))
    pairs = one.groupBy("control").agg(F.map_from_entries(F.collect_list(F.struct("property", F.struct(F.col("o.status").alias("status"), F.col("o.val").alias("value"))))).alias("m"))
    said = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    return pairs.select("control", said(text.states(F.col("m"))).alias("states"), said(text.field_status(F.col("m"))).alias("field_status"))


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers' views of each capture: one tells all but every fifth name, the other all but half of the items."""
    tree = inputs.tree(spark, sf_dir)
    k = F.col("ord")
    none = F.array().cast("array<string>")
    one = tree.withColumn("provider", F.lit("uia")).withColumn("label", F.when(k % 5 == 0, "").otherwise(F.col("label"))).withColumn("lines", none)
    two = tree.where((F.col("depth") != 2) | (k % 2 == 0)).withColumn("provider", F.lit("msaa")).withColumn("lines", F.when(F.col("depth") == 1, F.array("label")).otherwise(none))
    return score.choose_provider(score.provider_scores(one.unionByName(two)))


def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    part = lambda n: (k * n % 101) / 100.0
    parts = {"edges": part(7), "appearance": part(11), "precision": part(13), "imagery": F.when(k % 3 != 0, part(17)), "text": F.when(k % 4 != 0, part(19)), "layout": F.when(k % 5 != 0, part(23))}
    return p.select(k.alias("id"), score.weighted(parts, digits=9).alias("score"))


def report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    part = lambda n: (k * n % 101) / 100.0
    told = score.warnings(part(7), F.when(k % 3 != 0, part(11)), F.when(k % 4 != 0, part(13)), k % 6 == 0, part(17))
    return p.select(k.alias("id"), F.array_join(told, " / ").alias("warnings"))


def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and headings of pages, escaped, with the page's text length without tags."""
    pages = inputs.table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    bare = F.regexp_replace("html", "<[a-zA-Z/!][^>]*>", "")
    return pages.select("page_id", trees.html_escape(F.array_join(links, ";")).alias("links"), F.char_length(bare).cast("bigint").alias("chars"))


def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    colour = lambda n: geometry.hex_colour(k * n % 256, k * (n + 2) % 256, k * (n + 4) % 256)
    made = inputs.table(spark, sf_dir, "part").select(k.alias("id"), colour(7).alias("front"), colour(31).alias("back"))
    return made.select("id", "front", "back", F.round(geometry.contrast_ratio(F.col("front"), F.col("back")), 4).alias("ratio"), geometry.readable(F.col("front"), F.col("back")).alias("drawn"))


def role_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("push button", "AXButton", "entry", "AXRow", "unknown thing")))
    k = F.col("p_partkey")
    rows = inputs.table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "atspi").otherwise("ax").alias("provider"), F.get(names, (k % 5).cast("int")).alias("native"))
    return native.with_roles(rows).select("id", "provider", "native", "role")


def native_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees as a collector's raw ones: renumbered, at twice the size and shifted, protected values dropped."""
    tree = inputs.tree(spark, sf_dir).withColumn("value", F.col("val")).withColumn("text", F.col("label"))
    matrix = F.array(*(F.lit(v) for v in (2.0, 0.0, 0.0, 2.0, -10.0, 5.0)))
    nodes, _ = native.normalise(tree, inputs.edges(spark, sf_dir), matrix)
    return nodes.select("capture", "id", "parent", "x", "y", "w", "h", F.coalesce("value", F.lit("-")).alias("value"), F.coalesce("text", F.lit("-")).alias("text"))


def local_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark sentences against copies with a word changed, a word before them, or none of both."""
    b = inputs.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"))
    other = F.when(F.col("item_id") % 3 == 0, F.regexp_replace("source", "^\\w+", "Xyzzy")).when(F.col("item_id") % 3 == 1, F.concat(F.lit("OK "), "source")).otherwise(F.upper("source"))
    return score.local_text_checks(b.withColumn("rendered", other)).select("item_id", "ratio", "fault")


def fidelity_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright tiles of each picture merged into rectangles."""
    tiles = inputs.pixels(spark, sf_dir).select(F.col("id").alias("capture"), F.col("py").alias("ty"), F.col("px").alias("tx"), (F.col("v") > 150).alias("bad"))
    return score.merge_bad_tiles(tiles)


QUERIES = {
    "observation_status": observation_status,
    "field_status": field_status,
    "provider_score_choice": provider_choice,
    "score_weighted": score_weighted,
    "report_warnings": report_warnings,
    "html_outline": html_outline,
    "colour_contrast": contrast,
    "role_mapping": role_mapping,
    "native_normalised": native_normalised,
    "local_text_checks": local_text,
    "fidelity_regions": fidelity_regions,
}

_P = "p_partkey * {0} % 101 / 100.0::DOUBLE"
_LUM = "(0.2126::DOUBLE * {0} + 0.7152::DOUBLE * {1} + 0.0722::DOUBLE * {2})"
_LIN = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _lum(n: int) -> str:
    return _LUM.format(*(_LIN.format(f"(p_partkey * {m} % 256)") for m in (n, n + 2, n + 4)))


_HEX = "printf('#%02x%02x%02x', p_partkey * {0} % 256, p_partkey * {1} % 256, p_partkey * {2} % 256)"
_POINTS = "(CASE WHEN trim(label) <> '' AND role NOT IN ('window', 'pane', 'group', 'custom', 'list', 'tree', 'table', 'datagrid', 'document') THEN 3 ELSE 0 END + CASE WHEN role IN ('text', 'edit') THEN 1 ELSE 0 END + 4 * lines)"
_WALKED = f"""{inputs.TREE_SQL}, walk AS (
  SELECT t.*, [struct_pack(o := ord, i := id)] AS path FROM tree t WHERE depth = 0
  UNION ALL SELECT t.*, list_append(w.path, struct_pack(o := t.ord, i := t.id)) FROM tree t JOIN walk w ON t.capture = w.capture AND t.parent = w.id),
named AS (SELECT *, 'n' || row_number() OVER (PARTITION BY capture ORDER BY path) AS new_id FROM walk)"""
ORACLE_SQL = {
    "observation_status": f"WITH {inputs.OBSERVATIONS_SQL} SELECT property, status, count(*) AS n, coalesce(sum(val), 0)::BIGINT AS total FROM observations GROUP BY 1, 2",
    "field_status": f"""WITH {inputs.OBSERVATIONS_SQL}, one AS (SELECT id // 100 AS control, property, arg_max(struct_pack(status := status, val := val), id) AS o FROM observations GROUP BY 1, 2)
SELECT control, coalesce(string_agg(property || '=' || o.val, ';' ORDER BY property) FILTER (o.status = 'value'), '') AS states,
  coalesce(string_agg(property || '=' || o.status, ';' ORDER BY property) FILTER (o.status <> 'value'), '') AS field_status FROM one GROUP BY control""",
    "provider_score_choice": f"""WITH {inputs.TREE_SQL}, seen AS (
  SELECT capture, 'uia' AS provider, role, CASE WHEN ord % 5 = 0 THEN '' ELSE label END AS label, offscreen, 0 AS lines FROM tree
  UNION ALL SELECT capture, 'msaa', role, label, offscreen, CASE WHEN depth = 1 THEN 1 ELSE 0 END FROM tree WHERE depth <> 2 OR ord % 2 = 0),
s AS (SELECT capture, provider, sum(CASE WHEN NOT offscreen THEN {_POINTS} ELSE 0 END)::BIGINT AS score FROM seen GROUP BY 1, 2)
SELECT capture, provider, score FROM s QUALIFY row_number() OVER (PARTITION BY capture ORDER BY score DESC, provider DESC) = 1""",
    "score_weighted": f"""SELECT p_partkey AS id, round(list_sum(list_transform(list_filter([(v1, 0.25), (v2, 0.15), (v3, 0.1), (v4, 0.25), (v5, 0.25), (v6, 0.2)], lambda p: p[1] IS NOT NULL), lambda p: p[1] * p[2]::DOUBLE))
  / list_sum(list_transform(list_filter([(v1, 0.25), (v2, 0.15), (v3, 0.1), (v4, 0.25), (v5, 0.25), (v6, 0.2)], lambda p: p[1] IS NOT NULL), lambda p: p[2]::DOUBLE)), 9) AS score
FROM (SELECT p_partkey, {_P.format(7)} AS v1, {_P.format(11)} AS v2, {_P.format(13)} AS v3, CASE WHEN p_partkey % 3 <> 0 THEN {_P.format(17)} END AS v4, CASE WHEN p_partkey % 4 <> 0 THEN {_P.format(19)} END AS v5, CASE WHEN p_partkey % 5 <> 0 THEN {_P.format(23)} END AS v6 FROM part)""",
    "report_warnings": f"""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN {_P.format(7)} < 0.65 THEN 'Many source edges are missing or displaced' END,
  CASE WHEN p_partkey % 3 <> 0 AND {_P.format(11)} < 0.8 THEN 'Rendered text is not reliably readable by OCR' END, CASE WHEN p_partkey % 4 <> 0 AND {_P.format(13)} < 0.85 THEN 'Text visible in the input is missing or changed in the SVG' END,
  CASE WHEN p_partkey % 6 = 0 THEN 'Known fixture elements were missed' END, CASE WHEN {_P.format(17)} > 0.25 THEN 'Large regions use source-image fallback; editability is limited' END], lambda x: x IS NOT NULL), ' / ') AS warnings FROM part""",
    "html_outline": r"""SELECT page_id, replace(replace(replace(replace(replace(array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ';'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS links,
  length(regexp_replace(html, '<[a-zA-Z/!][^>]*>', '', 'g')) AS chars FROM pages""",
    "colour_contrast": f"""WITH l AS (SELECT p_partkey AS id, {_HEX.format(7, 9, 11)} AS front, {_HEX.format(31, 33, 35)} AS back, {_lum(7)} AS lf, {_lum(31)} AS lb FROM part),
r AS (SELECT *, (greatest(lf, lb) + 0.05) / (least(lf, lb) + 0.05) AS ratio FROM l)
SELECT id, front, back, round(ratio, 4) AS ratio, CASE WHEN ratio >= 4.4 THEN front WHEN (lb + 0.05) / 0.05 >= 1.05 / (lb + 0.05) THEN '#171717' ELSE '#ffffff' END AS drawn FROM r""",
    "role_mapping": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'atspi' ELSE 'ax' END AS provider, ['push button', 'AXButton', 'entry', 'AXRow', 'unknown thing'][p_partkey % 5 + 1] AS native,
  CASE WHEN p_partkey % 10 = 0 THEN 'button' WHEN p_partkey % 10 = 2 THEN 'edit' WHEN p_partkey % 10 = 1 THEN 'button' WHEN p_partkey % 10 = 3 THEN 'dataitem' ELSE 'custom' END AS role FROM part""",
    "native_normalised": f"""WITH RECURSIVE {_WALKED}
SELECT n.capture, n.new_id AS id, p.new_id AS parent, n.x * 2.0::DOUBLE - 10 AS x, n.y * 2.0::DOUBLE + 5 AS y, n.w * 2.0::DOUBLE AS w, n.h * 2.0::DOUBLE AS h,
  CASE WHEN n.protected THEN '-' ELSE coalesce(n.val, '-') END AS value, CASE WHEN n.protected THEN '-' ELSE n.label END AS text FROM named n LEFT JOIN named p ON n.capture = p.capture AND n.parent = p.id""",
}
