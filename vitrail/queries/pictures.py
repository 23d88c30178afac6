"""Queries over pictures and the icon catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.operators import catalog, pictures
from vitrail.plans import inputs

PALETTE = [0, 64, 128, 192, 255]


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.dominant(inputs.pixels(spark, sf_dir), ["id"])


def border_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.border_background(inputs.pixels(spark, sf_dir), 8)


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.ink(inputs.pixels(spark, sf_dir), 8)


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pictures.percentiles(inputs.pixels(spark, sf_dir), ["id"])
    return made.select("id", *(F.round(c, 4).alias(c) for c in ("p50", "p88", "p95", "mean", "std")), "ptp")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.tiles(spark, sf_dir).select("id", pictures.fingerprint(F.col("grey")).alias("mean"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.tiles(spark, sf_dir).select("id", pictures.digest(F.col("bg"), F.lit(8), F.lit(8), F.col("grey")).alias("hash"))


def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures cropped to sizes by their id, paired where they can match."""
    icons = inputs.tiles(spark, sf_dir).select("id", "bg", (16 + F.col("id") % 24).cast("int").alias("width"), (16 + F.col("id") % 7).cast("int").alias("height"), pictures.fingerprint(F.col("grey")).alias("mean"))
    return catalog.block_candidates(icons)


def icon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of two grey levels in order of their id, on a background by their label; each is followed by a slightly brighter copy."""
    tiles = inputs.tiles(spark, sf_dir).withColumn("bg", F.concat(F.lit("#"), F.lpad(F.hex(F.col("bg") * 16), 2, "0"), F.lit("0000")))
    both = tiles.select("*", F.explode(F.array(F.lit(0), F.lit(2))).alias("more"))
    grey = F.transform("grey", lambda v: F.least(F.floor(v / 128) * 200 + F.col("more"), F.lit(255)))
    hexed = F.array_join(F.transform(grey, lambda v: F.repeat(F.lpad(F.hex(v.cast("bigint")), 2, "0"), F.lit(3))), "")
    icons = both.select(
        (F.col("id") * 4 + F.col("more")).alias("seq"), F.sha2(F.concat("bg", hexed), 256).alias("hash"), F.lower("bg").alias("background"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("channels"), F.unhex(hexed).alias("pixels"),
    )
    return catalog.assign_groups(icons)


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.palette_histogram(inputs.pixels(spark, sf_dir), PALETTE)


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.complexity(inputs.pixels(spark, sf_dir))


def components_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.components(inputs.tiles(spark, sf_dir), 8).drop("component")


def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.components(inputs.tiles(spark, sf_dir), 8, eight=True).drop("component")


def error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.pixels(spark, sf_dir)
    other = pixels.withColumn("v", F.when(F.col("id") % 3 == 0, 255 - F.col("v")).otherwise(F.col("v") + F.col("px")))
    made = pictures.tile_means(pixels, other, 4)
    return made.select("id", "ty", "tx", F.round("error", 6).alias("error"), (F.col("error") > 6).alias("bad"))


def shared_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pictures.shared_definitions(inputs.tiles(spark, sf_dir))
    return made.select("id", "uses", F.coalesce(F.col("definition").cast("bigint"), F.lit(-1)).alias("definition"))


def _bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("hash"), (F.col("doc_id") % 97).alias("group_id"))


def names_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), F.col("lang").alias("name"))
    made = catalog.values_of_groups(names, _bitmaps(spark, sf_dir), "name")
    return made.select("group_id", F.array_join("names", ";").alias("names"))


def sources_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), F.col("source").alias("image"))
    made = catalog.values_of_groups(images, _bitmaps(spark, sf_dir), "image")
    return made.select("group_id", F.array_join("images", ";").alias("images"))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("hash"), F.col("source").alias("name"))
    return catalog.insert_ignore(docs.where("hash % 3 <> 0"), docs.withColumn("name", F.upper("name")), ["hash"])


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.table(spark, sf_dir, "labels").select((F.col("doc_id") % 200).alias("group_id"), F.col("quality").alias("status"), F.col("doc_id").alias("seq"))
    return catalog.upsert(labels.where("seq % 2 = 0"), labels.where("seq % 2 = 1"), ["group_id"], "seq")


QUERIES = {
    "tile_dominant_value": dominant,
    "tile_border_background": border_background,
    "tile_ink": ink,
    "tile_percentiles": percentiles,
    "tile_fingerprint": fingerprint,
    "tile_hash": digest,
    "icon_block_candidates": block_candidates,
    "icon_groups_replay": icon_groups,
    "palette_assign": palette,
    "mask_complexity": complexity,
    "components_4": components_4,
    "components_8": components_8,
    "tile_error_grid": error_grid,
    "svg_shared_defs": shared_defs,
    "catalog_names_join": names_join,
    "catalog_sources_join": sources_join,
    "catalog_insert_ignore": insert_ignore,
    "catalog_upsert": upsert,
}

_T = f"WITH {inputs.TILES_SQL}"
_R = f"WITH RECURSIVE {inputs.TILES_SQL}"
_EDGE = "py IN (0, 7) OR px IN (0, 7)"
_GREY = "greys AS (SELECT id, bg, list(v ORDER BY py, px) AS grey FROM pixels GROUP BY id, bg)"


def _components(near: str) -> str:
    return f"""{_R}, m AS (SELECT id, py * 8 + px AS k, py, px FROM pixels WHERE v >= 128),
reach AS (SELECT id, k, k AS root FROM m UNION SELECT b.id, b.k, r.root FROM reach r JOIN m a ON a.id = r.id AND a.k = r.k JOIN m b ON b.id = a.id AND {near}),
own AS (SELECT id, k, min(root) AS root FROM reach GROUP BY id, k)
SELECT o.id, min(px) AS x, min(py) AS y, max(px) - min(px) + 1 AS w, max(py) - min(py) + 1 AS h, count(*) AS pixels FROM own o JOIN m ON m.id = o.id AND m.k = o.k GROUP BY o.id, root"""


_SQUARES = ", ".join(f"(v - {p}) * (v - {p})" for p in PALETTE)
ORACLE_SQL = {
    "tile_dominant_value": f"{_T}, c AS (SELECT id, v // 16 AS coarse, count(*) AS n, median(v) AS median FROM pixels GROUP BY 1, 2) SELECT id, coarse, n, median FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, coarse) = 1",
    "tile_border_background": f"""{_T}, e AS (SELECT id, v FROM pixels WHERE {_EDGE}), c AS (SELECT id, v, count(*) AS n FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, v) = 1)
SELECT id, CASE WHEN n >= 3 THEN v::DOUBLE ELSE m END AS background FROM c JOIN (SELECT id, median(v) AS m FROM e GROUP BY id) USING (id)""",
    "tile_ink": f"""{_T}, e AS (SELECT id, median(v) AS edge FROM pixels WHERE {_EDGE} GROUP BY id), m AS (SELECT id, median(v) AS mid FROM pixels GROUP BY id), j AS (SELECT * FROM pixels JOIN e USING (id) JOIN m USING (id))
SELECT id, arg_max(v, (abs(v - edge), -py, -px)) AS ink, min(px) FILTER (abs(v - mid) > 45) AS x, min(py) FILTER (abs(v - mid) > 45) AS y,
  max(px) FILTER (abs(v - mid) > 45) - min(px) FILTER (abs(v - mid) > 45) + 1 AS w, max(py) FILTER (abs(v - mid) > 45) - min(py) FILTER (abs(v - mid) > 45) + 1 AS h FROM j GROUP BY id""",
    "tile_percentiles": f"{_T} SELECT id, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.88), 4) AS p88, round(quantile_cont(v, 0.95), 4) AS p95, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, max(v) - min(v) AS ptp FROM pixels GROUP BY id",
    "tile_fingerprint": f"{_T} SELECT id, round_even(sum(v) / 64.0, 0)::INTEGER AS mean FROM pixels GROUP BY id",
    "tile_hash": f"{_T}, {_GREY} SELECT id, sha256(bg || '|8|8|' || array_to_string(grey, ',')) AS hash FROM greys",
    "icon_block_candidates": f"""{_T}, i AS (SELECT id, bg, 16 + id % 24 AS w, 16 + id % 7 AS h, round_even(sum(v) / 64.0, 0) AS mean FROM pixels GROUP BY id, bg)
SELECT a.id AS a, b.id AS b, a.bg FROM i a JOIN i b ON a.bg = b.bg AND a.id < b.id AND abs(a.w - b.w) <= 1 AND abs(a.h - b.h) <= 1
WHERE abs(a.mean - b.mean) <= 10 + 255 * ((1 + greatest(0, a.w - b.w)) / a.w + (1 + greatest(0, a.h - b.h)) / a.h + (1 + greatest(0, b.w - a.w)) / b.w + (1 + greatest(0, b.h - a.h)) / b.h)""",
    "palette_assign": f"{_T}, e AS (SELECT id, list_position([{_SQUARES}], list_min([{_SQUARES}])) - 1 AS entry FROM pixels), i AS (SELECT DISTINCT id FROM pixels) SELECT i.id, k.k::INTEGER AS entry, count(e.id) AS n FROM i CROSS JOIN range({len(PALETTE)}) k(k) LEFT JOIN e ON e.id = i.id AND e.entry = k.k GROUP BY ALL",
    "mask_complexity": f"""{_T}, m AS (SELECT id, py, px FROM pixels WHERE v > 127), g AS (SELECT id, py + dy AS gy, px + dx AS gx, sum(1 << (2 * dy + dx))::BIGINT AS cells FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) GROUP BY ALL),
s AS (SELECT id, vertical, py + CASE WHEN vertical = 1 THEN 0 ELSE d END AS sy, px + CASE WHEN vertical = 1 THEN d ELSE 0 END AS sx FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(vertical, d) GROUP BY ALL HAVING count(*) = 1)
SELECT id, corners, perimeter FROM (SELECT id, sum(CASE WHEN bit_count(cells) IN (1, 3) THEN 1 WHEN cells IN (6, 9) THEN 2 ELSE 0 END)::BIGINT AS corners FROM g GROUP BY id) JOIN (SELECT id, count(*) AS perimeter FROM s GROUP BY id) USING (id)""",
    "components_4": _components("((a.py = b.py AND abs(a.px - b.px) = 1) OR (a.px = b.px AND abs(a.py - b.py) = 1))"),
    "components_8": _components("abs(a.py - b.py) <= 1 AND abs(a.px - b.px) <= 1"),
    "tile_error_grid": f"""{_T}, d AS (SELECT id, py // 4 AS ty, px // 4 AS tx, abs(v - CASE WHEN id % 3 = 0 THEN 255 - v ELSE v + px END) AS e FROM pixels)
SELECT id, ty, tx, round(avg(e), 6) AS error, avg(e) > 6 AS bad FROM d GROUP BY id, ty, tx""",
    "svg_shared_defs": f"""{_T}, k AS (SELECT id, bg || '|' || string_agg((v // 128)::VARCHAR, ',' ORDER BY py, px) AS key FROM pixels GROUP BY id, bg), g AS (SELECT key, count(*) AS uses, min(id) AS first FROM k GROUP BY key),
d AS (SELECT key, row_number() OVER (ORDER BY first) - 1 AS definition FROM g WHERE uses > 1) SELECT k.id, uses, coalesce(definition, -1) AS definition FROM k JOIN g USING (key) LEFT JOIN d USING (key)""",
    "catalog_names_join": "SELECT doc_id % 97 AS group_id, string_agg(DISTINCT lang, ';' ORDER BY lang) AS names FROM documents GROUP BY 1",
    "catalog_sources_join": "SELECT doc_id % 97 AS group_id, string_agg(DISTINCT source, ';' ORDER BY source) AS images FROM documents GROUP BY 1",
    "catalog_insert_ignore": "SELECT doc_id AS hash, CASE WHEN doc_id % 3 <> 0 THEN source ELSE upper(source) END AS name FROM documents",
    "catalog_upsert": "SELECT doc_id % 200 AS group_id, quality AS status, doc_id AS seq FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id % 200 ORDER BY doc_id DESC) = 1",
}
