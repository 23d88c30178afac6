"""Queries over merging, pruning and naming, over texts' functions, documents, snapshots and the catalogue's states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions import geometry, text
from vitrail.functions.geometry import Box
from vitrail.operators import catalog, pictures, reconcile, svg, trees, words
from vitrail.plans import inputs
from vitrail.plans.markings import marks, sql
from vitrail.queries import trees as tree_queries
from vitrail.sources import captures, png
from vitrail.sources.snapshots import OWN

c = F.col


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir, "texts").select("capture", "id", "x", "y", "w", "h", "conf", "text")


def text_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text read again, surer by up to 0.39."""
    texts = _texts(spark, sf_dir)
    again = texts.where("id % 2 = 0").withColumn("conf", c("conf") + c("id") % 40 / 100.0).withColumn("text", F.concat(F.lit("again "), c("text"))).withColumn("x", c("x") + 1)
    return reconcile.refined(texts, again).withColumn("conf", F.round("conf", 6))


def text_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return reconcile.overridden(texts.where("id % 2 = 0"), texts.where("id % 2 = 1")).select("capture", "id", "text")


def panel_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = inputs.boxes(spark, sf_dir).withColumn("kind", F.expr("CASE WHEN id % 2 = 0 THEN 'rect' ELSE 'outline' END"))
    panels = shapes.where("id % 5 = 0").select("capture", "id", (c("x") - 1).alias("x"), (c("y") - 1).alias("y"), (c("w") + c("id") % 7).alias("w"), (c("h") + 2).alias("h"))
    return reconcile.without_panel_copies(shapes, panels).select("capture", "id", "kind")


def button_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = inputs.boxes(spark, sf_dir)
    crops = boxes.withColumn("kind", F.expr("CASE WHEN id % 3 = 0 THEN 'raster' ELSE 'rect' END")).withColumn("w", c("w") * 2).withColumn("edge", c("id") % 50)
    inner = boxes.where("id % 4 <> 1").select("capture", c("id"), (c("x") + 3).alias("x"), (c("y") + 3).alias("y"), F.lit(10).cast("bigint").alias("w"), F.lit(6).cast("bigint").alias("h"))
    return reconcile.promoted_buttons(crops, inner).select("capture", "id", "kind")


def table_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).select("capture", "id", "x", "y", "w", "h", "text")
    tables = inputs.boxes(spark, sf_dir).where("id % 10 = 0").withColumn("w", c("w") * 3).withColumn("h", c("h") * 3)
    cells = texts.where("id % 10 = 0").withColumn("text", F.concat(F.lit("cell "), c("text"))).withColumn("id", -c("id") - 1)
    return reconcile.table_replaced(texts, tables, cells).select("capture", "id", "text")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts that a sure label contains."""
    texts = _texts(spark, sf_dir).withColumn("text", F.expr("CASE WHEN id % 3 = 0 THEN 'Lab' WHEN id % 3 = 1 THEN '|ap.' ELSE text END"))
    labels = _texts(spark, sf_dir).withColumn("x", c("x") - 5).withColumn("w", c("w") + 20).withColumn("h", c("h") + 4)
    return words.covered_fragments(texts, labels)


_SCENE = "CASE id % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'outline' WHEN 2 THEN 'header-icon' WHEN 3 THEN 'button' WHEN 4 THEN 'raster' WHEN 5 THEN 'input-field' WHEN 6 THEN 'text' WHEN 7 THEN 'rect' ELSE 'tab' END"
_ROLES = "CASE id % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'authoritative' WHEN 2 THEN 'artwork' WHEN 3 THEN 'scrollbar' WHEN 4 THEN 'caption-button' WHEN 5 THEN 'password' ELSE 'control' END"


def prune_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = inputs.boxes(spark, sf_dir)
    nodes = boxes.withColumn("kind", F.expr(_SCENE)).withColumn("leaf", c("id") % 4 > 0)
    regions = boxes.select("capture", "id", F.expr(_ROLES).alias("role"), (c("x") - 3).alias("x"), (c("y") - 2).alias("y"), (c("w") + 4).alias("w"), (c("h") + 4).alias("h"))
    return reconcile.prune_rules(nodes, regions, boxes.where("id % 23 = 0").select("capture", "id"))


def artwork_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = inputs.boxes(spark, sf_dir)
    controls = boxes.select("capture", "id", F.expr("CASE WHEN id % 3 = 0 THEN 'image' ELSE 'pane' END").alias("role"), F.expr("CASE WHEN id % 4 = 0 THEN ' ' ELSE concat(' pic ', CAST(id % 50 AS STRING)) END").alias("label"), (c("id") % 11 == 0).alias("protected"), "x", "y", "w", "h")
    return reconcile.named_artwork(boxes.where("id % 2 = 1"), controls).select("capture", "id", F.coalesce("name", F.lit("-")).alias("name"))


def box_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near and strict meeting of each box with a fixed one, and its corner under an affine map and back."""
    fixed = Box(F.lit(300), F.lit(200), F.lit(60), F.lit(30))
    box, m = Box.of(), F.array(*(F.lit(v) for v in (2.0, 0.0, 0.0, 4.0, -10.0, 5.0)))
    x, y = geometry.affine(box.x, box.y, m)
    back = geometry.unmapped(x, y, m)
    return inputs.boxes(spark, sf_dir).select(
        "capture", "id", geometry.near(fixed, box, 200).alias("near"), geometry.intersects(box, fixed).alias("meets"), x.alias("mx"), y.alias("my"), F.round(back[0], 6).alias("bx"), F.round(back[1], 6).alias("by")
    )


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window names, cut texts, styles, numbers and vector paths made from parts."""
    k = c("p_partkey")
    name = F.concat(F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Administrator: ' WHEN p_partkey % 3 = 1 THEN 'Select: ' ELSE '' END"), c("p_name"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN ' window' ELSE '' END"))
    raw = F.concat(F.lit("fg-color:"), (k * 257 % 65536).cast("string"), F.lit(",0,"), (k * 7 % 65536).cast("string"), F.lit(";size:"), (k % 30).cast("string"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN ';style:italic' ELSE ';weight:700' END"))
    style = text.style(raw)
    path = F.concat(F.lit("M"), (k % 90).cast("string"), F.lit(",-"), (k % 7).cast("string"), F.lit(".5L3 4Z"))
    icon = F.when(k % 3 == 0, " ").when(k % 3 == 1, "a").otherwise(" ")
    return inputs.table(spark, sf_dir, "part").select(
        k.alias("id"), text.shell_name(name).alias("shell"), text.truncated(c("p_name"), F.lit(7.0), (k % 200).cast("double")).alias("cut"), style["color"].alias("color"), style["size"].alias("size"), F.coalesce(style["weight"], F.lit(0)).alias("weight"),
        F.coalesce(style["italic"], F.lit(False)).alias("italic"), text.significant(k / 8.0 - 20, 3).alias("number"), F.array_join(text.path_tokens(path), " ").alias("tokens"), F.char_length(text.bounded(c("p_name"), 9)).alias("bounded"),
        text.icon_text(icon).alias("icon"), text.ellipsis_match(F.concat(F.substring("p_name", 1, 7), F.lit("...")), F.concat(c("p_name"), F.lit("x"))).alias("ellipsis"),
    )


def role_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    role = F.when(k % 4 == 0, "pane").when(k % 4 == 1, "")
    return inputs.table(spark, sf_dir, "part").select(k.alias("id"), trees.role_of(role, (49998 + k % 45).cast("int")).alias("role"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window titles as file names, with a number from the second of equal ones on."""
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", F.split("url", "/").alias("p"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    titles = pages.withColumn("title", F.concat(F.get("p", F.lit(2)), F.lit(": "), F.get("p", F.lit(3))))
    return captures.capture_names(titles, "title", "at", "page_id").select("page_id", "file")


def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return words.retry(texts.where("conf > 0.6 AND capture % 5 > 0"), texts.where("id % 3 = 0"), ["capture"]).select("capture", "id", "text")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE id % 6 WHEN 0 THEN 'rect' WHEN 1 THEN 'text' WHEN 2 THEN 'radio' WHEN 3 THEN 'selected-row' WHEN 4 THEN 'outlined-button' ELSE 'close-icon' END")
    back = F.expr("CASE WHEN id % 12 = 4 THEN NULL WHEN id % 5 = 0 THEN '' ELSE concat('#2', CAST(10000 + id % 89999 AS STRING)) END")
    return inputs.boxes(spark, sf_dir).select("capture", c("id").alias("ord"), kind.alias("kind"), "x", "y", "w", "h", F.expr("concat('#1', CAST(10000 + id % 89999 AS STRING))").alias("color"), back.alias("background"), F.concat(F.lit("A & "), c("id") % 9).alias("text"))


def svg_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg.surfaces_under(_kinds(spark, sf_dir)).select("capture", "ord", "surface")


def svg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each capture's drawing."""
    nodes = _kinds(spark, sf_dir).where("kind IN ('rect', 'radio', 'close-icon')")
    sizes = nodes.select("capture").distinct().withColumn("width", F.lit(1200)).withColumn("height", F.lit(800))
    return svg.to_svg(nodes, sizes).select("capture", F.md5("svg").alias("digest"), F.char_length("svg").alias("chars"))


def semantic_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree over a drawing of its own, with its hidden texts."""
    seen = tree_queries._described(trees.visible(inputs.tree(spark, sf_dir)))
    nodes = seen.select("capture", "id", "parent", "depth", "ord", "role", c("description").alias("label"), "shown", "x", "y", "w", "h", F.when(c("role") == "text", F.array("label")).alias("said"))
    roots = seen.where("depth = 0")
    svgs = roots.select("capture", F.lit('<svg role="img"><rect/></svg>\n').alias("svg"), c("label").alias("title"))
    extras = roots.where("capture % 2 = 0").select("capture", F.lit(1).alias("ord"), F.concat(F.lit("More <"), c("capture")).alias("text"))
    return svg.semantic_svg(svgs, nodes, extras).select("capture", "svg")


def svg_inlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey").cast("string")
    drawing = F.concat(F.lit('<svg><clipPath id="c'), k, F.lit('"/><g clip-path="url(#c'), k, F.lit(')"><use href="#c'), k, F.lit('"/></g></svg>'))
    return inputs.table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), svg.inlined(drawing, c("p_partkey") % 7).alias("svg"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(c("quality") == 1, "vector").otherwise("raster")
    return labels.select(c("doc_id").alias("group_id"), F.when(c("doc_id") % 2 == 0, "flat").otherwise("smooth").alias("algorithm"), status.alias("status"), F.sha2(F.concat(F.lit("svg"), c("doc_id") % 5), 256).alias("generated_hash"), (c("doc_id") % 900).alias("size"))


def catalog_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("lang").alias("background"))
    return catalog.traces_of(_traces(spark, sf_dir), groups, "flat", F.lit("en")).select("group_id", "size")


def catalog_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of stored drawings: every third file is lost, every fifth says something else."""
    traces = _traces(spark, sf_dir)
    files = traces.where("group_id % 3 > 0").select("group_id", "algorithm", F.encode(F.concat(F.when(c("group_id") % 5 == 4, "other").otherwise("svg"), c("group_id") % 5), "utf-8").alias("svg"))
    return catalog.edited(traces, files)


def catalog_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = inputs.table(spark, sf_dir, "documents").select(c("doc_id").alias("group_id"), c("lang").alias("digest"))
    after = before.where("group_id % 2 = 0").withColumn("digest", F.when(c("group_id") % 3 == 0, "changed").otherwise(c("digest")))
    return catalog.stale_groups(before.where("group_id % 7 > 0"), after)


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.table(spark, sf_dir, "documents").select(c("doc_id").alias("group_id"), F.array("lang", "source").alias("names"), F.array("source").alias("images"))
    return svg.review_pages(groups, _traces(spark, sf_dir)).select("group_id", "html", "digest")


_PICTURE = png.encode(np.full((4, 6, 3), 200, np.uint8))


def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and their panes as snapshots inside pictures, read back as nodes."""
    tree = inputs.tree(spark, sf_dir)
    node = lambda *more: F.struct("id", "role", "label", F.array("x", "y", "w", "h").alias("bounds"), F.struct("enabled", "offscreen").alias("states"), *more)
    panes = tree.where("depth = 1").groupBy("capture").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", node().alias("n")))), lambda r: r["n"]).alias("children"))
    whole = tree.where("depth = 0").join(panes, "capture", "left").select(
        c("capture").cast("string").alias("path"),
        F.to_json(F.struct(F.lit(OWN.format).alias("format"), F.lit(OWN.version).alias("version"), F.struct(F.array(F.lit(6), F.lit(4)).alias("size"), F.lit("image-pixels").alias("coordinate_space")).alias("image"), node(F.coalesce("children", F.array()).alias("children")).alias("root"))).alias("snapshot"),
    )
    files = whole.select("path", F.lit(_PICTURE).alias("content"))
    read = captures.read(captures.embed(files, whole))
    made = captures.nodes(read)
    return made.select(c("capture").cast("bigint").alias("capture"), "id", "parent", "depth", c("preorder").cast("bigint").alias("preorder"), "role", "label", "x", "y", "w", "h", "enabled", "offscreen")


def picture_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey tiles as PNG files, decoded again: sums of their pixels."""
    tiles = inputs.tiles(spark, sf_dir)
    files = captures.encoded(tiles.select(c("id").cast("string").alias("path"), "grey"), 8)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.conv(F.hex(F.substr("data", k * 3 + 1, F.lit(1))), 16, 10).cast("bigint") * (k + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return captures.pixels(files).select(c("path").cast("bigint").alias("id"), "width", "height", "channels", total.alias("weighted"))


def shape_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.complexity(inputs.pixels(spark, sf_dir), 200)


def picture_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each grey tile cut out, encoded and decoded again: sums of its pixels."""
    tiles = inputs.tiles(spark, sf_dir).select(c("id").cast("string").alias("path"), "grey")
    cut = captures.crops(captures.pixels(captures.encoded(tiles, 8)), tiles.select("path", c("path").alias("id"), F.lit(2).alias("x"), F.lit(-1).alias("y"), F.lit(4).alias("w"), F.lit(5).alias("h")))
    again = captures.pixels(cut.select("path", F.unbase64("png").alias("content")))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.hex(F.substr("data", k * 3 + 1, F.lit(1))), 16, 10).cast("bigint") * (k + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return again.select(c("path").cast("bigint").alias("id"), "width", "height", total.alias("weighted"))


def trace_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.table(spark, sf_dir, "documents").select(c("doc_id").alias("id"))
    traces = _traces(spark, sf_dir)
    return catalog.trace_states(groups, traces, traces.where("group_id % 4 > 0").select("group_id", "algorithm"), "flat")


def artwork_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = inputs.boxes(spark, sf_dir)
    nodes = boxes.select("capture", "id", F.expr(_SCENE).alias("kind"), (c("id") % 4 > 0).alias("leaf"), (c("id") % 5 == 0).alias("opaque"), (c("id") % 7 == 0).alias("approximated"), (c("w") * 2).alias("w"), "h", F.concat(F.lit("#"), c("capture") % 3).alias("background"), F.encode((c("id") % 11).cast("string"), "utf-8").alias("pixels"))
    return catalog.eligible_artwork(nodes).select("capture", "id", "key")


def tree_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.table_cells(inputs.tree(spark, sf_dir), ("listitem",), ("text",))


def tree_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = inputs.tree(spark, sf_dir)
    return trees.private(tree.withColumn("protected", c("protected") | ((c("depth") == 2) & (c("ord") == 6))))


QUERIES = {
    "picture_crops": picture_crops, "trace_states": trace_states, "artwork_eligible": artwork_eligible, "tree_table_cells": tree_cells, "tree_private": tree_private,
    "text_refined": text_refined, "text_overridden": text_overridden, "panel_copies": panel_copies, "button_promotions": button_promotions, "table_replacement": table_replacement, "text_fragments": fragments,
    "scene_prune_rules": prune_rules, "artwork_names": artwork_names, "box_neighbours": box_neighbours, "text_functions": text_functions, "role_resolved": role_resolved, "file_names": file_names, "ocr_retry": retry,
    "svg_surfaces": svg_surfaces, "svg_documents": svg_documents, "semantic_overlay": semantic_overlay, "svg_inlined": svg_inlined, "catalog_traces": catalog_traces, "catalog_edited": catalog_edited, "catalog_stale": catalog_stale,
    "review_pages": review_pages, "snapshot_round_trip": snapshot_round_trip, "picture_pixels": picture_pixels,
}

_SHARED = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
_B = f"WITH {inputs.BOXES_SQL}"


def _in(o: str, i: str, s: int) -> str:
    return f"({i}.x >= {o}.x - {s} AND {i}.y >= {o}.y - {s} AND {i}.x + {i}.w <= {o}.x + {o}.w + {s} AND {i}.y + {i}.h <= {o}.y + {o}.h + {s})"


_TRACES = "traces AS (SELECT doc_id AS group_id, CASE WHEN doc_id % 2 = 0 THEN 'flat' ELSE 'smooth' END AS algorithm, CASE WHEN max(quality) = 1 THEN 'vector' ELSE 'raster' END AS status, doc_id % 900 AS size FROM labels GROUP BY doc_id)"
_ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_NAMES = " || ', ' || ".join(_ESCAPE.format(x) for x in ("lang", "source"))
_DRAWN = "CASE id % 6 WHEN 0 THEN 'rect' WHEN 1 THEN 'text' WHEN 2 THEN 'radio' WHEN 3 THEN 'selected-row' WHEN 4 THEN 'outlined-button' ELSE 'close-icon' END"
_NODES = f"nodes AS (SELECT *, id AS ord, {_DRAWN} AS kind, '#1' || (10000 + id % 89999) AS color, CASE WHEN id % 12 = 4 THEN NULL WHEN id % 5 = 0 THEN '' ELSE '#2' || (10000 + id % 89999) END AS back FROM boxes)"
_NUM = r"regexp_replace(printf('%.2f', {0}::DOUBLE), '\.?0+$', '')"
_FACE = "coalesce(nullif(back, ''), 'none')"
_AT = "'x=\"' || x || '\" y=\"' || y || '\" width=\"' || w || '\" height=\"' || h || '\"'"
_MARK = "' data-kind=\"' || kind || '\"'"
_FRAGMENT = f"""CASE kind WHEN 'close-icon' THEN '<path d="M' || x || ',' || y || 'l' || w || ',' || h || 'm0,-' || h || 'l-' || w || ',' || h || '" stroke="' || color || '"' || {_MARK} || '/>'
  WHEN 'radio' THEN '<circle cx="' || {_NUM.format('(x + w / 2.0)')} || '" cy="' || {_NUM.format('(y + h / 2.0)')} || '" r="' || {_NUM.format('(least(w, h) / 2.0)')} || '" fill="' || {_FACE} || '" stroke="' || color || '"' || {_MARK} || '/>'
  ELSE '<rect ' || {_AT} || ' fill="' || CASE WHEN {_FACE} <> 'none' THEN {_FACE} ELSE color END || '" stroke="none"' || {_MARK} || '/>' END"""
_SEEN, _SAID, _ESCAPED = tree_queries._SEEN, tree_queries._SAID, tree_queries._ESCAPED


def _overlay() -> str:
    bare = "replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    text = f"CASE WHEN role = 'text' THEN '<g role=\"group\" aria-label=\"' || {_ESCAPE.format('label')} || '\"><title>' || {bare} || '</title></g>' ELSE '' END"
    group = f"'<g id=\"node-' || serial || '\" role=\"group\" aria-label=\"' || {_ESCAPED} || '\" data-node=\"' || id || '\" data-role=\"' || role || '\"><rect x=\"' || x || '\" y=\"' || y || '\" width=\"' || w || '\" height=\"' || h || '\" fill-opacity=\"0\" aria-hidden=\"true\"/>' || {text}"
    folds = "".join(
        f"d{d} AS (SELECT capture, {'parent' if d else 'id'} AS id, string_agg({group} || {'coalesce(inner_svg, ' + chr(39) + chr(39) + ')' if d < 3 else chr(39) + chr(39)} || '</g>', '' ORDER BY serial) AS inner_svg FROM n {f'LEFT JOIN d{d + 1} USING (capture, id)' if d < 3 else ''} WHERE depth = {d} GROUP BY ALL),\n"
        for d in (3, 2, 1)
    )
    return f"""WITH RECURSIVE {_SEEN}, walk AS (SELECT s.*, [struct_pack(o := ord, i := id)] AS path FROM seen s WHERE depth = 0 UNION ALL SELECT s.*, list_append(w.path, struct_pack(o := s.ord, i := s.id)) FROM seen s JOIN walk w ON s.capture = w.capture AND s.parent = w.id),
n AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY path) AS serial FROM walk),
{folds}
d0 AS (SELECT capture, {group} || coalesce(inner_svg, '') || '</g>' AS overlay, label FROM n LEFT JOIN d1 USING (capture, id) WHERE depth = 0)
SELECT capture, '<svg role="graphics-document group" aria-labelledby="capture-title"><title id="capture-title">' || {bare} || '</title><g aria-hidden="true"><rect/></g>' || overlay
  || CASE WHEN capture % 2 = 0 THEN '<g role="group" aria-label="Other visible text"><g role="group" aria-label="More &lt;' || capture || '"><title>More &lt;' || capture || '</title></g></g>' ELSE '' END || '</svg>' || chr(10) AS svg FROM d0"""


ORACLE_SQL = {
    "text_refined": f"""WITH {sql('texts')}, b AS (SELECT *, conf + id % 40 / 100.0::DOUBLE AS again, coalesce(id % 2 = 0 AND conf >= 0.35 AND conf < 0.72 AND h BETWEEN 4 AND 22 AND w BETWEEN 2 AND 180 AND conf + id % 40 / 100.0::DOUBLE >= greatest(0.68::DOUBLE, conf + 0.12::DOUBLE), false) AS better FROM texts)
SELECT capture, id, CASE WHEN better THEN x + 1 ELSE x END AS x, y, w, h, round(CASE WHEN better THEN again ELSE conf END, 6) AS conf, CASE WHEN better THEN 'again ' || text ELSE text END AS text FROM b""",
    "text_overridden": f"WITH {sql('texts')} SELECT capture, id, text FROM texts WHERE id % 2 = 1 UNION ALL SELECT capture, id, text FROM texts a WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM texts b WHERE b.id % 2 = 1 AND a.capture = b.capture AND {_SHARED} > 0 AND {_SHARED} >= 0.2::DOUBLE * (a.w * a.h + b.w * b.h - {_SHARED}))",
    "panel_copies": f"{_B}, p AS (SELECT capture, id, x - 1 AS x, y - 1 AS y, w + id % 7 AS w, h + 2 AS h FROM boxes WHERE id % 5 = 0) SELECT capture, id, CASE WHEN id % 2 = 0 THEN 'rect' ELSE 'outline' END AS kind FROM boxes a WHERE id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM p b WHERE a.capture = b.capture AND {_in('b', 'a', 2)} AND a.w * a.h > 0.85::DOUBLE * b.w * b.h)",
    "button_promotions": f"""{_B}, k AS (SELECT capture, id, x, y, w * 2 AS w, h, CASE WHEN id % 3 = 0 THEN 'raster' ELSE 'rect' END AS kind, id % 50 AS edge FROM boxes), t AS (SELECT capture, x + 3 AS x, y + 3 AS y, 10 AS w, 6 AS h FROM boxes WHERE id % 4 <> 1)
SELECT capture, id, CASE WHEN kind = 'raster' AND w BETWEEN 50 AND 220 AND h BETWEEN 16 AND 50 AND edge <= 35 AND EXISTS (SELECT 1 FROM t b WHERE a.capture = b.capture AND {_in('a', 'b', 2)}) THEN 'outlined-button' ELSE kind END AS kind FROM k a""",
    "table_replacement": f"WITH {sql('texts')}, {inputs.BOXES_SQL}, t AS (SELECT capture, x, y, w * 3 AS w, h * 3 AS h FROM boxes WHERE id % 10 = 0) SELECT capture, -id - 1 AS id, 'cell ' || text AS text FROM texts WHERE id % 10 = 0 UNION ALL SELECT capture, id, text FROM texts a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.capture = b.capture AND {_SHARED} > 0.3::DOUBLE * a.w * a.h)",
    "text_fragments": f"""WITH {sql('texts')}, a AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'Lab' WHEN id % 3 = 1 THEN '|ap.' ELSE text END AS text) FROM texts), b AS (SELECT * REPLACE (x - 5 AS x, w + 20 AS w, h + 4 AS h) FROM texts WHERE conf >= 0.7)
SELECT DISTINCT a.capture, a.id FROM a JOIN b ON a.capture = b.capture AND length(trim(a.text)) <= 4 AND {_SHARED} > 0 AND {_SHARED} / greatest(1, a.w * a.h)::DOUBLE >= 0.65 AND contains(lower(b.text), trim(lower(a.text), '|.,''"'))""",
    "scene_prune_rules": f"""{_B}, a AS (SELECT *, {_SCENE} AS kind, id % 4 > 0 AS leaf FROM boxes), b AS (SELECT capture, {_ROLES} AS role, x - 3 AS x, y - 2 AS y, w + 4 AS w, h + 4 AS h FROM boxes),
p AS (SELECT a.capture, a.id, a.kind, a.leaf, a.w * a.h AS area, b.role, b.w * b.h AS other, {_SHARED} AS shared, {_in('b', 'a', 2)} AS inside FROM a JOIN b ON a.capture = b.capture AND ({_SHARED} > 0 OR {_in('b', 'a', 2)})),
r AS (SELECT capture, id, bool_or(kind = 'text' AND role = 'text' AND shared > 0.35::DOUBLE * area) AS r1, sum(CASE WHEN kind <> 'text' AND role = 'authoritative' THEN shared ELSE 0 END) > 0.15::DOUBLE * any_value(area) AS r2, bool_or(kind <> 'text' AND leaf AND role IN ('text', 'artwork', 'scrollbar') AND inside) AS r3,
  bool_or(kind IN ('outline', 'input-field', 'dropdown') AND role = 'text' AND shared > 0.3::DOUBLE * area) AS r4, bool_or(kind = 'header-icon' AND role = 'caption-button' AND inside) AS r5, bool_or(kind = 'text' AND role = 'password' AND shared > 0) AS r7,
  bool_or(kind IN ('button', 'outlined-button', 'checkbox', 'checkbox-selected', 'radio', 'radio-selected', 'dropdown', 'outline', 'tab', 'tab-active') AND role = 'control' AND shared > 0.75::DOUBLE * greatest(1, area, other)) AS r8 FROM p GROUP BY ALL)
SELECT a.capture, a.id, CASE WHEN r1 THEN 1 WHEN r2 THEN 2 WHEN r3 THEN 3 WHEN r4 THEN 4 WHEN r5 THEN 5 WHEN a.id % 23 = 0 THEN 6 WHEN r7 THEN 7 WHEN r8 THEN 8 ELSE 0 END AS rule FROM a LEFT JOIN r USING (capture, id)""",
    "artwork_names": f"""{_B}, k AS (SELECT *, 'pic ' || id % 50 AS label FROM boxes WHERE id % 3 = 0 AND id % 4 <> 0 AND id % 11 <> 0),
m AS (SELECT a.capture, a.id, b.label FROM boxes a JOIN k b ON a.capture = b.capture AND a.id % 2 = 1 AND ({_in('a', 'b', 2)} OR {_in('b', 'a', 2)}) QUALIFY row_number() OVER (PARTITION BY a.capture, a.id ORDER BY b.w * b.h, b.id) = 1) SELECT a.capture, a.id, coalesce(label, '-') AS name FROM boxes a LEFT JOIN m USING (capture, id) WHERE a.id % 2 = 1""",
    "box_neighbours": f"{_B} SELECT capture, id, abs(x - 300) <= 200 AND abs(y - 200) <= 200 AND abs(x + w - 360) <= 200 AND abs(y + h - 230) <= 200 AS near, w > 0 AND h > 0 AND x < 360 AND 300 < x + w AND y < 230 AND 200 < y + h AS meets, x * 2.0::DOUBLE - 10 AS mx, y * 4.0::DOUBLE + 5 AS my, x::DOUBLE AS bx, y::DOUBLE AS by FROM boxes",
    "text_functions": r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 AND false THEN '' ELSE trim(p_name) END AS shell, CASE WHEN length(p_name) * 7 <= p_partkey % 200 THEN p_name ELSE rtrim(substr(p_name, 1, greatest(0, p_partkey % 200 // 7 - 1))) || '…' END AS cut,
  printf('#%02x00%02x', p_partkey * 257 % 65536 // 257, p_partkey * 7 % 65536 // 257) AS color, (p_partkey % 30)::DOUBLE AS size, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 700 END AS weight, p_partkey % 2 = 0 AS italic,
  CASE WHEN regexp_replace(printf('%.3f', p_partkey / 8.0::DOUBLE - 20), '\.?0+$', '') IN ('-0', '') THEN '0' ELSE regexp_replace(printf('%.3f', p_partkey / 8.0::DOUBLE - 20), '\.?0+$', '') END AS number,
  'M ' || p_partkey % 90 || ' -' || p_partkey % 7 || '.5 L 3 4 Z' AS tokens, least(9, length(p_name)) AS bounded, p_partkey % 3 = 0 AS icon, length(p_name) >= 6 AND starts_with(p_name || 'x', substr(p_name, 1, 7)) AS ellipsis FROM part""",
    "role_resolved": f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'pane' WHEN p_partkey % 45 BETWEEN 2 AND {len(trees.ROLES) + 1} THEN [{', '.join(repr(r) for r in trees.ROLES)}][p_partkey % 45 - 1] ELSE 'custom' END AS role FROM part",
    "file_names": r"""WITH t AS (SELECT page_id, string_split(url, '/')[3] || ': ' || string_split(url, '/')[4] AS title FROM pages), n AS (SELECT page_id, trim(substr(regexp_replace(title, '[\x00-\x1F<>:"/\\|?*]', '', 'g'), 1, 100), '. ') AS s FROM t),
b AS (SELECT page_id, CASE WHEN s = '' THEN 'Window' ELSE s END || ' 2023-11-14 22-13-20.000' AS s FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY page_id) AS rk FROM b) SELECT page_id, s || CASE WHEN rk > 1 THEN ' (' || rk || ')' ELSE '' END || '.png' AS file FROM k""",
    "ocr_retry": f"WITH {sql('texts')}, f AS (SELECT * FROM texts WHERE conf > 0.6 AND capture % 5 > 0) SELECT capture, id, text FROM f UNION ALL SELECT capture, id, text FROM texts WHERE id % 3 = 0 AND capture NOT IN (SELECT capture FROM f)",
    "svg_surfaces": f"""{_B}, {_NODES}, f AS (SELECT * FROM nodes WHERE kind IN ('rect', 'selected-row') OR (kind = 'outlined-button' AND back IS NOT NULL)),
m AS (SELECT b.capture, b.ord, CASE WHEN a.kind = 'selected-row' THEN a.color ELSE coalesce(nullif(a.back, ''), a.color) END AS s FROM f a JOIN nodes b ON a.capture = b.capture AND a.ord <> b.ord AND {_in('a', 'b', 0)} QUALIFY row_number() OVER (PARTITION BY b.capture, b.ord ORDER BY a.w * a.h, a.ord) = 1)
SELECT n.capture, n.ord, coalesce(s, '#ffffff') AS surface FROM nodes n LEFT JOIN m USING (capture, ord)""",
    "svg_documents": f"""{_B}, {_NODES}, d AS (SELECT capture, string_agg({_FRAGMENT}, chr(10) ORDER BY CASE WHEN kind = 'rect' AND w * h > 1000 THEN 1 WHEN kind = 'close-icon' THEN 6 ELSE 2 END, CASE WHEN kind = 'rect' AND w * h > 1000 THEN w * h ELSE 0 END DESC, ord) AS body FROM nodes WHERE kind IN ('rect', 'radio', 'close-icon') GROUP BY capture),
s AS (SELECT capture, '<svg xmlns="http://www.w3.org/2000/svg" width="1200" height="800" viewBox="0 0 1200 800" role="img">' || chr(10) || '<rect width="1200" height="800" fill="#ffffff"/>' || chr(10) || body || chr(10) || '</svg>' || chr(10) AS svg FROM d) SELECT capture, md5(svg) AS digest, length(svg) AS chars FROM s""",
    "semantic_overlay": _overlay(),
    "svg_inlined": "SELECT p_partkey AS id, '<svg><clipPath id=\"part-' || p_partkey % 7 || '-c' || p_partkey || '\"/><g clip-path=\"url(#part-' || p_partkey % 7 || '-c' || p_partkey || ')\"><use href=\"#part-' || p_partkey % 7 || '-c' || p_partkey || '\"/></g></svg>' AS svg FROM part",
    "catalog_traces": f"WITH {_TRACES} SELECT group_id, size FROM traces JOIN documents ON doc_id = group_id WHERE algorithm = 'flat' AND status = 'vector' AND lang = 'en'",
    "catalog_edited": f"WITH {_TRACES} SELECT group_id, algorithm, CASE WHEN group_id % 3 = 0 THEN 'missing' WHEN group_id % 5 = 4 THEN 'edited' ELSE 'kept' END AS state FROM traces WHERE status = 'vector'",
    "catalog_stale": "SELECT doc_id AS group_id FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0)",
    "review_pages": f"""WITH {_TRACES}, p AS (SELECT doc_id AS group_id, '<!doctype html><html lang="en"><meta charset="utf-8"><title>Icon group ' || doc_id || '</title><p>' || {_NAMES} || '</p><p>' || {_ESCAPE.format('source')} || '</p><table>' ||
  coalesce('<tr><td>' || algorithm || '</td><td>' || status || '</td><td>' || size || '</td></tr>', '') || '</table></html>' || chr(10) AS html FROM documents LEFT JOIN traces ON doc_id = group_id) SELECT group_id, html, sha256(html) AS digest FROM p""",
    "snapshot_round_trip": f"""WITH {inputs.TREE_SQL} SELECT capture, id, parent, depth, CASE WHEN depth = 0 THEN 1 ELSE 1 + row_number() OVER (PARTITION BY capture, depth ORDER BY ord, id) END AS preorder, role, label, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, enabled, offscreen FROM tree WHERE depth <= 1""",
    "picture_crops": f"WITH {inputs.TILES_SQL} SELECT id, 4 AS width, 4 AS height, sum(v * (py * 4 + px - 2 + 1))::BIGINT AS weighted FROM pixels WHERE py < 4 AND px BETWEEN 2 AND 5 GROUP BY id",
    "trace_states": f"WITH {_TRACES}, f AS (SELECT * FROM traces WHERE algorithm = 'flat') SELECT doc_id AS group_id, CASE WHEN status IS NULL THEN 'trace' WHEN status = 'vector' AND group_id % 4 = 0 THEN 'again' ELSE 'none' END AS todo FROM documents LEFT JOIN f ON doc_id = group_id",
    "artwork_eligible": f"{_B} SELECT capture, id, sha256((w * 2) || '|' || h || '|#' || (capture % 3) || '|' || upper(hex((id % 11)::VARCHAR))) AS key FROM boxes WHERE {_SCENE} = 'raster' AND id % 4 > 0 AND id % 5 <> 0 AND id % 7 <> 0 AND greatest(w * 2, h) <= 96",
    "tree_table_cells": f"WITH RECURSIVE {tree_queries._CLOSURE} SELECT DISTINCT c.capture, c.id FROM above a JOIN tree t ON a.capture = t.capture AND a.ancestor = t.id AND t.role = 'listitem' JOIN tree c ON c.capture = a.capture AND c.id = a.id AND c.role = 'text'",
    "tree_private": f"""WITH RECURSIVE {tree_queries._CLOSURE}, p AS (SELECT *, protected OR (depth = 2 AND ord = 6) AS hidden FROM tree)
SELECT capture, id FROM p WHERE hidden UNION SELECT a.capture, a.id FROM above a JOIN p ON a.capture = p.capture AND a.ancestor = p.id AND hidden
UNION SELECT b.capture, b.id FROM p a JOIN p b ON a.capture = b.capture AND a.hidden AND a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0 AND {_in('a', 'b', 2)}""",
    "picture_pixels": f"WITH {inputs.TILES_SQL} SELECT id, 8 AS width, 8 AS height, 3 AS channels, sum(v * (py * 8 + px + 1))::BIGINT AS weighted FROM pixels GROUP BY id",
}
