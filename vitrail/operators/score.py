"""Scores: weighted scorecards, warnings, provider choice, fidelity regions, local text checks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.functions import text

#: Weights of a scorecard's parts.
WEIGHTS = {"edges": 0.25, "appearance": 0.15, "precision": 0.1, "imagery": 0.25, "text": 0.25, "layout": 0.2}
#: Containers, whose name alone says little.
CONTAINERS = ("window", "pane", "group", "custom", "list", "tree", "table", "datagrid", "document")
ACCEPTED = 12


def weighted(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS, digits: int = 3) -> Column:
    """Mean of the parts that are there, by their weights, rounded; null if none is."""
    rows = F.filter(F.array(*(F.struct(parts[k].cast("double").alias("v"), F.lit(weights[k]).alias("w")) for k in parts)), lambda p: p["v"].isNotNull())
    total = lambda field: F.aggregate(rows, F.lit(0.0), lambda a, p: a + field(p))
    return F.round(total(lambda p: p["v"] * p["w"]) / F.nullif(total(lambda p: p["w"]), F.lit(0.0)), digits)


def warnings(edge_recall: Column, text_recall: Column, source_recall: Column, missed: Column, fidelity: Column) -> Column:
    """A report's warnings in their order."""
    told = (
        (edge_recall < 0.65, "Many source edges are missing or displaced"),
        (text_recall < 0.8, "Rendered text is not reliably readable by OCR"),
        (source_recall < 0.85, "Text visible in the input is missing or changed in the SVG"),
        (missed, "Known fixture elements were missed"),
        (fidelity > 0.25, "Large regions use source-image fallback; editability is limited"),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in told)))


def provider_scores(nodes: DataFrame) -> DataFrame:
    """How much each provider tells of a capture: capture, provider, score, accepted.

    For each visible node 3 points for a named one that is no container, 1 for a text or edit, 4 for each line of text that isn't
    blank. nodes: capture, provider, role, label, offscreen, lines (array of texts).
    """
    points = (
        F.when((F.trim("label") != "") & ~F.col("role").isin(*CONTAINERS), 3).otherwise(0)
        + F.when(F.col("role").isin("text", "edit"), 1).otherwise(0)
        + 4 * F.size(F.filter("lines", lambda x: F.trim(x) != ""))
    )
    scored = nodes.groupBy("capture", "provider").agg(F.sum(F.when(~F.col("offscreen"), points).otherwise(0)).cast("bigint").alias("score"))
    return scored.withColumn("accepted", F.col("score") >= ACCEPTED)


def choose_provider(scores: DataFrame, favourite: str = "uia") -> DataFrame:
    """The provider with the larger score; the favourite wins ties: capture, provider, score."""
    best = F.max_by(F.struct("provider", "score"), F.struct("score", (F.col("provider") == favourite).alias("f")))
    return scores.groupBy("capture").agg(best.alias("b")).select("capture", "b.provider", "b.score")


def local_text_checks(pairs: DataFrame) -> DataFrame:
    """Recognised source text against rendered text of the same place: adds a, b, ratio, fault.

    A fault is a ratio below 0.84, unless the source is a suffix of what was rendered, or a first word of three letters or
    more that reads otherwise. Sources under eight characters are left out. pairs: source, rendered.
    """
    clean = pairs.withColumn("a", text.clean_recognised(F.col("source"))).withColumn("b", text.clean_recognised(F.coalesce("rendered", F.lit(""))))
    rated = clean.where(F.char_length("a") >= 8).withColumn("ratio", text.similarity(F.col("a"), F.col("b")))
    first = lambda c: F.element_at(F.split(c, " "), 1)
    rated = rated.withColumn("first_ratio", text.similarity(first("a"), first("b")))
    suffix = F.endswith(F.col("b"), F.col("a")) & (F.col("a") != F.col("b"))
    fault = ~suffix & ((F.col("ratio") < 0.84) | ((F.char_length(first("a")) >= 3) & (F.col("first_ratio") <= 0.8)))
    return rated.withColumn("ratio", F.round("ratio", 3)).withColumn("fault", fault).drop("first_ratio")


def merge_bad_tiles(tiles: DataFrame) -> DataFrame:
    """Bad tiles merged into rectangles, to the right and then down while a whole run is bad: capture, tx, ty, w, h.

    tiles: capture, ty, tx, bad. Greedy in raster order, a capture at a time.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = {(r.ty, r.tx) for r in pdf.itertuples() if r.bad}
        out = []
        for ty, tx in sorted(bad):
            if (ty, tx) not in bad:
                continue
            right, bottom = tx, ty + 1
            while (ty, right) in bad:
                right += 1
            while all((bottom, x) in bad for x in range(tx, right)):
                bottom += 1
            bad -= {(y, x) for y in range(ty, bottom) for x in range(tx, right)}
            out.append((pdf["capture"].iloc[0], tx, ty, right - tx, bottom - ty))
        return pd.DataFrame(out, columns=["capture", "tx", "ty", "w", "h"])

    return tiles.groupBy("capture").applyInPandas(merge, "capture bigint, tx bigint, ty bigint, w bigint, h bigint")


def agree(a: str, b: str) -> float:
    """The ratio of two texts, case folded."""
    return difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio()
