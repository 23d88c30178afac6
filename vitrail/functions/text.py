"""Text functions as column expressions, and similarity as an Arrow UDF where the JVM has none."""

from __future__ import annotations

import difflib
import json
import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters stripped from recognised text before it is compared.
STRIPPED = " ‘'|:;,."


def normalize(text: Column) -> Column:
    """Without '&', an ellipsis as three dots, lower case, runs of white space as one blank."""
    flat = F.replace(F.replace(text, F.lit("&"), F.lit("")), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(F.lower(flat), r"\s+", " "))


@F.pandas_udf(T.StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    """As `normalize` with full case folding (ß as ss)."""
    return text.map(lambda t: None if t is None else " ".join(t.replace("&", "").replace("…", "...").casefold().split()))


def clean_recognised(text: Column) -> Column:
    """Recognised text for comparison: stripped of edge punctuation and a stray i before a capitalised word."""
    edge = F.btrim(text, F.lit(STRIPPED))
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(edge, "^i(?=[A-Z][a-z])", "")), r"\s+", " "))


def without_punctuation(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", ""))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of two texts, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def may_reach(a: Column, b: Column, limit: float) -> Column:
    """Whether the ratio of two texts can be above a limit, by their lengths alone: twice the shorter over both."""
    sizes = F.char_length(a), F.char_length(b)
    return 2 * F.least(*sizes) > F.lit(limit) * (sizes[0] + sizes[1])


def icon_text(text: Column) -> Column:
    """Whether a text consists of private-use characters (icon fonts) and white space alone."""
    return (F.trim(text) != "") & text.rlike(r"^[\p{Co}\s]+$") & text.rlike(r"\p{Co}")


def ellipsis_match(a: Column, b: Column) -> Column:
    """`a` is `b` cut off by an ellipsis, with six characters or more before it."""
    stem = F.substr(a, F.lit(1), F.char_length(a) - 3)
    return F.endswith(a, F.lit("...")) & (F.char_length(a) >= 9) & F.startswith(b, stem)


def bounded(text: Column, limit: int = 65_536) -> Column:
    return F.substring(text, 1, limit)


def safe_name(title: Column) -> Column:
    """A window title as a file name: no control or reserved characters, at most 100 characters and 180 bytes, no edge dots or blanks."""
    flat = F.btrim(F.substring(F.regexp_replace(title, r'[\x00-\x1F<>:"/\\|?*]', ""), 1, 100), F.lit(". "))
    sizes = F.transform(F.sequence(F.lit(0), F.char_length(flat)), lambda n: F.substr(flat, F.lit(1), n))
    cut = F.element_at(F.filter(sizes, lambda s: F.octet_length(s) <= 180), -1)
    return F.coalesce(F.nullif(F.btrim(cut, F.lit(". ")), F.lit("")), F.lit("Window"))


def settings_key(algorithm: str, *settings: object) -> str:
    """An algorithm's name with the first 16 digits of its settings' digest."""
    told = json.dumps(settings, separators=(",", ":"))
    return f"{algorithm}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def path_tokens(path: Column) -> Column:
    """Letters and numbers of a vector path, in order."""
    return F.regexp_extract_all(path, F.lit(r"([A-Za-z]|[-+]?(?:\d*\.\d+|\d+\.?\d*)(?:[eE][-+]?\d+)?)"), F.lit(1))


def observation(status: Column, value: Column) -> Column:
    """Typed missingness: a value with the status 'value', else the reason and no value."""
    return F.struct(status.alias("status"), F.when(status == "value", value).alias("value"))


def field_status(observations: Column) -> Column:
    """Of a map property -> observation, the statuses of those without a value."""
    return F.transform_values(F.map_filter(observations, lambda k, v: v["status"] != "value"), lambda k, v: v["status"])


def states(observations: Column) -> Column:
    """Of a map property -> observation, the values of those that have one."""
    return F.transform_values(F.map_filter(observations, lambda k, v: v["status"] == "value"), lambda k, v: v["value"])


def shell_name(name: Column) -> Column:
    """A collector's name for a window without the marks that the desktop adds around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"^(Administrator|Select): ", ""), r" (window|- Not Responding)$", ""))


def truncated(text: Column, wide: Column, room: Column) -> Column:
    """The longest beginning that fits with an ellipsis, every character as wide as `wide` (doubles); texts that fit stay whole."""
    fits = F.char_length(text) * wide <= room
    n = F.greatest(F.lit(0), F.floor(room / wide).cast("int") - 1)
    return F.when(fits, text).otherwise(F.concat(F.rtrim(F.substr(text, F.lit(1), n)), F.lit("…")))


def style(raw: Column) -> Column:
    """A run's style from a collector's attributes ('name:value;...'): color from 'r,g,b' in 16 bits each, size, weight and italic; nulls where unsaid."""
    said = lambda name: F.nullif(F.regexp_extract(raw, rf"(?:^|;)\s*{name}:([^;]*)", 1), F.lit(""))
    parts = F.split(said("fg-color"), ",")
    byte = lambda k: F.lower(F.lpad(F.hex(F.floor(F.get(parts, F.lit(k)).try_cast("bigint") / 257)), 2, "0"))
    colour = F.when(F.size(parts) == 3, F.concat(F.lit("#"), byte(0), byte(1), byte(2)))
    return F.struct(colour.alias("color"), said("size").try_cast("double").alias("size"), said("weight").try_cast("int").alias("weight"), (said("style") == "italic").alias("italic"))


def significant(v: Column, digits: int = 3) -> Column:
    """A number with that many digits behind the point at most, without closing zeros and without a sign before zero."""
    bare = F.regexp_replace(F.format_string(f"%.{digits}f", v.cast("double")), r"\.?0+$", "")
    return F.when(bare.isin("-0", ""), "0").otherwise(bare)
