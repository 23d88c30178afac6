"""Every query of the library outside the subpackage llm, by name, with its DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrail.queries import boxes, detected, merged, pictures, reconciled, scores, trees, words

_FAMILIES = (trees, boxes, words, pictures, scores, reconciled, detected, merged)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in _FAMILIES for k, v in f.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for f in _FAMILIES for k, v in f.ORACLE_SQL.items()}
