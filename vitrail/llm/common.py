"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.session import materialize, ship

__all__ = ["attach_groups", "blank_null", "broadcast_in_slices", "files_for", "fresh", "load", "materialize", "short_batches"]

#: Rows and bytes of one Arrow batch for operators that send whole texts to Python; a single longer text is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20

#: A group holding at least this share of all rows is hot; there can be no more than its inverse of them.
HOT_SHARE = 1_000

#: Narrow rows from which a table is made, for each file that it is written to.
FILE_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have yet, for working columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def blank_null(text: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts short in rows and in bytes, so that Python's memory doesn't follow the texts.

    The plan reads these settings when it runs, so they are lowered for the rest of the session (never raised).
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(size: str) -> int:
    """A setting's number, with Spark's units of bytes."""
    digits, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(digits) << " kmgt".index(unit or " ") * 10


def files_for(rows: int) -> int:
    """Files for a narrow table that is made from so many narrow rows, however many partitions a shuffle has."""
    return max(1, -(-rows // FILE_ROWS))


def broadcast_in_slices(rows: DataFrame, side: DataFrame, key: str, most: int, how: str = "left") -> DataFrame:
    """Join `rows` (left, inner or left_semi, on `key`) with a side of any size without ever moving `rows`.

    The side is counted. Up to `most` rows it is broadcast; beyond that, slices of it by the key's hash, of about
    `most` rows each, are broadcast one by one to the rows with such keys: `rows` is read once for each slice, and no
    exchange holds any of it. `side` should be materialised; null keys match nothing.
    """
    slices = max(1, -(-side.count() // max(1, most)))
    if slices == 1:
        return rows.join(F.broadcast(side), key, how)
    of = F.pmod(F.xxhash64(key), F.lit(slices))
    parts = [rows.where(of == k).join(F.broadcast(side.where(of == k)), key, how) for k in range(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join each row to its group's row (inner, on `key`) when one group may hold a third of all rows.

    Groups with at least a thousandth of `total` rows number a thousand at most, so they are broadcast whatever the
    input's size; every other group is small enough for a shuffled join on its key. Both inputs should be
    materialised, as each is read twice. Null keys match nothing.
    """
    share = F.col(size) * HOT_SHARE >= F.lit(max(total, 1))
    hot = groups.where(share)
    keys = [r[0] for r in hot.select(key).collect()]  # HOT_SHARE rows at most
    if not keys:
        return rows.join(groups, key)
    # both sides are told apart by the keys themselves, so no join passes rows on that another one takes in
    is_hot = F.col(key).isin(keys)
    return rows.where(is_hot).join(F.broadcast(hot), key).unionByName(rows.where(~is_hot).join(groups.where(~share), key))
