"""Row versions: keep the current row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`.

    Exact repeats collapse; of versions with an equal `order` the greatest
    (by the listed columns, in order) is kept, so the result is the same however
    rows are partitioned. Null keys form a group of their own, a null `order`
    loses against any other. It is a plain aggregate, so copies of a
    hot key are reduced before the shuffle.
    """
    picked = F.max(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in columns])).alias("_row")
    grouped = df.groupBy(*keys).agg(picked)
    return grouped.select(*keys, F.col("_row._order").alias(order), *[F.col("_row")[c].alias(c) for c in columns])


def drop_repeats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key of a table whose repeats are equal in all columns (ties: the greatest row)."""
    picked = F.max(F.struct(*[F.col(c) for c in columns])).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])
