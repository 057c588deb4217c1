"""Joins of rows with per-group results where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more rows than this, and with more than a 10,000th of all rows, is hot.
HOT_ROWS = 100_000
HOT_PARTS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of `rows` with one row per `key` of `groups`, safe against hot keys.

    `count` is the column of `groups` with the group's number of rows, `total` the
    number of all rows. Fewer than HOT_PARTS groups can hold more than
    total / HOT_PARTS rows, so the hot groups are broadcast: that side is bounded
    at any scale. The rest, of which none is hot, meets in a shuffle join.
    """
    limit = max(HOT_ROWS, total // HOT_PARTS)
    if total <= limit:
        return rows.join(groups, key)
    hot = groups.filter(F.col(count) > limit)
    cold = groups.filter(F.col(count) <= limit)
    by_broadcast = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_broadcast.unionByName(rest.join(cold, key))


def without_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The rows of `rows` whose `key` is not in `groups`, safe against hot keys as in join_groups."""
    limit = max(HOT_ROWS, total // HOT_PARTS)
    if total <= limit:
        return rows.join(groups.select(key), key, "left_anti")
    rest = rows.join(F.broadcast(groups.filter(F.col(count) > limit).select(key)), key, "left_anti")
    return rest.join(groups.select(key), key, "left_anti")


def add_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of `rows` with one row per `key` of `groups`, safe against hot keys as in join_groups; null keys match nothing."""
    known = join_groups(rows, groups, key, count, total)
    rest = without_groups(rows, groups, key, count, total)
    return known.unionByName(rest, allowMissingColumns=True)
