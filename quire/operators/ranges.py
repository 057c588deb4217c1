"""Ranges of units a run works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requested_range(start: Column, end: Column, total: Column) -> Column:
    """struct<first, last> of a 1-based request over `total` units.

    Without units it is (1, 0), which holds none. A start beyond the last unit
    selects the last unit; an end of zero or less means the last unit.
    """
    first = F.greatest(F.lit(1), start)
    last = F.when(end <= 0, total).otherwise(F.greatest(first, end))
    none = total <= 0
    return F.struct(F.when(none, 1).otherwise(F.least(first, total)).alias("first"), F.when(none, 0).otherwise(F.least(last, total)).alias("last"))


def within(unit: Column, chosen: Column) -> Column:
    """Whether a unit is in a range."""
    return unit.between(chosen["first"], chosen["last"])


def chosen_parts(df: DataFrame, scope: str, page: str, first: int, last: int, total: int) -> DataFrame:
    """Rows of the main part whose page is wanted; headers, footers, notes and comments only if all pages are."""
    main = (F.col(scope) == "Main") & F.col(page).between(first, last)
    return df.filter(main | ((F.col(scope) != "Main") & F.lit(first <= 1 and last >= total)))
