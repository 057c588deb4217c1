"""Translation units and their targets: table rows as cells, targets back in one text, tails and first distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_blank, strip, table_segments

#: What joins the cells of a row and other targets; lines and characters of a log's tail; texts of a cover.
CELL_GLUE, GLUE = "  ", " "
TAIL_LINES, TAIL_CHARACTERS, COVER_TEXTS = 400, 12_000, 4


def targets(blocks: DataFrame, text: str, block_type: str) -> DataFrame:
    """Adds target_no (from 0), target and glue: a row of a table gives a row for each cell, any other block one; blank blocks give none."""
    row = F.col(block_type) == "TableRow"
    parts = F.when(row, table_segments(strip(F.col(text)))).otherwise(F.array(F.col(text)))
    out = blocks.filter(~is_blank(F.col(text))).select("*", F.posexplode(parts).alias("target_no", "target"))
    several = row & (F.size(table_segments(strip(F.col(text)))) > 1)
    return out.withColumn("glue", F.when(several, F.lit(CELL_GLUE)).otherwise(F.lit(GLUE)))


def collapse(order: Column, text: Column, glue: Column) -> Column:
    """Aggregate: targets in order in one text, each after the glue of the one before it, stripped; a single one as it is."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"), glue.alias("g"))))
    whole = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.struct(parts[0]["t"].alias("t"), parts[0]["g"].alias("g")), lambda a, x: F.struct(F.concat(a["t"], a["g"], x["t"]).alias("t"), x["g"].alias("g")))
    return F.when(F.size(parts) == 1, parts[0]["t"]).otherwise(strip(whole["t"]))


def tail(df: DataFrame, order: list[str], rows: int = TAIL_LINES) -> DataFrame:
    """The last rows in order: a report of fixed size."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(rows)


def tail_text(c: Column, characters: int = TAIL_CHARACTERS) -> Column:
    """The last characters of a text."""
    return F.when(F.length(c) > characters, F.substring(c, -characters, characters)).otherwise(c)


def distinct_boxes(df: DataFrame, keys: list[str], sides: list[str], digits: int = 2) -> DataFrame:
    """One row for each box of a group, sides compared at two decimals, half to even."""
    return df.select(*keys, *[F.bround(F.col(c), digits).alias(c) for c in sides]).distinct()


def first_texts(df: DataFrame, group: str, order: str, text: str, most: int = COVER_TEXTS) -> DataFrame:
    """(group, place, text): the first distinct texts of each group, stripped, blank ones left out; of equal ones the first place counts."""
    rows = df.select(group, order, strip(F.col(text)).alias(text)).filter(F.col(text) != "")
    # Of each text only its first place goes into the window.
    firsts = rows.groupBy(group, text).agg(F.min(order).alias(order))
    ranked = firsts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, text)))
    return ranked.filter(F.col("place") <= most).select(group, "place", text)
