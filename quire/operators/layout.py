"""Layout of pages: boxes, columns, table rows, fonts, captions. All in the JVM; operators.pages has the folds that build blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import overlap_ratio
from quire.settings import LAYOUT, Layout

#: Gaps that count as columns of a table row, and how many gaps of a page may part columns.
ROW_GAP_FACTOR, ROW_GAPS, ROW_GAP_SHARE, TOP_GAPS, LEAST_WORDS = 1.5, 2, 0.3, 3, 5


def token_boxes(lines: DataFrame, char: float = 6.0, height: float = 14.0, per_page: int = 50) -> DataFrame:
    """Words of lines (doc_id, pos, line) with boxes on a plain grid: doc_id, page, line_no, word_no, text, l, r, t, b.

    Rows are parted by page once; what follows by page or line needs no further shuffle.
    """
    page = (F.floor((F.col("pos") - 1) / per_page) + 1).cast("int").alias("page")
    words = F.filter(F.split("line", r"[ \t\r]+"), lambda w: w != "")
    rows = lines.select("doc_id", page, "pos", F.posexplode(words).alias("word_no", "text")).repartition("doc_id", "page")
    # Where each word begins: the words before it and one blank each.
    w = Window.partitionBy("doc_id", "page", "pos").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    top = F.lit(800.0) - height * F.pmod(F.col("pos") - 1, F.lit(per_page))
    return rows.select("doc_id", "page", F.col("pos").alias("line_no"), "word_no", "text", (before * char).alias("l"), ((before + F.length("text")) * char).alias("r"), top.alias("t"), (top - height * 0.8).alias("b"))


def bounding_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """Box, number and area of the words of each group."""
    area = F.greatest(F.lit(1.0), F.col("r") - F.col("l")) * F.greatest(F.lit(1.0), F.col("t") - F.col("b"))
    return words.groupBy(*keys).agg(F.min("l").alias("l"), F.max("r").alias("r"), F.max("t").alias("t"), F.min("b").alias("b"), F.count(F.lit(1)).alias("words"), F.sum(area).alias("area"))


def table_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, gaps, large, is_row): lines whose words stand in columns: two or more wide gaps that are 30 % of all or more."""
    w = Window.partitionBy(*keys).orderBy("l", "word_no")
    gaps = words.withColumn("gap", F.col("l") - F.lag("r").over(w))
    mean = F.avg(F.col("r") - F.col("l")).over(Window.partitionBy(*keys))
    marked = gaps.withColumn("large", F.when(F.col("gap") > ROW_GAP_FACTOR * mean, 1).otherwise(0))
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.count("gap").alias("gaps"), F.sum("large").alias("large"))
    return out.withColumn("is_row", (F.col("gaps") >= 2) & (F.col("large") >= ROW_GAPS) & (F.col("large") >= ROW_GAP_SHARE * F.col("gaps")))


def column_cuts(words: Column, page_width: float, settings: Layout = LAYOUT) -> Column:
    """Where columns of a page (an array of words) part, from the left: of the three widest gaps between left edges those that divide the text.

    Words wholly left and wholly right of the cut must be three each and span more than a quarter of the height of all. Pages of fewer than five words have none.
    """
    edges = F.array_sort(F.transform(words, lambda w: w["l"]))
    pairs = F.zip_with(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda a, b: F.struct((a - b).alias("narrow"), (a + (b - a) / 2).alias("at")))
    # The widest first; of equal ones the leftmost.
    widest = F.slice(F.array_sort(F.filter(pairs, lambda p: -p["narrow"] > page_width * settings.column_gap)), 1, TOP_GAPS)
    top = lambda ws: F.array_max(F.transform(ws, lambda w: w["t"]))
    bottom = lambda ws: F.array_min(F.transform(ws, lambda w: w["b"]))
    least = settings.column_span * F.greatest(F.lit(1.0), top(words) - bottom(words))
    divides = lambda ws: (F.size(ws) >= settings.column_words) & (top(ws) - bottom(ws) > least)
    good = F.filter(widest, lambda p: divides(F.filter(words, lambda w: w["r"] < p["at"])) & divides(F.filter(words, lambda w: w["l"] > p["at"])))
    return F.when(F.size(words) >= LEAST_WORDS, F.array_sort(F.transform(good, lambda p: p["at"]))).otherwise(F.array().cast("array<double>"))


def page_columns(words: DataFrame, keys: list[str], page_width: float, settings: Layout = LAYOUT) -> DataFrame:
    """(keys, cuts, words): one row per page with its cuts and its words, each with column_no from 1: how many cuts lie at or left of its middle, and one.

    Words beyond the edges of the page belong to the outer columns. One shuffle by page does it all.
    """
    from quire.operators.pages import words_of

    known = [c for c in ("line_no", "word_no") if c in words.columns]
    pages = words.groupBy(*keys).agg(F.collect_list(F.struct(*known, *words_of(words))).alias("_w"))
    number = lambda w, cuts: (F.size(F.filter(cuts, lambda c: c <= (w["l"] + w["r"]) / 2)) + 1).cast("int")
    placed = lambda cuts: F.struct(cuts.alias("cuts"), F.transform("_w", lambda w: w.withField("column_no", number(w, cuts))).alias("words"))
    # An array of one binds the cuts, so they are found once a page and not once a word.
    return pages.select(*keys, F.element_at(F.transform(F.array(column_cuts(F.col("_w"), page_width, settings)), placed), 1).alias("_p")).select(*keys, "_p.cuts", "_p.words")


def dominant(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value): the most frequent value, letter case aside; of equally frequent ones the one that came first, spelt as there."""
    place = F.struct(*order, value)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.lower(value).alias("_low")).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"))).alias("_b"))
    return best.select(*keys, F.col("_b.f")[value].alias(value))


def upper_median(c: Column) -> Column:
    """Aggregate: the upper of the middle values; null without values."""
    values = F.array_sort(F.collect_list(c))
    return F.try_element_at(values, (F.floor(F.size(values) / 2).cast("int") + 1))


def captions_of_tables(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Captions with a table row near them: their middles less than six line heights apart and more than a fifth of the narrower one above the other."""
    mid = lambda p: (F.col(f"{p}.t") + F.col(f"{p}.b")) / 2
    c, t = blocks.filter("block_type = 'Caption'").alias("c"), blocks.filter("block_type = 'TableRow'").alias("t")
    same = [F.col(f"c.{k}") == F.col(f"t.{k}") for k in keys]
    near = (F.abs(mid("c") - mid("t")) < 6 * F.greatest(F.col("c.lh"), F.col("t.lh"))) & (overlap_ratio(F.col("c.l"), F.col("c.r"), F.col("t.l"), F.col("t.r")) > 0.2)
    on = near
    for s in same:
        on = on & s
    return c.join(t, on, "left_semi")
