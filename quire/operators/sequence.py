"""Operators on rows in order: page numbers, headings, islands, neighbours, continuations.

All order rows by explicit ordinals; nothing relies on the order rows come in. A document is ordered in ranges
of positions or pages, with one row for each range to carry over what came before, so a document of a
third of all rows is many tasks. Ordinals are expected to be dense, as a range spans a fixed number of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import goes_on_below
from quire.functions.text import SPACE, context_preview, drop_hyphen, ends_open, ends_sentence, ends_with_hyphen, is_blank, join_hyphenated, leading_lower_word, starts_lower, starts_open
from quire.session import materialize
from quire.settings import LAYOUT, Layout


#: Rows of a document that one task orders: documents are ranged by position, and a row for each range carries over what came before.
SPAN = 100_000


#: An aggregate of a range, and what puts the aggregates of ranges in order together.
Carried = tuple[Column, Callable[[Column], Column]]


def _ranged(df: DataFrame, pos: str, span: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(pos) / span))


def _carry(df: DataFrame, keys: list[str], before: dict[str, Carried] | None = None, after: dict[str, Carried] | None = None, source: DataFrame | None = None) -> DataFrame:
    """Adds, for each name, what the ranges before or after a row's own give: an aggregate of a range, and how ranges in order are put together.

    Only one row for each range is ordered by document; ranges come back to rows by their number, so no document is one task's.
    `source` are the rows the aggregates are of, where they do not need what was added to `df` since.
    """
    before, after = before or {}, after or {}
    sums = (df if source is None else source).groupBy(*keys, "_range").agg(*[agg.alias(n) for n, (agg, _) in {**before, **after}.items()])
    w = Window.partitionBy(*keys).orderBy("_range")
    frames = ((before, w.rowsBetween(Window.unboundedPreceding, -1)), (after, w.rowsBetween(1, Window.unboundedFollowing)))
    carried = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[put(F.col(n)).over(frame).alias(n) for found, frame in frames for n, (_, put) in found.items()])
    # Null keys are a document like any other.
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(carried, same).drop("_r", *[f"_k{i}" for i in range(len(keys))])


def _last(value: Column, at: Column) -> Carried:
    """The last value that is not null, to be carried."""
    return F.max_by(value, F.when(value.isNotNull(), at)), lambda c: F.last(c, ignorenulls=True)


def row_numbers(df: DataFrame, doc: str, pos: str, out: str, span: int = SPAN) -> DataFrame:
    """Adds the number of each row of a document in order of pos, from 1."""
    ranged = _carry(_ranged(df, pos, span), [doc], {"_before": (F.count(F.lit(1)), F.sum)})
    within = F.row_number().over(Window.partitionBy(doc, "_range").orderBy(pos))
    return ranged.withColumn(out, (F.coalesce("_before", F.lit(0)) + within).cast("bigint")).drop("_before", "_range")


def page_numbers(df: DataFrame, doc: str, pos: str, breaks: str, new_page: str, span: int = SPAN) -> DataFrame:
    """Adds page_no: one, and one more for each break in earlier paragraphs and each paragraph but the first that starts a page."""
    starts = F.when(F.col(new_page), 1).otherwise(0)
    ranged = _ranged(df, pos, span).withColumn("_starts", starts)
    ranged = _carry(ranged, [doc], {"_b": (F.sum(breaks), F.sum), "_s": (F.sum("_starts"), F.sum), "_f": (F.min_by("_starts", pos), lambda c: F.first(c))})
    w = Window.partitionBy(doc, "_range").orderBy(pos)
    before = F.coalesce(F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("_b", F.lit(0))
    so_far = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_s", F.lit(0))
    # The first paragraph of the document starts no further page.
    first = F.coalesce("_f", F.first("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranged.withColumn("page_no", 1 + before + so_far - first).drop("_range", "_starts", "_b", "_s", "_f")


def breadcrumbs(df: DataFrame, doc: str, pos: str, level: str, title: str, levels: int = 6, span: int = SPAN) -> DataFrame:
    """Adds breadcrumb: the headings a row stands under, its own included, joined from the top level down.

    A heading closes those of its own and deeper levels. Rows that are no heading have a null level.
    """
    heads = {k: F.when(F.col(level) == k, F.struct(F.col(pos).alias("p"), F.col(title).alias("t"))) for k in range(1, levels + 1)}
    out = _carry(_ranged(df, pos, span), [doc], {f"_c{k}": _last(h, F.col(pos)) for k, h in heads.items()})
    w = Window.partitionBy(doc, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for k, h in heads.items():
        out = out.withColumn(f"_h{k}", F.coalesce(F.last(h, ignorenulls=True).over(w), f"_c{k}"))
    parts = []
    for k in range(1, levels + 1):
        open_ = F.col(f"_h{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_h{j}").isNull() | (F.col(f"_h{j}.p") < F.col(f"_h{k}.p")))
        parts.append(F.when(open_, F.col(f"_h{k}.t")))
    return out.withColumn("breadcrumb", F.concat_ws(" > ", *parts)).drop("_range", *[f"_h{k}" for k in heads], *[f"_c{k}" for k in heads])


def islands(df: DataFrame, doc: str, pos: str, key: str, span: int = SPAN) -> DataFrame:
    """Adds island: the number of the run of equal keys a row belongs to, from 1; null keys are equal to each other."""
    own = F.struct(F.col(key).alias("k"))
    ranged = _carry(_ranged(df, pos, span), [doc], {"_l": _last(own, F.col(pos))})
    w = Window.partitionBy(doc, "_range").orderBy(pos)
    before = F.coalesce(F.lag(own).over(w), "_l")
    marked = ranged.withColumn("_c", F.when(before.isNull() | ~before["k"].eqNullSafe(F.col(key)), 1).otherwise(0))
    marked = _carry(marked, [doc], {"_n": (F.sum("_c"), F.sum)})
    return marked.withColumn("island", F.coalesce("_n", F.lit(0)) + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c", "_l", "_n", "_range")


def join_ordered(pos: Column, text: Column, glue: str = "") -> Column:
    """Aggregate: texts joined in order of their position."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), text.alias("t")))), lambda x: x["t"]), glue)


def as_of_heading(df: DataFrame, doc: str, pos: str, heading: Column, span: int = SPAN) -> DataFrame:
    """Adds heading: the last non-blank one at or before each row; null before the first."""
    value = F.when(~is_blank(heading), heading)
    ranged = _carry(_ranged(df, pos, span), [doc], {"_c": _last(value, F.col(pos))})
    w = Window.partitionBy(doc, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("heading", F.coalesce(F.last(value, ignorenulls=True).over(w), "_c")).drop("_c", "_range")


#: Pages of a document that one task orders.
PAGE_SPAN = 1000


def neighbours(df: DataFrame, doc: str, page: str, idx: str, text: str, region: str, eligible: Column, limit: int = 180, span: int = PAGE_SPAN) -> DataFrame:
    """Adds before and after: previews of the nearest eligible texts across pages, of the same region where there is one, else of any.

    A preview is made before anything moves, so long texts are not carried along.
    """
    rows = source = _ranged(df, page, span).withColumn("_v", F.when(eligible, context_preview(F.col(text), limit)))
    place, v = F.struct(page, idx), F.col("_v")
    first = F.min_by(v, F.when(v.isNotNull(), place)), lambda c: F.first(c, ignorenulls=True)
    for keys, n in (([doc, region], "s"), ([doc], "a")):
        rows = _carry(rows, keys, {f"_{n}b": _last(v, place)}, {f"_{n}f": first}, source)
        w = Window.partitionBy(*keys, "_range").orderBy(page, idx)
        rows = rows.withColumn(f"_{n}b", F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), f"_{n}b"))
        rows = rows.withColumn(f"_{n}f", F.coalesce(F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), f"_{n}f"))
    return rows.withColumn("before", F.coalesce("_sb", "_ab")).withColumn("after", F.coalesce("_sf", "_af")).drop("_range", "_v", "_sb", "_sf", "_ab", "_af")


def continuation_flags(df: DataFrame, doc: str, page: str, idx: str, text: str, eligible: Column, span: int = PAGE_SPAN) -> DataFrame:
    """Adds from_previous and into_next: whether the first block of a page but the first goes on from the pages before, and the last one of a page but the last into the next.

    There must be an `eligible` text before, or after, and the block must begin, or end, in the open.
    """
    rows = _ranged(df, page, span).withColumn("_ok", eligible)
    place = F.struct(page, idx)
    # One row a document: its first and last page, and the places of its first and last eligible block. Few enough bytes to meet by document range.
    on_page = Window.partitionBy(doc, page)
    ends = {"_p0": (F.min(page), F.min), "_p1": (F.max(page), F.max), "_e0": (F.min(F.when(F.col("_ok"), place)), F.min), "_e1": (F.max(F.when(F.col("_ok"), place)), F.max)}
    rows = _carry(rows, [doc], {n: ends[n] for n in ("_p0", "_e0")}, {n: ends[n] for n in ("_p1", "_e1")})
    own = Window.partitionBy(doc, "_range")
    least = F.coalesce("_p0", F.min(page).over(own))
    most = F.coalesce("_p1", F.max(page).over(own))
    before = F.coalesce(F.col("_e0").isNotNull() | (F.min(F.when(F.col("_ok"), place)).over(own) < place), F.lit(False))
    after = F.coalesce(F.col("_e1").isNotNull() | (F.max(F.when(F.col("_ok"), place)).over(own) > place), F.lit(False))
    first = (F.col(idx) == F.min(idx).over(on_page)) & (F.col(page) > least)
    last = (F.col(idx) == F.max(idx).over(on_page)) & (F.col(page) < most)
    rows = rows.withColumn("from_previous", first & before & starts_open(F.col(text))).withColumn("into_next", last & after & ends_open(F.col(text)))
    return rows.drop("_range", "_ok", "_p0", "_p1", "_e0", "_e1")


#: Fields of a block that tell whether it goes on from another.
_PLACE = ("text", "region", "l", "r", "t", "b", "lh")


def group_paragraphs(df: DataFrame, keys: list[str], idx: str, groupable: Column, cells: Column, skipped: Column, settings: Layout = LAYOUT) -> DataFrame:
    """Adds unit: the number of the translation unit a block of a page begins or joins, from 1; null for skipped blocks.

    A block joins the one right before it if both are groupable and of one region, that one does not end a
    sentence, the gap between them is small, and it goes on by a hyphen, by its beginning or by its place. A block of
    several `cells` is as many units, of which `unit` is the first. Expects text, region, l, r, t, b and lh; a page's blocks are one partition.
    """
    w = Window.partitionBy(*keys).orderBy(idx)
    df = df.withColumn("_g", groupable).withColumn("_skip", skipped).withColumn("_cells", cells)
    df = df.withColumn("_prev", F.lag(F.struct(F.col("_g").alias("g"), *_PLACE)).over(w))
    prev = F.col("_prev")
    cur = F.struct(*_PLACE)
    height = F.greatest(prev["lh"], F.col("lh"))
    gap = prev["b"] - F.col("t")
    near = (gap >= -2) & (gap <= height * settings.grouping_gap)
    on = ends_with_hyphen(prev["text"]) | starts_open(F.col("text")) | starts_lower(F.col("text")) | goes_on_below(prev, cur, height, settings)
    joins = F.coalesce(F.col("_g") & prev["g"] & (prev["region"] == F.col("region")) & ~ends_sentence(prev["text"]) & near & on, F.lit(False))
    units = F.when(F.col("_skip") | joins, 0).otherwise(F.greatest(F.lit(1), "_cells"))
    numbered = df.withColumn("_units", units).withColumn("_upto", F.sum("_units").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("_units") > 0, F.col("_upto") - F.col("_units") + 1).otherwise(F.col("_upto"))
    return numbered.withColumn("unit", F.when(~F.col("_skip"), first)).drop("_g", "_skip", "_cells", "_prev", "_units", "_upto")


def concat_hyphenated(pos: Column, text: Column) -> Column:
    """Aggregate: texts in order in one, without the hyphens at their seams."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), text.alias("t")))), lambda x: x["t"])
    return F.aggregate(ordered, F.lit(""), join_hyphenated)


#: A word cut at the end of a text, and a small ASCII word at its beginning.
_CUT = rf"[A-Za-z]{{2,}}{SPACE}*[\-\x{{2010}}\x{{2011}}\x{{2012}}\x{{2013}}\x{{FE63}}\x{{FF0D}}\x{{AD}}]{SPACE}*$"
_HEAD = rf"^{SPACE}*[a-z]+{SPACE}*"


def hyphen_target(source: Column, target: Column, same_page: Column, settings: Layout = LAYOUT) -> Column:
    """Whether a block (struct of l, r, t, b, lh, text) may hold the rest of a word that another one ends with."""
    height = F.greatest(source["lh"], target["lh"])
    column = goes_on_below(source, target, height, settings)
    gap = source["b"] - target["t"]
    wraps = (target["l"] <= source["r"] + F.greatest(F.lit(48.0), height * (settings.wrap_forward + 0.5))) & (target["r"] >= source["l"] + F.greatest(F.lit(30.0), height * settings.wrap_backward))
    below = (gap >= -2) & (gap < height * 2.8) & (column | wraps)
    ws, wt = source["r"] - source["l"], target["r"] - target["l"]
    return starts_lower(target["text"]) & F.when(same_page, below).otherwise(column | (ws > wt * 0.7) | (wt > ws * 0.7))


def repair_hyphens(df: DataFrame, doc: str, page: str, idx: str, eligible: Column, settings: Layout = LAYOUT, span: int = PAGE_SPAN) -> DataFrame:
    """Adds repaired: a block that ends in a cut word has the rest of it, which the next eligible block of the document has lost.

    The cut part must be two ASCII letters or more, the rest a small ASCII word at the
    start of the next eligible block, which must lie where the text would go on, also across pages. Of several blocks
    before one such block the first takes the word. A block that is nothing but a small word and its hyphen takes none.
    Expects text, l, r, t, b and lh.
    """
    place = F.struct(F.regexp_extract("text", rf"{_HEAD}|^{SPACE}*[\"'(\[{{]*\p{{Ll}}", 0).alias("text"), "l", "r", "t", "b", "lh", F.col(page).alias("page"))
    at, order = F.struct(page, idx), (page, idx)
    out = _ranged(df, page, span).withColumn("_e", eligible).withColumn("_own", place)
    target = F.when(F.col("_e"), F.col("_own"))
    out = _carry(out, [doc], {"_sum": (F.count_if("_e"), F.sum)}, {"_later": (F.min_by(target, F.when(target.isNotNull(), at)), lambda c: F.first(c, ignorenulls=True))})
    w = Window.partitionBy(doc, "_range").orderBy(*order)
    out = out.withColumn("_next", F.coalesce(F.first(target, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "_later"))
    text = F.col("text")
    cut = text.rlike(_CUT) & (~text.rlike(_HEAD) | F.regexp_replace(text, _HEAD, "").rlike(_CUT))
    rest = leading_lower_word(F.col("_next.text"))
    takes = cut & F.col("_next").isNotNull() & (F.coalesce(rest, F.lit("")) != "") & hyphen_target(F.col("_own"), F.col("_next"), F.col("_next.page") == F.col(page), settings)
    # Blocks from one eligible block up to the next share the number of eligible ones so far, and with it their target.
    out = out.withColumn("_takes", F.coalesce(takes, F.lit(False))).withColumn("_rest", rest)
    out = out.withColumn("_group", F.coalesce("_sum", F.lit(0)) + F.count(F.when(F.col("_e"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(doc, "_group").orderBy(*order)
    out = out.withColumn("_takers", F.count(F.when(F.col("_takes"), 1)).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    out = _carry(out, [doc], {"_before": (F.max_by("_takers", at), lambda c: F.last(c))})
    out = out.withColumn("_gives", F.col("_e") & F.coalesce(F.coalesce(F.lag("_takers").over(w), "_before") > 0, F.lit(False)))
    own = F.when(F.col("_gives"), F.regexp_replace(text, _HEAD, "")).otherwise(text)
    repaired = F.when(F.col("_takes") & (F.col("_takers") == 1), F.concat(drop_hyphen(own), F.col("_rest"))).otherwise(own)
    made = out.withColumn("repaired", repaired)
    return made.select(*df.columns, "repaired")


def running_offsets(df: DataFrame, key: str, count: str, out: str) -> DataFrame:
    """Adds the sum of `count` over all rows of smaller `key`; keys are unique.

    Rows are range-partitioned; a task sums its range, and only one row per
    range goes through the window over ranges, so no task sorts all rows.
    """
    ranged = materialize(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the data.
    sums = ranged.groupBy("_range").agg(F.sum(count).alias("_sum"), F.min(key).alias("_first"))
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = ranged.withColumn("_within", F.coalesce(F.sum(count).over(w), F.lit(0)))
    return within.join(F.broadcast(base), "_range").withColumn(out, F.col("_base") + F.col("_within")).drop("_range", "_base", "_within")


def resume(df: DataFrame, doc: str, pos: str, done: Column) -> DataFrame:
    """Units that are still to do: those whose running number over all documents is greater than `done`; adds unit_index."""
    per_doc = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(per_doc, doc, "_n", "_offset").drop("_n")
    numbered = df.join(offsets, doc).withColumn("unit_index", F.col("_offset") + F.row_number().over(Window.partitionBy(doc).orderBy(pos)))
    return numbered.filter(F.col("unit_index") > done).drop("_offset")
