"""Queries on the layout of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.operators import layout as O
from quire.operators import pages
from quire.plans import sql_rules as R
from quire.plans.carriers import document_lines, page_blocks
from quire.plans.registry import SQL_BLOCKS, SQL_LINES, query
from quire.session import table

WIDTH, HEIGHT = 595.0, 842.0

_BOXES = f"""t0 AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \\t\\r]+'), lambda w: w <> '') AS ws FROM ({SQL_LINES})),
t1 AS (SELECT doc_id, pos, unnest(range(1, len(ws) + 1)) AS k, ws FROM t0),
box AS (SELECT doc_id, ((pos - 1) // 50 + 1)::INT AS page, pos AS line_no, (k - 1)::INT AS word_no, ws[k] AS text, coalesce(list_sum(list_transform(ws[1:k-1], lambda w: length(w) + 1)), 0) * 6.0::DOUBLE AS l, (coalesce(list_sum(list_transform(ws[1:k-1], lambda w: length(w) + 1)), 0) + length(ws[k])) * 6.0::DOUBLE AS r, 800.0::DOUBLE - 14.0::DOUBLE * ((pos - 1) % 50) AS t, 800.0::DOUBLE - 14.0::DOUBLE * ((pos - 1) % 50) - 11.2::DOUBLE AS b FROM t1)"""


@query(f"""WITH {_BOXES} SELECT doc_id, page, min(l) AS l, max(r) AS r, max(t) AS t, round(min(b), 6) AS b, count(*) AS words, round(sum(greatest(1.0, r - l) * greatest(1.0, t - b)) / {WIDTH * HEIGHT}, 6) AS coverage FROM box GROUP BY doc_id, page""")
def line_bbox_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Box, words and covered share of every page of words."""
    boxes = O.bounding_boxes(O.token_boxes(document_lines(spark, folder)), ["doc_id", "page"])
    return boxes.select("doc_id", "page", "l", "r", "t", F.round("b", 6).alias("b"), "words", F.round(F.col("area") / (WIDTH * HEIGHT), 6).alias("coverage"))


@query(f"""WITH {_BOXES}, g AS (SELECT doc_id, line_no, l - lag(r) OVER (PARTITION BY doc_id, line_no ORDER BY l, word_no) AS gap, avg(r - l) OVER (PARTITION BY doc_id, line_no) AS mean FROM box)
SELECT doc_id, line_no, count(*) AS words, count(gap) AS gaps, sum(CASE WHEN gap > 1.5 * mean THEN 1 ELSE 0 END) AS large, count(*) >= 3 AND sum(CASE WHEN gap > 1.5 * mean THEN 1 ELSE 0 END) >= 2 AND sum(CASE WHEN gap > 1.5 * mean THEN 1 ELSE 0 END) >= 0.3 * count(gap) AS is_row FROM g GROUP BY doc_id, line_no""")
def table_row_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose words stand in columns."""
    return O.table_rows(O.token_boxes(document_lines(spark, folder)), ["doc_id", "line_no"])


_COLS = f"""{_BOXES}, d AS (SELECT doc_id, page, l, lag(l) OVER (PARTITION BY doc_id, page ORDER BY l) AS p FROM box),
c AS (SELECT doc_id, page, p + (l - p) / 2 AS boundary, row_number() OVER (PARTITION BY doc_id, page ORDER BY l - p DESC, p + (l - p) / 2) AS k FROM d WHERE l - p > {WIDTH} * 0.04),
s AS (SELECT doc_id, page, greatest(1.0, max(t) - min(b)) AS h FROM box GROUP BY 1, 2 HAVING count(*) >= 5),
j AS (SELECT c.doc_id, c.page, c.boundary, s.h, x.r < c.boundary AS lft, x.l > c.boundary AS rgt, x.t, x.b FROM c JOIN s USING (doc_id, page) JOIN box x ON x.doc_id = c.doc_id AND x.page = c.page WHERE k <= 3),
ok AS (SELECT doc_id, page, boundary FROM j GROUP BY 1, 2, 3 HAVING count(*) FILTER (lft) >= 3 AND count(*) FILTER (rgt) >= 3 AND max(t) FILTER (lft) - min(b) FILTER (lft) > 0.25 * max(h) AND max(t) FILTER (rgt) - min(b) FILTER (rgt) > 0.25 * max(h))"""


@query(f"WITH {_COLS} SELECT doc_id, page, boundary FROM ok")
def column_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Where the columns of each page part."""
    pages = O.page_columns(O.token_boxes(document_lines(spark, folder)), ["doc_id", "page"], WIDTH)
    return pages.select("doc_id", "page", F.explode("cuts").alias("boundary"))


@query(f"WITH {_COLS}, n AS (SELECT x.doc_id, x.page, x.line_no, x.word_no, 1 + count(ok.boundary) AS column_no FROM box x LEFT JOIN ok ON ok.doc_id = x.doc_id AND ok.page = x.page AND ok.boundary <= (x.l + x.r) / 2 GROUP BY 1, 2, 3, 4) SELECT doc_id, page, column_no::INT AS column_no, count(*) AS words FROM n GROUP BY 1, 2, 3")
def column_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each column of each page."""
    pages = O.page_columns(O.token_boxes(document_lines(spark, folder)), ["doc_id", "page"], WIDTH)
    return pages.select("doc_id", "page", F.explode("words").alias("w")).groupBy("doc_id", "page", F.col("w.column_no").alias("column_no")).agg(F.count(F.lit(1)).alias("words"))


@query()
def layout_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks of every page: words without marginal noise, columns, lines, blocks, merges, roles and regions."""
    boxes = O.token_boxes(document_lines(spark, folder))
    boxes = boxes.filter(~L.marginal_noise(F.col("text"), F.col("l"), F.col("r"), F.col("t"), F.col("b"), WIDTH))
    return pages.build_blocks(O.page_columns(boxes, ["doc_id", "page"], WIDTH), ["doc_id", "page"], WIDTH, HEIGHT)


@query()
def continuation_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of pages with those that go on from another merged into it."""
    rows = page_blocks(spark, folder).withColumnRenamed("block_type", "kind")
    return pages.merge_continuations(rows, ["doc_id", "page"])


@query(f"""WITH b AS (SELECT *, CASE WHEN size > 0 THEN size ELSE lh END AS fs, {R.trimmed('text')} AS x FROM ({SQL_BLOCKS})), m AS (SELECT doc_id, page, list_sort(list(fs))[count(fs) // 2 + 1] AS med FROM b GROUP BY 1, 2),
r AS (SELECT b.*, CASE WHEN {R.caption('text')} THEN 'Caption' WHEN length(x) <= 24 AND (t / {HEIGHT} > 0.9 OR b / {HEIGHT} < 0.1) AND ({R.page_mark('text')} OR length(x) <= 18) THEN 'HeaderFooter'
 WHEN b / {HEIGHT} < 0.18 AND NOT fs > med * 0.92 AND ({R.footnote_mark('text')} OR length(x) <= 100) THEN 'Footnote'
 WHEN length(x) <= 80 AND r - l < {WIDTH} * 0.8 AND NOT {R.ends_sentence('text')} AND (coalesce(alignment, '') = 'Center' OR (t / {HEIGHT} > 0.58 AND fs >= med * 1.15)) THEN 'Title' ELSE block_type END AS role FROM b JOIN m USING (doc_id, page))
SELECT doc_id, page, idx, role FROM r""")
def block_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Types of blocks once their page is known: captions, running lines, footnotes, titles."""
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("lh"))
    rows = page_blocks(spark, folder).withColumn("fs", size)
    median = rows.groupBy("doc_id", "page").agg(O.upper_median(F.col("fs")).alias("med"))
    centered = F.coalesce(F.col("alignment") == "Center", F.lit(False))
    role = L.block_role(F.col("block_type"), F.col("text"), *(F.col(c) for c in "lrtb"), F.col("fs"), F.col("med"), centered, WIDTH, HEIGHT)
    return rows.join(median, ["doc_id", "page"]).select("doc_id", "page", "idx", role.alias("role"))


@query(f"""WITH b AS ({SQL_BLOCKS}), n AS (SELECT doc_id, lower(font) AS low, count(*) AS n, min({{'page': page, 'idx': idx, 'font': font}}) AS f FROM b WHERE font IS NOT NULL GROUP BY 1, 2),
d AS (SELECT doc_id, f.font AS font, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM n),
m AS (SELECT doc_id, list_sort(list(size))[count(size) // 2 + 1] AS median_size, round(coalesce(avg(CASE WHEN size > 0 THEN size END), 0), 6) AS mean_size, count(*) FILTER (bold) > count(*) // 2 AS mostly_bold FROM b GROUP BY 1)
SELECT m.doc_id, d.font, median_size, mean_size, mostly_bold FROM m LEFT JOIN d ON d.doc_id = m.doc_id AND k = 1""")
def dominant_font(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent font, upper median and mean size, and whether most blocks are bold, of each document."""
    rows = page_blocks(spark, folder)
    sizes = rows.groupBy("doc_id").agg(
        O.upper_median(F.col("size")).alias("median_size"),
        F.round(F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(0.0)), 6).alias("mean_size"),
        (F.count_if(F.col("bold")) > F.floor(F.count(F.lit(1)) / 2)).alias("mostly_bold"),
    )
    return sizes.join(O.dominant(rows, ["doc_id"], "font", ["page", "idx"]), "doc_id", "left").select("doc_id", "font", "median_size", "mean_size", "mostly_bold")


@query(f"""WITH b AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN 'TableRow' WHEN idx % 4 = 1 THEN 'Caption' ELSE block_type END AS kind FROM ({SQL_BLOCKS}))
SELECT DISTINCT c.doc_id, c.page, c.idx FROM b c WHERE c.kind = 'Caption' AND EXISTS (SELECT 1 FROM b t WHERE t.kind = 'TableRow' AND t.doc_id = c.doc_id AND t.page = c.page AND abs((c.t + c.b) / 2 - (t.t + t.b) / 2) < 6 * greatest(c.lh, t.lh) AND least(c.r, t.r) - greatest(c.l, t.l) > 0 AND (least(c.r, t.r) - greatest(c.l, t.l)) / greatest(1.0, least(c.r - c.l, t.r - t.l)) > 0.2)""")
def caption_near_table(spark: SparkSession, folder: str) -> DataFrame:
    """Captions with a row of a table near them; every fourth block stands for a caption."""
    rows = page_blocks(spark, folder).withColumn("block_type", F.when(F.col("text").rlike("^[0-9]+$"), "TableRow").when(F.col("idx") % 4 == 1, "Caption").otherwise(F.col("block_type")))
    return O.captions_of_tables(rows, ["doc_id", "page"]).select("doc_id", "page", "idx").distinct()


@query(f"""WITH b AS ({SQL_BLOCKS}), a AS (SELECT doc_id, page, count(*) AS blocks, sum(len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}]+'))) AS words, sum(greatest(1.0, r - l) * greatest(1.0, t - b)) / {WIDTH * HEIGHT} AS coverage FROM b WHERE source = 'Native' GROUP BY 1, 2)
SELECT doc_id, page, blocks, words::BIGINT AS words, round(coverage, 6) AS coverage, blocks = 0 OR words < 8 OR (words < 16 AND coverage < 0.025 AND blocks <= 3) AS needs_ocr FROM a""")
def needs_ocr(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with too little text of their own."""
    from quire.functions.text import token_count

    rows = page_blocks(spark, folder).filter("source = 'Native'")
    area = F.greatest(F.lit(1.0), F.col("r") - F.col("l")) * F.greatest(F.lit(1.0), F.col("t") - F.col("b"))
    pages = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("blocks"), F.sum(token_count(F.col("text"))).alias("words"), (F.sum(area) / (WIDTH * HEIGHT)).alias("c"))
    return pages.select("doc_id", "page", "blocks", "words", F.round("c", 6).alias("coverage"), L.needs_ocr(F.col("blocks"), F.col("words"), F.col("c")).alias("needs_ocr"))


@query(f"""WITH o AS (SELECT DISTINCT doc_id, page, idx, text, left_x, top_y, width, height FROM ocr_blocks), t AS (SELECT *, {R.trimmed("coalesce(text, '')")} AS x, left_x + width / 2 AS mid FROM o)
SELECT doc_id, page, idx, round(842.0 - top_y, 6) AS flipped, x <> '' AND NOT ({R.page_mark('x')} OR ((mid < {WIDTH} * 0.08 OR mid > {WIDTH} * 0.92) AND length(x) <= 2 AND width < {WIDTH} * 0.08) OR ((top_y < {HEIGHT} * 0.06 OR top_y + height > {HEIGHT} * 0.94) AND length(x) <= 10)) AS keep FROM t""")
def ocr_keep_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised blocks that are kept, and their height measured from the bottom."""
    rows = table(spark, folder, "ocr_blocks").select("doc_id", "page", "idx", "text", "left_x", "top_y", "width", "height").distinct()
    keep = L.keep_ocr_block(F.col("text"), F.col("left_x"), F.col("top_y"), F.col("width"), F.col("height"), WIDTH, HEIGHT)
    return rows.select("doc_id", "page", "idx", F.round(L.flip_y(F.col("top_y"), HEIGHT), 6).alias("flipped"), keep.alias("keep"))


@query(f"""WITH b AS ({SQL_BLOCKS}), m AS (SELECT *, (l + r) / 2 AS mid, {WIDTH} - r AS rs, {R.trimmed('text')} AS x FROM b) SELECT doc_id, page, idx,
 CASE block_type WHEN 'HeaderFooter' THEN 'HeaderFooter' WHEN 'Footnote' THEN 'Footnote' WHEN 'Caption' THEN 'Caption' WHEN 'TableRow' THEN 'Table' ELSE CASE WHEN (mid < {WIDTH} * 0.12 OR mid > {WIDTH} * 0.88) AND r - l < {WIDTH} * 0.22 AND length(x) <= 60 AND t > {HEIGHT} * 0.08 AND b < {HEIGHT} * 0.92 THEN 'Margin' ELSE 'Body' END END AS region,
 CASE WHEN abs(l - rs) < {WIDTH} * 0.03 THEN 'Center' WHEN rs < {WIDTH} * 0.03 AND l > {WIDTH} * 0.15 THEN 'Right' WHEN l < {WIDTH} * 0.03 OR (l < {WIDTH} * 0.12 AND rs > {WIDTH} * 0.1) THEN 'Left' WHEN (r - l) / {WIDTH} < 0.6 AND abs(l - rs) < {WIDTH} * 0.08 THEN 'Center' ELSE 'Left' END AS aligned,
 (mid < {WIDTH} * 0.1 OR mid > {WIDTH} * (1 - 0.1::DOUBLE)) AND (greatest(1.0, t - b) > greatest(1.0, r - l) * 1.4 OR length(x) <= 3 OR contains(lower(text), 'arxiv') OR contains(lower(text), '[cs.')) AS marginal_noise FROM m""")
def regions_and_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Region, alignment and marginal noise of every block."""
    l, r, t, b = (F.col(c) for c in "lrtb")
    noise = L.marginal_noise(F.col("text"), l, r, t, b, WIDTH)
    return page_blocks(spark, folder).select("doc_id", "page", "idx", L.region(F.col("block_type"), F.col("text"), l, r, t, b, WIDTH, HEIGHT).alias("region"), L.alignment(l, r, WIDTH).alias("aligned"), noise.alias("marginal_noise"))


@query(f"SELECT chunk_id, pure_formula, has_formula AS contains_formula FROM ({R.formula('(SELECT chunk_id, original AS text FROM chunks WHERE original IS NOT NULL)')})")
def formula_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a chunk is, or has, a formula."""
    rows = table(spark, folder, "chunks").filter("original IS NOT NULL").withColumn("f", L.formula_flags(F.col("original")))
    return rows.select("chunk_id", F.col("f.pure").alias("pure_formula"), F.col("f.contains").alias("contains_formula"))


@query("""WITH b AS (SELECT DISTINCT doc_id, page, idx, style.color AS color FROM blocks WHERE style.color IS NOT NULL), n AS (SELECT doc_id, lower(color) AS low, count(*) AS n, min({'page': page, 'idx': idx, 'color': color}) AS f FROM b GROUP BY 1, 2), r AS (SELECT doc_id, f.color AS color, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM n)
SELECT doc_id, color FROM r WHERE k = 1""")
def dominant_colour(spark: SparkSession, folder: str) -> DataFrame:
    """The colour most blocks of a document have; of equally frequent ones the first."""
    rows = table(spark, folder, "blocks").select("doc_id", "page", "idx", F.col("style.color").alias("color")).distinct()
    return O.dominant(rows, ["doc_id"], "color", ["page", "idx"])
