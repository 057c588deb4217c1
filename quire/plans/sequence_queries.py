"""Queries on rows in order and on lookups between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import hints as H
from quire.functions import layout as L
from quire.functions import text as X
from quire.operators import ranges
from quire.operators import sequence as S
from quire.operators.skew import add_groups
from quire.operators.versions import drop_repeats
from quire.plans import sql_rules as R
from quire.plans.carriers import current_segments, document_lines, page_blocks
from quire.plans.registry import SQL_BLOCKS, SQL_CURRENT, SQL_LINES, query, sql_strip
from quire.session import table

#: Requests (start, end) that are tried on every document.
REQUESTS = [(1, 0), (2, 4), (4, 2), (10, 3), (3, 99)]


@query(f"""WITH n AS (SELECT doc_id, count(*) AS total FROM ({SQL_LINES}) GROUP BY doc_id), q AS (SELECT * FROM (VALUES {', '.join(map(str, REQUESTS))}) v(s, e)),
r AS (SELECT doc_id, s AS start_no, e AS end_no, total, least(greatest(1, s), total) AS first, least(CASE WHEN e <= 0 THEN total ELSE greatest(greatest(1, s), e) END, total) AS last FROM n, q)
SELECT doc_id, start_no, end_no, first, last, last - first + 1 AS selected FROM r""")
def requested_range(spark: SparkSession, folder: str) -> DataFrame:
    """Five requested ranges over the lines of every document."""
    totals = document_lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in REQUESTS])).alias("q")
    rows = totals.select("doc_id", "total", asked)
    chosen = ranges.requested_range(F.col("q.s"), F.col("q.e"), F.col("total"))
    rows = rows.withColumn("c", chosen)
    return rows.select("doc_id", F.col("q.s").alias("start_no"), F.col("q.e").alias("end_no"), "c.first", "c.last", (F.col("c.last") - F.col("c.first") + 1).alias("selected"))


@query(f"""WITH l AS (SELECT *, CASE WHEN length(line) % 7 = 0 THEN 1 WHEN length(line) % 11 = 0 THEN 2 ELSE 0 END AS breaks, length(line) % 13 = 5 AS new_page FROM ({SQL_LINES})),
f AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(breaks) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 1 + before + sum(CASE WHEN rn > 1 AND new_page THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS page_no FROM f""")
def word_page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Page of each line, with breaks derived from its length."""
    n = F.length("line")
    rows = document_lines(spark, folder).withColumn("breaks", F.when(n % 7 == 0, 1).when(n % 11 == 0, 2).otherwise(0)).withColumn("new_page", n % 13 == 5)
    return S.page_numbers(rows, "doc_id", "pos", "breaks", "new_page").select("doc_id", "pos", "page_no")


_HEADS = "\n".join(
    f", last(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w AS p{k}, last(CASE WHEN level = {k} THEN line END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 5)
).replace("last(", "last_value(")
_OPEN = ", ".join("CASE WHEN " + " AND ".join([f"p{k} IS NOT NULL", *[f"(p{j} IS NULL OR p{j} < p{k})" for j in range(1, k)]]) + f" THEN t{k} END" for k in range(1, 5))


@query(f"""WITH l AS (SELECT *, CASE WHEN length(line) BETWEEN 1 AND 40 THEN length(line) % 4 + 1 END AS level FROM ({SQL_LINES})),
h AS (SELECT doc_id, pos{_HEADS} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, pos, concat_ws(' > ', {_OPEN}) AS breadcrumb FROM h""")
def heading_breadcrumb(spark: SparkSession, folder: str) -> DataFrame:
    """Headings each line stands under; short lines are headings of a level by their length."""
    n = F.length("line")
    rows = document_lines(spark, folder).withColumn("level", F.when(n.between(1, 40), n % 4 + 1))
    return S.breadcrumbs(rows, "doc_id", "pos", "level", "line", 4).select("doc_id", "pos", "breadcrumb")


@query(f"""WITH l AS (SELECT *, length(line) % 3 AS key FROM ({SQL_LINES})), c AS (SELECT *, CASE WHEN lag(key) OVER w IS DISTINCT FROM key OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c)
SELECT doc_id, island, min(key) AS key, count(*) AS runs, string_agg(line, '' ORDER BY pos) AS text FROM i GROUP BY doc_id, island""")
def format_run_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent runs of one format in one piece."""
    rows = S.islands(document_lines(spark, folder).withColumn("key", F.length("line") % 3), "doc_id", "pos", "key")
    return rows.groupBy("doc_id", "island").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("runs"), S.join_ordered(F.col("pos"), F.col("line")).alias("text"))


@query(f"""WITH cur AS ({SQL_CURRENT}), h AS (SELECT doc_id, seq, last_value(CASE WHEN context = 'heading' AND {sql_strip('original')} <> '' THEN original END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM cur) SELECT * FROM h WHERE heading IS NOT NULL""")
def positional_asof_heading(spark: SparkSession, folder: str) -> DataFrame:
    """The heading each segment stands under."""
    rows = current_segments(spark, folder)
    return S.as_of_heading(rows, "doc_id", "seq", F.when(F.col("context") == "heading", F.col("original"))).filter("heading IS NOT NULL").select("doc_id", "seq", "heading")


def _sql_preview(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '[' || chr(13) || chr(10) || ' ]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > 180 THEN substring({flat}, 1, 180) || '...' ELSE {flat} END"


_NEAR = f"""e AS ({R.eligible(f'({SQL_BLOCKS})')}), v AS (SELECT *, CASE WHEN ok THEN text END AS v FROM e),
n AS (SELECT *,
 coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id, region ORDER BY page, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b0,
 coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY doc_id, region ORDER BY page, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), first_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS a0,
 idx = min(idx) OVER (PARTITION BY doc_id, page) AND page > min(page) OVER (PARTITION BY doc_id) AND b0 IS NOT NULL AND {R.starts_open('text')} AS from_previous,
 idx = max(idx) OVER (PARTITION BY doc_id, page) AND page < max(page) OVER (PARTITION BY doc_id) AND a0 IS NOT NULL AND {R.ends_open('text')} AS into_next FROM v)"""


def _context(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with `f`, their formula flags, and `ok`, whether they give context."""
    rows = page_blocks(spark, folder).withColumn("f", L.formula_flags(F.col("text")))
    return rows.withColumn("ok", L.gives_context(F.col("text"), F.col("block_type"), F.col("region"), F.col("f.pure")))


@query(f"WITH {_NEAR} SELECT doc_id, page, idx, {_sql_preview('b0')} AS before, {_sql_preview('a0')} AS after FROM n")
def neighbour_context(spark: SparkSession, folder: str) -> DataFrame:
    """Previews of the texts before and after each block, across pages."""
    return S.neighbours(_context(spark, folder), "doc_id", "page", "idx", "text", "region", F.col("ok")).select("doc_id", "page", "idx", "before", "after")


@query(f"WITH {_NEAR} SELECT doc_id, page, idx, from_previous, into_next FROM n")
def cross_page_continuation(spark: SparkSession, folder: str) -> DataFrame:
    """Whether blocks at the edges of pages go on from, or into, the next page."""
    return S.continuation_flags(_context(spark, folder), "doc_id", "page", "idx", "text", F.col("ok")).select("doc_id", "page", "idx", "from_previous", "into_next")


_REGIONS = "CASE region WHEN 'Caption' THEN '图注区' WHEN 'Table' THEN '表格区' WHEN 'Margin' THEN '边注区' WHEN 'HeaderFooter' THEN '页眉页脚区' WHEN 'Footnote' THEN '脚注区' ELSE '正文区' END"


@query(f"""WITH {_NEAR} SELECT doc_id, page, idx, array_to_string(list_filter(['PDF 第 ' || page || ' 页文本块 ' || (idx + 1), CASE WHEN region <> 'Body' THEN '区域：' || {_REGIONS} END, '前文：' || ({_sql_preview('b0')}), '后文：' || ({_sql_preview('a0')}),
 CASE WHEN from_previous OR into_next THEN '当前文本很可能是跨页续句。请结合前后文完整翻译当前片段，但不要把前后文一并输出。' END], lambda q: q IS NOT NULL), '；') || CASE WHEN has_formula THEN '；当前片段包含公式、变量或编号。请翻译可翻译的正文内容，并严格保留公式、变量名、运算符、编号和引用格式。' ELSE '' END AS hint FROM n""")
def context_hints(spark: SparkSession, folder: str) -> DataFrame:
    """What a translator is told of the place of each block."""
    near = S.neighbours(_context(spark, folder), "doc_id", "page", "idx", "text", "region", F.col("ok"))
    rows = S.continuation_flags(near, "doc_id", "page", "idx", "text", F.col("ok"))
    hint = H.block_hint(F.col("page"), F.col("idx") + 1, F.col("region"), F.col("before"), F.col("after"), F.col("from_previous") | F.col("into_next"), F.col("f.contains"))
    return rows.select("doc_id", "page", "idx", hint.alias("hint"))


@query(f"""WITH e AS ({R.formula(f'({SQL_BLOCKS})')}) SELECT doc_id, page, idx, array_to_string(list_filter([CASE WHEN region <> 'Body' THEN '页面区域：' || {_REGIONS} || '。请保持该区域常见的表达方式和结构，不要把它改写成普通正文。' END,
 CASE block_type WHEN 'Title' THEN '类型：标题。请保持标题风格，译文尽量简洁，不要擅自补充说明或改写成正文语气。' WHEN 'Caption' THEN '类型：图注。请保留图号、表号、子图编号（如(a)/(b)）、单位、变量名和引用标记；语言保持简洁，不要扩写。' WHEN 'TableRow' THEN '类型：表格。请严格保持列顺序、数字、单位、百分比、正负号和变量符号，不要把多列内容合并成解释性整句。'
  WHEN 'ListItem' THEN '类型：列表。请保留项目符号、编号层级和换行结构，不要把多个条目合并成一段。' WHEN 'Code' THEN '类型：代码。只翻译自然语言说明，保留代码、路径、API 名称、命令行参数和符号原样。' WHEN 'Footnote' THEN '类型：脚注。请保留脚注编号/符号与引用关系，语言可简洁但不要漏译。' WHEN 'HeaderFooter' THEN '类型：页眉页脚。请保留页码、编号、期刊信息和短标题的结构，不要扩写。' END,
 CASE WHEN has_formula THEN '当前片段含公式或变量。请仅翻译自然语言部分，严格保留公式、变量名、上下标、编号、引用、单位和符号。' END, CASE WHEN source = 'Ocr' THEN '当前片段来自 OCR。请结合上下文纠正明显断词，但不要臆造原文中不存在的数字、公式或专有名词。' END], lambda q: q IS NOT NULL), chr(10)) AS requirements FROM e""")
def block_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """What a translator is to keep of each block."""
    made = H.block_requirements(F.col("block_type"), F.col("region"), L.formula_flags(F.col("text"))["contains"], F.col("source") == "Ocr")
    return page_blocks(spark, folder).select("doc_id", "page", "idx", made.alias("requirements"))


_UNITS = f"""e AS ({R.eligible(f'({SQL_BLOCKS})')}),
c AS (SELECT *, {R.trimmed('text')} = '' OR pure_formula AS skip, CASE WHEN block_type = 'TableRow' THEN greatest(1, len(list_filter(regexp_split_to_array({R.trimmed('text')}, '\t+|{R.S}{{2,}}'), lambda q: {R.trimmed('q')} <> ''))) ELSE 1 END AS cells,
 lag({{'g': plain, 'rg': region, 'x': text, 'l': l, 'r': r, 'b': b, 'lh': lh}}) OVER (PARTITION BY doc_id, page ORDER BY idx) AS p FROM e),
j AS (SELECT *, greatest(p.lh, lh) AS h, coalesce(plain AND p.g AND p.rg = region AND NOT {R.ends_sentence('p.x')} AND p.b - t >= -2 AND p.b - t <= greatest(p.lh, lh) * 3.2
  AND ({R.ends_hyphen('p.x')} OR {R.starts_open('text')} OR {R.starts_lower('text')} OR {R.below('p.', '', 'greatest(p.lh, lh)')}), false) AS joins FROM c),
u AS (SELECT *, CASE WHEN skip OR joins THEN 0 ELSE cells END AS n, sum(CASE WHEN skip OR joins THEN 0 ELSE cells END) OVER (PARTITION BY doc_id, page ORDER BY idx) AS upto FROM j),
w AS (SELECT *, CASE WHEN n > 0 THEN upto - n + 1 ELSE upto END AS unit FROM u WHERE NOT skip)"""


def _units(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the unit they begin or join."""
    rows = page_blocks(spark, folder).withColumn("_pure", L.is_formula(F.col("text")))
    text, kind, pure = F.col("text"), F.col("block_type"), F.col("_pure")
    cells = F.when(kind == "TableRow", F.size(X.table_segments(X.strip(text)))).otherwise(1)
    skipped = X.is_blank(text) | pure
    return S.group_paragraphs(rows, ["doc_id", "page"], "idx", L.is_groupable(text, kind, F.col("region"), pure), cells, skipped).filter("unit IS NOT NULL")


@query(f"WITH {_UNITS} SELECT doc_id, page, unit::BIGINT AS unit, count(*) AS blocks, min(idx) AS first_block, max(idx) AS last_block FROM w GROUP BY 1, 2, 3")
def paragraph_unit_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of a page that form one translation unit."""
    return _units(spark, folder).groupBy("doc_id", "page", "unit").agg(F.count(F.lit(1)).alias("blocks"), F.min("idx").alias("first_block"), F.max("idx").alias("last_block"))


@query(f"""WITH {_UNITS} SELECT doc_id, page, unit::BIGINT AS unit, list_reduce(list({R.trimmed('text')} ORDER BY idx), lambda a, q: CASE WHEN {R.ends_hyphen('a')} THEN regexp_replace(a, '{R.S}*{R.HYPHEN}{R.S}*$', '') || q ELSE a || ' ' || q END) AS text FROM w GROUP BY 1, 2, 3""")
def paragraph_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the translation units, without the hyphens at the seams of their blocks."""
    return _units(spark, folder).groupBy("doc_id", "page", "unit").agg(S.concat_hyphenated(F.col("idx"), X.strip(F.col("text"))).alias("text"))


_CUT = rf"[A-Za-z]{{2,}}{R.S}*{R.HYPHEN}{R.S}*$"
_HEAD = f"^{R.S}*[a-z]+{R.S}*"


@query(f"""WITH e AS ({R.eligible(f'({SQL_BLOCKS})')}), o AS (SELECT *, {{'x': text, 'l': l, 'r': r, 't': t, 'lh': lh, 'page': page}} AS own FROM e),
a AS (SELECT *, first_value(CASE WHEN ok THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q, count(*) FILTER (ok) OVER (PARTITION BY doc_id ORDER BY page, idx) AS grp FROM o),
k AS (SELECT *, greatest(lh, q.lh) AS h, coalesce(regexp_matches(text, '{_CUT}') AND (NOT regexp_matches(text, '{_HEAD}') OR regexp_matches(regexp_replace(text, '{_HEAD}', ''), '{_CUT}')) AND regexp_extract(q.x, '^{R.S}*([a-z]+)', 1) <> '' AND {R.starts_lower('q.x')}
 AND CASE WHEN q.page = page THEN b - q.t >= -2 AND b - q.t < greatest(lh, q.lh) * 2.8 AND ({R.below('', 'q.', 'greatest(lh, q.lh)')} OR (q.l <= r + greatest(48.0, greatest(lh, q.lh) * 7.0) AND q.r >= l + greatest(30.0, greatest(lh, q.lh) * 5.0)))
  ELSE {R.below('', 'q.', 'greatest(lh, q.lh)')} OR r - l > (q.r - q.l) * 0.7 OR q.r - q.l > (r - l) * 0.7 END, false) AS takes FROM a),
n AS (SELECT *, count(*) FILTER (takes) OVER (PARTITION BY doc_id, grp ORDER BY page, idx) AS takers FROM k),
g AS (SELECT *, ok AND coalesce(lag(takers) OVER (PARTITION BY doc_id ORDER BY page, idx) > 0, false) AS gives FROM n),
f AS (SELECT *, CASE WHEN gives THEN regexp_replace(text, '{_HEAD}', '') ELSE text END AS mine FROM g)
SELECT doc_id, page, idx, CASE WHEN takes AND takers = 1 THEN regexp_replace(mine, '{R.S}*{R.HYPHEN}{R.S}*$', '') || regexp_extract(q.x, '^{R.S}*([a-z]+)', 1) ELSE mine END AS repaired FROM f""")
def hyphen_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Words cut at the end of a block made whole."""
    return S.repair_hyphens(_context(spark, folder), "doc_id", "page", "idx", F.col("ok")).select("doc_id", "page", "idx", "repaired")


@query("""WITH u AS (SELECT DISTINCT doc_id, unit_no, context FROM epub_units), f AS (SELECT DISTINCT doc_id, unit_no, fragment_no FROM epub_fragments)
SELECT f.doc_id, f.unit_no, f.fragment_no, coalesce(u.context, '') AS context, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.unit_no, f.fragment_no) AS place FROM f JOIN u USING (doc_id, unit_no)""")
def spine_order(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments joined with their units, in reading order."""
    unit = drop_repeats(table(spark, folder, "epub_units"), ["doc_id", "unit_no"], ["context"])
    part = table(spark, folder, "epub_fragments").select("doc_id", "unit_no", "fragment_no").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no", "fragment_no")).cast("bigint")
    return part.join(unit, ["doc_id", "unit_no"]).select("doc_id", "unit_no", "fragment_no", F.coalesce("context", F.lit("")).alias("context"), place.alias("place"))


@query("""SELECT DISTINCT u.doc_id, u.unit_no FROM epub_units u WHERE u.context = 'nav' AND NOT EXISTS (SELECT 1 FROM epub_fragments f WHERE f.doc_id = u.doc_id AND f.unit_no = u.unit_no AND f.fragment_no > 1)""")
def nav_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Navigation units that are not content of several fragments."""
    cut = table(spark, folder, "epub_fragments").filter("fragment_no > 1").select("doc_id", "unit_no")
    return table(spark, folder, "epub_units").filter("context = 'nav'").select("doc_id", "unit_no").distinct().join(cut, ["doc_id", "unit_no"], "left_anti")


@query(f"""WITH cur AS ({SQL_CURRENT}), h AS (SELECT doc_id, seq, max(translation) AS t FROM cur WHERE context = 'heading' GROUP BY 1, 2), d AS (SELECT doc_id, arg_min(translation, seq) AS t FROM cur WHERE context = 'heading' GROUP BY 1)
SELECT c.doc_id, c.seq, coalesce(h.t, d.t, c.translation) AS label, CASE WHEN h.t IS NOT NULL THEN 'anchor' WHEN d.t IS NOT NULL THEN 'document' ELSE 'own' END AS found FROM cur c LEFT JOIN h ON h.doc_id = c.doc_id AND h.seq = c.seq LEFT JOIN d ON d.doc_id = c.doc_id WHERE c.context IN ('heading', 'slide title', 'chapter')""")
def toc_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a table of contents: by anchor, else by document, else as they are."""
    rows = current_segments(spark, folder)
    heads = rows.filter("context = 'heading'")
    anchor = heads.select("doc_id", "seq", F.col("translation").alias("_a"))
    entries = rows.filter(F.col("context").isin("heading", "slide title", "chapter"))
    # A document may hold a third of all entries, so its one label does not meet them in one task.
    sizes = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    document = heads.groupBy("doc_id").agg(F.min_by("translation", "seq").alias("_d")).join(sizes, "doc_id")
    wanted = add_groups(entries.join(anchor, ["doc_id", "seq"], "left"), document, "doc_id", "_n", entries.count())
    found = F.when(F.col("_a").isNotNull(), "anchor").when(F.col("_d").isNotNull(), "document").otherwise("own")
    return wanted.select("doc_id", "seq", F.coalesce("_a", "_d", "translation").alias("label"), found.alias("found"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def shared_string_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Shared strings that the chosen cells refer to."""
    cells = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").select("p_partkey", "p_name").join(cells, "p_partkey", "left_semi")


@query("""WITH p AS (SELECT lower(replace(source_path, '\\', '/')) AS path, min(doc_id) AS doc_id, count(*) AS listed FROM documents WHERE source_path IS NOT NULL GROUP BY 1)
SELECT path, doc_id, listed, CASE regexp_extract(path, '\\.([a-z0-9]+)$', 1) WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'excel' WHEN 'pptx' THEN 'powerpoint' WHEN 'pdf' THEN 'pdf' WHEN 'epub' THEN 'ebook' WHEN 'mobi' THEN 'ebook' WHEN 'azw3' THEN 'ebook' ELSE 'failed' END AS reader,
 regexp_replace(path, '\\.[^./]*$', '') || '.translated' || regexp_extract(path, '(\\.[^./]*)$', 1) AS output_path FROM p""")
def format_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct files (path in any case and slashes), the reader of their format and the path of their result."""
    from quire.sources.formats import output_path, reader_of

    path = F.lower(F.regexp_replace("source_path", r"\\", "/"))
    files = table(spark, folder, "documents").filter("source_path IS NOT NULL").groupBy(path.alias("path")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("listed"))
    return files.select("path", "doc_id", "listed", reader_of(F.col("path")).alias("reader"), output_path(F.col("path")).alias("output_path"))


@query(f"""WITH n AS (SELECT doc_id, pos, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id, pos) AS unit_index FROM ({SQL_LINES})) SELECT doc_id, pos, unit_index, round_even(unit_index * 100.0 / total, 0)::INT AS progress FROM n WHERE unit_index > 100""")
def unit_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running number and progress of the units that are left after the first hundred."""
    rows = document_lines(spark, folder)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    left = S.resume(rows, "doc_id", "pos", F.lit(100)).join(F.broadcast(total), F.lit(True))
    return left.select("doc_id", "pos", "unit_index", F.bround(F.col("unit_index") * 100.0 / F.col("total")).cast("int").alias("progress"))
