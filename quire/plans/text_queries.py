"""Queries on texts: audit of bilingual tables, quality predicates, string functions, glossary, cache, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import quality as Q
from quire.functions import text as X
from quire.operators import glossary as G
from quire.plans import sql_rules as R
from quire.plans.carriers import current_segments, document_lines
from quire.plans.registry import SP, SQL_CURRENT, SQL_LINES, query, sql_comparable, sql_ratio, sql_strip
from quire.session import table

_CJK = X.CJK_NARROW
_AUDIT = f"""
WITH cur AS ({SQL_CURRENT}),
s AS (SELECT doc_id, seq, {sql_strip('original')} AS o, {sql_strip('translation')} AS t FROM cur),
f AS (SELECT *, {sql_comparable('o')} AS co, {sql_comparable('t')} AS ct, {sql_ratio('t')} AS ratio, regexp_matches(t, '{_CJK}') AS cjk, substring(t, 1, 36) AS ht, substring(o, 1, 36) AS ho FROM s),
g AS (SELECT doc_id, seq, o, t, co <> '' AND co = ct AS same,
  regexp_matches(t, '{X.LONG_ENGLISH}') AND (NOT cjk OR ratio > 0.38 OR contains(ct, co)) AS run,
  NOT cjk AND ratio > 0.45 AS english,
  length(t) >= 12 AND regexp_matches(ht, '^[A-Za-z][A-Za-z,\\-\\s()0-9]{{10,}}$') AND {sql_comparable('ht')} <> {sql_comparable('ho')} AS cont FROM f),
h AS (SELECT doc_id, seq, CASE WHEN o = '' THEN '' WHEN t = '' THEN '{Q.REASONS['empty']}'
  WHEN NOT regexp_matches(o, '\\p{{L}}') AND regexp_matches(o, '\\p{{Nd}}') THEN ''
  ELSE concat_ws('|', CASE WHEN same THEN '{Q.REASONS['same']}' END, CASE WHEN run THEN '{Q.REASONS['run']}' END, CASE WHEN english THEN '{Q.REASONS['english']}' END, CASE WHEN cont THEN '{Q.REASONS['continuation']}' END) END AS reasons FROM g)
"""


def _audited(spark: SparkSession, folder: str) -> DataFrame:
    return current_segments(spark, folder).select("doc_id", "seq", F.array_join(Q.reasons(F.col("original"), F.col("translation")), "|").alias("reasons"))


@query(_AUDIT + "SELECT doc_id, seq, reasons FROM h WHERE reasons <> ''")
def audit_suspected_untranslated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the bilingual table that look untranslated, with the reasons."""
    return _audited(spark, folder).filter("reasons <> ''")


@query(_AUDIT + "SELECT count(*) AS total_rows, count(*) FILTER (reasons <> '') AS suspected_rows, CASE WHEN count(*) FILTER (reasons <> '') > 0 THEN 2 ELSE 0 END AS exit_code FROM h")
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the audit and its exit code."""
    totals = _audited(spark, folder).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("reasons") != "").alias("suspected_rows"))
    return totals.withColumn("exit_code", F.when(F.col("suspected_rows") > 0, 2).otherwise(0))


_TOK = r"[^\t\n\x0B\f\r \x{85}\p{Z}]+"


def _sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_TOK}'))"


def _sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda z: {sql_strip('z')}), lambda z: z <> '')"


_RETRY = f"""
WITH cur AS ({SQL_CURRENT}),
s AS (SELECT doc_id, seq, original, translation, {sql_strip('original')} AS o, {sql_strip('translation')} AS t FROM cur),
f AS (SELECT *, {sql_comparable('original')} AS co, {sql_comparable('translation')} AS ct, {sql_ratio('t')} AS ratio, {_sql_tokens('o')} AS no, {_sql_tokens('t')} AS nt, {_sql_lines('original')} AS lo, {_sql_lines('translation')} AS lt,
 len(list_filter(string_split(o, chr(10)), lambda z: z <> '')) AS ro, len(list_filter(string_split(t, chr(10)), lambda z: z <> '')) AS rt,
 len(regexp_extract_all(original, '{R.LINE_PREFIX}')) AS po, len(regexp_extract_all(translation, '{R.LINE_PREFIX}')) AS pt, len(regexp_extract_all(original, '{R.CLAUSE}')) AS cco, len(regexp_extract_all(translation, '{R.CLAUSE}')) AS cct FROM s),
g AS (SELECT *, len(list_filter(lo, lambda z: regexp_matches(z, '{X.BULLET_LINE}'))) AS bo, len(list_filter(lt, lambda z: regexp_matches(z, '{X.BULLET_LINE}'))) AS bt,
 length(o) >= 20 AND (regexp_matches(o, '^\\p{{Ll}}') OR regexp_matches(o, '[\\-‐‑‒–]$') OR regexp_matches(o, '{X.TRAILING_CONNECTIVE}')) AS risky,
 t <> '' AND ratio > 0.55 AND NOT regexp_matches(translation, '{_CJK}') AS english FROM f)
SELECT doc_id, seq, risky, english, o <> '' AND t <> '' AND risky AND (co = ct OR english) AS fragment,
 length(o) >= 32 AND t <> '' AND nt <= greatest(1, no // 4) AND length(t) <= greatest(12, length(o) // 4) AS cut,
 len(lo) >= 2 AND (len(lt) < greatest(1, len(lo) - 1) OR (bo > 0 AND bt < greatest(1, bo - 1))) AS list_broken,
 o <> '' AND t <> '' AND ((ro > 1 AND rt = 1 AND length(o) <= 80) OR (no <= 10 AND length(o) <= 80 AND nt > greatest(14, no * 2) AND length(t) > greatest(80.0, length(o) * 2.4))) AS cell_expanded,
 po > 0 AND (pt < greatest(1, po - 1) OR (cco > 0 AND cct < greatest(1, cco - 1))) AS numbering_broken
FROM g
"""


@query(_RETRY)
def quality_retry_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Quality predicates of every current segment."""
    o, t = F.col("original"), F.col("translation")
    return current_segments(spark, folder).select(
        "doc_id",
        "seq",
        Q.risky_fragment(o).alias("risky"),
        Q.mostly_english(t).alias("english"),
        Q.untranslated_fragment(o, t).alias("fragment"),
        Q.truncated(o, t).alias("cut"),
        Q.list_broken(o, t).alias("list_broken"),
        Q.cell_expanded(o, t).alias("cell_expanded"),
        Q.numbering_broken(o, t).alias("numbering_broken"),
    )


_KIND = "CASE WHEN context LIKE '%cell%' THEN 'cell' WHEN context LIKE '%list%' THEN 'list' WHEN context LIKE '%caption%' THEN 'caption' ELSE 'plain' END"


@query(f"""WITH r AS ({_RETRY}), k AS (SELECT doc_id, seq, {_KIND} AS kind FROM ({SQL_CURRENT}))
SELECT doc_id, seq, kind, fragment OR numbering_broken OR (kind = 'cell' AND (english OR cut OR cell_expanded)) OR (kind = 'list' AND list_broken) OR (kind = 'caption' AND english) AS retry FROM r JOIN k USING (doc_id, seq)""")
def retry_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which current segments would be asked for once more, by the kind of unit they are."""
    c = F.col("context")
    kind = F.when(c.contains("cell"), "cell").when(c.contains("list"), "list").when(c.contains("caption"), "caption").otherwise("plain")
    rows = current_segments(spark, folder).withColumn("kind", kind)
    return rows.select("doc_id", "seq", "kind", Q.needs_retry(F.col("original"), F.col("translation"), F.col("kind")).alias("retry"))


@query(r"""SELECT chunk_id, CASE WHEN trim(original) = '' THEN original ELSE '译' || original END AS translation FROM chunks WHERE original IS NOT NULL AND regexp_matches(original, '^[A-Za-z ]*$')""")
def translation_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Plain chunks through the whole pipeline with a translator that marks what it was sent."""
    from quire.operators.translate import translate

    rows = table(spark, folder, "chunks").select("chunk_id", F.col("original").alias("text")).filter(F.col("text").rlike(r"^[A-Za-z ]*\z"))
    return translate(rows, "text", [], lambda texts: "译" + texts).select("chunk_id", "translation")


@query(f"""SELECT doc_id, pos, {sql_comparable('line')} AS comparable, round({sql_ratio('line')}, 9) AS english_ratio, regexp_matches(line, '{_CJK}') AS cjk, regexp_matches(line, '{X.CJK_WIDE}') AS wide_cjk,
 CASE WHEN length(regexp_replace({sql_strip('line')}, '{SP}+', ' ', 'g')) > 60 THEN substring(regexp_replace({sql_strip('line')}, '{SP}+', ' ', 'g'), 1, 60) || '...' ELSE regexp_replace({sql_strip('line')}, '{SP}+', ' ', 'g') END AS preview
FROM ({SQL_LINES})""")
def english_ratio_cjk(spark: SparkSession, folder: str) -> DataFrame:
    """Comparable form, share of English letters, ideographs and preview of every line."""
    line = F.col("line")
    return document_lines(spark, folder).select("doc_id", "pos", X.comparable(line).alias("comparable"), F.round(X.english_ratio(line), 9).alias("english_ratio"), X.has_cjk(line).alias("cjk"), X.has_wide_cjk(line).alias("wide_cjk"), X.preview(line, 60).alias("preview"))


@query(f"""SELECT chunk_id, regexp_extract(original, '^({SP}*)', 1) || {sql_strip("coalesce(translation, '')")} || regexp_extract(original, '({SP}*)$', 1) AS kept,
 {sql_strip("regexp_replace(regexp_replace(original, chr(13), chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS cell, substring(sha256(original), 1, 16) AS key
FROM chunks WHERE original IS NOT NULL""")
def edge_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    """Translations with the outer white space of their originals; cell texts; short hashes."""
    o = F.col("original")
    return table(spark, folder, "chunks").filter(o.isNotNull()).select("chunk_id", X.keep_edges(o, F.col("translation")).alias("kept"), X.cell_text(o).alias("cell"), X.short_hash(o).alias("key"))


@query(f"""WITH g AS (SELECT line_no, line FROM glossary WHERE {sql_strip("coalesce(line, '')")} <> '' AND NOT starts_with({sql_strip("coalesce(line, '')")}, '#')),
p AS (SELECT line_no, CASE WHEN contains(line, chr(9)) THEN chr(9) ELSE '=' END AS sep, line FROM g),
q AS (SELECT line_no, CASE WHEN contains(line, sep) THEN {sql_strip("substring(line, 1, instr(line, sep) - 1)")} ELSE '' END AS source, CASE WHEN contains(line, sep) THEN {sql_strip("substring(line, instr(line, sep) + 1)")} ELSE '' END AS target FROM p)
SELECT line_no, source, target FROM q WHERE source <> '' AND target <> ''""")
def glossary_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the glossary file, parsed from its lines."""
    return G.parse_lines(table(spark, folder, "glossary").select("line_no", "line"))


@query("""WITH m AS (SELECT c.chunk_id, g.line_no, g.source, g.target FROM chunks c JOIN glossary g ON g.source IS NOT NULL AND contains(lower(c.original), lower(g.source))),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY length(source) DESC, line_no) AS rank FROM m)
SELECT chunk_id, count(*) AS terms, '术语表约束：' || chr(10) || string_agg('- ' || source || ' => ' || target, chr(10) ORDER BY rank) AS prompt FROM r WHERE rank <= 30 GROUP BY chunk_id""")
def glossary_match_top30(spark: SparkSession, folder: str) -> DataFrame:
    """For each chunk the glossary terms in it, the 30 longest at most, as lines of a prompt."""
    return G.match(table(spark, folder, "chunks").select("chunk_id", "original"), table(spark, folder, "glossary").filter("source IS NOT NULL"), "chunk_id", "original")


@query("""WITH k AS (SELECT chunk_id, coalesce(provider_type, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(original, '') AS key, translation FROM chunks),
f AS (SELECT key, min(chunk_id) AS first_id, count(*) AS requests FROM k GROUP BY key)
SELECT k.chunk_id, f.first_id, f.requests, k.chunk_id = f.first_id AS calls FROM k JOIN f USING (key)""")
def translation_cache_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with one key share the call of the first of them."""
    from quire.operators.cache import shared_requests

    return shared_requests(table(spark, folder, "chunks"), "chunk_id", ["provider_type", "lang", "original"])


@query(f"""WITH cur AS ({SQL_CURRENT}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS row_no, context, original, translation FROM cur""")
def bilingual_export(spark: SparkSession, folder: str) -> DataFrame:
    """The three-column bilingual table of each document in order."""
    from quire.operators.sequence import row_numbers

    return row_numbers(current_segments(spark, folder), "doc_id", "seq", "row_no").select("doc_id", "row_no", "context", "original", "translation")


@query(f"""WITH l AS ({SQL_LINES}) SELECT doc_id, pos,
 CASE WHEN {R.list_item('line')} THEN 'ListItem' WHEN regexp_matches(line, '^{R.S}{{4,}}{R.VISIBLE}') AND ({" OR ".join(f"contains(line, '{m}')" for m in ('()', '{}', '[]', '=>', '->', '::', '//', '/*', '#include', 'import ', 'def ', 'class ', 'function '))}) THEN 'Code' ELSE 'Normal' END AS block_type,
 {R.trimmed(f"regexp_extract(line, '^{R.S}*(?:{chr(92)}p{{Nd}}{{1,3}}[.)、]|[(（]{chr(92)}p{{Nd}}{{1,3}}[)）]|[a-zA-Z][.)]|[•{chr(92)}-·◦▪■★→►▸‣⦿⁃])', 0)")} AS marker,
 {R.caption('line')} AS caption, {R.footnote_mark('line')} AS footnote_like, {R.page_mark('line')} AS page_mark FROM l""")
def list_code_caption_types(spark: SparkSession, folder: str) -> DataFrame:
    """First guess of the type of every line, its list marker, and whether it is a caption, a footnote or a page's number by its form."""
    from quire.functions import layout as L

    line = F.col("line")
    return document_lines(spark, folder).select("doc_id", "pos", L.line_type(line).alias("block_type"), X.list_marker(line).alias("marker"), L.is_caption(line).alias("caption"), L.has_footnote_mark(line).alias("footnote_like"), L.is_page_mark(line).alias("page_mark"))
