"""Queries on the state of jobs, streams, protected and distributed texts, styles and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.answers import answer_text
from quire.functions.layout import overlap_ratio
from quire.operators import distribute as D
from quire.operators import protect as P
from quire.operators import state as S
from quire.plans.carriers import current_segments, page_blocks
from quire.plans.registry import SP, SQL_BLOCKS, SQL_CURRENT, query, sql_strip
from quire.session import table
from quire.streaming import feeds

#: Event types as states of a job.
STATUS = {"view": S.PENDING, "click": S.RUNNING, "signup": S.PAUSED, "purchase": S.COMPLETED, "error": S.FAILED}
_SQL_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_LOG = f"SELECT event_id, ts, user_id, {_SQL_STATUS} AS status, CASE WHEN user_id % 2 = 0 THEN 'Docs/F' ELSE 'docs/f' END || (user_id // 2) || '.docx' AS source_path, least(100, floor(value))::INT AS progress FROM events"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    path = F.concat(F.when(F.col("user_id") % 2 == 0, "Docs/F").otherwise("docs/f"), F.floor(F.col("user_id") / 2).cast("string"), F.lit(".docx"))
    return table(spark, folder, "events").select("event_id", "ts", "user_id", status[F.col("event_type")].alias("status"), path.alias("source_path"), F.least(F.lit(100), F.floor("value")).cast("int").alias("progress"))


@query(f"WITH l AS ({_LOG}), r AS (SELECT lower(source_path) AS path, event_id, status, progress, row_number() OVER (PARTITION BY lower(source_path) ORDER BY ts DESC, event_id >= 5000 DESC, event_id DESC) AS k FROM l) SELECT path, event_id, status, progress FROM r WHERE k = 1")
def checkpoint_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The latest checkpoint of every path, letter case aside."""
    log = _log(spark, folder).select("event_id", "ts", "source_path", "status", "progress")
    merged = S.upsert_checkpoints(log.filter("event_id < 5000"), log.filter("event_id >= 5000"), "source_path", "ts")
    return merged.select(F.lower("source_path").alias("path"), "event_id", "status", "progress")


@query(f"WITH l AS ({_LOG}) SELECT event_id, source_path, status FROM l ORDER BY ts DESC, event_id DESC LIMIT 200")
def history_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 200 rows of the history."""
    return S.newest(_log(spark, folder), "ts", "event_id").select("event_id", "source_path", "status")


@query(f"WITH l AS ({_LOG}), j AS (SELECT user_id, arg_max(status, ts) AS status, count(*) AS changes, round_even(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 2) AS seconds FROM l GROUP BY user_id) SELECT user_id, status, changes, seconds, status IN ('Running', 'Paused', 'Pending') AS recoverable FROM j")
def status_machine(spark: SparkSession, folder: str) -> DataFrame:
    """State of each job after its last event, and whether a new run picks it up."""
    jobs = _log(spark, folder).groupBy("user_id").agg(F.max_by("status", "ts").alias("status"), F.count(F.lit(1)).alias("changes"), S.seconds_between(F.min("ts"), F.max("ts")).alias("seconds"))
    return jobs.withColumn("recoverable", F.col("status").isin(*S.RECOVERABLE))


@query(f"WITH l AS ({_LOG}) SELECT status, count(*) AS jobs, round_even(coalesce(avg(progress), 0), 0)::INT AS overall FROM l GROUP BY status")
def overall_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Mean progress of the jobs of each state."""
    return _log(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.bround(F.coalesce(F.avg("progress"), F.lit(0.0))).cast("int").alias("overall"))


@query("WITH r AS (SELECT epoch_us(ts) // 150000 AS slot, event_id, event_type, row_number() OVER (PARTITION BY epoch_us(ts) // 150000 ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT slot, event_id, event_type FROM r WHERE k = 1")
def stream_conflation(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each 150 ms, from the events read as a stream."""
    return feeds.replay(spark, f"{folder}/events.parquet", "ts", "event_id", ["event_type"]).select("slot", "event_id", "event_type")


_SSE = "SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'data: [DONE]' WHEN 'view' THEN ': ping' ELSE 'data: ' || props END AS line FROM events"


@query(f"""WITH l AS ({_SSE}), d AS (SELECT *, max(CASE WHEN line = 'data: [DONE]' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM l),
c AS (SELECT user_id, event_id, json_extract_string(substring(line, 7), '$.k') AS t FROM d WHERE done = 0 AND starts_with(line, 'data:'))
SELECT user_id, event_id, string_agg(t, '') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS partial FROM c WHERE t IS NOT NULL""")
def sse_accumulate(spark: SparkSession, folder: str) -> DataFrame:
    """The answer so far after each chunk of an event stream."""
    line = F.when(F.col("event_type") == "error", "data: [DONE]").when(F.col("event_type") == "view", ": ping").otherwise(F.concat(F.lit("data: "), "props"))
    rows = table(spark, folder, "events").select("user_id", "event_id", line.alias("line"))
    return feeds.answer_chunks(rows, "user_id", "event_id", "line", "$.k")


@query("SELECT chunk_id, original AS answer FROM chunks WHERE original IS NOT NULL AND original <> '' AND NOT starts_with(original, '[') AND NOT starts_with(original, '{')")
def json_text_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Texts out of answers in four shapes."""
    o = F.col("original")
    shape = F.col("chunk_id") % 4
    json = (
        F.when(shape == 0, F.to_json(F.struct(o.alias("content"))))
        .when(shape == 1, F.to_json(F.struct(F.array(F.struct(o.alias("text"))).alias("content"))))
        .when(shape == 2, F.to_json(F.struct(o.alias("completion"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(o.alias("content")).alias("message"))).alias("choices"))))
    )
    rows = table(spark, folder, "chunks").filter(o.isNotNull() & (o != "") & ~o.startswith("[") & ~o.startswith("{"))
    return rows.select("chunk_id", answer_text(json).alias("answer"))


@query("""WITH s AS (SELECT p_partkey, p_size, p_size || CASE p_size % 4 WHEN 0 THEN 'px' WHEN 1 THEN 'pt' WHEN 2 THEN '.5em' ELSE '%' END AS len, CASE p_size % 5 WHEN 0 THEN '#abc' WHEN 1 THEN '#12ef9A' WHEN 2 THEN 'Grey' WHEN 3 THEN 'rgb(1,2,3)' ELSE ' red ' END AS colour FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 15 WHEN 1 THEN p_size * 20 WHEN 2 THEN round_even((p_size + 0.5) * 240, 0)::INT END AS twips, CASE p_size % 5 WHEN 0 THEN 'AABBCC' WHEN 1 THEN '12EF9A' WHEN 2 THEN '808080' WHEN 4 THEN 'FF0000' END AS colour FROM s""")
def css_style_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths and colours out of inline styles."""
    n = F.col("p_size")
    length = F.concat(n.cast("string"), F.when(n % 4 == 0, "px").when(n % 4 == 1, "pt").when(n % 4 == 2, ".5em").otherwise("%"))
    colour = F.when(n % 5 == 0, "#abc").when(n % 5 == 1, "#12ef9A").when(n % 5 == 2, "Grey").when(n % 5 == 3, "rgb(1,2,3)").otherwise(" red ")
    styles = X.css_declarations(F.concat(F.lit("Color: blue; width:"), length, F.lit(";;color:"), colour))
    rows = table(spark, folder, "part").select("p_partkey", styles.alias("s"))
    return rows.select("p_partkey", X.css_twips(F.col("s")["width"]).alias("twips"), X.colour_hex(F.col("s")["color"]).alias("colour"))


@query(f"""WITH b AS ({SQL_BLOCKS}), n AS (SELECT *, lead(l) OVER w AS l2, lead(r) OVER w AS r2 FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx))
SELECT doc_id, page, idx, round(CASE WHEN least(r, r2) - greatest(l, l2) > 0 THEN (least(r, r2) - greatest(l, l2)) / greatest(1.0, least(r - l, r2 - l2)) ELSE 0 END, 6) AS overlap FROM n WHERE l2 IS NOT NULL""")
def overlap_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """How far each block stands above the next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    rows = page_blocks(spark, folder).withColumn("l2", F.lead("l").over(w)).withColumn("r2", F.lead("r").over(w)).filter("l2 IS NOT NULL")
    return rows.select("doc_id", "page", "idx", F.round(overlap_ratio(F.col("l"), F.col("r"), F.col("l2"), F.col("r2")), 6).alias("overlap"))


#: Texts with spans to protect: the text as it is sent, and how many spans it has.
SPANS = [
    ("See https://x.example/a?b=1 and mail a.b@c.example now", "See @@KEEP_0001@@ and mail @@KEEP_0002@@ now", 2),
    ("As in [3, 4] and doi 10.1000/xyz-1", "As in @@KEEP_0001@@ and doi @@KEEP_0002@@", 2),
    ("arXiv:2101.00001v2 (a) is \\alpha{x}", "@@KEEP_0001@@ @@KEEP_0002@@ is @@KEEP_0003@@", 3),
    ("plain words", "plain words", 0),
]


@query("SELECT p_partkey, v.sent, v.spans, v.text AS restored FROM part JOIN (VALUES " + ", ".join(f"({i}, '{t}', '{s}', {n})" for i, (t, s, n) in enumerate(SPANS)) + f") v(k, text, sent, spans) ON v.k = p_partkey % {len(SPANS)}")
def protected_spans(spark: SparkSession, folder: str) -> DataFrame:
    """What is sent of texts with addresses, citations, labels and commands, and what comes back."""
    text = F.element_at(F.array(*[F.lit(t) for t, _, _ in SPANS]), (F.col("p_partkey") % len(SPANS) + 1).cast("int"))
    rows = table(spark, folder, "part").select("p_partkey", P.protect(text).alias("p"))
    return rows.select("p_partkey", F.col("p.text").alias("sent"), F.size("p.tokens").alias("spans"), P.restore(F.col("p.text"), F.col("p.tokens")).alias("restored"))


#: SQL: originals with none of the signs a protected span needs, which are sent as they are.
_BARE = r"NOT regexp_matches(original, '[@\\\[(（]|https?:|10\.[0-9]{4}|(?i)arxiv|[0-9.)、•·▪■◆◦-]|第|chapter|section|article|(?m)^\s*[A-Za-z]+[.)]')"


@query(f"SELECT doc_id, seq, original AS restored, CASE WHEN {_BARE} THEN original END AS sent, 0 AS lost, true AS whole FROM ({SQL_CURRENT})")
def protect_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Protected spans cut out of every original and put back: the originals again; texts without any sign of a span are sent as they are."""
    rows = current_segments(spark, folder).withColumn("p", P.protect(F.col("original")))
    restored = P.restore(F.col("p.text"), F.col("p.tokens"))
    signs = F.col("original").rlike(r"[@\\\[(（]|https?:|10\.[0-9]{4}|(?i:arxiv)|[0-9.)、•·▪■◆◦\-]|第|(?i:chapter|section|article)|(?m)^\s*[A-Za-z]+[.)]")
    return rows.select("doc_id", "seq", restored.alias("restored"), F.when(~signs, F.col("p.text")).alias("sent"), P.missing(F.col("p.text"), F.col("p.tokens")).alias("lost"), P.all_restored(restored, F.col("p.tokens")).alias("whole"))


def _sql_cut(x: str, start: str, target: str) -> str:
    """SQL: where a piece of `x` that begins at `start` and should be `target` long ends: after the last mark of the best kind within three tenths."""
    low, high = f"greatest({start}, floor({start} + {target} - 0.3::DOUBLE * {target})::BIGINT)", f"least(length({x}), ceil({start} + {target} + 0.3::DOUBLE * {target})::BIGINT)"
    part = f"substring({x}, {low} + 1, {high} - {low})"
    found = [f"nullif(length(regexp_extract({part}, '(?s)^(.*{c})', 1)), 0)" for c in ("[。！？.!?]", "[，；,;、]", "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]", "\\p{P}", "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]")]
    return f"(CASE WHEN {low} < {high} THEN coalesce({low} + coalesce({', '.join(found)}), least(trunc({start} + {target})::BIGINT, length({x}))) ELSE least(trunc({start} + {target})::BIGINT, length({x})) END)"


@query(f"""WITH c AS (SELECT doc_id, seq, translation AS x, length(translation) AS n, greatest(1, greatest(1, length({sql_strip('original')})) % 5) AS w FROM ({SQL_CURRENT})),
a AS (SELECT *, n * 3 / (4 + w)::DOUBLE AS t1, n * 1 / (4 + w)::DOUBLE AS t2, n / 2.0::DOUBLE AS th FROM c), b AS (SELECT *, {_sql_cut('x', '0', 't1')} AS e1, {_sql_cut('x', '0', 'th')} AS eh FROM a), d AS (SELECT *, {_sql_cut('x', 'e1', 't2')} AS e2 FROM b)
SELECT doc_id, seq, substring(x, 1, e1) AS first, substring(x, e1 + 1, e2 - e1) AS second, substring(x, e2 + 1) AS third, CASE WHEN x = '' THEN '' ELSE substring(x, 1, eh) END AS half, CASE WHEN x = '' THEN '' ELSE substring(x, eh + 1) END AS rest FROM d""")
def distribute_translation(spark: SparkSession, folder: str) -> DataFrame:
    """Translations dealt out over three targets by weight, and over two equal ones."""
    rows = current_segments(spark, folder)
    weights = F.array(F.lit(3), F.lit(1), X.text_weight(F.col("original")) % 5)
    made = rows.select("doc_id", "seq", D.distribute(F.col("translation"), weights).alias("p"), D.distribute_evenly(F.col("translation"), F.lit(2)).alias("h"))
    return made.select("doc_id", "seq", *[F.col("p")[k].alias(n) for k, n in enumerate(("first", "second", "third"))], F.col("h")[0].alias("half"), F.col("h")[1].alias("rest"))


@query(r"""WITH RECURSIVE u AS (SELECT DISTINCT doc_id, unit_no, original AS x FROM epub_units WHERE original IS NOT NULL),
p AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(x, '([.!?。！？；;:：])([\t\n\x0B\f\r \x{85}\p{Z}]|$)', '\1' || chr(1) || '\2', 'g'), '\n([^\t\n\x0B\f\r \x{85}\p{Z}])', chr(10) || chr(1) || '\1', 'g'), chr(1)), lambda q: regexp_matches(q, '[^\t\n\x0B\f\r \x{85}\p{Z}]')) AS parts FROM u),
r AS (SELECT doc_id, unit_no, x, parts, 0 AS i, '' AS open, -1 AS n, NULL::VARCHAR AS frag FROM p WHERE length(x) > 420 AND len(parts) > 1
 UNION ALL SELECT doc_id, unit_no, x, parts, i + 1, CASE WHEN open <> '' AND length(open) + length(parts[i + 1]) > 420 THEN parts[i + 1] ELSE open || parts[i + 1] END, n + CASE WHEN open <> '' AND length(open) + length(parts[i + 1]) > 420 THEN 1 ELSE 0 END, CASE WHEN open <> '' AND length(open) + length(parts[i + 1]) > 420 THEN open END FROM r WHERE i < len(parts))
SELECT doc_id, unit_no, n AS fragment_no, frag AS fragment FROM r WHERE frag IS NOT NULL UNION ALL SELECT doc_id, unit_no, n + 1, open FROM r WHERE i = len(parts)
UNION ALL SELECT doc_id, unit_no, 0, x FROM p WHERE NOT (length(x) > 420 AND len(parts) > 1)""")
def sentence_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Units packed into fragments of 420 characters at most."""
    rows = table(spark, folder, "epub_units").filter("original IS NOT NULL").select("doc_id", "unit_no", "original").distinct()
    return rows.select("doc_id", "unit_no", F.posexplode(D.pack_sentences(F.col("original"))).alias("fragment_no", "fragment"))


@query(f"""SELECT doc_id, seq, replace(replace('Übersetze {{source}} nach {{target}}.' || CASE WHEN seq % 2 = 0 THEN chr(10) || '- a => b' ELSE '' END, '{{source}}', 'en'), '{{target}}', 'zh$1') AS system,
 '文档上下文（仅供理解，不要翻译这一部分）：' || chr(10) || context || chr(10) || chr(10) || '翻译要求：' || chr(10) || '1. 只翻译“待翻译文本”部分，仅返回译文。' || chr(10) || '2. 保留原文段落、换行、列表和占位符结构，不要把多个段落合并成一整段。' || chr(10) || '3. 不要遗漏任何可翻译英文；若当前片段是跨页续句，请结合上下文把当前片段完整译成中文。' || chr(10)
 || '4. 若待翻译文本是英文残句、断词续句或句中片段，也必须译成自然中文，不要原样照抄英文。' || chr(10) || '5. 除公认缩写、公式、代码、文献编号等必须保留的内容外，不要残留未翻译英文。' || chr(10) || CASE WHEN seq % 3 = 0 THEN '补充要求：' || chr(10) || 'x' || chr(10) || chr(10) ELSE chr(10) END || '待翻译文本：' || chr(10) || '<<<TEXT' || chr(10) || original || chr(10) || 'TEXT' AS request FROM ({SQL_CURRENT})""")
def request_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Both parts of the request for every current segment; every second has a glossary, every third a requirement."""
    from quire.functions.answers import system_prompt, user_prompt

    glossary = F.when(F.col("seq") % 2 == 0, "- a => b")
    system = system_prompt(F.lit("Übersetze {Source} nach {target}."), F.lit("en"), F.lit("zh$1"), glossary)
    return current_segments(spark, folder).select("doc_id", "seq", system.alias("system"), user_prompt(F.col("original"), F.col("context"), F.when(F.col("seq") % 3 == 0, " x ")).alias("request"))


#: Base addresses with the message service and the chat services below them.
BASES = [
    ("https://api.example/v1/messages/", "https://api.example/v1/messages", "https://api.example/v1/messages/chat/completions https://api.example/v1/messages/v1/chat/completions https://api.example/v1/messages/v2/chat/completions https://api.example/v1/messages/v3/chat/completions"),
    (" https://api.example/v1/ ", "https://api.example/v1/messages", "https://api.example/v1/chat/completions"),
    ("https://api.example", "https://api.example/v1/messages", "https://api.example/chat/completions https://api.example/v1/chat/completions https://api.example/v2/chat/completions https://api.example/v3/chat/completions"),
    ("https://api.example/V3", "https://api.example/V3/v1/messages", "https://api.example/V3/chat/completions"),
    ("https://api.example/v2/chat/completions//", "https://api.example/v2/chat/completions/v1/messages", "https://api.example/v2/chat/completions"),
    (" ", None, ""),
]


@query("SELECT s_suppkey, v.messages, v.chats FROM supplier JOIN (VALUES " + ", ".join(f"({i}, {f"'{m}'" if m else 'NULL'}, '{c}')" for i, (_, m, c) in enumerate(BASES)) + f") v(k, messages, chats) ON v.k = s_suppkey % {len(BASES)}")
def endpoint_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of both services for forms of a base address."""
    base = F.element_at(F.array(*[F.lit(b) for b, _, _ in BASES]), (F.col("s_suppkey") % len(BASES) + 1).cast("int"))
    return table(spark, folder, "supplier").select("s_suppkey", X.message_endpoint(base).alias("messages"), F.array_join(X.chat_endpoints(base), " ").alias("chats"))


@query(r"""WITH b AS (SELECT * FROM (""" + SQL_BLOCKS + r""") WHERE block_type = 'TableRow' OR idx % 5 = 0), k AS (SELECT *, CASE WHEN block_type = 'TableRow' THEN 'TableRow' ELSE 'Normal' END AS kind, regexp_replace(regexp_replace(text, '[ ]*\n[ ]*', '  ', 'g'), '^[\t\n\x0B\f\r \x{85}\p{Z}]+|[\t\n\x0B\f\r \x{85}\p{Z}]+$', '', 'g') AS line FROM b),
c AS (SELECT doc_id, page, idx, kind, line, CASE WHEN kind = 'TableRow' THEN list_filter(regexp_split_to_array(line, '\t+|\s{2,}'), lambda q: trim(q) <> '') ELSE [line] END AS parts FROM k WHERE line <> '')
SELECT doc_id, page, idx, len(parts) AS targets, array_to_string(parts, '  ') AS whole FROM c""")
def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of tables as cells and back again; lines of a block stand for cells."""
    from quire.operators import units as U

    kind = F.when(F.col("block_type") == "TableRow", "TableRow").otherwise("Normal")
    rows = page_blocks(spark, folder).filter("block_type = 'TableRow' OR idx % 5 = 0").select("doc_id", "page", "idx", kind.alias("kind"), X.strip(F.regexp_replace("text", r"[ ]*\n[ ]*", "  ")).alias("line"))
    cells = U.targets(rows, "line", "kind")
    return cells.groupBy("doc_id", "page", "idx").agg(F.count(F.lit(1)).alias("targets"), U.collapse(F.col("target_no"), F.col("target"), F.col("glue")).alias("whole"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS stamp, CASE WHEN length(props) > 10 THEN right(props, 10) ELSE props END AS ending FROM events ORDER BY ts DESC, event_id DESC LIMIT 400")
def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last 400 events, with their times and the ends of their properties."""
    from quire.operators import state as ST
    from quire.operators import units as U

    rows = U.tail(table(spark, folder, "events"), ["ts", "event_id"])
    return rows.select("event_id", ST.utc_stamp(F.col("ts")).alias("stamp"), U.tail_text(F.col("props"), 10).alias("ending"))


@query(f"SELECT doc_id, count(*) AS boxes FROM (SELECT DISTINCT doc_id, round_even(l / 7, 0) AS l, round_even(t / 7, 0) AS t, round_even(r / 7, 0) AS r FROM ({SQL_BLOCKS})) GROUP BY 1")
def rounded_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of each document that differ on a coarse grid."""
    from quire.operators import units as U

    rows = page_blocks(spark, folder).select("doc_id", *[(F.col(c) / 7).alias(c) for c in "ltr"])
    return U.distinct_boxes(rows, ["doc_id"], ["l", "t", "r"], 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("boxes"))


@query(rf"""WITH c AS (SELECT doc_id, seq, regexp_replace(original, '^[\t\n\x0B\f\r \x{{85}}\p{{Z}}]+|[\t\n\x0B\f\r \x{{85}}\p{{Z}}]+$', '', 'g') AS text FROM ({SQL_CURRENT})), f AS (SELECT doc_id, text, min(seq) AS seq FROM c WHERE text <> '' GROUP BY 1, 2), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, text) AS place, text FROM f)
SELECT doc_id, place::INT AS place, text FROM r WHERE place <= 4""")
def cover_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The first four distinct texts of each document."""
    from quire.operators import units as U

    return U.first_texts(current_segments(spark, folder), "doc_id", "seq", "original").select("doc_id", "place", F.col("original").alias("text"))


#: Kinds of word-document paragraphs by segment context: scope, style, in a cell, numbered.
_WORDS = {"heading": ("Main", "Heading 2", False, False), "list item": ("Main", "List", False, True), "table cell": ("Main", "", True, False), "footnote": ("Footnote", "", False, False), "header": ("Header", "", False, False)}


@query(f"""WITH c AS (SELECT doc_id, seq, context, coalesce(context, '') AS x FROM ({SQL_CURRENT})),
k AS (SELECT *, CASE WHEN x = 'heading' THEN 'Heading' WHEN x = 'list item' THEN 'ListItem' WHEN x = 'table cell' THEN 'TableCell' WHEN x = 'footnote' THEN 'Footnote' WHEN x = 'header' THEN 'Header' ELSE 'Paragraph' END AS kind, CASE WHEN x = 'footnote' THEN 'Footnote' WHEN x = 'header' THEN 'Header' ELSE 'Main' END AS scope FROM c)
SELECT doc_id, seq, kind, CASE kind WHEN 'Heading' THEN 'Word 标题段落' WHEN 'ListItem' THEN 'Word 列表项' WHEN 'TableCell' THEN 'Word 表格单元格' WHEN 'Footnote' THEN 'Word 脚注' WHEN 'Header' THEN 'Word 页眉' ELSE 'Word 段落' END || CASE WHEN x <> '' THEN '；章节上下文：' || x ELSE '' END AS hint,
 array_to_string(list_filter([CASE kind WHEN 'Heading' THEN '类型：标题。请保持标题风格，译文简洁，不要扩写成正文。' WHEN 'ListItem' THEN '类型：列表。请保留列表层级、编号/项目符号和换行结构，不要把多个条目合并成一段。' WHEN 'TableCell' THEN '类型：表格单元格。请保留数字、单位、百分号、缩写和换行，不要把表格短语扩写成解释性整句。' WHEN 'Footnote' THEN '类型：脚注/尾注。请保留编号、引用关系、URL、DOI、作者年份等结构。' WHEN 'Header' THEN '类型：页眉页脚。请保留页码、短标题、日期和编号结构，不要扩写。' END,
  CASE WHEN scope <> 'Main' THEN '当前内容来自 Word ' || scope || ' 区域，请保持该区域常见的简短表达方式。' END, CASE WHEN seq % 3 = 0 THEN '当前片段包含超链接显示文本。请翻译可见文字，但保留链接文本边界，不要把链接前后的正文合并改写。' END, CASE WHEN seq % 4 = 0 THEN '当前片段包含上标或下标。请保留上标/下标对应的结构边界，不要把编号、脚注标记、化学式或公式索引并入普通正文。' END], lambda q: q IS NOT NULL), chr(10)) AS requirements,
 CASE WHEN seq % 3 = 0 AND seq % 4 = 0 THEN 'link|sup' WHEN seq % 3 = 0 THEN 'link' WHEN seq % 4 = 0 THEN 'sup' ELSE 'plain' END AS boundary FROM k""")
def word_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, place, requirements and run boundaries of segments as units of a word document; every third holds a link, every fourth a superscript."""
    from quire.functions import hints as H

    c, no = F.col("context"), F.lit(False)
    pick = lambda i, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in _WORDS.items() for x in (k, v[i])]), c), F.lit(default))
    scope = pick(0, "Main")
    kind = H.word_kind(scope, no, pick(2, False), pick(3, False), pick(1, ""), no)
    link, raised = F.col("seq") % 3 == 0, F.col("seq") % 4 == 0
    hint = H.word_hint(kind, scope, c, F.lit(""))
    asked = H.word_requirements(kind, scope, link, raised, no, no, F.lit(""))
    return current_segments(spark, folder).select("doc_id", "seq", kind.alias("kind"), hint.alias("hint"), asked.alias("requirements"), H.run_boundary(link, no, raised, no, no).alias("boundary"))


@query(f"""WITH u AS (SELECT DISTINCT doc_id, unit_no, coalesce(context, '') AS x FROM epub_units), t AS (SELECT *, CASE WHEN x = 'heading' THEN 'h2' WHEN x = 'nav' THEN 'title' WHEN x = 'list item' THEN 'li' WHEN x = 'caption' THEN 'figcaption' ELSE 'p' END AS tag FROM u)
SELECT doc_id, unit_no, x, 'EPUB ' || CASE tag WHEN 'h2' THEN '章节标题' WHEN 'title' THEN '文档标题' WHEN 'li' THEN '列表项' WHEN 'figcaption' THEN '图表说明' ELSE '正文块' END || ' <' || tag || '>' || CASE WHEN x <> '' THEN '；章节上下文：' || x ELSE '' END || '；来源文件：c' || doc_id || '.xhtml' AS hint,
 CASE tag WHEN 'h2' THEN '类型：电子书标题。请保持标题风格和层级感，译文简洁，不要扩写成正文。' WHEN 'title' THEN '类型：电子书标题。请保持标题风格和层级感，译文简洁，不要扩写成正文。' WHEN 'li' THEN '类型：电子书列表。请保留条目边界、编号/项目符号和换行结构，不要把多个条目合并成一段。' WHEN 'figcaption' THEN '类型：电子书图表说明。请保留图号、子图编号、单位、括号和短说明风格。' ELSE '类型：电子书正文。请保留段落边界、内联强调边界和链接文本边界，不要无故扩写。' END
 || CASE WHEN unit_no % 2 = 0 THEN chr(10) || '当前片段包含链接文本。请翻译可见文字，但不要破坏链接边界，也不要把链接前后的内容并到一起。' ELSE '' END AS requirements, tag <> 'p' AND tag <> 'li' AND tag <> 'figcaption' OR contains(x, 'chapter') OR contains(x, 'title') OR contains(x, 'heading') AS heading_like FROM t""")
def ebook_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Place, requirements and heading test of e-book units; every second holds a link."""
    from quire.functions import hints as H

    x = F.coalesce("context", F.lit(""))
    tag = F.when(x == "heading", "h2").when(x == "nav", "title").when(x == "list item", "li").when(x == "caption", "figcaption").otherwise("p")
    rows = table(spark, folder, "epub_units").select("doc_id", "unit_no", x.alias("x")).distinct()
    tag = F.when(F.col("x") == "heading", "h2").when(F.col("x") == "nav", "title").when(F.col("x") == "list item", "li").when(F.col("x") == "caption", "figcaption").otherwise("p")
    hint = H.ebook_hint(tag, F.lit(""), F.col("x"), F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".xhtml")))
    return rows.select("doc_id", "unit_no", "x", hint.alias("hint"), H.ebook_requirements(tag, F.col("unit_no") % 2 == 0, F.lit(False)).alias("requirements"), H.is_heading_like(tag, F.col("x")).alias("heading_like"))
