"""Operators on ordered rows, lookups, layout, state, streams, sources and the pipeline."""

import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import cache, glossary, layout, ocr_layout, pages, ranges, sequence, skew, state, translate, units, versions
from quire.sources import office, sinks, state_files
from quire.streaming import feeds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize(("start", "end", "n", "wanted"), [(1, 0, 5, (1, 5)), (2, 4, 5, (2, 4)), (4, 2, 5, (4, 4)), (10, 3, 5, (5, 5)), (3, 99, 5, (3, 5)), (0, 0, 0, (1, 0))])
def test_ranges(spark, start, end, n, wanted):
    assert tuple(spark.range(1).select(ranges.requested_range(F.lit(start), F.lit(end), F.lit(n)).alias("r")).first()["r"]) == wanted


def test_pages_breadcrumbs_islands(spark):
    p = spark.createDataFrame([(1, i, b, s) for i, (b, s) in enumerate([(0, False), (1, False), (0, False), (2, False), (0, True)], 1)], "d int, pos int, b int, s boolean")
    assert [r[-1] for r in rows(sequence.page_numbers(p, "d", "pos", "b", "s"), "pos")] == [1, 1, 2, 2, 5]
    h = spark.createDataFrame([(1, i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (None, "x"), (2, "B"), (None, "x"), (3, "C"), (2, "D"), (None, "x"), (1, "E")], 1)], "d int, pos int, lv int, t string")
    assert [r["breadcrumb"] for r in sequence.breadcrumbs(h, "d", "pos", "lv", "t").orderBy("pos").collect()] == ["A", "A", "A > B", "A > B", "A > B > C", "A > D", "A > D", "E"]
    k = spark.createDataFrame([(1, i, x, str(i)) for i, x in enumerate(["a", "a", "b", "a"], 1)], "d int, pos int, k string, t string")
    grouped = sequence.islands(k, "d", "pos", "k").groupBy("island").agg(F.first("k").alias("k"), sequence.join_ordered(F.col("pos"), F.col("t")).alias("t"))
    assert rows(grouped, "island") == [(1, "a", "12"), (2, "b", "3"), (3, "a", "4")]


def test_hyphens_and_neighbours(spark):
    b = spark.createDataFrame([(1, 1, 0, "An exam-", "Body"), (1, 2, 0, "ple of it.", "Body"), (1, 2, 1, "", "Body")], "d int, page int, idx int, text string, region string")
    for c, v in (("l", 50.0), ("r", 400.0), ("t", 700.0), ("b", 690.0), ("lh", 10.0)):
        b = b.withColumn(c, F.lit(v))
    assert [r["repaired"] for r in sequence.repair_hyphens(b, "d", "page", "idx", F.col("text") != "").orderBy("page", "idx").collect()] == ["An example", "of it.", ""]
    near = sequence.neighbours(b, "d", "page", "idx", "text", "region", F.col("text") != "").orderBy("page", "idx").collect()
    assert [(r["before"], r["after"]) for r in near] == [(None, "ple of it."), ("An exam-", None), ("ple of it.", None)]
    flags = sequence.continuation_flags(b, "d", "page", "idx", "text", F.col("text") != "").orderBy("page", "idx").collect()
    assert [(r["from_previous"], r["into_next"]) for r in flags] == [(False, True), (True, False), (False, False)]


def test_ranges_of_a_document_carry_over(spark):
    import random

    r = random.Random(3)
    data = [(d, p, r.choice([None, None, 1, 2, 3]), f"t{p}", r.randint(0, 2), r.random() < 0.2, r.choice(["a", "b", None])) for d in (1, None) for p in range(1, 60)]
    df = spark.createDataFrame(data, "d int, pos int, lv int, t string, br int, np boolean, k string")
    for f in (
        lambda n: sequence.row_numbers(df, "d", "pos", "x", n),
        lambda n: sequence.page_numbers(df, "d", "pos", "br", "np", n).withColumnRenamed("page_no", "x"),
        lambda n: sequence.breadcrumbs(df, "d", "pos", "lv", "t", 3, n).withColumnRenamed("breadcrumb", "x"),
        lambda n: sequence.islands(df, "d", "pos", "k", n).withColumnRenamed("island", "x"),
        lambda n: sequence.as_of_heading(df, "d", "pos", F.when(F.col("lv") == 1, F.col("t")), n).withColumnRenamed("heading", "x"),
    ):
        whole, cut = ({(x["d"], x["pos"]): x["x"] for x in f(n).collect()} for n in (100_000, 7))
        assert whole == cut and len(whole) == len(data)
    blocks = spark.createDataFrame([(d, p, i, r.choice(["It goes", "and on", "Ends.", ""]), r.choice(["Body", "Table"])) for d in (1, None) for p in range(1, 40) for i in range(r.randint(1, 3))], "d int, page int, idx int, text string, region string")
    ok = F.col("text") != ""
    for c, v in (("l", 50.0), ("r", 400.0), ("t", 700.0), ("b", 690.0), ("lh", 10.0)):
        blocks = blocks.withColumn(c, F.lit(v))
    cut = blocks.withColumn("text", F.when(F.col("text") == "It goes", "an exam-").when(F.col("text") == "and on", "ple of pa-").otherwise(F.col("text")))
    whole, parts = (sorted(map(str, sequence.repair_hyphens(cut, "d", "page", "idx", ok, span=n).collect())) for n in (1000, 6))
    assert whole == parts and any("an example" in x for x in whole)
    for f in (lambda n: sequence.neighbours(blocks, "d", "page", "idx", "text", "region", ok, span=n), lambda n: sequence.continuation_flags(blocks, "d", "page", "idx", "text", ok, n)):
        whole, cut = (sorted(map(str, f(n).collect())) for n in (1000, 6))
        assert whole == cut and len(whole) == blocks.count()


def test_running_offsets(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k int, n int").repartition(5)
    want = {i: sum(j % 3 for j in range(i)) for i in range(100)}
    assert {r["k"]: r["o"] for r in sequence.running_offsets(df, "k", "n", "o").collect()} == want
    assert sequence.running_offsets(df.limit(0), "k", "n", "o").count() == 0


def test_versions(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01", "a", "x"), (1, 1, "2024-01-02", "b", "y"), (1, 1, "2024-01-02", "b", "y"), (None, 2, None, None, "z")], "d int, s int, at string, t string, extra string")
    assert sorted(rows(versions.latest_versions(df, ["d", "s"], "at", ["t"])), key=str) == [(1, 1, "2024-01-02", "b"), (None, 2, None, None)]
    assert versions.latest_versions(df.limit(0), ["d", "s"], "at", ["t"]).count() == 0


def test_group_join_with_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(90)], "id int, k int")
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = skew.join_groups(df, groups, "k", "n", 90)
    assert out.count() == 90 and out.filter("k = 0 AND first <> 0").count() == 0


def test_glossary(spark):
    lines = spark.createDataFrame(list(enumerate(["Large Language Model=大语言模型", "Word\tWord 文档", "# note", "", "a=", "a=b=c", None], 1)), "line_no int, line string")
    parsed = glossary.parse_lines(lines)
    assert rows(parsed, "line_no") == [(1, "Large Language Model", "大语言模型"), (2, "Word", "Word 文档"), (6, "a", "b=c")]
    texts = spark.createDataFrame([(1, "a LARGE language model"), (2, None), (3, "zzz")], "id int, t string")
    assert rows(glossary.match(texts, parsed, "id", "t")) == [(1, 2, "术语表约束：\n- Large Language Model => 大语言模型\n- a => b=c")]


def test_cache_and_pipeline(spark):
    calls = spark.sparkContext.accumulator(0)

    def upper(s: pd.Series) -> pd.Series:
        calls.add(len(s))
        if (s == "bad").any():
            raise RuntimeError("no")
        return s.str.upper().map(lambda t: "译" + t)

    df = spark.createDataFrame([(1, "see [12] now"), (2, "see [12] now"), (3, ""), (4, None), (5, "bad")], "id int, text string")
    out = {r["id"]: (r["translation"], r["error"]) for r in translate.translate(df, "text", [], upper).collect()}
    assert out[1] == out[2] == ("译SEE [12] NOW", None)
    assert out[3] == out[4] == ("", None)
    assert out[5] == ("bad", "RuntimeError: no")
    shared = cache.shared_requests(df.withColumn("extra", F.lit(1)), "id", ["text"])
    assert {r["id"]: (r["first_id"], r["requests"]) for r in shared.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


def _word(text, l, t, width=None, size=10.0, font="Times", height=10.0):
    return pages.Word(text, l, l + (width or 5.0 * len(text)), t, t - height, font, size, len(text))


def _line(text, l, t, **more):
    out, at = [], l
    for w in text.split():
        out.append(_word(w, at, t, **more))
        at = out[-1].r + 3.0
    return out


def test_lines_and_blocks():
    words = _line("Two words be-", 60, 700) + _line("low the line and", 60, 687) + _line("so on.", 60, 674) + _line("A new one.", 60, 640)
    lines = pages.lines_of(words, 595.0)
    assert [x.text for x in lines] == ["Two words be-", "low the line and", "so on.", "A new one."]
    blocks = pages.fold(lines, lambda p, c: pages.joins_line(p, c, 595.0))
    assert [b.text for b in blocks] == ["Two words below the line and so on.", "A new one."]
    assert blocks[0].lh == 11.5 and (blocks[0].t, blocks[0].b) == (700.0, 664.0)
    # A word joins the first line whose mean bottom is nearer than the reach, not at it.
    assert len(pages.lines_of([_word("a", 10, 700), _word("b", 30, 696)], 595.0)) == 2 and len(pages.lines_of([_word("a", 10, 700), _word("b", 30, 696.1)], 595.0)) == 1
    assert pages.line_text([_word("漢", 0, 0), _word("字", 6, 0), _word("far", 60, 0)]) == "漢字  far"
    assert pages.line_height([pages.Word("a", 0, 9, 12, 0)]) == 12 and pages.line_height([_word("a", 0, 10, size=20.0)]) == 23.0
    assert pages.kind_of(_line("1) item", 0, 0), "1) item") == "ListItem" and pages.kind_of(_line("x", 0, 0, font="Hack"), "x") == "Code" and pages.kind_of([_word("a", 0, 0), _word("b", 90, 0), _word("c", 200, 0)], "a  b  c") == "TableRow"


def test_merging_blocks():
    plain = lambda text: False
    block = lambda text, t, l=60.0, r=400.0, **more: pages.Block(text, l, r, t, t - 10.0, 10.0, more.pop("align", "Left"), size=more.pop("size", 10.0), **more)
    joins = lambda a, b: pages.joins_block(a, b, 595.0, plain)
    assert joins(block("The box and", 700), block("the lamp.", 685))
    assert not joins(block("The box.", 700), block("The lamp.", 685))  # a sentence ends and one begins, a gap between
    assert not joins(block("The box and", 700), block("the lamp.", 660))  # too far below
    assert not joins(block("The box and", 700, size=20.0), block("the lamp.", 685))
    assert not joins(block("1. x", 700, kind="ListItem"), block("y", 685, kind="TableRow"))
    assert joins(block("code()", 700, kind="Code"), block("more()", 685, kind="Code")) and not joins(block("a  b", 700, kind="TableRow"), block("c  d", 685, kind="TableRow"))
    assert not pages.joins_block(block("x = y", 700), block("and so", 685), 595.0, lambda t: "=" in t)
    on = lambda a, b: pages.continues(a, b, plain)
    assert on(block("It is an exam-", 700), block("ple of it.", 680)) and on(block("It goes", 700), block("on and on.", 680))
    assert not on(block("It ends.", 700), block("Next one.", 680)) and not on(block("It goes", 700), block("on.", 680, kind="ListItem")) and not on(block("It goes", 700), block("on.", 640))
    assert [b.text for b in pages.fold([block("It goes", 700), block("on, cut-", 680), block("ting.", 660)], on)] == ["It goes on, cutting."]
    assert block("a", 700, font="").merged(block("b", 680, font="Arial", size=12.0)).font == "Arial" and block("a", 700, region="Table").merged(block("b", 680)).region == "Table"


def test_roles():
    block = lambda text, t, l=60.0, r=500.0, size=10.0, **more: pages.Block(text, l, r, t, t - 10.0, 10.0, "Left", size=size, **more)
    found = pages.with_roles(
        [
            block("Figure 3: A box", 300), block("12 / 90", 830), block("A running head", 30), block("1. A note.", 100, size=8.0), block("A title", 700, r=300.0, size=14.0),
            block("Plain text that ends.", 500), block("side", 500, l=5.0, r=40.0), block("a  b  c", 280, kind="TableRow"),
        ],
        595.0,
        842.0,
    )
    assert [(b.kind, b.region) for b in found] == [("Caption", "Table"), ("HeaderFooter", "HeaderFooter"), ("HeaderFooter", "HeaderFooter"), ("Footnote", "Footnote"), ("Title", "Body"), ("Normal", "Body"), ("Normal", "Margin"), ("TableRow", "Table")]


def test_formulas(spark):
    from quire.functions import layout as L
    from quire.functions.formula import analyse

    golden = {
        "\\alpha": (True, True), "\\frac{a}{b}": (True, True), "x ∈ S": (True, True), "a_i": (True, True), "arg min f(x)": (False, True), "x = 3": (True, True), "": (False, False), " ": (False, False), "The box opens.": (False, False),
        "see Eq. 3": (False, False), "v1.2.3": (False, False), "where x = 3 is the value": (False, True), "∑ (a)": (True, True), "{[()]}": (True, True), "x" * 161 + "=": (False, False), "f(x) = 3*(x+1)": (True, True), "价格 x": (False, False), "max": (False, True),
    }
    assert {t: analyse(t) for t in golden} == golden
    df = spark.createDataFrame([(t,) for t in golden], "t string")
    assert {r["t"]: (r["f"]["pure"], r["f"]["contains"]) for r in df.select("t", L.formula_flags(F.col("t")).alias("f")).collect()} == golden
    assert spark.range(1).select(L.formula_flags(F.lit(None).cast("string")).alias("f")).first()["f"] == (False, False)


def test_layout(spark):
    data = [(1, 1, k, w.text, float(w.l), float(w.r), float(w.t), float(w.b)) for k, w in enumerate(sum((_line("left side here", 50, 800 - 20 * n) + _line("that side then", 350, 800 - 20 * n) for n in range(12)), []))]
    df = spark.createDataFrame(data, "d int, p int, word_no int, text string, l double, r double, t double, b double")
    made = layout.page_columns(df, ["d", "p"], 595.0)
    assert len(made.first()["cuts"]) == 1 and {w["column_no"] for w in made.first()["words"]} == {1, 2}
    blocks = pages.build_blocks(made, ["d", "p"], 595.0, 842.0).orderBy("idx").collect()
    assert {b["text"].split()[0] for b in blocks} == {"left", "that"} and all(b["text"].count("that") * b["text"].count("left") == 0 for b in blocks)
    assert layout.page_columns(df.limit(4), ["d", "p"], 595.0).first()["cuts"] == [] and pages.build_blocks(layout.page_columns(df.limit(0), ["d", "p"], 595.0), ["d", "p"], 595.0, 842.0).count() == 0
    fonts = spark.createDataFrame([(1, 1, "A"), (1, 2, "b"), (1, 3, "B"), (1, 4, "a")], "d int, i int, font string")
    assert rows(layout.dominant(fonts, ["d"], "font", ["i"])) == [(1, "A")]
    nums = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert nums.agg(layout.upper_median(F.col("x"))).first()[0] == 3.0
    assert nums.limit(0).agg(layout.upper_median(F.col("x"))).first()[0] is None


def test_state(spark):
    stored = spark.createDataFrame([("A.docx", 1, "x")], "path string, at int, s string")
    change = spark.createDataFrame([("a.DOCX", 1, "y"), ("b", 2, "z")], "path string, at int, s string")
    assert rows(state.upsert_checkpoints(stored, change, "path", "at"), "s") == [("a.DOCX", 1, "y"), ("b", 2, "z")]


def test_answer_stream(spark):
    lines = [(1, 1, 'data: {"k":"a"}'), (1, 2, ": ping"), (1, 3, 'data: {"k":"b"}'), (1, 4, "data: [DONE]"), (1, 5, 'data: {"k":"c"}'), (2, 1, "data: x")]
    df = spark.createDataFrame(lines, "id int, seq int, line string")
    assert rows(feeds.answer_chunks(df, "id", "seq", "line", "$.k"), "seq") == [(1, 1, "a"), (1, 3, "ab")]


def test_conflation_and_reload(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00.00", "a"), (2, "2024-01-01 00:00:00.10", "b"), (3, "2024-01-01 00:00:00.20", "c"), (4, None, "d")], "id int, ts string, v string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in/e.parquet")
    assert sorted(r["v"] for r in feeds.replay(spark, f"{tmp_path}/in/e.parquet", "ts", "id", ["v"]).collect()) == ["b", "c"]
    seen = []
    (tmp_path / "g.txt").write_text("a=b\n", encoding="utf-8")
    schema = spark.read.parquet(f"{tmp_path}/in/e.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*.parquet")
    feeds.with_reloaded_glossary(stream, str(tmp_path / "g.txt"), lambda batch, g, n: seen.append((batch.count(), g.count())), f"{tmp_path}/cp").awaitTermination()
    assert seen == [(4, 1)]


def test_word_files(spark, tmp_path):
    office.register(spark)
    segments = spark.createDataFrame([(7, 1, "c", "a & b", "甲"), (7, 2, None, "x\ny", None)], "doc_id int, seq int, context string, original string, translation string")
    made = sinks.write_bilingual_docx(segments, str(tmp_path)).collect()
    assert made[0]["rows"] == 2
    back = spark.read.format("quire_bilingual").load(f"{tmp_path}/*.docx")
    assert [(r["row_no"], r["context"], r["original"], r["translation"], r["error"]) for r in back.orderBy("row_no").collect()] == [(1, "c", "a & b", "甲", None), (2, "", "x\ny", "", None)]
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    runs = spark.read.format("quire_docx").load(f"{tmp_path}/*.docx")
    assert runs.filter("error IS NOT NULL").count() == 1 and runs.filter("in_cell AND text = '甲'").count() == 1
    again = office.read(spark, f"{tmp_path}/*.docx", "quire_docx")
    assert again.filter("error IS NOT NULL").count() == 1 and again.filter("in_cell AND text = '甲'").count() == 1


def test_word_paragraphs(spark, tmp_path):
    w = f'xmlns:w="{office.W[1:-1]}"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr/><w:pageBreakBefore/></w:pPr><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>up</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br w:type="page"/></w:r></w:p>'
        '<w:p><w:r><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:r><w:fldSimple><w:r><w:t>f</w:t></w:r></w:fldSimple></w:p>'
    )
    with zipfile.ZipFile(tmp_path / "p.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>")
    from quire.functions import hints as H

    runs = office.read(spark, f"{tmp_path}/p.docx", "quire_docx")
    kind = H.word_kind(F.col("scope"), F.col("in_box"), F.col("in_cell"), F.col("numbered"), F.col("style"), F.col("outline").isNotNull())
    boundary = H.run_boundary(F.col("link"), F.col("in_box"), F.col("raised"), F.col("lowered"), F.col("field"))
    got = runs.filter("text <> ''").select("text", kind.alias("k"), boundary.alias("b"), H.heading_level(F.col("style"), F.col("outline")).alias("n")).collect()
    assert {r["text"]: (r["k"], r["b"], r["n"]) for r in got} == {"Head": ("Heading", "plain", 2), "up": ("ListItem", "sup", None), "link": ("ListItem", "link", None), "boxed": ("TextBox", "textbox", None), "f": ("Paragraph", "field", None), "top": ("Header", "plain", None)}
    paras = runs.filter("scope = 'Main'").groupBy("path", "para").agg(F.sum("breaks").alias("b"), F.max("new_page").alias("s"))
    assert [r["page_no"] for r in sequence.page_numbers(paras, "path", "para", "b", "s").orderBy("para").collect()] == [1, 2, 3, 3]
    paged = runs.join(sequence.page_numbers(paras, "path", "para", "b", "s").select("para", "page_no"), "para", "left").filter("text <> ''")
    assert {r["text"] for r in ranges.chosen_parts(paged, "scope", "page_no", 2, 2, 3).collect()} == {"up", "link"} and ranges.chosen_parts(paged, "scope", "page_no", 1, 3, 3).count() == 6


def test_units_state_and_failover(spark, tmp_path):
    b = spark.createDataFrame([(1, "a  b | c", "TableRow"), (2, "a  b", "Normal"), (3, " ", "Normal"), (4, "one", "TableRow")], "id int, text string, kind string")
    cells = units.targets(b, "text", "kind")
    assert rows(cells.select("id", "target_no", "target", "glue"), "id", "target_no") == [(1, 0, "a", "  "), (1, 1, "b", "  "), (1, 2, "c", "  "), (2, 0, "a  b", " "), (4, 0, "one", " ")]
    assert rows(cells.groupBy("id").agg(units.collapse(F.col("target_no"), F.col("target"), F.col("glue")).alias("t")), "id") == [(1, "a  b  c"), (2, "a  b"), (4, "one")]
    (tmp_path / "s.json").write_text('[{"SourcePath": "a", "Progress": 3, "Extra": 1}, {"SourcePath": "b"}]')
    (tmp_path / "bad.json").write_text("[{")
    assert rows(state_files.read_state(spark, f"{tmp_path}/s.json").select("SourcePath", "Progress"), "SourcePath") == [("a", 3), ("b", None)]
    assert state_files.read_state(spark, f"{tmp_path}/bad.json").count() == 0 and state_files.read_state(spark, f"{tmp_path}/none.json").count() == 0

    def refused(texts):
        raise RuntimeError("HTTP 404: not found")

    def broken(texts):
        raise RuntimeError("HTTP 500")

    assert list(translate.with_failover(refused, lambda t: t.str.upper())(pd.Series(["a"]))) == ["A"]
    with pytest.raises(RuntimeError):
        translate.with_failover(broken, lambda t: t)(pd.Series(["a"]))
    assert translate.throttled(spark.range(10), 3).rdd.getNumPartitions() == 3
    assert rows(translate.translate(spark.createDataFrame([(1, "x")], "id int, text string"), "text", [], lambda t: "译" + t, requests=1).select("translation")) == [("译x",)]


def test_recognised_folds():
    # Mean bottoms are compared, not tops; a merged block's height is the measure of the next gap.
    found = ocr_layout.lines_of([("a", 10.0, 100.0, 20.0, 110.0, 90.0), ("tall", 22.0, 90.0, 40.0, 110.0, 90.0), ("far", 10.0, 117.0, 30.0, 127.0, 90.0)])
    assert [[w[0] for w in x.parts] for x in found] == [["a", "tall"], ["far"]]
    lines = [ocr_layout.Box([("x",)], 10.0, t, 200.0, b) for t, b in ((0.0, 10.0), (20.0, 30.0), (50.0, 60.0))]
    assert len(ocr_layout.blocks_of(lines)) == 1


def test_other_formats(spark, tmp_path):
    office.register(spark)
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{office.S[1:-1]}" {rel}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{office.S[1:-1]}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{office.S[1:-1]}"><c r="A1" t="s"><v>1</v></c><c r="A2" t="s"><v>9</v></c><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="A4"><v>3</v></c></worksheet>')
    got = spark.read.format("quire_xlsx").load(f"{tmp_path}/*.xlsx").orderBy("cell").collect()
    assert [(r["cell"], r["kind"], r["string_index"], r["text"]) for r in got] == [("A1", "shared", 1, "rich"), ("A3", "inline", None, "in")]
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{office.P[1:-1]}" {rel}><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="a" Target="slides/1.xml"/><Relationship Id="b" Target="slides/2.xml"/></Relationships>')
        for n in (1, 2):
            z.writestr(f"ppt/slides/{n}.xml", f'<s xmlns:a="{office.A[1:-1]}"><a:p><a:r><a:rPr b="1"/><a:t>s{n}</a:t></a:r></a:p><a:p><a:r><a:t> </a:t></a:r></a:p></s>')
    assert [(r["slide"], r["format_key"], r["text"]) for r in spark.read.format("quire_pptx").load(f"{tmp_path}/*.pptx").orderBy("slide").collect()] == [(1, "b:1", "s2"), (2, "b:1", "s1")]
    book = tmp_path / "book"
    for name, text in {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": '<package><manifest><item id="x" href="x.xhtml" media-type="application/xhtml+xml"/><item id="y" href="y.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="y"/></spine></package>',
        "O/x.xhtml": "<html><body><p>last</p><p>12</p></body></html>",
        "O/y.xhtml": '<html><body><h1 id="t">Head</h1><div><p>A <b>b</b><script>no</script></p></div><pre><p>code</p></pre></body></html>',
    }.items():
        (book / name).parent.mkdir(parents=True, exist_ok=True)
        (book / name).write_text(text)
    sinks.write_epub(str(book), str(tmp_path / "b.epub"))
    assert zipfile.ZipFile(tmp_path / "b.epub").infolist()[0].filename == "mimetype"
    assert [(r["doc_no"], r["tag"], r["id"], r["text"]) for r in spark.read.format("quire_epub").load(f"{tmp_path}/*.epub").orderBy("doc_no", "pos").collect()] == [(1, "h1", "t", "Head"), (1, "p", "", "A b"), (2, "p", "", "last")]


def test_books(spark, tmp_path):
    parts = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": '<package xmlns:dc="d"><metadata><dc:title> A book </dc:title><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><dc:date>2001</dc:date><meta name="cover" content="img"/></metadata><manifest>'
        '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="x" href="t/x%20y.xhtml" media-type="application/xhtml+xml"/><item id="c" href="t/c.ncx" media-type="application/x-dtbncx+xml"/><item id="img" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="x"/></spine></package>',
        "O/nav.xhtml": '<html><body><nav><a href="t/x%20y.xhtml?q#s%31">One</a><a href="http://x">Out</a></nav></body></html>',
        "O/t/c.ncx": '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="x%20y.xhtml#s1"/></navPoint></navMap></ncx>',
        "O/t/x y.xhtml": '<html><body><section><p class="chapter-title" id="s1">See <a href="#b"><em>here</em></a></p><img src="../i.png"/></section></body></html>',
    }
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    book = office.read(spark, f"{tmp_path}/b.epub", "quire_epub_book").first()
    assert (book["title"], book["creators"], book["date"], book["publisher"], book["cover_image"], book["cover_page"], book["error"]) == ("A book", ["Ann", "Bo"], "2001", "", "O/i.png", "O/t/x y.xhtml", None)
    assert [(r["kind"], r["target"], r["label"]) for r in office.read(spark, f"{tmp_path}/b.epub", "quire_epub_guide").orderBy("kind", "pos").collect()] == [("nav", "O/t/x y.xhtml", "One"), ("nav", None, "Out"), ("ncx", "O/t/x y.xhtml#s1", "One")]
    leaf = office.read(spark, f"{tmp_path}/b.epub", "quire_epub").collect()
    assert [(r["tag"], r["names"], r["link"], r["links"], r["emphasis"], r["text"]) for r in leaf] == [("p", "chapter-title s1", "#b", True, True, "See here")]
    with pytest.raises(ValueError):
        office.target_of("O/t/x.xhtml", "../../../etc/passwd")


def test_write_back(spark):
    df = spark.createDataFrame([(1, 1, " a", "x"), (1, 2, "b ", "x")], "g int, n int, t string, new string")
    assert [r["written"] for r in sinks.write_back(df, ["g"], "n", "t", "new").orderBy("n").collect()] == [" x ", ""]
