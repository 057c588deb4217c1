"""String functions and quality predicates on literal rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import quality as Q
from quire.functions import text as X
from quire.functions.answers import answer_text, system_prompt, user_prompt
from quire.operators import distribute as D
from quire.operators import protect as P
from quire.operators import state as S


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "wanted"),
    [
        (X.strip, "　 a b ", "a b"),
        (X.comparable, "Ab-1 é。漢", "ab1é漢"),
        (X.english_ratio, "ab 12", 0.5),
        (X.english_ratio, "", 0.0),
        (X.english_ratio, None, None),
        (X.has_cjk, "x漢", True),
        (X.has_cjk, "かな", False),
        (X.has_wide_cjk, "かな", True),
        (X.lines, "a\r\n\n b \n", ["a", "b"]),
        (X.table_segments, "a\tb | c", ["a", "b", "c"]),
        (X.table_segments, "abc", ["abc"]),
        (X.drop_hyphen, "exam- ", "exam"),
        (X.leading_lower_word, " ple is", "ple"),
        (X.leading_lower_word, "Ple", ""),
        (X.cell_text, "a\r\r\r\rb", "a\n\nb"),
        (X.list_marker, "12) text", "12)"),
        (X.ends_sentence, "He left. ", True),
        (X.ends_sentence, "He left.”", False),
        (X.ends_sentence, "他走了。", True),
        (X.ends_open, "He left", True),
        (X.ends_open, "as follows: ", False),
        (X.ends_open, "(see", True),
        (X.ends_open, "a)", False),
        (X.ends_open, " ", False),
        (X.starts_open, " and more", True),
        (X.starts_open, "And more", True),
        (X.starts_open, "Andrew", False),
        (X.starts_open, "3 boxes", True),
        (X.starts_open, "Boxes", False),
        (X.starts_sentence, "“Box", False),
        (X.starts_sentence, "(\"Box", True),
        (X.starts_sentence, "箱", True),
        (X.starts_lower, "[box", True),
        (X.message_endpoint, "https://a/v1/", "https://a/v1/messages"),
        (X.chat_endpoints, "https://a/v3", ["https://a/v3/chat/completions"]),
        (X.context_preview, "a\r\nb  c\td", "a b c\td"),
        (X.list_marker, "（3） text", "（3）"),
        (X.list_marker, "★ text", "★"),
        (X.css_twips, "10px", 150),
        (X.css_twips, "12pt", 240),
        (X.css_twips, "1.5em", 360),
        (X.css_twips, "50%", None),
        (X.colour_hex, "#abc", "AABBCC"),
        (X.colour_hex, "Grey", "808080"),
        (X.colour_hex, "rgb(1,2,3)", None),
        (X.css_declarations, "Color: red; x; color:blue;:", {"color": "blue"}),
        (X.text_weight, None, 1),
    ],
)
def test_scalar(spark, f, text, wanted):
    assert one(spark, f(F.col("t")), t=text) == wanted


def test_previews_and_edges(spark):
    assert one(spark, X.preview(F.col("t"), 5), t="ab\n cd  ef") == "ab cd..."
    assert one(spark, X.keep_edges(F.col("o"), F.col("n")), o=" a\n", n="\tb ") == " b\n"
    assert one(spark, X.keep_edges(F.col("o"), F.col("n")), o="  ", n="") == "    "
    assert one(spark, X.join_hyphenated(F.col("a"), F.col("b")), a="exam-", b=" ple") == "example"
    assert one(spark, X.join_hyphenated(F.col("a"), F.col("b")), a=None, b="x") == "x"
    assert one(spark, X.href_target(F.col("h"), F.col("f")), h="A.xhtml?x=1#Top", f="OEBPS") == "oebps/a.xhtml#Top"
    assert one(spark, X.href_target(F.col("h"), F.col("f")), h="https://a/b", f="OEBPS") is None


@pytest.mark.parametrize(
    ("original", "translation", "n"),
    [
        ("Deep learning models", "", 1),
        ("Deep learning models", None, 1),
        ("Deep learning models", "Deep learning models", 3),
        ("Deep learning models", "深度学习模型", 0),
        ("123 45", "123 45", 0),
        ("", "anything", 0),
        (None, None, 0),
    ],
)
def test_reasons(spark, original, translation, n):
    assert len(one(spark, Q.reasons(F.col("o"), F.col("t")), o=original, t=translation)) == n


def test_structure(spark):
    assert one(spark, Q.list_broken(F.col("o"), F.col("t")), o="1. a\n2. b\n3. c", t="1. a")
    assert not one(spark, Q.list_broken(F.col("o"), F.col("t")), o="1. a\n2. b", t="1. 甲\n2. 乙")
    assert one(spark, Q.numbering_broken(F.col("o"), F.col("t")), o="1. a", t="甲")
    assert one(spark, Q.truncated(F.col("o"), F.col("t")), o="one two three four five six seven eight", t="一")
    assert one(spark, Q.cell_expanded(F.col("o"), F.col("t")), o="a\nb", t="a b")
    assert one(spark, Q.needs_retry(F.col("o"), F.col("t"), F.lit("table")), o="甲", t="left in English here")


def test_protection(spark):
    text = "See [12] at https://a.io/x and mail me@b.co (a)"
    cut, kept = P.protect_text(text)
    assert cut == "See @@KEEP_0001@@ at @@KEEP_0002@@ and mail @@KEEP_0003@@ @@KEEP_0004@@"
    assert kept == ["[12]", "https://a.io/x", "me@b.co", "(a)"]
    assert P.protect_text("plain words") == ("plain words", [])
    assert P.protect_text(None) == (None, [])
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").withColumn("p", P.protect("t"))
    out = rows.select("t", P.restore(F.col("p.text"), F.col("p.tokens")).alias("r"), P.missing(F.lit("x"), F.col("p.tokens")).alias("m")).collect()
    assert [r["r"] for r in out] == [text, "", None]
    assert [r["m"] for r in out] == [4, 0, 0]


def test_distribution(spark):
    assert D.distribute_text("Hello world. Bye now.", [12, 9]) == ["Hello world.", " Bye now."]
    assert D.distribute_text("abcdefghij", [1, 1]) == ["abcde", "fghij"]
    assert D.distribute_text("", [3, 4]) == ["", ""]
    assert D.distribute_text("x", [5]) == ["x"]
    assert D.distribute_text("x", []) == []
    with pytest.raises(ValueError, match="negative"):
        D.distribute_text("x", [1, -1])
    long = ("One sentence here. " * 60).strip()
    rows = spark.createDataFrame([(long,), ("short",), (None,), ("a" * 500,)], "t string")
    out = [r[0] for r in rows.select(D.pack_sentences(F.col("t"))).collect()]
    assert "".join(out[0]) == long and all(len(x) <= 420 for x in out[0])
    assert out[1:] == [["short"], [None], ["a" * 500]]


def test_distribution_properties():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=80), st.lists(st.integers(0, 9), min_size=1, max_size=6))
    def whole(text, weights):
        out = D.distribute_text(text, weights)
        assert "".join(out) == text and len(out) == len(weights)

    whole()

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=80))
    def kept(text):
        cut, tokens = P.protect_text(text)
        for i, t in enumerate(tokens):
            cut = cut.replace(P.PLACEHOLDER.format(i + 1), t)
        assert cut == text

    kept()


def test_state_functions(spark):
    assert one(spark, S.failure_kind(F.col("e")), e="HTTP 401") == "auth"
    assert one(spark, S.failure_kind(F.col("e")), e="The request timed out") == "timeout"
    assert one(spark, S.failure_kind(F.col("e")), e=None) is None
    assert one(spark, S.clamp(F.col("n"), 0.5, 3.0), n=9.0) == 3.0
    assert one(spark, S.retry_delay(F.col("n")), n=7) == 8
    assert one(spark, S.retries(F.col("a"), F.col("b")), a=2, b=5) == 5
    assert one(spark, S.percent(F.col("a"), F.col("b")), a=1, b=0) == 0


def test_answers(spark):
    shapes = {'{"content":"a"}': "a", '{"content":[{"text":"a"},{"content":"b"}]}': "ab", '{"completion":"a"}': "a", '{"choices":[{"message":{"content":"a"}}]}': "a", '{"choices":[{"text":"a"}]}': "a", "{}": None, "no json": None}
    for json, wanted in shapes.items():
        assert one(spark, answer_text(F.col("j")), j=json) == wanted
    assert one(spark, system_prompt(F.col("t"), F.lit("en"), F.lit("$1"), F.lit("")), t="From {Source} to {target}") == "From en to $1"
    assert one(spark, user_prompt(F.col("t"), F.lit(""), F.lit(" r ")), t="x").endswith("不要残留未翻译英文。\n补充要求：\nr\n\n待翻译文本：\n<<<TEXT\nx\nTEXT")
    assert one(spark, user_prompt(F.col("t"), F.lit("c"), F.lit(None).cast("string")), t=None).startswith("文档上下文（仅供理解，不要翻译这一部分）：\nc\n\n翻译要求：\n1. ")
