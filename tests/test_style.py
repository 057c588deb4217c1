"""Fonts, colours, pictures, markup, line breaks, recognised words."""

from pyspark.sql import functions as F

from quire.functions import style as Y
from quire.operators import markup, ocr_layout


def test_style(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(Y.font_family(F.lit("ABCDEF+FangSong-Bold"))) == "SimSun"
    assert one(Y.font_family(F.lit("Bold"))) == "Bold" and one(Y.font_family(F.lit(None).cast("string"))) == ""
    assert tuple(one(Y.cmyk_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.5)))) == (128, 0, 0)
    assert one(Y.html_pixels(F.lit("12.4px"))) == 12 and one(Y.html_pixels(F.lit("50%"))) is None
    assert tuple(one(Y.image_size(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")))) == (480 * 9525, 320 * 9525)
    assert one(Y.cover_lines(F.array(F.lit("A"), F.lit(" "), F.lit("B")), F.lit(None).cast("string"), F.array(F.lit("x"), F.lit("y")))) == ["A / B", "x    y"]
    assert one(Y.header_map(F.lit("A: b: c\nnone\nA: d\nE:"))) == {"A": "b: c", "E": ""}


def test_markup(spark):
    html = "<p>A <b>b<i>c</i></b><ol><li>x<li>y<p>inner</p></ol><script>no</script>&amp;<br>z"
    blocks = markup.flatten_page(html)
    assert [(t, d, m, "".join(x for x, _ in r)) for t, d, m, r in blocks] == [("p", 0, "", "A bc"), ("li", 1, "1.", "x"), ("li", 1, "2.", "y"), ("p", 1, "", "inner"), ("p", 0, "", "&\nz")]
    assert blocks[0][3] == [("A ", ""), ("b", "bold"), ("c", "bold|italic")]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert markup.flatten(df, "id", "html").select("id").distinct().count() == 1


def test_line_breaks():
    assert markup.wrap("one two three four", 9) == ["one two", " three", " four"]
    for text in ("漢字、漢字。漢字漢字、字", "abcdefghijklmnop", "", "a"):
        for width in (1, 3, 8):
            lines = markup.wrap(text, width)
            assert "".join(lines) == text and all(len(x) <= max(1, width) for x in lines)


def test_recognised(spark):
    words = [(1, "One", 10.0, 10.0, 40.0, 20.0, 90.0), (1, "two", 45.0, 11.0, 80.0, 21.0, 90.0), (1, "three", 10.0, 25.0, 80.0, 35.0, 90.0), (1, "low", 10.0, 40.0, 80.0, 50.0, 9.0), (1, " ", 0.0, 0.0, 1.0, 1.0, 99.0), (1, "right", 400.0, 60.0, 470.0, 70.0, 90.0)]
    df = spark.createDataFrame(words, "p int, text string, l double, t double, r double, b double, confidence double")
    out = [(r["block_no"], r["text"]) for r in ocr_layout.recognised_blocks(df, ["p"], 595.0).orderBy("block_no").collect()]
    assert out == [(1, "One two\nthree"), (2, "right")]
    assert ocr_layout.recognised_blocks(df.limit(0), ["p"], 595.0).count() == 0
