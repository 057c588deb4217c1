"""Queries on fonts, colours, images, markup and recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import style as Y
from quire.operators import layout, markup, ocr_layout
from quire.plans.carriers import document_lines
from quire.plans.registry import query
from quire.session import table
from quire.settings import Recognition

#: Names of fonts, with family, bold, italic and one-width as the rules have them.
FONTS = [
    ("ABCDEF+Times-Bold", "Times New Roman", True, False, False),
    ("Arial,Helvetica", "Arial", False, False, False),
    ("Calibri Light", "Arial", False, False, False),
    ("Courier_New", "Courier New", False, False, True),
    ("Microsoft YaHei UI", "Microsoft YaHei", False, False, False),
    ("SimHei", "SimHei", False, False, False),
    ("Noto Serif CJK", "SimSun", False, False, False),
    ("Quil Sans Bold Italic", "Quil Sans", True, True, False),
    ("FangSong", "SimSun", False, False, False),
    ("KaiTi_GB2312", "DengXian", False, False, False),
    ("MS Mincho", "SimSun", False, False, False),
    ("Yu Gothic 700", "SimHei", True, False, False),
    ("JetBrains Mono Slanted", "JetBrains Mono Slanted", False, True, True),
    ("Hack", "Hack", False, False, True),
    ("Georgia-Inclined", "Times New Roman", False, True, False),
    ("Noto Sans 900", "DengXian", True, False, False),
    ("Songti SC", "SimSun", False, False, False),
    ("Black", "Black", True, False, False),
    (" ", "", False, False, False),
]


@query("SELECT p_partkey, v.family, v.bold, v.italic, v.mono FROM part JOIN (VALUES " + ", ".join(f"({i}, '{f[1]}', {f[2]}, {f[3]}, {f[4]})" for i, f in enumerate(FONTS)) + ") v(k, family, bold, italic, mono) ON v.k = p_partkey % " + str(len(FONTS)))
def font_families(spark: SparkSession, folder: str) -> DataFrame:
    """Family and style of forms of font names."""
    name = F.element_at(F.array(*[F.lit(f[0]) for f in FONTS]), (F.col("p_partkey") % len(FONTS) + 1).cast("int"))
    flags = Y.font_flags(name)
    return table(spark, folder, "part").select("p_partkey", Y.font_family(name).alias("family"), flags["bold"].alias("bold"), flags["italic"].alias("italic"), flags["mono"].alias("mono"))


_C = "least(1.0, greatest(0.0, p_size / 40.0))"


@query(f"""WITH c AS (SELECT p_partkey, {_C}::DOUBLE AS c, 0.25::DOUBLE AS m, 0.0::DOUBLE AS y, ((p_partkey % 10) / 10.0)::DOUBLE AS k FROM part),
b AS (SELECT p_partkey, round_even((1 - c) * (1 - k) * 255, 0)::INT AS r, round_even((1 - m) * (1 - k) * 255, 0)::INT AS g, round_even((1 - y) * (1 - k) * 255, 0)::INT AS b FROM c)
SELECT p_partkey, r, g, b, (r + g + b) / 765.0::DOUBLE > 0.8 AS bright FROM b""")
def colour_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Printing colours as bytes, and whether they are bright."""
    rgb = Y.cmyk_to_rgb(F.col("p_size") / 40.0, F.lit(0.25), F.lit(-1.0), (F.col("p_partkey") % 10) / 10.0)
    rows = table(spark, folder, "part").select("p_partkey", rgb.alias("x"))
    return rows.select("p_partkey", "x.r", "x.g", "x.b", (Y.brightness(F.col("x.r"), F.col("x.g"), F.col("x.b")) > 0.8).alias("bright"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (p_size * 30)::BIGINT END AS w, CASE WHEN p_size % 4 = 0 THEN (p_size * 10)::BIGINT END AS h FROM part),
e AS (SELECT p_partkey, coalesce(w * 9525, CASE WHEN h IS NULL THEN 400 * 9525 ELSE round_even(h * 9525 * 400 / 300.0, 0) END)::BIGINT AS w, coalesce(h * 9525, CASE WHEN w IS NULL THEN 300 * 9525 ELSE round_even(w * 9525 * 300 / 400.0, 0) END)::BIGINT AS h FROM s)
SELECT p_partkey, least(w, 6000000) AS width, CASE WHEN w > 6000000 THEN greatest(32 * 9525, round_even(h * (6000000.0::DOUBLE / w), 0)::BIGINT) ELSE h END AS height FROM e""")
def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of pictures of 400 by 300 pixels with some wanted sizes."""
    n = F.col("p_size")
    width = Y.html_pixels(F.when(n % 3 == 0, F.concat((n * 30).cast("string"), F.lit("px"))))
    height = Y.html_pixels(F.when(n % 4 == 0, (n * 10).cast("string")))
    rows = table(spark, folder, "part").select("p_partkey", Y.image_size(width, height, F.lit(400), F.lit(300)).alias("s"))
    return rows.select("p_partkey", F.col("s.width").cast("bigint").alias("width"), F.col("s.height").cast("bigint").alias("height"))


@query()
def page_flattening(spark: SparkSession, folder: str) -> DataFrame:
    """Styled runs of pages made of the documents' lines."""
    text = F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;")
    html = F.concat(F.lit("<h1>Doc</h1><ol><li>"), F.regexp_replace(text, "\n+", "</li><li><b>"), F.lit("</b></li></ol>"))
    return markup.flatten(table(spark, folder, "documents").select("doc_id", html.alias("html")), "doc_id", "html")


@query()
def recognised_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of recognised words, from the documents' words on a grid."""
    boxes = layout.token_boxes(document_lines(spark, folder))
    words = boxes.select("doc_id", "page", "text", "l", (842 - F.col("t")).alias("t"), "r", (842 - F.col("b")).alias("b"), (F.lit(30.0) + F.length("text")).alias("confidence"))
    return ocr_layout.recognised_blocks(words, ["doc_id", "page"], 595.0, 1.0, Recognition(confidence=32.0))
