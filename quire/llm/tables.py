"""Cleaned views of the test tables that several problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.versions import drop_repeats, latest_versions
from quire.session import table


def base_language(column: str):
    """Language code in lower case without region ('ZH', 'zh-CN' -> 'zh'); blanks become null."""
    code = F.lower(F.regexp_extract(F.trim(F.col(column)), r"^[A-Za-z]+", 0))
    return F.when(code != "", code)


def current_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (doc_id, seq): the version with the greatest updated_at."""
    wanted = ["original", "translation", "source_lang", "target_lang"]
    rows = latest_versions(table(spark, folder, "segments"), ["doc_id", "seq"], "updated_at", wanted)
    return rows.select("doc_id", "seq", "original", "translation", base_language("source_lang").alias("source_lang"), base_language("target_lang").alias("target_lang"))


def units(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (doc_id, unit_no) of epub_units."""
    rows = drop_repeats(table(spark, folder, "epub_units"), ["doc_id", "unit_no"], ["lang", "original"])
    return rows.select("doc_id", "unit_no", base_language("lang").alias("lang"), "original")


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (doc_id, unit_no, fragment_no) of epub_fragments."""
    return drop_repeats(table(spark, folder, "epub_fragments"), ["doc_id", "unit_no", "fragment_no"], ["original"])


def parallel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (doc_id, seq) of parallel_lines."""
    rows = drop_repeats(table(spark, folder, "parallel_lines"), ["doc_id", "seq"], ["original", "translation", "source_lang", "target_lang"])
    return rows.withColumn("source_lang", base_language("source_lang")).withColumn("target_lang", base_language("target_lang"))


def ocr_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (doc_id, page, idx) of both block tables: origin, text and the top and left edge, top-down."""
    ocr = drop_repeats(table(spark, folder, "ocr_blocks"), ["doc_id", "page", "idx"], ["text", "left_x", "top_y", "width", "height"])
    ocr = ocr.select(F.lit("ocr").alias("origin"), "doc_id", "page", "idx", "text", "left_x", "top_y", "width", "height", F.lit(None).cast("double").alias("size"), F.lit(None).cast("boolean").alias("bold"))
    pdf = drop_repeats(table(spark, folder, "blocks"), ["doc_id", "page", "idx"], ["text", "rect", "style"])
    pdf = pdf.select(
        F.lit("pdf").alias("origin"),
        "doc_id",
        "page",
        "idx",
        "text",
        F.col("rect.left_x").alias("left_x"),
        (F.lit(842.0) - F.col("rect.top_y")).alias("top_y"),
        (F.col("rect.right_x") - F.col("rect.left_x")).alias("width"),
        (F.col("rect.top_y") - F.col("rect.bottom_y")).alias("height"),
        F.col("style.size").alias("size"),
        F.col("style.bold").alias("bold"),
    )
    return ocr.unionByName(pdf)
