"""Frames the queries start from: tables without repeats, with explicit ordinals and no nulls where the operators expect text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.versions import latest_versions
from quire.session import table


def current_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Current segments: doc_id, seq, context, original, translation."""
    rows = latest_versions(table(spark, folder, "segments"), ["doc_id", "seq"], "updated_at", ["context", "original", "translation"])
    return rows.select("doc_id", "seq", *[F.coalesce(c, F.lit("")).alias(c) for c in ("context", "original", "translation")])


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents: doc_id, pos from 1, line."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return docs.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), "line")


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of pages, flat: doc_id, page, idx, text, l, r, t, b (origin at the bottom left), lh, block_type, region, source, font, size, bold."""
    return (
        table(spark, folder, "blocks")
        .select(
            "doc_id",
            "page",
            "idx",
            F.coalesce("text", F.lit("")).alias("text"),
            F.col("rect.left_x").alias("l"),
            F.col("rect.right_x").alias("r"),
            F.col("rect.top_y").alias("t"),
            F.col("rect.bottom_y").alias("b"),
            F.col("line_height").alias("lh"),
            "alignment",
            F.coalesce("block_type", F.lit("Normal")).alias("block_type"),
            F.coalesce("region", F.lit("Body")).alias("region"),
            F.coalesce("source", F.lit("Native")).alias("source"),
            F.col("style.font").alias("font"),
            F.col("style.size").alias("size"),
            F.col("style.bold").alias("bold"),
        )
        .distinct()
    )
