"""Queries of the ten training-data problems over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import align, confusables, dedup, defects, mixture, ocr, pieces, sentences, subjects, tables, tokens
from quire.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    unit = tables.units(spark, folder).select(F.lit("unit").alias("origin"), "doc_id", F.col("unit_no").alias("item_no"), F.col("original").alias("text"))
    segment = tables.current_segments(spark, folder).select(F.lit("segment").alias("origin"), "doc_id", F.col("seq").alias("item_no"), F.col("translation").alias("text"))
    return unit.unionByName(segment)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of parallel documents that render one another."""
    return align.align(tables.parallel(spark, folder)).select("doc_id", "original_seq", "translation_seq")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence starts of e-book units and current segments' translations."""
    texts = spread(_texts(spark, folder))
    model = sentences.train(texts, "text")
    return sentences.sentence_starts(texts, ["origin", "doc_id", "item_no"], "text", model)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks affected by page layout or recogniser, by kind."""
    return ocr.defects(tables.ocr_blocks(spark, folder))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Clean paragraphs of scanned and positioned documents, whole across pages."""
    return ocr.continuous(tables.ocr_blocks(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are one record but for formatting, each with the smallest chunk_id of its group."""
    return dedup.copies_found(table(spark, folder, "chunks"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct record with its number of copies."""
    return dedup.records(table(spark, folder, "chunks"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    unit = tables.units(spark, folder)
    fragment = tables.fragments(spark, folder).join(unit.select("doc_id", "unit_no", "lang"), ["doc_id", "unit_no"], "left")
    items = unit.select(F.lit("unit").alias("origin"), "doc_id", F.col("unit_no").alias("item_no"), F.lit(0).alias("fragment_no"), "lang", "original").unionByName(
        fragment.select(F.lit("fragment").alias("origin"), "doc_id", F.col("unit_no").alias("item_no"), "fragment_no", "lang", "original")
    )
    # The limits are a fixed table of one row per language.
    limits = F.broadcast(table(spark, folder, "split_limits").groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars")))
    fallback = F.broadcast(limits.filter("lang = 'any'").select(F.col("max_chars").alias("_any"), F.col("overlap_chars").alias("_any_overlap")))
    known = items.join(limits, "lang", "left").join(fallback, F.lit(True), "left")
    return known.withColumn("max_chars", F.coalesce("max_chars", "_any")).withColumn("overlap_chars", F.coalesce("overlap_chars", "_any_overlap")).drop("_any", "_any_overlap")


KEYS = ["origin", "doc_id", "item_no", "fragment_no"]


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    model = sentences.train(spread(tables.units(spark, folder).select("original")), "original")
    return pieces.split_items(spread(_items(spark, folder).filter(F.length("original") > F.col("max_chars"))), model, KEYS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized items and the best boundaries they offer."""
    return _cut(spark, folder).select(*KEYS, "boundary")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized items."""
    return _cut(spark, folder).select(*KEYS, F.explode("pieces").alias("p")).select(*KEYS, "p.*")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current segments with a defective translation."""
    return defects.defects(tables.current_segments(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms seen in chunks that a plain search does not find."""
    return confusables.find_terms(table(spark, folder, "chunks"), table(spark, folder, "glossary"), disguised_only=True)


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All glossary terms seen in chunks."""
    return confusables.find_terms(table(spark, folder, "chunks"), table(spark, folder, "glossary"))


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks in one consistent form."""
    return confusables.unify_column(spread(table(spark, folder, "chunks").select("chunk_id", "original")), "original", "unified").select("chunk_id", "unified")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' tokens mixed to the wanted shares."""
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of the sources."""
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subject areas of documents."""
    return subjects.classify(table(spark, folder, "documents"), table(spark, folder, "subject_labels"))


def p10_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents of each and their share of all that have one."""
    found = p10_found(spark, folder)
    counts = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    total = counts.agg(F.sum("documents").alias("_all"))
    # One row of totals beside at most one row per subject.
    return counts.join(F.broadcast(total), F.lit(True)).select("subject", "documents", (F.col("documents") / F.col("_all")).alias("share"))


def queries() -> dict[str, Query]:
    """Query name to callable."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express on whole tables."""
    return {}
