"""Records equal but for formatting: progressive partition refinement.

Two texts are copies if they agree but for white space, letter case, punctuation
and, in catalogue records (three or more labelled fields), the order of fields.
Marks inside a number, symbols that are not punctuation, the words of a value and
the label it stands under are content.

Refinement: rows are first split by a cheap invariant (number of letters and
digits, and a hash of their multiset, the letter histogram), which any two copies share; rows
alone in their class are done. Only classes with several members get the costly
key (fields parsed, cleaned and sorted), and only its 128-bit digest is
shuffled. All steps are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import join_groups
from quire.session import materialize

#: Java patterns of what formatting may change.
SPACE = r"[\s\p{Z}\p{Cc}\p{Cf}]"
LOOSE_MARK = r"(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd})"
RULES = r"[`^~|]|(?m:^[^\p{L}\p{N}\n]*>)"
#: A field label: at the start or after a separator, up to three words, then a colon or equals sign.
LABEL = r"(?:^|[;；\n|,，/、])\s*(\p{L}[\p{L}\p{M}]*(?:[ _-]\p{L}[\p{L}\p{M}]*){0,2})\s*[:：=]"
MIN_FIELDS = 3
FIELD, VALUE = "\ue000", "\ue001"


def _folded(c: Column) -> Column:
    """Upper case, as lower case would keep sharp s and its capitals apart."""
    return F.upper(c)


def is_blank(c: Column) -> Column:
    """Null, or without letter and digit."""
    return F.coalesce(~c.rlike(r"[\p{L}\p{N}]"), F.lit(True))


def _clean(c: Column) -> Column:
    """Formatting taken out of folded text; marks between two digits stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, RULES, ""), LOOSE_MARK, ""), SPACE, "")


def cheap_invariant(c: Column) -> Column:
    """Hash of the stripped length and the multiset of letters and digits; equal for any two copies."""
    stripped = F.regexp_replace(_folded(c), r"[^\p{L}\p{N}]", "")
    letters = F.array_join(F.array_sort(F.split(stripped, "")), "")
    return F.xxhash64(F.length(stripped), letters)


def costly_key(c: Column) -> Column:
    """Digest of the content: of the sorted labelled fields in a record, of the whole cleaned text otherwise."""
    text = F.trim(F.translate(_folded(c), FIELD + VALUE, ""))
    # Private-use marks before each label and each value outlive the cleaning.
    clean = _clean(F.regexp_replace(text, LABEL, FIELD + "$1" + VALUE))
    fields = F.split(clean, FIELD)
    # The first part is what stands before the first label: nothing, in a record.
    record = clean.startswith(FIELD) & (F.size(fields) > MIN_FIELDS)
    body = F.when(record, F.array_join(F.array_sort(fields), FIELD)).otherwise(F.translate(clean, FIELD + VALUE, ""))
    return F.md5(body.cast("binary"))


def refine(df: DataFrame, key: str = "chunk_id", text: str = "original") -> tuple[DataFrame, DataFrame, int]:
    """(members, classes, number of rows): rows of classes with several members with their digest, and those classes.

    Classes have `digest`, `keep_id` (smallest key) and `copies`. Rows with a
    blank text belong to no class; a row delivered twice counts once.
    """
    rows = df.filter(~is_blank(F.col(text))).select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    light = rows.select("_id", cheap_invariant(F.col("_text")).alias("_inv"))
    sizes = materialize(light.groupBy("_inv").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    total = rows.count()
    suspects = join_groups(rows.withColumn("_inv", cheap_invariant(F.col("_text"))), sizes, "_inv", "_n", total)
    members = materialize(suspects.select("_id", costly_key(F.col("_text")).alias("digest")))
    classes = (
        members.groupBy("digest")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("_rows"), F.max("_id").alias("_last"))
        .filter("_last > keep_id")
    )
    return members, classes, total


def copies_found(df: DataFrame, key: str = "chunk_id", text: str = "original") -> DataFrame:
    """(keep_id, copy_id): for each record the smallest key and each other copy.

    Null and blank texts have no copies; nothing is dropped from hot classes,
    however many copies they have: their members meet the class by broadcast.
    """
    members, classes, total = refine(df, key, text)
    pairs = join_groups(members, materialize(classes.select("digest", "keep_id", "_rows")), "digest", "_rows", total)
    return pairs.filter("_id <> keep_id").select("keep_id", F.col("_id").alias("copy_id")).distinct()


def records(df: DataFrame, key: str = "chunk_id", text: str = "original") -> DataFrame:
    """(keep_id, copies): one row per distinct non-blank record with the number of rows that hold it."""
    members, classes, total = refine(df, key, text)
    pairs = join_groups(members, materialize(classes.select("digest", "keep_id", "_rows")), "digest", "_rows", total)
    extra = pairs.select("keep_id", "_id").distinct()
    single = df.filter(~is_blank(F.col(text))).select(F.col(key).alias("_id")).join(extra.select("_id"), "_id", "left_anti").distinct()
    several = extra.groupBy("keep_id").agg(F.count(F.lit(1)).alias("copies"))
    return several.unionByName(single.select(F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies")))
