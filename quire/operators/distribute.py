"""A text dealt out over weighted targets, and long texts packed into fragments."""

from __future__ import annotations

import math

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quire.functions.text import is_blank

#: Where a cut goes, the best place first, and how far from its target it may be.
CUT_AFTER = [regex.compile(p) for p in (r"[。！？.!?]", r"[，；,;、]", r"\s", r"\p{P}", r"[\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]")]
SLACK = 0.3
#: Longest fragment of a paragraph, and where paragraphs part.
FRAGMENT = 420
SENTENCE_SEAM = r"(?U)(?<=[.!?。！？；;:：])(?=\s|$)|(?<=\n)(?=\S)"


def _cut(text: str, start: int, target: float) -> int:
    """The end of a piece that begins at `start` and should be `target` long."""
    aim = start + target
    low = max(start, math.floor(aim - SLACK * target))
    high = min(len(text), math.ceil(aim + SLACK * target))
    if low < high:
        for mark in CUT_AFTER:
            last = None
            for last in mark.finditer(text, low, high):  # noqa: B007
                pass
            if last is not None:
                return last.end()
    return min(int(aim), len(text))


def distribute_text(text: str | None, weights: list[int]) -> list[str]:
    """Pieces of a text, one for each weight, which joined give the text.

    Weights below one count as one, negative ones are an error; one weight takes
    all; an empty or null text gives empty pieces; the last piece takes the rest.
    """
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    text = text or ""
    if len(weights) < 2 or not text:
        return [text] * len(weights)
    whole = [max(1, int(w)) for w in weights]
    out, at = [], 0
    for w in whole[:-1]:
        end = _cut(text, at, len(text) * w / sum(whole))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


@pandas_udf(T.ArrayType(T.StringType()))
def distribute(texts: pd.Series, weights: pd.Series) -> pd.Series:
    """distribute_text as a column function; null weights give no pieces."""
    return pd.Series([distribute_text(t if isinstance(t, str) else None, list(w) if w is not None else []) for t, w in zip(texts, weights)])


def distribute_evenly(text: Column, n: Column) -> Column:
    """A text dealt out over n equal targets; a single target or an empty text is repeated as it is."""
    plain = F.array_repeat(F.coalesce(text, F.lit("")), F.greatest(n, F.lit(0)))
    return F.when((n <= 1) | (F.coalesce(text, F.lit("")) == ""), plain).otherwise(distribute(text, F.array_repeat(F.lit(1), F.greatest(n, F.lit(0)))))


def pack_sentences(text: Column, limit: int = FRAGMENT) -> Column:
    """Fragments of a long text: sentences packed until the next would exceed `limit`; in the JVM.

    Blank parts between sentences are dropped; a text within the limit, or of one sentence, is one
    fragment; a single sentence may exceed the limit.
    """
    parts = F.filter(F.split(text, SENTENCE_SEAM), lambda p: ~is_blank(p))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(part) > limit)
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, part).otherwise(F.concat(acc["open"], part)).alias("open"))

    packed = F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(is_blank(text) | (F.length(text) <= limit) | (F.size(parts) <= 1), F.array(text)).otherwise(packed)
