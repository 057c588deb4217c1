"""Spans that must survive translation: cut out before, put back after."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quire.functions.text import is_blank

#: What is protected, in order of precedence for spans of one start and length.
URL = r"(?i)https?://\S+"
EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
ARXIV = r"(?i)\barXiv:\d{4}\.\d{4,5}(?:v\d+)?\b"
LATEX = r"\\[A-Za-z]+(?:\{[^{}]*\})?"
CITATION = r"\[(?:\d{1,3}(?:\s*[-,–]\s*\d{1,3}){0,8}|[A-Za-z][A-Za-z0-9_.-]{0,20})\]"
SUBFIGURE = r"(?<!\w)\([a-z]\)(?!\w)"
LINE_START = r"(?im)^(?:\s*)(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|(?:Chapter|Section|Article)\s+\d+[A-Za-z0-9.\-]*|(?:\d{1,3}|[A-Za-z]|[IVXLC]+)(?:\.\d{1,3}){0,5}[\.\)、\)]|[\(（](?:\d{1,3}|[A-Za-z]|[ivxlc]+)[\)）]|[A-Za-z]\)|[•\-·▪■◆◦])\s*"
CLAUSE = r"(?i)(?<!\w)(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|(?:\d{1,3})(?:\.\d{1,3}){1,5}|(?:Article|Section)\s+\d+[A-Za-z0-9.\-]*)"
PLACEHOLDER = "@@KEEP_{:04d}@@"

PATTERNS = [regex.compile(p) for p in (URL, EMAIL, DOI, ARXIV, LATEX, CITATION, SUBFIGURE, LINE_START, CLAUSE)]


def spans(text: str) -> list[tuple[int, int]]:
    """Protected spans from left to right: of overlapping ones the earliest, of those of one start the longest."""
    found = {m.span() for p in PATTERNS for m in p.finditer(text) if m[0].strip()}
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def protect_text(text: str | None) -> tuple[str | None, list[str]]:
    """(text with placeholders, what they stand for in order); blank texts stay as they are."""
    if text is None or not text.strip():
        return text, []
    parts, kept, at = [], [], 0
    for start, end in spans(text):
        kept.append(text[start:end])
        parts += [text[at:start], PLACEHOLDER.format(len(kept))]
        at = end
    return "".join([*parts, text[at:]]), kept


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def protect(texts: pd.Series) -> pd.DataFrame:
    """struct<text, tokens>: a text with its protected spans replaced; a null text stays null, without tokens."""
    done = [protect_text(t if isinstance(t, str) else None) for t in texts]
    return pd.DataFrame({"text": [a for a, _ in done], "tokens": [b for _, b in done]})


def restore(text: Column, tokens: Column) -> Column:
    """Placeholders put back, all occurrences, in order of the tokens; in the JVM."""
    numbered = F.transform(tokens, lambda t, i: F.struct(F.format_string("@@KEEP_%04d@@", i + 1).alias("p"), t.alias("t")))
    return F.aggregate(numbered, text, lambda acc, x: F.replace(acc, x["p"], x["t"]))


def missing(text: Column, tokens: Column) -> Column:
    """How many placeholders a translation lost."""
    held = F.transform(tokens, lambda t, i: F.when(F.contains(text, F.format_string("@@KEEP_%04d@@", i + 1)), 0).otherwise(1))
    return F.when(is_blank(text), F.size(tokens)).otherwise(F.aggregate(held, F.lit(0), lambda a, b: a + b))


def all_restored(text: Column, tokens: Column) -> Column:
    """Whether every protected span stands in the text."""
    return F.forall(tokens, lambda t: F.contains(text, t))
