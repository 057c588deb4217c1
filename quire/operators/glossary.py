"""Glossary: parsing of its lines and matching of its terms."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import is_blank, strip

#: Terms given to one request at most, and the line before them.
TERMS_PER_REQUEST = 30
HEADER = "术语表约束："
#: Entries that one automaton holds; a larger glossary is searched in as many passes as it takes.
BLOCK = 50_000


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, source, target) of the lines (line_no, line) of a glossary file.

    A line is split once, at a tab if it has one, else at an equals sign; comments
    (#), blank lines and lines without both sides are left out, repeated ones stay.
    """
    line = F.coalesce("line", F.lit(""))
    mark = F.when(line.contains("\t"), F.lit("\t")).otherwise(F.lit("="))
    at = F.instr(line, mark)
    rows = lines.filter((strip(line) != "") & ~strip(line).startswith("#")).filter(at > 0)
    parsed = rows.select("line_no", strip(F.substr(line, F.lit(1), at - 1)).alias("source"), strip(F.substr(line, at + 1)).alias("target"))
    return parsed.filter((F.col("source") != "") & (F.col("target") != ""))


def match(texts: DataFrame, entries: DataFrame, key: str, text: str, limit: int = TERMS_PER_REQUEST) -> DataFrame:
    """(key, terms, prompt): the entries whose source is contained in a text, letter case aside, longest first, below a header line.

    One automaton of the entries passes over each text once, whatever their number; no row is shuffled
    unless the hand-kept list exceeds BLOCK lines, whose blocks then meet by key. Texts
    without a match are not returned; null texts and blank sources match nothing. Keys should be
    unique: rows of one key are one text.
    """
    # The entries are kept by hand; a task holds BLOCK of them at most.
    blocks: list[list[tuple[int, str, str, str]]] = [[]]
    for r in entries.filter(~is_blank(F.col("source"))).select("line_no", F.lower("source").alias("low"), "source", F.coalesce("target", F.lit("")).alias("target")).toLocalIterator():
        if len(blocks[-1]) >= BLOCK:
            blocks.append([])
        blocks[-1].append(tuple(r))
    source = texts.filter(F.col(text).isNotNull()).select(key, F.lower(text).alias("low"))
    found_type = T.ArrayType(T.StructType([T.StructField("short", T.IntegerType()), T.StructField("line_no", entries.schema["line_no"].dataType), T.StructField("line", T.StringType())]))
    schema = T.StructType([source.schema[key], T.StructField("found", found_type)])
    out = None
    for block in blocks:
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lines: dict[str, list[tuple[int, int, str]]] = {}
            for no, low, source_, target in shared.value:
                lines.setdefault(low, []).append((-len(source_), no, f"- {source_} => {target}"))
            auto = ahocorasick.Automaton()
            for low, rows in lines.items():
                auto.add_word(low, rows)
            if len(auto):
                auto.make_automaton()
            for pdf in batches:
                rows = []
                for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                    hits = {row for _, found in auto.iter(t) for row in found} if len(auto) else ()
                    if hits:
                        rows.append((k, sorted(hits)[:limit]))
                yield pd.DataFrame(rows, columns=[key, "found"])

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if len(blocks) > 1:
        out = out.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, limit).alias("found"))
    return out.select(key, F.size("found").cast("bigint").alias("terms"), F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("found", lambda x: x["line"]), "\n")).alias("prompt"))
