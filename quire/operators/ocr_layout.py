"""Recognised words (origin at the top left) to lines, columns and blocks; one call for each page, which bounds its input."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import spread
from quire.settings import RECOGNITION, Recognition

#: Least distances of the folds, in points.
LINE_SLACK, LINE_SHARE = 6.0, 0.6
GAP, INDENT, WIDTH = 16.0, 18.0, 50.0


@dataclass
class Box:
    """Words of a line, or lines of a block, with their common box."""

    parts: list
    l: float
    t: float
    r: float
    b: float

    def add(self, part, l: float, t: float, r: float, b: float) -> None:
        self.parts.append(part)
        self.l, self.t, self.r, self.b = min(self.l, l), min(self.t, t), max(self.r, r), max(self.b, b)


def lines_of(words: list[tuple[str, float, float, float, float, float]]) -> list[Box]:
    """Lines of words (text, left, top, right, bottom, confidence), from the top: a word joins the first line whose mean bottom is near its own."""
    out: list[Box] = []
    for w in sorted(words, key=lambda x: (x[2], x[1], x[0])):
        near = max(LINE_SLACK, LINE_SHARE * (w[4] - w[2]))
        line = next((x for x in out if abs(sum(p[4] for p in x.parts) / len(x.parts) - w[4]) < near), None)
        if line:
            line.add(w, *w[1:5])
        else:
            out.append(Box([w], *w[1:5]))
    for line in out:
        line.parts.sort(key=lambda x: (x[1], x[0]))
    return sorted(out, key=lambda x: (x.t, x.l))


def columns_of(lines: list[Box], page_width: float, settings: Recognition = RECOGNITION) -> list[Box]:
    """Columns of lines: a line joins the first column that is near in centre or left edge, or overlaps it; the column grows."""
    out: list[Box] = []
    for line in lines:
        for c in out:
            common = min(c.r, line.r) - max(c.l, line.l)
            if (
                abs((c.l + c.r) - (line.l + line.r)) / 2 < settings.column_centre * page_width
                or abs(c.l - line.l) < settings.column_left * page_width
                or common / max(1.0, min(c.r - c.l, line.r - line.l)) > settings.column_overlap
            ):
                c.add(line, line.l, line.t, line.r, line.b)
                break
        else:
            out.append(Box([line], line.l, line.t, line.r, line.b))
    return sorted(out, key=lambda c: c.l)


def blocks_of(lines: list[Box], settings: Recognition = RECOGNITION) -> list[Box]:
    """Blocks of the lines of a column: near below, little indented, of like width to what was merged so far, whose height is the measure."""
    out: list[Box] = []
    for line in sorted(lines, key=lambda x: (x.t, x.l)):
        if out:
            last = out[-1]
            height, width = last.b - last.t, last.r - last.l
            if (
                line.t - last.b < max(GAP, settings.merge_gap * height)
                and abs(line.l - last.l) < max(INDENT, settings.merge_indent * height)
                and abs((line.r - line.l) - width) < max(WIDTH, settings.merge_width * width)
            ):
                last.add(line, line.l, line.t, line.r, line.b)
                continue
        out.append(Box([line], line.l, line.t, line.r, line.b))
    return out


def recognised_blocks(words: DataFrame, keys: list[str], page_width: float, scale: float = 1.0, settings: Recognition = RECOGNITION) -> DataFrame:
    """(keys, block_no, text, left, top, width, height): blocks of every page in reading order, lines kept in order.

    Expects text, l, t, r, b and confidence. Blank words and those below the
    least confidence are dropped before any Python runs; positions are divided by `scale`.
    """
    kept = words.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("confidence") >= settings.confidence))
    place = [(F.col(c) / F.lit(scale)).cast("double").alias(c) for c in ("l", "t", "r", "b")]
    pages = kept.groupBy(*keys).agg(F.collect_list(F.struct("text", *place, F.col("confidence").cast("double").alias("confidence"))).alias("_w"))
    schema = T.StructType([*[pages.schema[k] for k in keys], T.StructField("block_no", T.IntegerType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("left", "top", "width", "height")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                found = lines_of([(w["text"].strip(), w["l"], w["t"], w["r"], w["b"], w["confidence"]) for w in row[-1]])
                blocks = [b for c in columns_of(found, page_width, settings) for b in blocks_of(c.parts, settings)]
                for i, b in enumerate(blocks, 1):
                    text = "\n".join(" ".join(w[0] for w in line.parts) for line in b.parts)
                    out.append((*row[:-1], i, text, b.l, b.t, b.r - b.l, b.b - b.t))
            yield pd.DataFrame(out, columns=schema.names)

    return spread(pages).mapInPandas(run, schema)
