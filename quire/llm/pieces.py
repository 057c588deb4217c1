"""Oversized items cut into balanced pieces at natural boundaries, with overlap.

Method: the fewest pieces that can hold an item under its limit, with the wanted
overlap, are counted; cut targets are set at equal distances; each target
moves to the strongest boundary near it (sentence end, then clause mark, then
white space, else between two characters that are no cluster). If a piece or
its overlap breaks the limit, one piece more is tried. Sentences come from the
hidden-event model of `sentences`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.sentences import BoundaryModel, decode

#: Commas, semicolons and colons, and sentence marks, of any script.
CLAUSE = ",;:，；：、､﹐﹔﹕،؛՝፣፤፥᠂"
SENTENCE = ".!?…。｡．！？।॥؟۔։።፧‼⁇⁈⁉"
#: A stretch in which no natural cut is possible.
SOLID = regex.compile(r"[^\s" + regex.escape(CLAUSE + SENTENCE) + r"]+")
CLAUSE_END = regex.compile(r"[" + regex.escape(CLAUSE) + r"–—]\s*")
BLANK = regex.compile(r"\s+")
CLUSTER = regex.compile(r"\X")

#: How far from its target a cut may move, as a share of the room, for boundaries of each strength (3 sentence, 2 clause, 1 blank, 0 any).
REACH = {3: 1.0, 2: 0.7, 1: 0.5, 0: 1.0}


def boundaries(text: str, sentences: list[tuple[int, int]]) -> dict[int, list[int]]:
    """Sorted cut positions by strength: a cut at i puts text[:i] before it."""
    out: dict[int, set[int]] = {3: {s for s, _ in sentences[1:]}, 2: set(), 1: set()}
    out[2] = {m.end() for m in CLAUSE_END.finditer(text)}
    out[1] = {m.end() for m in BLANK.finditer(text)}
    n = len(text)
    return {k: sorted(i for i in v if 0 < i < n) for k, v in out.items()}


def _snap(target: float, low: int, high: int, cuts: dict[int, list[int]], clusters: list[int]) -> int | None:
    """The strongest boundary in [low, high] near the target: stronger ones win from farther away."""
    room = max(1.0, (high - low) / 2)
    best, score = None, None
    for strength in (3, 2, 1):
        at = cuts[strength]
        k = bisect_left(at, target)
        for i in (k - 1, k):
            if 0 <= i < len(at) and low <= at[i] <= high:
                away = abs(at[i] - target) / (room * REACH[strength] * 2)
                value = strength - 2.5 * away
                if score is None or value > score:
                    best, score = at[i], value
        if best is None:
            # None on either side of the target: the nearest within the bounds.
            i = bisect_right(at, high) - 1
            if i >= 0 and at[i] >= low:
                best, score = at[i], strength - 2.5
    if best is not None:
        return best
    i = bisect_right(clusters, min(high, max(low, int(target)))) - 1
    if i >= 0 and low <= clusters[i] <= high and clusters[i] > 0:
        return clusters[i]
    i = bisect_left(clusters, low)
    if i < len(clusters) and clusters[i] <= high:
        return clusters[i]
    # One cluster longer than the limit: cut within it.
    return min(high, max(low, int(target)))


def _overlap_start(cut: int, overlap: int, floor: int, cuts: dict[int, list[int]], clusters: list[int]) -> int:
    """Where the piece after a cut begins: about `overlap` before it, at the nearest boundary, never at or before `floor`."""
    if overlap <= 0:
        return cut
    want = cut - overlap
    best, away = None, None
    for strength in (3, 2, 1):
        at = cuts[strength]
        k = bisect_left(at, want)
        for i in (k - 1, k):
            if 0 <= i < len(at) and floor < at[i] < cut and want - overlap // 2 <= at[i]:
                d = abs(at[i] - want) - (overlap // 6 if strength == 3 else 0)
                if d <= overlap // 2 and (away is None or d < away):
                    best, away = at[i], d
    if best is None:
        i = bisect_left(clusters, max(want, floor + 1))
        best = clusters[i] if i < len(clusters) and clusters[i] < cut else cut
    return best


def split_item(text: str, limit: int, overlap: int, sentences: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of each piece; one piece when the text fits.

    Pieces cover the text from end to end, each at most `limit` long. The
    strength is 3 for a sentence end, 2 for a clause mark, 1 for white
    space, 0 for a cut within a word, and 4 for the end of the text.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 4)] if n else []
    limit = max(1, limit)
    # An overlap of half the limit or more would never let the pieces move on.
    overlap = max(0, min(overlap, (limit - 1) // 2))
    cuts = boundaries(text, sentences)
    clusters = [m.start() for m in CLUSTER.finditer(text)]
    known = {k: set(v) for k, v in cuts.items()}
    least = -(-(n - overlap) // (limit - overlap))
    for count in range(max(2, least), n + 1):
        out: list[tuple[int, int, int]] = []
        start, done = 0, 0
        for k in range(1, count):
            left = count - k
            target = done + (n - done) / (left + 1)
            low, high = max(done + 1, start + 1), min(start + limit, n - 1)
            # What remains must fit into the pieces left, each of which repeats an overlap of up to one and a half.
            need = n - left * (limit - overlap - overlap // 2)
            low = max(low, min(need, high))
            if low > high:
                break
            cut = _snap(min(max(target, low), high), low, high, cuts, clusters)
            if cut is None or cut <= done:
                break
            strength = next((s for s in (3, 2, 1) if cut in known[s]), 0)
            out.append((start, cut, strength))
            start, done = _overlap_start(cut, overlap, start, cuts, clusters), cut
        else:
            if n - start <= limit:
                out.append((start, n, 4))
                return out
        if count > 4 * least + 8:
            break
    # Greedy fall-back with the same boundaries: always ends, since each cut moves on.
    out, start, done = [], 0, 0
    while n - start > limit:
        high = min(start + limit, n - 1)
        cut = _snap(high, max(done + 1, start + 1), high, cuts, clusters) or high
        cut = max(cut, done + 1)
        out.append((start, cut, next((s for s in (3, 2, 1) if cut in known[s]), 0)))
        start, done = _overlap_start(cut, overlap, start, cuts, clusters), cut
        if start + limit <= done:
            start = done
    out.append((start, n, 4))
    return out


def boundary_kind(text: str, limit: int, sentences: list[tuple[int, int]]) -> str:
    """Where a text longer than the limit can be cut: none (a solid stretch is over it), inner (a sentence is), sentence."""
    if any(m.end() - m.start() > limit for m in SOLID.finditer(text)):
        return "none"
    if any(e - s > limit for s, e in sentences):
        return "inner"
    return "sentence"


PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start_pos", T.IntegerType()),
            T.StructField("end_pos", T.IntegerType()),
            T.StructField("cut", T.StringType()),
            T.StructField("piece", T.StringType()),
        ]
    )
)
CUTS = ("word", "blank", "clause", "sentence", "end")


def split_items(items: DataFrame, model: BoundaryModel, keep: list[str], text: str = "original", limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """(*keep, boundary, pieces): each item longer than its limit, how it can be cut, and its pieces in order.

    Items within the limit, null ones and items without a limit are not
    returned; an empty table gives an empty table; repeated rows are each cut.
    The filter on length runs before any Python does.
    """
    long = items.filter(F.length(text) > F.col(limit)).select(*keep, text, limit, F.coalesce(F.col(overlap), F.lit(0)).alias("_overlap"))
    shared = items.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[long.schema[k] for k in keep], T.StructField("boundary", T.StringType()), T.StructField("pieces", PIECE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            kinds, pieces = [], []
            for t, most, again in zip(pdf[text], pdf[limit], pdf["_overlap"]):
                found = decode(t, m)
                kinds.append(boundary_kind(t, int(most), found))
                cut = split_item(t, int(most), int(again), found)
                pieces.append([{"piece_no": i + 1, "start_pos": s, "end_pos": e, "cut": CUTS[k], "piece": t[s:e]} for i, (s, e, k) in enumerate(cut)])
            yield pdf[keep].assign(boundary=np.array(kinds, dtype=object), pieces=pd.Series(pieces, index=pdf.index, dtype=object))

    return long.mapInPandas(run, schema)
