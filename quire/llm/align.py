"""Sentence alignment of bilingual documents.

Method: sentences are first aligned by length alone (dynamic programming over
beads of up to two sentences a side). Pairs of which length is sure train
word-translation probabilities by expectation-maximization; the documents are then
realigned by dynamic programming on lexical scores, the pairs found train the
probabilities once more, and a last alignment follows. Sentences that the monotone path
leaves alone are matched by their lexical score wherever they stand, which
finds reordered ones.

Scores and paths are computed for many documents at once. The scores of a long document
are computed in tiles, each a task's row: every original meets every translation, wherever it
stands. A tile gives only the pairs that may be part of a link, and the
path and what it leaves alone follow from these as they would from all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import lexicon
from quire.llm.lexicon import CELLS, Side, Strengths, ranges
from quire.operators.skew import join_groups, without_groups
from quire.session import materialize, spread, task_count

#: Beads of a path (sentences of the original, of the translation) with their cost in a length alignment.
BEADS = {(1, 1): 0.0, (1, 0): 5.5, (0, 1): 5.5, (1, 2): 3.2, (2, 1): 3.2, (2, 2): 6.0}
#: Least gain a word must bring on average for a link, what a merge costs, and the least gain of a link off the path.
NEEDED, MERGE_COST, LOOSE_GAIN = 0.34, 0.12, 0.30
#: A word in more than this share of a document's sentences, and in more than three, tells nothing.
CROWD = 0.6
#: Documents with more sentences on a side are scored in tiles of TILE originals by TILE translations.
WINDOW, TILE = 400, 500
#: Where there are long documents, training goes on while its pairs grow in number by more than this.
GROWTH = 1.02
#: Pairs of tiles for a task, as long as that makes no more tasks than this.
TILES_PER_TASK, MOST_TASKS = 50, 20_000
#: What a second partner must add to the first one's gain, and the least gain it may have on its own.
ADDED, PARTNER_GAIN = 0.1, -0.3
#: Documents scored at once: so many pairs of sentences.
CELLS_AT_ONCE = 1_500_000
NOTHING = np.float32(-1e9)


def _chunks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Indices of documents of like sizes (n, m), as many as are handled at once."""
    order = sorted(range(len(sizes)), key=lambda d: sizes[d])
    chunk: list[int] = []
    wide = 0
    for d in order:
        n, m = sizes[d]
        if chunk and (sizes[chunk[-1]][0] + n + 2) * max(wide, m + 1) * (len(chunk) + 1) > CELLS_AT_ONCE:
            yield chunk
            chunk, wide = [], 0
        chunk.append(d)
        wide = max(wide, m + 1)
    if chunk:
        yield chunk


def length_paths(a: list[list[int]], b: list[list[int]], ratios: list[float]) -> list[list[tuple[int, int, int, int, float]]]:
    """For each document the beads (i, di, j, dj, cost) of its cheapest path by length; a ratio is translation length over original length."""
    out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in a]
    for chunk in _chunks([(len(x), len(y)) for x, y in zip(a, b)]):
        n, m, k = max(len(a[d]) for d in chunk), max(len(b[d]) for d in chunk), len(chunk)
        ca, cb = np.zeros((n + 1, k), np.float32), np.zeros((m + 1, k), np.float32)
        for c, d in enumerate(chunk):
            ca[1 : len(a[d]) + 1, c], cb[1 : len(b[d]) + 1, c] = np.cumsum(a[d]), np.cumsum(b[d])
            ca[len(a[d]) + 1 :, c], cb[len(b[d]) + 1 :, c] = ca[len(a[d]), c], cb[len(b[d]), c]
        ratio = np.array([ratios[d] for d in chunk], np.float32)
        ca *= ratio
        beads = list(BEADS.items())
        steps = []
        for (di, dj), base in beads:
            step = np.full((n + 1, m + 1, k), base, np.float32)
            if di and dj:
                x, y = (ca[di:] - ca[:-di])[:, None, :], (cb[dj:] - cb[:-dj])[None, :, :]
                step[di:, dj:] += 0.5 * (x - y) ** 2 / (np.maximum((x + y) / 2, 1.0) * (1.0 + 0.25 * ratio))
            steps.append(step)
        cost = np.full((n + 1, m + 1, k), np.inf, np.float32)
        move = np.zeros((n + 1, m + 1, k), np.int8)
        cost[0, 0] = 0.0
        ways = np.empty((len(beads), k), np.float32)
        for i in range(n + 1):
            for j in range(m + 1):
                if not i and not j:
                    continue
                for w, ((di, dj), _) in enumerate(beads):
                    ways[w] = cost[i - di, j - dj] + steps[w][i, j] if i >= di and j >= dj else np.inf
                best = ways.argmin(axis=0)
                move[i, j], cost[i, j] = best, ways[best, np.arange(k)]
        for c, d in enumerate(chunk):
            i, j = len(a[d]), len(b[d])
            way = move[: i + 1, : j + 1, c].tolist()
            path = []
            while i or j:
                (di, dj), _ = beads[way[i][j]]
                path.append((i - di, di, j - dj, dj, float(steps[way[i][j]][i, j, c])))
                i, j = i - di, j - dj
            out[d] = path[::-1]
    return out


def sure_by_length(path: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int]]:
    """One-to-one beads of low cost whose neighbours are one-to-one as well."""
    one = [di == 1 and dj == 1 and c < 2.0 for _, di, _, dj, c in path]
    return [(b[0], b[2]) for k, b in enumerate(path) if one[k] and (k == 0 or one[k - 1]) and (k + 1 == len(path) or one[k + 1])]


class _Tokens:
    """Words of one side of some documents: document, sentence (over all documents), cell, and weight by rarity."""

    def __init__(self, sides: list[list[list[int]]], label: np.ndarray):
        counts = np.array([len(side) for side in sides])
        self.first = np.cumsum(counts) - counts
        self.sentences = int(counts.sum())
        words = np.array([len(ws) for side in sides for ws in side], dtype=np.int64)
        self.sent = np.repeat(np.arange(self.sentences), words)
        self.doc_of = np.repeat(np.arange(len(sides)), counts)
        self.doc = self.doc_of[self.sent]
        flat = [ws for side in sides for ws in side if len(ws)]
        self.cell = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
        self.crowded = np.zeros(len(self.cell), bool)
        self.label = label[self.doc]
        self.key = self.label * CELLS + self.cell


def _cover(own: _Tokens, other: _Tokens, lex: Side, weight: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, ...]:
    """(own sentence, other sentence, cover) and (own sentence, other sentence, common) of what both it and the next one cover.

    cover is the share of an own sentence's weight that the words of the other one render.
    """
    first, count = lex.rows(own.key)
    at, row = ranges(first, count)
    # A word with no known translation may stand as it is: numbers, codes, names.
    alone = np.nonzero(count == 0)[0]
    token = np.concatenate([at, alone])
    cell = np.concatenate([lex.other[row], own.cell[alone]])
    value = np.concatenate([lex.strength[row], np.ones(len(alone))])
    order = np.argsort(other.doc * CELLS + other.cell, kind="stable")
    order = order[~other.crowded[order]]
    places = (other.doc * CELLS + other.cell)[order]
    wanted = own.doc[token] * CELLS + cell
    low, high = np.searchsorted(places, wanted), np.searchsorted(places, wanted, side="right")
    use = (high > low) & (high - low <= crowd[own.doc[token]])
    token, value, low, high = token[use], value[use], low[use], high[use]
    at, place = ranges(low, high - low)
    token, value, there = token[at], value[at], other.sent[order][place]
    # The best counterpart of a word in each sentence.
    wide = other.sentences + 1
    key = token * wide + there
    order = np.argsort(key, kind="stable")
    key, starts = np.unique(key[order], return_index=True)
    value = np.maximum.reduceat(value[order], starts) if len(starts) else value
    token, there = key // wide, key % wide
    total = np.bincount(own.sent, weights=weight, minlength=own.sentences).astype(float)
    part = weight * np.divide(1.0, total, out=np.ones_like(total), where=total > 0)[own.sent]
    both = np.nonzero((token[1:] == token[:-1]) & (there[1:] == there[:-1] + 1) & (other.doc_of[there[1:]] == other.doc_of[there[:-1]]))[0] if len(token) > 1 else np.zeros(0, np.int64)
    common = np.minimum(value[both], value[both + 1]) * part[token[both]]
    return own.sent[token], there, value * part[token], own.sent[token[both]], there[both], common


class Scores:
    """Lexical scores of some documents of like sizes: arrays (original, translation, document).

    `crowded` are the cells of originals and of translations that are too frequent to tell anything, for parts of one document that is not at hand as a whole.
    """

    def __init__(self, s: list[list[list[int]]], t: list[list[list[int]]], pairs: list[str], lex: Strengths, crowded: tuple[np.ndarray, np.ndarray] | None = None):
        label = np.array([lex.names.get(p, len(lex.names)) for p in pairs], dtype=np.int64)
        a, b = _Tokens(s, label), _Tokens(t, label)
        top = lex.top[label]
        ws, _ = lex.forward.weights(a.key, top[a.doc])
        wt, known = lex.backward.weights(b.key, top[b.doc])
        # Pieces of two characters that mean nothing on their own have no translation and weigh little.
        wt = wt * np.where((lex.backward.rows(b.key)[1] > 0) | ~known, 1.0, 0.15)
        n, m, k = max(map(len, s)), max(map(len, t)), len(s)
        if crowded:
            a.crowded, b.crowded = np.isin(a.cell, crowded[0]), np.isin(b.cell, crowded[1])
        crowd = lambda sides: np.maximum(3.0, CROWD * np.array([len(x) for x in sides])) if crowded is None else np.full(len(sides), np.inf)
        i, j, v, i2, j2, c = _cover(a, b, lex.forward, ws, crowd(t))
        at = lambda i, j: ((i - a.first[a.doc_of[i]]) * m + (j - b.first[b.doc_of[j]])) * k + a.doc_of[i]
        dense = lambda i, j, v: np.bincount(at(i, j), weights=v, minlength=n * m * k).reshape(n, m, k).astype(np.float32)
        self.s, self.s_common = dense(i, j, v), dense(i2, j2, c)
        self.hit = dense(i, j, np.ones(len(i))) > 0
        j, i, v, j2, i2, c = _cover(b, a, lex.backward, wt, crowd(s))
        self.t, self.t_common = dense(i, j, v), dense(i2, j2, c)
        self.hit |= dense(i, j, np.ones(len(i))) > 0
        self.one = np.where(self.hit, self.s + self.t - 2 * NEEDED, np.float32(-1.0))
        #: Gain of two originals rendered by one, at the second original; of one by two, at the second translation.
        self.two_one, self.one_two = np.full((n, m, k), NOTHING), np.full((n, m, k), NOTHING)
        self.two_one[1:] = self.s[1:] + self.s[:-1] + self.t[1:] + self.t[:-1] - self.t_common[:-1] - 3 * NEEDED - MERGE_COST
        self.one_two[:, 1:] = self.t[:, 1:] + self.t[:, :-1] + self.s[:, 1:] + self.s[:, :-1] - self.s_common[:, :-1] - 3 * NEEDED - MERGE_COST


def _moves(sc: Scores) -> np.ndarray:
    """The best way into each pair of prefixes: 1 leaves an original alone, 2 a translation, 3 links, 4 links two originals, 5 two translations."""
    n, m, k = sc.one.shape
    one = np.where(sc.one > 0, sc.one, NOTHING)
    two_one, one_two = np.where(sc.two_one > 0, sc.two_one, NOTHING), np.where(sc.one_two > 0, sc.one_two, NOTHING)
    two_one[1:][~(sc.hit[1:] & sc.hit[:-1])] = NOTHING
    one_two[:, 1:][~(sc.hit[:, 1:] & sc.hit[:, :-1])] = NOTHING
    best = np.zeros((n + 1, m + 1, k), np.float32)
    move = np.zeros((n + 1, m + 1, k), np.int8)
    move[1:, 0], move[0, 1:] = 1, 2
    ways = np.empty((5, k), np.float32)
    docs = np.arange(k)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways[0], ways[1] = best[i - 1, j], best[i, j - 1]
            ways[2] = best[i - 1, j - 1] + one[i - 1, j - 1]
            ways[3] = best[i - 2, j - 1] + two_one[i - 1, j - 1] if i > 1 else NOTHING
            ways[4] = best[i - 1, j - 2] + one_two[i - 1, j - 1] if j > 1 else NOTHING
            how = ways.argmax(axis=0)
            move[i, j], best[i, j] = how + 1, ways[how, docs]
    return move


def _links_of(move: list[list[int]], one: np.ndarray, two_one: np.ndarray, one_two: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, float]]:
    """Links (i, j, gain) of one document from its path, and of what that leaves alone."""
    n, m = one.shape
    out: list[tuple[int, int, float]] = []
    i, j = n, m
    while i or j:
        how = move[i][j]
        if how == 3:
            out.append((i - 1, j - 1, float(one[i - 1, j - 1])))
        elif how == 4:
            g = float(two_one[i - 1, j - 1])
            out += [(i - 2, j - 1, g), (i - 1, j - 1, g)]
        elif how == 5:
            g = float(one_two[i - 1, j - 1])
            out += [(i - 1, j - 2, g), (i - 1, j - 1, g)]
        i, j = i - (how != 2) - (how == 4), j - (how != 1) - (how == 5)
    # Reordered sentences: both alone on the path, the best scores first.
    used_i, used_j = {a for a, _, _ in out}, {b for _, b, _ in out}
    if len(used_i) == n and len(used_j) == m:
        return sorted(out)
    free_i, free_j = np.ones(n, bool), np.ones(m, bool)
    free_i[list(used_i)], free_j[list(used_j)] = False, False
    loose = sorted(((float(one[i, j]), int(i), int(j)) for i, j in zip(*np.nonzero((one > LOOSE_GAIN) & free_i[:, None] & free_j[None, :]))), key=lambda x: (-x[0], x[1], x[2]))
    for g, i, j in loose:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j, g))
    # One of two moved sentences that were merged: a second partner next to the first, if it adds what the first lacks.
    linked = {(i, j) for i, j, _ in out}
    for i in range(n):
        for j in np.nonzero(hit[i])[0].tolist() if i not in used_i else ():
            if any((k, j) in linked and two_one[max(i, k), j] > max(0.0, float(one[k, j])) + ADDED for k in (i - 1, i + 1)) and one[i, j] > PARTNER_GAIN:
                out.append((i, j, float(one[i, j])))
                linked.add((i, j))
                used_i.add(i)
                break
    for j in range(m):
        for i in np.nonzero(hit[:, j])[0].tolist() if j not in used_j else ():
            if any((i, k) in linked and one_two[i, max(j, k)] > max(0.0, float(one[i, k])) + ADDED for k in (j - 1, j + 1)) and one[i, j] > PARTNER_GAIN:
                out.append((i, j, float(one[i, j])))
                linked.add((i, j))
                used_j.add(j)
                break
    return sorted(out)


def lexical_links(s: list[list[list[int]]], t: list[list[list[int]]], pairs: list[str], lex: Strengths) -> list[list[tuple[int, int, float]]]:
    """For each document (cells of its originals and translations) its links (i, j, gain): by dynamic programming and, for what that leaves, by score alone."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in s]
    both = [d for d in range(len(s)) if s[d] and t[d]]
    for chunk in _chunks([(len(s[d]), len(t[d])) for d in both]):
        docs = [both[c] for c in chunk]
        sc = Scores([s[d] for d in docs], [t[d] for d in docs], [pairs[d] for d in docs], lex)
        move = _moves(sc)
        for c, d in enumerate(docs):
            n, m = len(s[d]), len(t[d])
            out[d] = _links_of(move[: n + 1, : m + 1, c].tolist(), *(x[:n, :m, c] for x in (sc.one, sc.two_one, sc.one_two, sc.hit)))
    return out


def _sides(lines: DataFrame) -> DataFrame:
    """(doc_id, pair, side, seq, text): every sentence that is not blank."""
    side = F.struct(F.lit(0).alias("side"), "seq", F.col("original").alias("text")), F.struct(F.lit(1).alias("side"), "seq", F.col("translation").alias("text"))
    doc = F.coalesce("doc_id", F.lit(NONE).cast("bigint")).alias("doc_id")
    rows = lines.select(doc, F.concat_ws("-", "source_lang", "target_lang").alias("pair"), F.explode(F.array(*side)).alias("r")).select("doc_id", "pair", "r.*")
    return rows.filter(F.col("text").rlike(r"\S") & F.col("seq").isNotNull())


#: Stands for a null doc_id while documents are put together.
NONE = -(2**63)
SENTENCE = "doc_id bigint, pair string, side int, seq int, cells array<int>, length int"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["doc_id", "pair", "side", "seq"]].assign(cells=[lexicon.cells(x) for x in pdf["text"]], length=pdf["text"].str.len().astype("int32"))


def _together(rows: DataFrame) -> DataFrame:
    """Sentences (doc_id, part, pair, side, seq, cells, length) as documents or blocks of them, both sides in order; those with an empty side are left out."""
    side = lambda k: F.array_sort(F.filter("all", lambda x: x["side"] == k))
    grouped = rows.groupBy("doc_id", "part").agg(F.max("pair").alias("pair"), F.collect_list(F.struct("side", "seq", "cells", "length")).alias("all"))
    grouped = grouped.select("doc_id", "part", "pair", side(0).alias("a"), side(1).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    return grouped.select("doc_id", "part", "pair", F.col("a.seq").alias("so"), F.col("b.seq").alias("st"), F.col("a.cells").alias("s"), F.col("b.cells").alias("t"), F.col("a.length").alias("lo"), F.col("b.length").alias("lt"))


def _by_proportion(long: DataFrame) -> DataFrame:
    """Long documents in parts: each translation where it would be if both sides ran alike. Good enough for pairs to train on."""
    at = F.when(F.col("side") == 0, F.col("pos").cast("double")).otherwise(F.col("pos") * F.col("no") / F.col("nt"))
    return _together(long.withColumn("part", F.floor(at / WINDOW)).select("doc_id", "part", "pair", "side", "seq", "cells", "length"))


def _tiles(long: DataFrame) -> DataFrame:
    """(doc_id, pair, a, b, s, t, ca, cb): every TILE originals of a document with every TILE of its translations, both led by the sentence before, and the cells in more than CROWD of a side's sentences."""
    own = F.when(F.col("side") == 0, F.col("no")).otherwise(F.col("nt"))
    tile = F.floor(F.col("pos") / TILE)
    within = F.filter(F.array(tile, F.floor((F.col("pos") + 1) / TILE)), lambda k: k * TILE < own)
    tiles = materialize(long.select("doc_id", "side", F.explode(F.array_distinct(within)).alias("tile"), "pos", "cells").groupBy("doc_id", "side", "tile").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("x")))
    counted = long.select("doc_id", "side", own.alias("own"), F.explode("cells").alias("cell")).groupBy("doc_id", "side", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("own").alias("own"))
    # Fewer cells than a sentence has words on average, over CROWD.
    crowded = counted.filter(F.col("n") > F.greatest(F.lit(3.0), CROWD * F.col("own"))).groupBy("doc_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("cell")))).alias(c) for k, c in ((0, "ca"), (1, "cb"))))
    docs = materialize(long.groupBy("doc_id").agg(F.max("pair").alias("pair"), F.max("no").alias("no"), F.max("nt").alias("nt")).join(crowded, "doc_id", "left"))
    last = lambda n: F.floor((F.col(n) - 1) / TILE)
    pairs = docs.withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), last("no")))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), last("nt"))))
    side = lambda k, tile, c: tiles.filter(F.col("side") == k).select("doc_id", F.col("tile").alias(tile), F.col("x.cells").alias(c))
    number = docs.agg(F.sum((last("no") + 1) * (last("nt") + 1))).first()[0] or 0
    joined = pairs.join(side(0, "a", "s"), ["doc_id", "a"]).join(side(1, "b", "t"), ["doc_id", "b"]).select("doc_id", "pair", "a", "b", "s", "t", "ca", "cb")
    return joined.repartition(max(task_count(long.sparkSession), min(number // TILES_PER_TASK, MOST_TASKS)))


#: One pair of sentences of a long document: its gains, and those of the original before with the translation (up) and of the original with the translation before (left).
PLACE = "doc_id bigint, i int, j int, one float, two_one float, one_two float, up float, left float"


def _places(sc: Scores, skip_i: int, skip_j: int) -> tuple[np.ndarray, ...]:
    """(i, j, one, two_one, one_two, up, left) of all pairs of one document, but for the first skip_i originals and skip_j translations, that can be part of a link: those that gain, alone or merged, and those that can be a second partner."""
    one, hit = sc.one[:, :, 0], sc.hit[:, :, 0]
    up, left = np.full_like(one, NOTHING), np.full_like(one, NOTHING)
    up[1:], left[:, 1:] = one[:-1], one[:, :-1]
    both_i, both_j = np.zeros_like(hit), np.zeros_like(hit)
    both_i[1:], both_j[:, 1:] = hit[1:] & hit[:-1], hit[:, 1:] & hit[:, :-1]
    two_one, one_two = np.where(both_i, sc.two_one[:, :, 0], NOTHING), np.where(both_j, sc.one_two[:, :, 0], NOTHING)
    use = one > 0
    for merged, before in ((two_one, up), (one_two, left)):
        first, second = np.maximum(before, 0), np.maximum(one, 0)
        use |= (merged > np.maximum(first, second)) | ((merged > first + ADDED) & (one > PARTNER_GAIN)) | ((merged > second + ADDED) & (before > PARTNER_GAIN))
    use[:skip_i], use[:, :skip_j] = False, False
    i, j = np.nonzero(use)
    return i - skip_i, j - skip_j, *(x[i, j] for x in (one, two_one, one_two, up, left))


def _scored(tiles: DataFrame, lex) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                cells = lambda c: np.zeros(0, np.int64) if c is None else np.asarray(c, np.int64)
                sc = Scores([list(r.s)], [list(r.t)], [r.pair], lex.value, (cells(r.ca), cells(r.cb)))
                i, j, *gains = _places(sc, int(r.a > 0), int(r.b > 0))
                yield pd.DataFrame({"doc_id": r.doc_id, "i": i + r.a * TILE, "j": j + r.b * TILE, **dict(zip(("one", "two_one", "one_two", "up", "left"), gains))})

    return tiles.mapInPandas(run, PLACE)


def path_of(i: np.ndarray, j: np.ndarray, one: np.ndarray, two_one: np.ndarray, one_two: np.ndarray) -> list[tuple[int, int, int]]:
    """The path that _moves finds, from the pairs that gain alone, by i and j: (place, originals, translations) of its links, the last first."""
    m = int(j.max()) + 1
    starts = np.searchsorted(i, np.arange(int(i.max()) + 2))
    # The best gain of the prefixes of the last two rows, and the link that each ends with.
    value, owner = np.zeros(m + 1, np.float32), np.full(m + 1, -1)
    value_before, owner_before = value, owner
    links: list[np.ndarray] = []
    known = 0
    columns = np.arange(m + 1)
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if low == high:
            value_before, owner_before = value, owner
            continue
        at, c = np.arange(low, high), j[low:high]
        ways = np.full((3, high - low), NOTHING)
        for w, (gain, best) in enumerate(((one, value[c]), (two_one, value_before[c]), (one_two, value[np.maximum(c - 1, 0)]))):
            ways[w] = np.where(gain[low:high] > 0, best + gain[low:high], NOTHING)
        how = ways.argmax(axis=0)
        gain = ways[how, at - low]
        better = gain > value[c + 1]
        c, how, at, gain = c[better], how[better], at[better], gain[better]
        previous = np.where(how == 0, owner[c], np.where(how == 1, owner_before[c], owner[np.maximum(c - 1, 0)]))
        links.append(np.stack([at, how, previous], axis=1))
        here, mine = value.copy(), owner.copy()
        here[c + 1], mine[c + 1] = gain, known + np.arange(len(c))
        known += len(c)
        linked = np.zeros(m + 1, bool)
        linked[c + 1] = True
        most = np.maximum.accumulate(here)
        # Of equal ways the one that leaves the original alone comes first, then the one that leaves the translation.
        own = np.ones(m + 1, bool)
        own[1:] = (here[1:] > most[:-1]) | ((here[1:] == most[:-1]) & ~linked[1:])
        value_before, owner_before = value, owner
        value, owner = most, mine[np.maximum.accumulate(np.where(own, columns, 0))]
    table = np.concatenate(links) if links else np.zeros((0, 3), np.int64)
    out, k = [], int(owner[m])
    while k >= 0:
        at, how, k = table[k].tolist()
        out.append((at, 2 if how == 1 else 1, 2 if how == 2 else 1))
    return out


def place_links(i: np.ndarray, j: np.ndarray, one: np.ndarray, two_one: np.ndarray, one_two: np.ndarray, up: np.ndarray, left: np.ndarray) -> list[tuple[int, int, float]]:
    """The links that _links_of finds, from the places of _places alone."""
    order = np.lexsort((j, i))
    i, j, one, two_one, one_two, up, left = (x[order] for x in (i, j, one, two_one, one_two, up, left))
    out: list[tuple[int, int, float]] = []
    for at, di, dj in path_of(i, j, one, two_one, one_two):
        a, b, g = int(i[at]), int(j[at]), float((two_one if di == 2 else one_two if dj == 2 else one)[at])
        out += [(a - 1, b, g)] * (di == 2) + [(a, b - 1, g)] * (dj == 2) + [(a, b, g)]
    free_i, free_j = np.ones(int(i.max()) + 1, bool), np.ones(int(j.max()) + 1, bool)
    free_i[[a for a, _, _ in out]], free_j[[b for _, b, _ in out]] = False, False
    loose = np.nonzero((one > LOOSE_GAIN) & free_i[i] & free_j[j])[0]
    for at in loose[np.lexsort((j[loose], i[loose], -one[loose]))].tolist():
        a, b = int(i[at]), int(j[at])
        if free_i[a] and free_j[b]:
            free_i[a], free_j[b] = False, False
            out.append((a, b, float(one[at])))
    linked = {(a, b) for a, b, _ in out}
    for own, other, merged, before, free, turned in ((i, j, two_one, up, free_i, False), (j, i, one_two, left, free_j, True)):
        # (sentence, counterpart, neighbour, own gain) of all that may be a second partner: both sentences of a merge, beside each other.
        later = (merged > np.maximum(before, 0) + ADDED) & (one > PARTNER_GAIN) & free[own]
        earlier = (merged > np.maximum(one, 0) + ADDED) & (before > PARTNER_GAIN) & free[np.maximum(own - 1, 0)]
        sentence, counterpart = np.concatenate([own[later], own[earlier] - 1]), np.concatenate([other[later], other[earlier]])
        neighbour, gain = np.concatenate([own[later] - 1, own[earlier]]), np.concatenate([one[later], before[earlier]])
        for at in np.lexsort((neighbour, counterpart, sentence)).tolist():
            a, b, k = int(sentence[at]), int(counterpart[at]), int(neighbour[at])
            if free[a] and ((b, k) if turned else (k, b)) in linked:
                free[a] = False
                link = (b, a) if turned else (a, b)
                linked.add(link)
                out.append((*link, float(gain[at])))
    return sorted(out)


def _whole(long: DataFrame, tiles: DataFrame, lex) -> DataFrame:
    """(doc_id, i, j, gain, alone): links of long documents by place; `alone` if neither sentence has another."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = place_links(*(pdf[c].to_numpy() for c in ("i", "j", "one", "two_one", "one_two", "up", "left")))
        many_i, many_j = Counter(i for i, _, _ in found), Counter(j for _, j, _ in found)
        out = [(pdf["doc_id"].iloc[0], i, j, g, many_i[i] == 1 and many_j[j] == 1) for i, j, g in found]
        return pd.DataFrame(out, columns=["doc_id", "i", "j", "gain", "alone"])

    links = materialize(_scored(tiles, lex).groupBy("doc_id").applyInPandas(run, "doc_id bigint, i int, j int, gain double, alone boolean"))
    side = lambda k, pos, *c: long.filter(F.col("side") == k).select("doc_id", F.col("pos").alias(pos), *(F.col(x).alias(y) for x, y in c))
    return links.join(side(0, "i", ("seq", "original_seq"), ("cells", "s"), ("pair", "pair")), ["doc_id", "i"]).join(side(1, "j", ("seq", "translation_seq"), ("cells", "t")), ["doc_id", "j"])


def _by_length(docs: DataFrame, ratios: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = length_paths(list(pdf["lo"]), list(pdf["lt"]), [ratios.get(p, 1.0) for p in pdf["pair"]])
            out = [(p, s[i], t[j]) for p, s, t, path in zip(pdf["pair"], pdf["s"], pdf["t"], paths) for i, j in sure_by_length(path)]
            yield pd.DataFrame(out, columns=["pair", "s", "t"])

    return docs.mapInPandas(run, lexicon.PAIR_SCHEMA)


LINK = "doc_id bigint, original_seq int, translation_seq int, gain double"


def _by_words(docs: DataFrame, lex, pairs_only: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            links = lexical_links([list(x) for x in pdf["s"]], [list(x) for x in pdf["t"]], list(pdf["pair"]), lex.value)
            for doc, pair, so, st, s, t, found in zip(pdf["doc_id"], pdf["pair"], pdf["so"], pdf["st"], pdf["s"], pdf["t"], links):
                if pairs_only:
                    many_i, many_j = Counter(i for i, _, _ in found), Counter(j for _, j, _ in found)
                    out += [(pair, s[i], t[j]) for i, j, g in found if g > LOOSE_GAIN and many_i[i] == 1 and many_j[j] == 1]
                else:
                    out += [(doc, int(so[i]), int(st[j]), float(g)) for i, j, g in found]
            yield pd.DataFrame(out, columns=["pair", "s", "t"] if pairs_only else ["doc_id", "original_seq", "translation_seq", "gain"])

    return docs.mapInPandas(run, lexicon.PAIR_SCHEMA if pairs_only else LINK)


def align(lines: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, original_seq, translation_seq, gain): all links of all documents.

    `lines` has one row per (doc_id, seq) with original, translation and the two
    languages. Rows without a doc_id are one document. Null and blank sentences, and those without a seq, have no links; documents with an empty
    side give none; an empty table gives none. Documents of more than `window` sentences on a side are scored in tiles, which changes no link.
    """
    spark = lines.sparkSession
    rows = materialize(spread(_sides(lines)).mapInPandas(_cut, SENTENCE))
    sizes = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("pair").alias("_pair"),
        F.count_if(F.col("side") == 0).alias("_no"),
        F.count_if(F.col("side") == 1).alias("_nt"),
    )
    sizes = materialize(sizes.filter((F.col("_no") > window) | (F.col("_nt") > window)))
    total = sizes.agg(F.sum("_rows")).first()[0]
    whole = F.lit(0).cast("bigint").alias("part")
    short = without_groups(rows, sizes, "doc_id", "_rows", total) if total else rows
    docs = materialize(spread(_together(short.select("doc_id", whole, "pair", "side", "seq", "cells", "length"))))
    first_docs, long = docs, None
    if total:
        place = F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("seq", "cells", "length")) - 1
        long = join_groups(rows, sizes.filter("_no > 0 AND _nt > 0"), "doc_id", "_rows", total).withColumn("pos", place)
        long = materialize(long.select("doc_id", F.col("_pair").alias("pair"), "side", "seq", "pos", "cells", "length", F.col("_no").alias("no"), F.col("_nt").alias("nt")))
        first_docs = docs.unionByName(_by_proportion(long))
    characters = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    ratios = {r["pair"]: r["b"] / max(1, r["a"]) for r in first_docs.groupBy("pair").agg(characters("lo").alias("a"), characters("lt").alias("b")).collect()}
    if not ratios:
        return docs.select("doc_id", F.lit(0).alias("original_seq"), F.lit(0).alias("translation_seq"), F.lit(0.0).alias("gain"))
    share = lambda lex: spark.sparkContext.broadcast(Strengths.of(lex))
    first = share(lexicon.train(_by_length(first_docs, ratios)))
    tiles = materialize(_tiles(long)) if total else None
    second, known, grown = first, 0, True
    while grown:
        pairs = _by_words(docs, second, True)
        if total:
            # Of long documents length alone gives few pairs that are right; each round finds more of them.
            pairs = materialize(pairs.unionByName(_whole(long, tiles, second).filter((F.col("gain") > LOOSE_GAIN) & F.col("alone")).select("pair", "s", "t")))
        second = share(lexicon.train(pairs, lasting=bool(total)))
        found = pairs.count() if total else 0
        grown, known = found > GROWTH * known, found
    links = _by_words(docs, second, False)
    if total:
        found = _whole(long, tiles, second).groupBy("doc_id", "original_seq", "translation_seq").agg(F.max("gain").alias("gain"))
        links = links.unionByName(found)
    return links.withColumn("doc_id", F.nullif("doc_id", F.lit(NONE).cast("bigint")))
