"""Word-translation probabilities by expectation-maximization over sentence pairs.

Words are hashed to a fixed number of cells for each language pair, and each cell
keeps its strongest candidates only, so the table that is handed to every task
has a size bound that does not depend on the corpus. Counting and every
expectation step run over all given pairs in parallel; only the table travels.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import fetch, materialize

#: Cells for the words of one language of a pair, and candidates kept for a cell.
CELLS, CANDIDATES = 1 << 18, 12
EM_ROUNDS = 3
#: Share of a language pair's sentences in which two words must stand together, their least Dice coefficient, and the least probability kept.
SHARE, DICE, LEAST = 1e-6, 0.02, 0.002
#: A counterpart of less than this share of the best one's probability does not count.
LESSER = 0.05

TOKEN = regex.compile(r"(\p{N}[\p{N}.,]*|\p{Lu}\p{N}+)|([\p{Script=Han}々〆]+)|([\p{Script=Hiragana}]+)|([\p{Script=Katakana}ー]+)|([\p{Script=Thai}]+)|([\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?)")
#: An elided article before a word, as in French.
ELIDED = regex.compile(r"^\p{L}['’](?=\p{L}{2})")


def words(text: str | None) -> list[str]:
    """Tokens of a sentence: words in lower case, numbers without their separators, pairs of neighbours in scripts without spaces."""
    if not text:
        return []
    out: list[str] = []
    for m in TOKEN.finditer(text):
        number, han, hira, kata, thai, word = m.groups()
        if number:
            out.append("#" + number.replace(",", "").replace(".", ""))
        elif han or thai:
            run = han or thai
            out += [run] if len(run) < 2 else [run[i : i + 2] for i in range(len(run) - 1)]
        elif hira:
            if len(hira) > 1:
                out.append(hira)
        elif kata:
            out.append(kata)
        else:
            out.append(ELIDED.sub("", word.lower()))
    return out


@functools.lru_cache(maxsize=200_000)
def cell(word: str) -> int:
    """Cell of a word."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CELLS


def cells(text: str | None) -> list[int]:
    """Distinct cells of a sentence's tokens, in order."""
    return list(dict.fromkeys(cell(w) for w in words(text)))


#: Rows of sentence pairs: pair string, s array<int>, t array<int>.
PAIR_SCHEMA = "pair string, s array<int>, t array<int>"

#: Word pairs handled at once, which bounds a task's memory.
AT_ONCE = 2_000_000


def ordered_cells(text: str | None) -> list[int]:
    """Cells of a text's tokens, in order and with repeats."""
    return [cell(w) for w in words(text)]


@dataclass
class Lexicon:
    """Word translations as sorted arrays.

    `keys` are (language pair, source cell, target cell) with both probabilities;
    weights by rarity belong to (language pair, cell) of each side.
    """

    names: dict[str, int]
    keys: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    source_keys: np.ndarray
    source_weight: np.ndarray
    target_keys: np.ndarray
    target_weight: np.ndarray


@dataclass
class Side:
    """Counterparts of the words of one language: rows of `other` cells with strengths, from `starts` to `ends` for each of the sorted `keys`; weights of words."""

    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    other: np.ndarray
    strength: np.ndarray
    weight_keys: np.ndarray
    weight: np.ndarray

    def rows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each wanted key."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return self.starts[at], np.where(hit, self.ends[at] - self.starts[at], 0)

    def weights(self, wanted: np.ndarray, default: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, whether known) of each wanted key."""
        if not len(self.weight_keys):
            return default, np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.weight_keys, wanted), len(self.weight_keys) - 1)
        hit = self.weight_keys[at] == wanted
        return np.where(hit, self.weight[at], default), hit


def _side(keys: np.ndarray, other: np.ndarray, p: np.ndarray, weight_keys: np.ndarray, weight: np.ndarray) -> Side:
    order = np.lexsort((other, keys))
    keys, other, p = keys[order], other[order], p[order]
    unique, starts = np.unique(keys, return_index=True)
    best = np.repeat(np.maximum.reduceat(p, starts), np.diff(np.append(starts, len(keys)))) if len(keys) else p
    keep = p > LESSER * best
    keys, other, value = keys[keep], other[keep], np.sqrt(p[keep] / best[keep])
    unique, starts = np.unique(keys, return_index=True)
    return Side(unique, starts, np.append(starts[1:], len(keys)), other, value, weight_keys, weight)


@dataclass
class Strengths:
    """A lexicon in which a word's best counterpart counts 1 and lesser ones the root of their share."""

    names: dict[str, int]
    top: np.ndarray
    forward: Side
    backward: Side

    @classmethod
    def of(cls, lex: Lexicon) -> Strengths:
        a, b, pair = lex.keys // CELLS, lex.keys % CELLS, lex.keys // (CELLS * CELLS)
        top = np.full(len(lex.names) + 1, 4.0)
        for keys, weight in ((lex.source_keys, lex.source_weight), (lex.target_keys, lex.target_weight)):
            np.maximum.at(top, keys // CELLS, weight)
        f, g = lex.forward > 0, lex.backward > 0
        return cls(
            lex.names,
            top,
            _side(a[f], b[f], lex.forward[f], lex.source_keys, lex.source_weight),
            _side(pair[g] * CELLS + b[g], a[g] % CELLS, lex.backward[g], lex.target_keys, lex.target_weight),
        )


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of the positions first..first+count-1 of each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return owner, np.arange(len(owner)) - np.repeat(ends - count, count) + np.repeat(first, count)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _expect(label: np.ndarray, s: list[np.ndarray], t: list[np.ndarray], lex: Lexicon | None) -> Counts:
    """(keys, f, g): expected counts of word pairs, forward and backward; without a lexicon plain co-occurrence."""
    ns, nt = np.array([len(x) for x in s], dtype=np.int64), np.array([len(x) for x in t], dtype=np.int64)
    # Every word of a sentence with every word of its partner: positions in the joined lists.
    row, at_s = ranges(np.cumsum(ns) - ns, ns)
    at, at_t = ranges((np.cumsum(nt) - nt)[row], nt[row])
    at_s = at_s[at]
    all_s = np.concatenate(s).astype(np.int64) if ns.sum() else np.zeros(0, np.int64)
    all_t = np.concatenate(t).astype(np.int64) if nt.sum() else np.zeros(0, np.int64)
    key = (label[row[at]] * CELLS + all_s[at_s]) * CELLS + all_t[at_t]
    if lex is None:
        found, n = np.unique(key, return_counts=True)
        return found, n.astype(float), np.zeros(len(found))
    if not len(lex.keys) or not len(key):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    at = np.minimum(np.searchsorted(lex.keys, key), len(lex.keys) - 1)
    hit = lex.keys[at] == key
    at, key, at_s, at_t = at[hit], key[hit], at_s[hit], at_t[hit]
    pf, pb = lex.forward[at], lex.backward[at]
    whole_t = np.bincount(at_t, weights=pf, minlength=len(all_t))
    whole_s = np.bincount(at_s, weights=pb, minlength=len(all_s))
    f = np.divide(pf, whole_t[at_t], out=np.zeros_like(pf), where=pf > 0)
    g = np.divide(pb, whole_s[at_s], out=np.zeros_like(pb), where=pb > 0)
    return _merged([(key, f, g)])


def _merged(parts: list[Counts]) -> Counts:
    """The counts of several parts in one."""
    keys = np.concatenate([k for k, _, _ in parts])
    found, back = np.unique(keys, return_inverse=True)
    f, g = (np.bincount(back, weights=np.concatenate([x[w] for x in parts]), minlength=len(found)) for w in (1, 2))
    return found, f, g


def expectations(labels: list[int], s: list, t: list, lex: Lexicon | None) -> Iterator[Counts]:
    """_expect over slices of bounded size."""
    first, load = 0, 0
    for i in range(len(labels)):
        load += len(s[i]) * len(t[i])
        if load > AT_ONCE or i + 1 == len(labels):
            yield _expect(np.array(labels[first : i + 1], dtype=np.int64), s[first : i + 1], t[first : i + 1], lex)
            first, load = i + 1, 0


def _step(pairs: DataFrame, names: dict[str, int], lex: Lexicon | None) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast((names, lex))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, got = shared.value
        kept: list[Counts] = []
        for pdf in batches:
            for part in expectations([known[p] for p in pdf["pair"]], list(pdf["s"]), list(pdf["t"]), got):
                kept.append(part)
                if sum(len(k) for k, _, _ in kept) > AT_ONCE:
                    # Counts of a task are summed up here as far as memory goes, so few rows leave it.
                    kept = [_merged(kept)]
                    if len(kept[0][0]) > AT_ONCE // 2:
                        yield _frame(kept.pop())
        if kept:
            yield _frame(_merged(kept))

    counted = pairs.mapInPandas(run, "key bigint, f double, g double").groupBy("key").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    cells = F.lit(CELLS).cast("bigint")
    whole = F.floor(F.col("key") / cells)
    return counted.select(F.floor(whole / cells).cast("int").alias("pair"), F.pmod(whole, cells).cast("int").alias("a"), F.pmod("key", cells).cast("int").alias("b"), "f", "g")


def _frame(counts: Counts) -> pd.DataFrame:
    return pd.DataFrame({"key": counts[0], "f": counts[1], "g": counts[2]})


def _shares(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values over their sum for each key."""
    _, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=values) if len(keys) else values
    return np.divide(values, total[back], out=np.zeros_like(values), where=values > 0) if len(keys) else values


def _settled(rows: pd.DataFrame) -> Counts:
    """(keys, forward, backward) of counts (pair, a, b, f, g), without what is hardly ever chosen."""
    pair, a, b = (rows[c].to_numpy(np.int64) for c in ("pair", "a", "b"))
    f, g = _shares(pair * CELLS + a, rows["f"].to_numpy(float)), _shares(pair * CELLS + b, rows["g"].to_numpy(float))
    keep = (f > LEAST) | (g > LEAST)
    keys = ((pair * CELLS + a) * CELLS + b)[keep]
    order = np.argsort(keys)
    return keys[order], f[keep][order], g[keep][order]


def train(pairs: DataFrame, rounds: int = EM_ROUNDS, lasting: bool = False) -> Lexicon:
    """Lexicon of sentence pairs (pair, s, t); `lasting` tells that they are checkpointed already.

    Candidates are the cells that go together most (Dice) of all co-occurring
    ones; expectation-maximization (both directions) then settles their
    probabilities. Every threshold is a share, so copies of the corpus change nothing. For
    a language pair the driver holds CELLS times CANDIDATES rows of each direction at most.
    No pairs give an empty lexicon.
    """
    pairs = pairs if lasting else materialize(pairs)
    sizes = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = {p: i for i, p in enumerate(sorted(sizes))}
    spark = pairs.sparkSession
    # One row for each language pair.
    known = F.broadcast(spark.createDataFrame([(p, i, sizes[p]) for p, i in names.items()], "pair string, _p int, _n bigint"))
    single = lambda side, cell, n: pairs.select("pair", F.explode(side).alias(cell)).join(known, "pair").groupBy(F.col("_p").alias("pair"), cell).agg(F.count(F.lit(1)).alias(n), F.first("_n").alias("_n"))
    single_s, single_t = single("s", "a", "na"), single("t", "b", "nb")
    weights = []
    for side, c, n in ((single_s, "a", "na"), (single_t, "b", "nb")):
        got = fetch(side)
        key = got["pair"].to_numpy(np.int64) * CELLS + got[c].to_numpy(np.int64)
        order = np.argsort(key)
        weights += [key[order], np.maximum(0.02, -np.log(got[n].to_numpy(float) / got["_n"].to_numpy(float)))[order]]
    together = _step(pairs, names, None).select("pair", "a", "b", F.col("f").alias("n"))
    scored = together.join(single_s, ["pair", "a"]).filter(F.col("n") >= SHARE * F.col("_n")).drop("_n").join(single_t.drop("_n"), ["pair", "b"])
    scored = scored.withColumn("dice", 2 * F.col("n") / (F.col("na") + F.col("nb"))).filter(F.col("dice") > DICE)
    by_s = Window.partitionBy("pair", "a").orderBy(F.desc("dice"), "b")
    by_t = Window.partitionBy("pair", "b").orderBy(F.desc("dice"), "a")
    kept = scored.withColumn("rs", F.row_number().over(by_s)).withColumn("rt", F.row_number().over(by_t))
    kept = kept.filter((F.col("rs") <= CANDIDATES) | (F.col("rt") <= CANDIDATES))
    lex = Lexicon(names, *_settled(fetch(kept.select("pair", "a", "b", F.col("dice").alias("f"), F.col("dice").alias("g")))), *weights)
    for _ in range(rounds):
        lex.keys, lex.forward, lex.backward = _settled(fetch(_step(pairs, names, lex)))
    return lex


def renderings(lex: Lexicon) -> Side:
    """The translations of each source word with their probabilities."""
    use = lex.forward > 0
    keys, other, p = lex.keys[use] // CELLS, lex.keys[use] % CELLS, lex.forward[use]
    unique, starts = np.unique(keys, return_index=True)
    return Side(unique, starts, np.append(starts[1:], len(keys)), other, p, lex.source_keys, lex.source_weight)
