"""Sentence boundaries by a hidden-event language model.

Method: between words the text may hold a hidden event, the sentence boundary.
The model is a bigram model with that event: how often a word ends a sentence,
which words begin one, and which words follow a given word inside one. Its counts
come from all texts: word pairs around each possible place are counted over
hashed words, certain events (text starts, empty lines) give the first
estimate of sentence starts, and expectation-maximization over the
counted pairs settles the rest. The table that reaches the driver is bounded: pairs
beyond it are counted in coarser cells. In a text, forward-backward over the
possible places gives each one's posterior; places with at least one half
are boundaries.

Possible places are sentence marks of any script with what closes after them
and, in scripts without such marks (Thai), blanks. An empty line is always a
boundary. Inside an open quotation there is none, so a quotation stays with its
reporting clause.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import fetch, materialize, task_count

#: Cells of the hashed model: words before a place, words after it.
PREVIOUS, NEXT = 1 << 16, 1 << 16
#: Distinct events trained on the driver at most, and those of a task where there are more.
MAX_PAIRS = 500_000
ROUNDS = 12
#: Events that all counts are scaled to.
NOMINAL = 2e5
#: Distinct events a task holds before it hands them on.
AT_ONCE = 500_000
#: Share of a word's own followers in what may follow it inside a sentence; the rest is what follows any word there.
OWN = 0.3
#: Words of so many letters are hardly ever abbreviations.
LONG = 5
#: A word needs to be seen inside sentences more often than this before its own followers count.
ENOUGH = 5.0

#: Marks that may end a sentence.
FULL_MARKS = "。！？｡।॥؟۔！？։።፧"
MARKS = ".!?…" + FULL_MARKS
#: What may close after a mark and still belongs to the sentence.
CLOSERS = "\"'’”»›)]}）］】」』〉》〕﹂﹄"
OPENERS = "\"'‘“„«‹([{（［【「『〈《〔¿¡"
#: Opening quotation marks with what closes them.
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "《": "》"}

SPACE = r"[\s​﻿]"
EMPTY_LINE = regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
PLACE = regex.compile(r"(?:\.{2,}|[" + regex.escape(MARKS) + r"]+)[" + regex.escape(CLOSERS) + r"]*(?:\p{Zs}[»”])?")
WORD_AFTER = regex.compile(r"\s*([" + regex.escape(OPENERS) + r"]*)\s*(\p{N}+[.,:)\p{N}]*|[\p{L}\p{M}]+[.]?|[^\s\p{L}\p{N}]|\p{N})?")
#: A numbering or bullet, which belongs to what follows.
INSIDE = regex.compile(r"[\p{L}\p{N}][,;]\s+(\p{N}+[.,:)\p{N}]*|[\p{L}\p{M}]+[.]?)|^\s*[\p{L}\p{M}]+\s+([\p{L}\p{M}]+)")
NUMBERING = regex.compile(r"^[\s" + regex.escape(OPENERS) + r"]*(?:[(（]?(?:\p{N}{1,3}|\p{Lu}|\p{Ll}|[IVXLC]{1,6}|[ivxlc]{1,5})[.)）]|[•‣▪●○◦\-–—*§·#]|\p{N}{1,3}(?:\.\p{N}{1,3})*[.)]?)\s*$")
NUMBERED = regex.compile(r"(?:[(（](?:\p{N}{1,3}|\p{L}|[IVXLCivxlc]{1,6})[)）]|(?:\p{N}{1,3}|[IVXLC]{1,6})[.)]|\p{Ll}\)|[•‣▪●○◦–—*§·\-])(?=\s|$)")
THAI = regex.compile(r"\p{Script=Thai}")
THAI_START = regex.compile(r"\p{Script=Thai}.{0,2}")
THAI_BLANK = regex.compile(r"(?<=\S)\s+(?=\S)")
ALNUM = regex.compile(r"[\p{L}\p{N}]")
#: A clause after a closed quotation that reports it, in scripts without spaces.
REPORTS = regex.compile(r"^\s*[とと、，,]")


#: Scripts whose words are counted apart: what begins a sentence compares only with words of the same writing.
SCRIPTS = ("Latin", "Cyrillic", "Arabic", "Devanagari", "Thai", "Han", "Other")
_SCRIPT = [(s, regex.compile(p)) for s, p in zip(SCRIPTS, (r"\p{Script=Latin}", r"\p{Script=Cyrillic}", r"\p{Script=Arabic}", r"\p{Script=Devanagari}", r"\p{Script=Thai}", r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}]"))]


@functools.lru_cache(maxsize=100_000)
def _script_of(c: str) -> int:
    return next((i for i, (_, rx) in enumerate(_SCRIPT) if rx.match(c)), len(SCRIPTS) - 1)


def main_script(text: str) -> int:
    """Index of the script most of the text's letters are of (Other without letters); ties go to the first named."""
    if text.isascii():
        return 0
    counts = [0] * len(SCRIPTS)
    for c, n in Counter(text).items():
        counts[_script_of(c)] += n
    best = max(range(len(SCRIPTS) - 1), key=lambda i: counts[i])
    return best if counts[best] else len(SCRIPTS) - 1


@functools.lru_cache(maxsize=200_000)
def _cell(word: str, size: int) -> int:
    """Cell of a word; numbers share one, whatever their digits; a dot after a long word is not part of it."""
    if len(word) > 5 and word[-1] == ".":
        word = word[:-1]
    if word[:1].isdigit():
        word = "<0.>" if word[-1] in ".)" else "<0>"
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def _shape(word: str) -> str:
    """Class of a word: what is known of it when it was never seen."""
    if not word:
        return "none"
    c = word[0]
    if c.isdigit():
        return "item" if word[-1] in ".)" else "digit"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        return "lower"
    if c.isalpha():
        return "letter"
    return "mark"


SHAPES = ("none", "item", "digit", "upper", "lower", "letter", "mark")
SHAPE_AT = {s: i for i, s in enumerate(SHAPES)}


#: What stands for a mark in the model where the mark, not the word before it, tells whether a sentence ends.
MARK_WORDS = {"full": "<full>", "!": "<exclaim>", "?": "<question>", "blank": "<blank>"}


def _loud(text: str, p: Place) -> str | None:
    """The word of the model that stands for an exclamation or question mark at a place; None if there is none."""
    marks = text[max(0, p.end - 3) : p.end]
    return MARK_WORDS["?"] if "?" in marks else MARK_WORDS["!"] if "!" in marks else None


@dataclass(slots=True)
class Place:
    """A possible boundary: `end` is where the sentence would end, `after` the first character of the next."""

    end: int
    after: int
    before: str
    next: str
    kind: str  # full: mark of a script without other use; mark; dots; blank; line
    glued: bool
    opens: bool
    second: str = ""  # the word after a numbering or bullet


@functools.lru_cache(maxsize=100_000)
def _kind_of(c: str) -> str:
    """L for letters and marks, N for numbers, S for white space, else O."""
    k = unicodedata.category(c)[0]
    return "L" if k in "LM" else "N" if k == "N" else "S" if c.isspace() else "O"


def _word_before(text: str, at: int) -> str:
    """The word (of 24 letters at most), number or mark right before a place."""
    if not at:
        return ""
    kind = _kind_of(text[at - 1])
    if kind == "S":
        return ""
    first, least = at - 1, max(0, at - (24 if kind == "L" else 25 if kind == "N" else 1))
    while first > least and _kind_of(text[first - 1]) == kind:
        first -= 1
    return text[first:at]


def places(text: str) -> list[Place]:
    """Possible boundaries of a text, in order; none of them inside an open quotation."""
    spans: list[tuple[int, int, str]] = [(m.start(), m.end(), "line") for m in EMPTY_LINE.finditer(text)]
    for m in PLACE.finditer(text):
        mark = m[0][0]
        kind = "full" if any(c in FULL_MARKS for c in m[0]) else "dots" if m[0].startswith("..") or mark == "…" else "mark"
        spans.append((m.start(), m.end(), kind))
    if THAI.search(text):
        spans += [(m.start(), m.start(), "blank") for m in THAI_BLANK.finditer(text)]
    spans.sort()
    lines = [(s, e) for s, e, k in spans if k == "line"]
    line = 0
    quoted = _quoted(text) if any(q in text for q in '"“„«「『《') else []
    out: list[Place] = []
    q = 0
    size = len(text)
    for start, end, kind in spans:
        while line < len(lines) and lines[line][1] <= start:
            line += 1
        if kind == "blank" and line < len(lines) and lines[line][0] < start:
            continue
        while q < len(quoted) and quoted[q][1] < end:
            q += 1
        if q < len(quoted) and quoted[q][1] == end < size and kind not in ("line", "blank"):
            # The mark that closes this quotation may open others.
            end += 1
        inside = q < len(quoted) and quoted[q][0] < start and end <= quoted[q][1]
        if kind == "line":
            if end < size:
                out.append(Place(start, end, "", "", "line", False, False))
            continue
        if inside:
            continue
        m = WORD_AFTER.match(text, end)
        after = end
        while after < size and text[after].isspace():
            after += 1
        if after >= size:
            continue
        if kind == "blank":
            left, right = text[start - 1], text[after]
            if not (THAI.match(left) or THAI.match(right)):
                # A blank of Latin text within Thai is a word space.
                if not (left in ".!?" or left in CLOSERS):
                    continue
            out.append(Place(start, after, left if left.isdigit() else _word_before(text, start)[-3:], right, "blank", False, False))
            continue
        second = ""
        if m[2] and NUMBERED.match(m[2]):
            more = WORD_AFTER.match(text, m.end())
            second = more[2] or "" if more else ""
        elif (numbered := NUMBERED.match(text, m.start(1))) and numbered.end() < size:
            more = WORD_AFTER.match(text, numbered.end())
            second = more[2] or "" if more else ""
        out.append(Place(end, after, _word_before(text, start), m[2] or "", kind, after == end, bool(m[1]), second))
    return out


#: Quotation marks of any kind.
QUOTE = regex.compile("[" + regex.escape("".join(sorted({'"', *QUOTES, *"".join(QUOTES.values())}))) + "]")


def _quoted(text: str) -> list[tuple[int, int]]:
    """Outermost quotations [start, end] that are closed within the same paragraph."""
    marks = [(m.start(), m[0]) for m in QUOTE.finditer(text)]
    breaks = [m.start() for m in EMPTY_LINE.finditer(text)] + [len(text)]
    out: list[tuple[int, int]] = []
    k, b = 0, 0
    while k < len(marks):
        i, c = marks[k]
        k += 1
        close = '"' if c == '"' else QUOTES.get(c)
        if close is None or c in "‘‚" and i and text[i - 1].isalpha():
            continue
        while breaks[b] < i:
            b += 1
        depth = 1
        for at in range(k, len(marks)):
            j, d = marks[at]
            if j >= breaks[b]:
                break
            if d in close:
                depth -= 1
                if not depth:
                    out.append((i, j))
                    k = at + 1
                    break
            elif d == c:
                depth += 1
    return out


#: Share of the places of a word before a mark that end a sentence, as far as nothing is known of the word; what stands for a mark alone is surer.
PRIOR = np.full(PREVIOUS, 0.85)
for _mark, _share in (("full", 0.9995), ("!", 0.99), ("?", 0.99), ("blank", 0.99)):
    PRIOR[_cell(MARK_WORDS[_mark], PREVIOUS)] = _share


@dataclass
class PairTable:
    """A read-only dictionary of word pairs in twelve bytes each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, prev: np.ndarray, next_: np.ndarray, values: np.ndarray) -> PairTable:
        keys = (prev.astype(np.uint32) * np.uint32(NEXT)) | next_.astype(np.uint32)
        order = np.argsort(keys)
        return cls(keys[order], values[order].astype(np.float64))

    def get(self, pair: tuple[int, int], default: float) -> float:
        key = np.uint32(pair[0] * NEXT + pair[1])
        i = int(np.searchsorted(self.keys, key))
        return float(self.values[i]) if i < len(self.keys) and self.keys[i] == key else default


@dataclass
class BoundaryModel:
    """Hashed counts of the hidden-event model after training."""

    ends: np.ndarray = field(default_factory=lambda: np.full(PREVIOUS, 0.85))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(PREVIOUS))
    start: np.ndarray = field(default_factory=lambda: np.full((len(SCRIPTS), NEXT), 1.0 / NEXT))
    start_shape: np.ndarray = field(default_factory=lambda: np.tile([0.02, 0.05, 0.01, 0.6, 0.002, 0.3, 0.018], (len(SCRIPTS), 1)))
    inner: dict[tuple[int, int], float] | PairTable = field(default_factory=dict)
    inner_total: dict[int, float] = field(default_factory=dict)
    inner_word: np.ndarray = field(default_factory=lambda: np.full((len(SCRIPTS), NEXT), 1.0 / NEXT))
    start_like: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS), NEXT)))
    inner_shape: np.ndarray = field(default_factory=lambda: np.tile([0.02, 0.03, 0.3, 0.15, 0.3, 0.15, 0.05], (len(SCRIPTS), 1)))

    def odds(self, before: str, after: str, script: int) -> float:
        """Log odds of a boundary between two words of a text."""
        p, n, s = _cell(before, PREVIOUS), _cell(after, NEXT), SHAPE_AT[_shape(after)]
        begin = 0.9 * self.start[script, n] + 0.1 * self.start_shape[script, s] / 64
        total = self.inner_total.get(p, 0.0)
        follow = (1 - OWN) * (0.5 * self.inner_word[script, n] + 0.5 * self.inner_shape[script, s] / 64)
        if total:
            follow += (OWN if len(before) < LONG else OWN / 100) * (1 - self.start_like[script, n]) * self.inner.get((p, n), 0.0) / (total + ENOUGH)
        prior = (self.ends[p] * self.seen[p] + PRIOR[p] * 2.0) / (self.seen[p] + 2.0)
        return math.log(prior * begin + 1e-12) - math.log((1 - prior) * follow + 1e-12)

    def ending(self, before: str) -> float:
        """Log odds that a word with a mark ends a sentence, whatever follows."""
        p = _cell(before, PREVIOUS)
        prior = (self.ends[p] * self.seen[p] + PRIOR[p] * 2.0) / (self.seen[p] + 2.0)
        return math.log(prior + 1e-6) - math.log(1 - prior + 1e-6)


def _train_pairs(text: str) -> Iterator[tuple[int, ...]]:
    """(kind, script, previous cell, next cell, shape, whether the word before is long): kind 0 certain starts, 1 open places of the mark '.', 2 words certainly inside."""
    script = main_script(text)

    def event(kind: int, before: str, word: str) -> tuple[int, ...]:
        return kind, script, _cell(before, PREVIOUS) if before else 0, _cell(word, NEXT), SHAPE_AT[_shape(word)], int(len(before) >= LONG)

    for m in INSIDE.finditer(text):
        yield event(2, "", m[1] or m[2])
    m = WORD_AFTER.match(text)
    if m and m[2] and not NUMBERING.match(m[2] + " "):
        yield event(0, "", m[2])
    if THAI.search(text) and (m := THAI_START.search(text)):
        yield event(0, "", m[0])
    for p in places(text):
        if p.kind == "line":
            m = WORD_AFTER.match(text, p.after)
            if m and m[2]:
                yield event(0, "", m[2])
        elif p.kind == "blank":
            if THAI.match(text[p.end - 1]) and THAI.match(text[p.after]):
                yield event(1, MARK_WORDS["blank"], text[p.after : p.after + 3])
        elif p.kind == "full" and not p.opens:
            if p.next:
                yield event(0, "", p.next)
                yield event(1, MARK_WORDS["full"], p.next)
        elif p.kind == "mark" and text[p.end - 1] not in "." and (loud := _loud(text, p)) and p.next:
            yield event(1, loud, p.next)
        elif p.kind == "mark" and p.next and not (p.glued and _shape(p.next) in ("lower", "digit", "item")) and not (p.end < 8 and NUMBERING.match(text[: p.end])):
            yield event(1, p.before, p.next)


EVENT = ["kind", "script", "prev", "next", "shape", "long"]


def count_events(df: DataFrame, text: str, also: Callable[[dict, str], Iterator[tuple[int, ...]]] | None = None) -> DataFrame:
    """(kind, script, prev, next, shape, long, n) over all texts, summed before the shuffle.

    `also` gives further events of a text that are counted in the same pass; the dictionary it gets is the task's own.
    """
    schema = "kind int, script int, prev int, next int, shape int, long int, n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, ...], int] = {}
        own: dict = {}
        for pdf in batches:
            for t in pdf.iloc[:, 0]:
                if t:
                    for key in _train_pairs(t):
                        counts[key] = counts.get(key, 0) + 1
                    for key in also(own, t) if also else ():
                        counts[key] = counts.get(key, 0) + 1
            if len(counts) > AT_ONCE:
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*EVENT, "n"])
                counts = {}
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*EVENT, "n"])

    parts = df.select(text).mapInPandas(run, schema)
    return parts.groupBy(*EVENT).agg(F.sum("n").alias("n"))


def _shares(counts: np.ndarray, floor: float) -> np.ndarray:
    """Rows of counts as probabilities."""
    counts = counts + floor
    return counts / counts.sum(axis=1, keepdims=True)


def _tally(script: np.ndarray, cell: np.ndarray, weight: np.ndarray, wide: int) -> np.ndarray:
    """Sums of weights by script and cell."""
    kinds = len(SCRIPTS)
    return np.bincount(script * wide + cell, weights=weight, minlength=kinds * wide).reshape(kinds, wide)


def _begun(sure_word: np.ndarray, sure_shape: np.ndarray, inner_word: np.ndarray, inner_shape: np.ndarray) -> BoundaryModel:
    """The model before the first round, from counts of certain starts and of words certainly inside."""
    model = BoundaryModel()
    model.start, model.start_shape = _shares(sure_word, 0.01), _shares(sure_shape, 0.05)
    model.inner_word, model.inner_shape = _shares(inner_word, 0.01), _shares(inner_shape, 0.05)
    # A word that mostly begins sentences says nothing about the word before it when it follows that.
    model.start_like = sure_word / (sure_word + inner_word + 3.0)
    return model


class _Open:
    """Open places (kind 1): counts of word pairs and what the rounds so far make of them. Words before need all their rows here."""

    def __init__(self, rest: pd.DataFrame, model: BoundaryModel) -> None:
        self.c, self.p, self.n, self.s = (rest[k].to_numpy().astype(np.int64) for k in ("script", "prev", "next", "shape"))
        self.w = rest.n.to_numpy(float)
        self.cell = np.unique(self.p * NEXT + self.n, return_inverse=True)[1]
        self.cells = self.cell.max() + 1
        self.cell_p, self.cell_n = np.zeros(self.cells, dtype=np.int64), np.zeros(self.cells, dtype=np.int64)
        self.cell_p[self.cell], self.cell_n[self.cell] = self.p, self.n
        self.seen = np.bincount(self.p, weights=self.w, minlength=PREVIOUS)
        self.ends = np.where(PRIOR > 0.9, PRIOR, 0.7)
        self.follow = np.bincount(self.cell, weights=self.w, minlength=self.cells) * 0.3
        own_share = np.where(rest.long.to_numpy() == 1, OWN / 100, OWN)
        self.base = (1 - OWN) * (0.5 * model.inner_word[self.c, self.n] + 0.5 * model.inner_shape[self.c, self.s] / 64)
        self.own = own_share * (1 - model.start_like[self.c, self.n])

    def step(self, start: np.ndarray, start_shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round with the shares of starts; what it adds to the counts of starts by word and by shape."""
        c, p, n, s, w = self.c, self.p, self.n, self.s, self.w
        total = np.bincount(self.cell_p, weights=self.follow, minlength=PREVIOUS)
        b1 = 0.9 * start[c, n] + 0.1 * start_shape[c, s] / 64
        b0 = self.base + self.own * self.follow[self.cell] / (total[p] + ENOUGH)
        prior = (self.ends[p] * self.seen[p] + PRIOR[p] * 2.0) / (self.seen[p] + 2.0)
        post = prior * b1 / np.maximum(prior * b1 + (1 - prior) * b0, 1e-300)
        gain = np.bincount(p, weights=post * w, minlength=PREVIOUS)
        self.ends = np.divide(gain, self.seen, out=np.full(PREVIOUS, 0.85), where=self.seen > 0)
        self.follow = np.bincount(self.cell, weights=(1 - post) * w, minlength=self.cells)
        return _tally(c, n, post * w, NEXT), _tally(c, s, post * w, len(SHAPES))


def fit(counts: pd.DataFrame, rounds: int = ROUNDS) -> BoundaryModel:
    """Expectation-maximization on counted word pairs; without any count the model keeps its priors."""
    if counts.empty:
        return BoundaryModel()
    sure, rest, inside = (counts[counts.kind == k] for k in (0, 1, 2))
    sure_word, sure_shape, inner_word, inner_shape = (_tally(part["script"].to_numpy(), part[k].to_numpy(), part.n.to_numpy(float), wide) for part in (sure, inside) for k, wide in (("next", NEXT), ("shape", len(SHAPES))))
    model = _begun(sure_word, sure_shape, inner_word, inner_shape)
    if rest.empty:
        return model
    open_ = _Open(rest, model)
    for _ in range(rounds):
        word, shape = open_.step(model.start, model.start_shape)
        model.start, model.start_shape = _shares(sure_word + word, 0.01), _shares(sure_shape + shape, 0.05)
    model.ends, model.seen = open_.ends, open_.seen
    keep = open_.follow > 1e-3
    model.inner = {(int(a), int(b)): float(f) for a, b, f in zip(open_.cell_p[keep], open_.cell_n[keep], open_.follow[keep])}
    total = np.bincount(open_.cell_p, weights=open_.follow, minlength=PREVIOUS)
    model.inner_total = {int(i): float(total[i]) for i in np.nonzero(total)[0]}
    return model


def fit_spread(counts: DataFrame, rounds: int = ROUNDS, most: int = MAX_PAIRS) -> BoundaryModel:
    """What fit() gives, for any number of distinct pairs: each round is one pass over all of them where they lie.

    Pairs are parted by the word before, of which a task has about `most`. A pass
    repeats the rounds before from their shares of starts, so nothing is kept between passes.
    Only sums by cell reach the driver, and in the end the pairs inside sentences, in twelve bytes each.
    """
    spark = counts.sparkSession
    kinds, wide = len(SCRIPTS), len(SHAPES)
    fixed = counts.filter("kind <> 1")
    tables = []
    for k in (0, 2):
        for column, width in (("next", NEXT), ("shape", wide)):
            got = fixed.filter(F.col("kind") == k).groupBy("script", F.col(column).alias("cell")).agg(F.sum("n").alias("n")).toPandas()
            tables.append(_tally(got.script.to_numpy(np.int64), got.cell.to_numpy(np.int64), got.n.to_numpy(float), width))
    sure_word, sure_shape = tables[:2]
    model = _begun(*tables)
    rest = counts.filter("kind = 1")
    size = rest.count()
    if not size:
        return model
    rest = materialize(rest.repartition(max(task_count(spark), -(-size // most)), "prev"))
    begun, shares = spark.sparkContext.broadcast(model), [spark.sparkContext.broadcast((model.start, model.start_shape))]

    def replayed(batches: Iterator[pd.DataFrame]) -> tuple[_Open, np.ndarray, np.ndarray] | None:
        parts = [pdf for pdf in batches if len(pdf)]
        if not parts:
            return None
        open_ = _Open(pd.concat(parts, ignore_index=True), begun.value)
        for s in shares:
            word, shape = open_.step(*s.value)
        return open_, word, shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if got := replayed(batches):
            for what, table in enumerate(got[1:]):
                c, cell = np.nonzero(table)
                yield pd.DataFrame({"what": what, "script": c, "cell": cell, "v": table[c, cell]})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if got := replayed(batches):
            o = got[0]
            p = np.nonzero(o.seen)[0]
            total = np.bincount(o.cell_p, weights=o.follow, minlength=PREVIOUS)
            for what, v in enumerate((o.ends, o.seen, total)):
                yield pd.DataFrame({"what": what, "a": p, "b": 0, "v": v[p]})
            keep = o.follow > 1e-3
            yield pd.DataFrame({"what": 3, "a": o.cell_p[keep], "b": o.cell_n[keep], "v": o.follow[keep]})

    for k in range(rounds):
        got = rest.mapInPandas(sums, "what int, script int, cell int, v double").groupBy("what", "script", "cell").agg(F.sum("v").alias("v")).toPandas()
        word, shape = (_tally(part.script.to_numpy(np.int64), part.cell.to_numpy(np.int64), part.v.to_numpy(float), width) for part, width in ((got[got.what == 0], NEXT), (got[got.what == 1], wide)))
        model.start, model.start_shape = _shares(sure_word + word, 0.01), _shares(sure_shape + shape, 0.05)
        if k + 1 < rounds:
            shares.append(spark.sparkContext.broadcast((model.start, model.start_shape)))
    done = materialize(rest.mapInPandas(last, "what int, a int, b int, v double"))
    words = done.filter("what < 3").toPandas()
    ends, seen, total = (words[words.what == k] for k in range(3))
    model.ends, model.seen = np.full(PREVIOUS, 0.85), np.zeros(PREVIOUS)
    model.ends[ends.a], model.seen[seen.a] = ends.v, seen.v
    model.inner_total = {int(i): float(v) for i, v in zip(total.a, total.v) if v}
    pairs = done.filter("what = 3").select("a", "b", "v").toPandas()
    model.inner = PairTable.of(pairs.a.to_numpy(), pairs.b.to_numpy(), pairs.v.to_numpy())
    return model


def learn(counts: DataFrame, most: int = MAX_PAIRS) -> BoundaryModel:
    """Model of checkpointed event counts; up to `most` distinct events are settled on the driver, more of them where they lie, with the same result.

    Counts are scaled to NOMINAL events in all, so a corpus and copies of it give one and the same model.
    """
    size, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not size:
        return BoundaryModel()
    scaled = counts.withColumn("n", F.col("n") * F.lit(NOMINAL / total))
    return fit(fetch(scaled)) if size <= most else fit_spread(scaled, most=most)


def train(df: DataFrame, text: str, most: int = MAX_PAIRS) -> BoundaryModel:
    """Model of all texts of a column."""
    return learn(materialize(count_events(df, text)), most)


def _cased(p: Place, text: str, model: BoundaryModel) -> Place:
    """A place of a text in capitals or without any, with its words as they would be written otherwise."""
    if p.kind != "mark" or p.glued:
        return p
    forms = (p.before, p.before.lower(), p.before.capitalize())
    before = max(forms, key=lambda w: model.seen[_cell(w, PREVIOUS)])
    return replace(p, before=before, next=p.next.capitalize(), second=p.second.capitalize())


def _before_numbering(p: Place, before: str, model: BoundaryModel) -> float:
    """Log odds of a boundary before a numbering or a bullet: the word after that tells, and whether the word or mark before ends sentences."""
    return model.ending(before) + ((3.0 if p.next[:1].isdigit() else 6.0) if _shape(p.second) in ("upper", "letter", "mark") else -3.0)


def _local(p: Place, text: str, model: BoundaryModel, script: int) -> float:
    """Log odds of a boundary at a place from its own surroundings."""
    if p.kind == "line":
        return 50.0
    nxt = p.next
    if nxt and nxt[0] in ",;:，；：、،؛":
        # The clause goes on.
        return -15.0
    if p.kind == "blank":
        # Thai: never next to a numeral, hardly ever around a foreign word; else the model tells.
        left, right = text[p.end - 1], text[p.after]
        if left.isnumeric() or right.isnumeric():
            return -50.0
        if left.isalpha() and not THAI.match(left) or right.isalpha() and not THAI.match(right):
            return -4.0
        return model.odds(MARK_WORDS["blank"], text[p.after : p.after + 3], script)
    if p.kind == "full":
        if p.glued and text[p.end - 1] in CLOSERS and REPORTS.match(text[p.after : p.after + 2]):
            return -8.0
        return _before_numbering(p, MARK_WORDS["full"], model) if p.second else model.odds(MARK_WORDS["full"], nxt, script) if nxt else model.ending(MARK_WORDS["full"])
    shape = _shape(nxt)
    if p.kind == "dots":
        if shape == "lower" or shape == "digit":
            return -6.0
        # Dots inside a sentence stand between words of one clause; a start word settles it.
        return model.odds("...", nxt, script) - 1.0 if shape == "upper" else (-4.0 if text[p.end - 1] == "…" and p.glued else -1.0)
    mark = text[p.end - 1]
    if p.glued:
        if len(p.before) == 1 and p.before.isalpha() and script in (0, 1):
            # Letters of an abbreviation.
            return -9.0
        if shape in ("lower", "digit", "item") or not nxt and not p.opens:
            return -9.0
        if shape == "mark" and not p.opens:
            return -6.0
    if mark in ",;:":
        return -20.0
    if loud := _loud(text, p):
        return _before_numbering(p, loud, model) if p.second else model.odds(loud, nxt, script) if nxt else model.ending(loud)
    if p.second:
        return _before_numbering(p, p.before, model)
    return model.odds(p.before, nxt, script) if nxt else 3.0


def _plus(a: float, b: float) -> float:
    """Log of the sum of two exponentials."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def decode(text: str, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without outer white space, by forward-backward posteriors."""
    if not text or not ALNUM.search(text):
        return []
    found = places(text)
    first = 0
    while text[first].isspace():
        first += 1
    # Two states at each place, boundary or not; what joins two places is whether a
    # boundary at both would leave a piece that can be no sentence of its own.
    k = len(found)
    cuts: list[tuple[int, int]] = []
    if k:
        script = main_script(text)
        flat = script in (0, 1) and (text.islower() or text.isupper())
        own = [_local(_cased(p, text, model) if flat else p, text, model, script) for p in found]
        bar = []
        at = first
        for i, p in enumerate(found):
            piece = text[at : p.end]
            apart = at == first or text[at - 1].isspace() or text[at - 1] in FULL_MARKS + CLOSERS
            numbering = apart and len(piece) < 16 and NUMBERING.match(piece) is not None
            bar.append(-40.0 if (numbering or not ALNUM.search(piece)) and p.kind != "line" else 0.0)
            if numbering and p.kind == "mark" and (i == 0 or own[i - 1] > -4.0):
                # Either the place before the numbering is the boundary, or this one; the words around it decide.
                own[i] = min(own[i], 4.0 if p.before.isdigit() else 2.0)
            at = p.after
        # State 1 is a boundary. From a boundary (or the text's start) the piece between must be able to stand alone.
        fwd, stay, leave = [], -1e9, 0.0
        for i in range(k):
            stay, leave = _plus(stay, leave), own[i] + _plus(stay, leave + bar[i])
            fwd.append((stay, leave))
        back, stay, leave = [(0.0, 0.0)], 0.0, 0.0
        for i in range(k - 1, 0, -1):
            one = own[i] + leave
            stay, leave = _plus(stay, one), _plus(stay, one + bar[i])
            back.append((stay, leave))
        both = [(f[0] + b[0], f[1] + b[1]) for f, b in zip(fwd, back[::-1])]
        cuts = [(p.end, p.after) for i, p in enumerate(found) if both[i][1] >= both[i][0]]
    out: list[tuple[int, int]] = []
    at = first
    for end, after in [*cuts, (len(text), len(text))]:
        stop = min(end, len(text))
        while stop > at and text[stop - 1].isspace():
            stop -= 1
        if stop > at:
            if ALNUM.search(text, at, stop) or not out:
                out.append((at, stop))
            else:
                out[-1] = (out[-1][0], stop)
        at = after
    if len(out) > 1 and not ALNUM.search(text, *out[0]):
        out[0:2] = [(out[0][0], out[1][1])]
    return out


def sentence_starts(df: DataFrame, keys: list[str], text: str, model: BoundaryModel) -> DataFrame:
    """(*keys, start_pos): one row per sentence; null, empty and blank texts have none, repeated rows give theirs again."""
    source = df.select(*keys, text)
    schema = T.StructType([*[source.schema[k] for k in keys], T.StructField("start_pos", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            found = [[s for s, _ in decode(t, m)] if isinstance(t, str) else [] for t in pdf[text]]
            yield pdf[keys].assign(start_pos=found).explode("start_pos").dropna(subset=["start_pos"]).astype({"start_pos": "int32"})

    return source.mapInPandas(run, schema)
