"""Broken original-translation pairs, each with its defect.

Method: a multi-label linear classifier (refusal, copy, truncated, wrong_language)
on hashed n-grams of the translation and features of the pair: how much of the
original's words, and of its last words, the translation renders by the word
translations learnt from all pairs; how lengths compare; how much of the original
stands in the translation as it was; and how the translation's words
distribute over languages. It is trained on pairs of the corpus that look sound and on
copies of them that were truncated, copied, given another row's language or refused
synthetically, in a bounded sample; word translations and language counts cover
all rows. Thresholds are calibrated on a held-out part. A blank translation
is empty without any model.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import lexicon
from quire.llm.dedup import is_blank
from quire.llm.lexicon import Lexicon
from quire.session import fetch, materialize, spread

LABELS = ("refusal", "copy", "truncated", "wrong_language")
#: Rows from which synthetic training pairs are made, and cells of hashed n-grams.
SAMPLE, GRAMS = 4000, 1 << 18
EPOCHS, BATCH = 12, 4
#: Share of the original's weight that a pair to train on must render, so that refusals in the corpus are not taken for sound.
RENDERED = 0.2
#: Rows whose features are computed at once, in tasks and in training.
AT_ONCE, SLICE = 2000, 500
#: Log share of a word that a language never has, and the least one of a word it has.
NEVER, RAREST = -13.0, -12.0
#: Score as a refusal that an ordinary text may have.
ORDINARY = 0.0

TERMINAL = regex.compile(r"(?:[.!?…。！？।॥؟]|\p{N}\))[\"'”’»›)\]}」』）］】*_>\s]*$")
BREAKS = regex.compile(r"(?:\.\.\.|…|[-,、，;；:：–—(（“«「])\s*$")
LETTERS = regex.compile(r"\p{L}")
LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")
CODED = frozenset("0123456789@/\\_#=~")
SPACELESS = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}]")
WORD = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}]|(?<![\p{L}\p{M}])\p{L}[\p{L}\p{M}]+")
#: What one may write before a copied text.
PREFIX = regex.compile(r"^\s*[\p{L} ]{1,24}[:：]\s*")
PLAIN = regex.compile(r"[^\p{L}\p{N}]+")
SENTENCE_END = regex.compile(r"[.!?。！？।؟]+[”»」』\"]?(?=\s|$|[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}])")
#: A mark within a text after which a sentence begins; not a dot before a number, after one letter, or after a short title or label in capitals.
INNER_END = regex.compile(r"(?:(?<![\s.(]\p{L}|^\p{L}|(?:[\s(]|^)\p{Lu}\p{L}{1,2})\.+[”»’\"'’)]*\s+(?![\p{Ll}\p{N}]|\s*$)|[!?।؟]+[”»’\"'’)]*\s+(?!\p{Ll}|\s*$))|[。！？]+[”」』）]*(?=\s*\S)(?!\s*[とと，、,])")

#: Phrases from which refusals are put together for training: an opening, what is declined, a closing.
REFUSAL_PARTS = {
    "en": (["I'm sorry, but", "Sorry,", "Unfortunately,", "I apologize, but", "As an AI,", "As a language model,", "Regrettably,", "I am afraid", ""],
           ["I cannot translate this text.", "I can't help with that request.", "I am not able to translate this passage.", "I must decline to translate this content.", "I am unable to assist with this text.", "I won't be able to provide a translation.", "this request can't be fulfilled.", "translating this is something I cannot do.", "I must refuse this request.", "I am not allowed to render this passage.", "I can't provide a translation here.", "that is beyond what I may translate."],
           ["", "", "Please provide another text.", "It may violate the guidelines.", "Please send a different text."]),
    "zh": (["抱歉，", "对不起，", "很抱歉，", "很遗憾，", "作为人工智能，", "作为语言模型，", ""],
           ["我无法翻译这段文字", "我不能提供该文本的翻译", "我无法协助处理这个请求", "恕我不能完成此翻译", "无法满足您的请求", "我不能翻译此内容", "恕我无法给出译文", "这项请求我不能完成", "我不便处理这段内容", "恕不能提供译文"],
           ["。", "。", "，因为它可能违反规定。", "。请提供其他文本。", "，请更换内容。"]),
    "de": (["Es tut mir leid, aber", "Entschuldigung,", "Leider", "Als Sprachmodell", "Bedauerlicherweise"],
           ["kann ich diesen Text nicht übersetzen.", "ich kann diesen Abschnitt nicht übersetzen.", "ich kann bei dieser Anfrage nicht helfen.", "muss ich die Übersetzung ablehnen.", "ist es mir nicht möglich, diesen Text zu bearbeiten.", "darf ich diesen Inhalt nicht wiedergeben.", "muss ich diese Bitte abschlagen.", "kann ich keine Übersetzung liefern."],
           ["", "", "Bitte senden Sie einen anderen Text.", "Er könnte gegen die Richtlinien verstoßen."]),
    "fr": (["Je suis désolé, mais", "Désolé,", "Malheureusement,", "En tant que modèle de langue,", "Avec regret,"],
           ["je ne peux pas traduire ce texte.", "je ne peux pas traduire ce passage.", "il m'est impossible de traiter ce texte.", "je dois refuser de traduire ce contenu.", "je ne suis pas en mesure de répondre à cette demande.", "il m'est interdit de rendre ce contenu.", "je ne peux fournir aucune traduction.", "je dois décliner cette demande."],
           ["", "", "Merci d'envoyer un autre texte.", "Il pourrait enfreindre les règles."]),
    "es": (["Lo siento, pero", "Lamentablemente,", "Disculpe,", "Como modelo de lenguaje,", "Con pesar,"],
           ["no puedo traducir este texto.", "no puedo traducir este pasaje.", "me es imposible ayudar con este texto.", "debo negarme a traducir este contenido.", "no es posible atender esta solicitud.", "no se me permite reproducir este contenido.", "no puedo ofrecer ninguna traducción.", "tengo que rechazar esta petición."],
           ["", "", "Envíe otro texto, por favor.", "Podría infringir las normas."]),
    "ja": (["申し訳ありませんが、", "すみませんが、", "残念ながら、", "恐れ入りますが、", "言語モデルとして、"],
           ["この文章は翻訳できません。", "このテキストを翻訳することはできません。", "このご依頼にはお応えできません。", "この内容の翻訳はお断りします。", "お手伝いできません。", "訳文を提供することはできません。", "この依頼は完了できません。", "この文章の処理は差し控えます。"],
           ["", "", "別の文章をお送りください。", "ガイドラインに違反する可能性があります。"]),
}


def has_words(text: str | None) -> bool:
    """Whether a text has a word to translate: letters beyond codes, numbers and addresses."""
    if not text:
        return False
    if SPACELESS.search(text):
        return True
    for token in text.split():
        if WORD.search(token) and (len(token) > 60 or not (CODED & set(token) or token.count(".") > 1 or "." in token.strip(".,;:!?()[]\"'"))):
            return True
    return False


def _plain(text: str) -> str:
    return PLAIN.sub("", text.casefold())


def sentence_count(text: str) -> int:
    """Number of sentences by their marks."""
    return 1 + sum(1 for _ in INNER_END.finditer(text))


def _grams(text: str) -> set[str]:
    return {text[i : i + 4] for i in range(len(text) - 3)} or {text}


@dataclass
class Languages:
    """log P(cell | language) of hashed tokens: a row for each cell, a column for each language; the best of each row, its language, and the second best."""

    names: dict[str, int]
    row: np.ndarray
    logs: np.ndarray
    best: np.ndarray
    best_of: np.ndarray
    second: np.ndarray

    def margins(self, owner: np.ndarray, cells: np.ndarray, rows: int, languages: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of languages (one of each row) (mean, share): how much better it explains the row's tokens than the best other one does; share of tokens far likelier elsewhere."""
        at = self.row[cells]
        owner, at = owner[at >= 0], at[at >= 0]
        n = np.bincount(owner, minlength=rows).astype(float)
        few = len(self.names) < 2
        sums = np.stack([np.bincount(owner, weights=self.logs[at, k], minlength=rows) for k in range(len(self.names))], axis=1) if len(self.names) else np.zeros((rows, 1))
        out = []
        for wanted in languages:
            k = np.array([self.names.get(w, -1) for w in wanted])
            none = (k < 0) | (n == 0) | few
            if few:
                out.append((np.zeros(rows), np.zeros(rows)))
                continue
            others = sums.copy()
            others[np.arange(rows), k] = -np.inf
            mean = np.clip((sums[np.arange(rows), k] - others.max(axis=1)) / np.maximum(n, 1), -3.0, 3.0)
            other = np.where(self.best_of[at] == k[owner], self.second[at], self.best[at])
            far = np.bincount(owner, weights=other > self.logs[at, k[owner]] + 3.0, minlength=rows) / np.maximum(n, 1)
            out.append((np.where(none, 0.0, mean), np.where(none, 0.0, far)))
        return out


def languages(counts: pd.DataFrame) -> Languages:
    """Token distributions of languages from counts (k, c, n) of cells; shares only, so copies of the corpus change nothing."""
    names = {k: i for i, k in enumerate(sorted(counts["k"].unique()))}
    cells = np.unique(counts["c"].to_numpy(np.int64))
    row = np.full(lexicon.CELLS, -1, dtype=np.int32)
    row[cells] = np.arange(len(cells))
    logs = np.full((len(cells), len(names)), NEVER, dtype=np.float32)
    k = counts["k"].map(names).to_numpy(np.int64)
    n = counts["n"].to_numpy(float)
    total = np.bincount(k, weights=n, minlength=len(names)) if len(n) else n
    logs[row[counts["c"].to_numpy(np.int64)], k] = np.maximum(np.log(n / total[k]), RAREST) if len(n) else 0.0
    ordered = np.sort(logs, axis=1) if len(names) > 1 else np.full((len(cells), 2), NEVER, np.float32)
    best_of = logs.argmax(axis=1) if len(names) else np.zeros(0, np.int64)
    return Languages(names, row, logs, ordered[:, -1], best_of, ordered[:, -2])


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the values of all rows."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = [np.asarray(x, dtype=np.int64) for x in lists if len(x)]
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate(flat) if flat else np.zeros(0, np.int64)


def grams(rows: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct hashed words and word pairs of each row."""
    pair = rows[1:] == rows[:-1]
    two = (cells[:-1] * 1_000_003 + cells[1:] * 7_919 + 17)[pair] % GRAMS
    key = np.unique(np.concatenate([rows * GRAMS + cells % GRAMS, rows[1:][pair] * GRAMS + two]))
    return key // GRAMS, key % GRAMS


class Features:
    """Pair features of many rows at once; holds the tables that cover all rows."""

    names = 22

    def __init__(self, lex: Lexicon, langs: Languages, ratio: dict[str, tuple[float, float]]):
        self.names_of, self.forward, self.langs, self.ratio = lex.names, lexicon.renderings(lex), langs, ratio

    def coverage(self, label: np.ndarray, ro: np.ndarray, co: np.ndarray, rt: np.ndarray, ct: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cover, tail, last, front) of each row: weight of the original's words that is rendered, weight of the end that nothing renders, cover of the last third and of the first half."""
        rows = len(label)
        here = np.unique(rt * lexicon.CELLS + ct)
        inside = lambda r, c: here[np.minimum(np.searchsorted(here, r * lexicon.CELLS + c), len(here) - 1)] == r * lexicon.CELLS + c if len(here) else np.zeros(len(r), bool)
        first, count = self.forward.rows(label[ro] * lexicon.CELLS + co)
        w, _ = self.forward.weights(label[ro] * lexicon.CELLS + co, np.full(len(co), 4.0))
        at, place = lexicon.ranges(first, count)
        there = inside(ro[at], self.forward.other[place])
        v = np.zeros(len(co))
        np.maximum.at(v, at[there], self.forward.strength[place[there]])
        same = inside(ro, co)
        v = np.where(same, 1.0, np.minimum(1.0, 3.0 * v))
        use = (count > 0) | same
        r, w, v = ro[use], w[use], v[use]
        total = np.bincount(r, weights=w, minlength=rows)
        upto = np.cumsum(w)
        base = np.zeros(rows)
        starts = np.searchsorted(r, np.arange(rows))
        base[starts > 0] = upto[starts[starts > 0] - 1]
        upto = upto - base[r]
        good = np.full(rows, -1)
        sure = np.nonzero((v > 0.25) & (w > 0.3))[0]
        np.maximum.at(good, r[sure], sure)
        share = lambda take, x: np.bincount(r[take], weights=x[take], minlength=rows)
        over = lambda a, b, none: np.divide(a, b, out=np.full(rows, none), where=b > 0)
        cover, tail = over(share(slice(None), w * v), total, 0.5), over(share(np.arange(len(r)) > good[r], w), total, 0.0)
        third, half = total[r] - upto <= total[r] / 3, upto - w <= total[r] / 2
        return cover, tail, over(share(third, w * v), share(third, w), 0.5), over(share(half, w * v), share(half, w), 0.5)

    def of(self, o: list[str], t: list[str], source: list[str], target: list[str], co: list, ct: list) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Pair features of rows with cells of both texts in order, and (row, cell) of hashed n-grams of translation and original."""
        rows = len(o)
        keys = [f"{a}-{b}" for a, b in zip(source, target)]
        label = np.array([self.names_of.get(k, len(self.names_of)) for k in keys], dtype=np.int64)
        (ro, fo), (rt, ft) = _joined(co), _joined(ct)
        cover, tail, last, front = self.coverage(label, ro, fo, rt, ft)
        key = np.unique(rt * lexicon.CELLS + ft)
        (mine, foreign), (like_source, _) = self.langs.margins(key // lexicon.CELLS, key % lexicon.CELLS, rows, [target, source])
        some = np.zeros((rows, 8))
        for i, (a, b, k) in enumerate(zip(o, t, keys)):
            mean, spread_ = self.ratio.get(k, (0.0, 1.0))
            hangs = bool(BREAKS.search(b)) and not BREAKS.search(a)
            so, st = sentence_count(a), sentence_count(b)
            pa, pb, pp = _plain(a), _plain(b), _plain(PREFIX.sub("", b))
            ga, gb = _grams(pa), _grams(pp)
            both = len(ga & gb)
            some[i] = (
                (math.log(max(1, len(b)) / max(1, len(a))) - mean) / max(0.05, spread_),
                float(bool(TERMINAL.search(a)) and not TERMINAL.search(b)) or float(hangs),
                hangs,
                max(0, so - st) / max(1, so),
                pa in (pb, pp),
                both / len(ga),
                both / len(gb),
                len(b) < 12,
            )
        z, cut, hangs, missing, same, of_a, of_b, short = some.T
        one = np.ones(rows)
        x = [one, cover, tail, tail > 0.3, last, front - last, np.clip(z, -3.0, 3.0), z < -1.5, cut, cut * tail, hangs, missing, missing * tail, same, of_a, of_b, mine, mine < 0, foreign, like_source, short, cut * (1 - last)]
        return np.stack(x, axis=1).astype(float), grams(rt, ft), grams(ro, fo)


    def sliced(self, o: list[str], t: list[str], source: list[str], target: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The same of texts that are not cut yet, in slices that bound the memory."""
        parts = []
        for first in range(0, len(o), SLICE):
            a, b, s, k = (v[first : first + SLICE] for v in (o, t, source, target))
            x, (r1, c1), (r2, c2) = self.of(a, b, s, k, [lexicon.ordered_cells(v) for v in a], [lexicon.ordered_cells(v) for v in b])
            parts.append((x, r1 + first, c1, r2 + first, c2))
        x, r1, c1, r2, c2 = (np.concatenate(v) for v in zip(*parts))
        return x, (r1, c1), (r2, c2)


def _gram_scores(weights: np.ndarray, rows: int, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of the weights of each row's n-grams over the root of their number."""
    row, cell = found
    n = np.maximum(1, np.bincount(row, minlength=rows))
    return np.stack([np.bincount(row, weights=weights[cell, k], minlength=rows) for k in range(weights.shape[1])], axis=1) / np.sqrt(n)[:, None]


@dataclass
class Classifier:
    """Weights of pair features and of hashed n-grams, one column for each label; thresholds on probabilities."""

    pair: np.ndarray
    gram: np.ndarray
    cut: np.ndarray

    def probabilities(self, x: np.ndarray, of_translation: tuple, of_original: tuple) -> np.ndarray:
        """Probability of each label; an original that reads like a refusal itself counts against one."""
        s = x @ self.pair + _gram_scores(self.gram, len(x), of_translation)
        s[:, 0] -= np.maximum(0.0, _gram_scores(self.gram[:, :1], len(x), of_original)[:, 0] - ORDINARY)
        return 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30)))


def _truncate(t: str, r: random.Random) -> str | None:
    n = len(t.rstrip())
    ends = [m.end() for m in SENTENCE_END.finditer(t) if m.end() < 0.72 * n]
    if ends and r.random() < 0.35:
        return t[: r.choice(ends)]
    keep = r.uniform(0.08, 0.7)
    cut = t[: max(1, int(n * keep))].rstrip()
    return (cut + r.choice(["", "", "", "…", "...", "-", "、", ",", "，"])) or None


def _copy(o: str, r: random.Random) -> str:
    way = r.randrange(9)
    shapes = ["{}", "“{}”", "[{}]", "({})", "Translation: {}", "译文：{}", "{} ", '"{}"', "*{}*"]
    out = shapes[way].format(o)
    k = r.random()
    return out.lower() if k < 0.1 else out.upper() if k < 0.15 else out.rstrip(".") if k < 0.3 else out


def _refuse(language: str, r: random.Random, held: bool) -> str:
    """A refusal put together from phrases; every fourth core and opening is kept for held-out examples alone."""
    a, b, c = REFUSAL_PARTS[language]
    a, b = ([x for i, x in enumerate(xs) if (i % 4 == 1) == held] for xs in (a, b))
    first = r.choice(a)
    glue = "" if language in ("zh", "ja") or not first else " "
    end = r.choice(c)
    return (first + glue + r.choice(b) + ("" if language in ("zh", "ja") or not end else " ") + end).strip()


def synthetic(rows: list[tuple[str, str, str, str]], seed: int = 7) -> list[tuple[str, str, str, str, tuple[int, ...], bool]]:
    """(original, translation, source, target, labels, held out) made of pairs that look sound."""
    r = random.Random(seed)
    by_target: dict[str, list[str]] = {}
    for _, t, _, k in rows:
        by_target.setdefault(k, []).append(t)
    for o, _, k, _ in rows:
        by_target.setdefault(k, []).append(o)
    out = []
    for i, (o, t, s, k) in enumerate(rows):
        held = i % 5 == 0
        first = len(out)
        out.append((o, t, s, k, (0, 0, 0, 0)))
        if r.random() < 0.7 and (cut := _truncate(t, r)):
            out.append((o, cut, s, k, (0, 0, 1, 0)))
        if r.random() < 0.25:
            out.append((o, _copy(o, r), s, k, (0, 1, 0, 0)))
        if r.random() < 0.5:
            out.append((o, _refuse(r.choice([k if k in REFUSAL_PARTS else "en", "en", r.choice(list(REFUSAL_PARTS))]), r, held), s, k, (1, 0, 0, 0)))
        others = [x for x in by_target if x not in (k,)]
        if others and r.random() < 0.5:
            # Another row's text of about the same length stands for the same text in another language.
            x = r.choice(others)
            some = [r.choice(by_target[x]) for _ in range(6)]
            wrong = min(some, key=lambda y: abs(len(y) - len(t)))
            out.append((o, wrong, s, k, (0, 0, -1, 1)))
        out[first:] = [(*x, held) for x in out[first:]]
    return out


def fit(examples: list[tuple[str, str, str, str, tuple[int, ...], bool]], features: Features, seed: int = 3) -> Classifier:
    """Logistic regression by adaptive gradient steps over small batches; thresholds of best F1 on the held-out examples. A label of -1 is left open."""
    n = len(LABELS)
    pair, gram = np.zeros((Features.names, n)), np.zeros((GRAMS, n))
    model = Classifier(pair, gram, np.full(n, 0.5))
    if not examples:
        return model
    o, t, s, k, labels, held = (list(c) for c in zip(*examples))
    x, of_t, of_o = features.sliced(o, t, s, k)
    y, held = np.array(labels, dtype=float), np.array(held)
    row, cell = of_t
    starts = np.searchsorted(row, np.arange(len(x) + 1))
    sizes = np.diff(starts)
    scale = 1.0 / np.sqrt(np.maximum(1, sizes))
    gp, gg = np.full(pair.shape, 1e-3), np.full(gram.shape, 1e-3)
    rng = np.random.default_rng(seed)
    train = np.nonzero(~held)[0]
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for first in range(0, len(order), BATCH):
            b = order[first : first + BATCH]
            owner, at = lexicon.ranges(starts[b], sizes[b])
            cells = cell[at]
            z = x[b] @ pair
            np.add.at(z, owner, gram[cells] * scale[b][owner][:, None])
            d = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[b]
            d[y[b] < 0] = 0.0
            step = x[b].T @ d + 1e-4 * len(b) * pair
            gp += step * step
            pair -= 0.15 * step / np.sqrt(gp)
            used, back = np.unique(cells, return_inverse=True)
            step = np.zeros((len(used), n))
            np.add.at(step, back, d[owner] * scale[b][owner][:, None])
            gg[used] += step * step
            gram[used] -= 0.08 * step / np.sqrt(gg[used])
    if held.any():
        p = model.probabilities(x, of_t, of_o)[held]
        known_y = y[held]
        for c in range(n):
            known = known_y[:, c] >= 0
            best = (-1.0, 0.5)
            for v in np.linspace(0.1, 0.95, 35):
                hit = (p[known, c] >= v) & (known_y[known, c] == 1)
                f1 = 2 * hit.sum() / max(1, (p[known, c] >= v).sum() + (known_y[known, c] == 1).sum())
                # Of equal thresholds the one nearest to the middle.
                best = max(best, (round(float(f1), 4) - abs(v - 0.5) * 1e-3, v))
            model.cut[c] = best[1]
    return model


def classify(o: list, t: list, source: list, target: list, co: list, ct: list, features: Features, model: Classifier) -> list[str | None]:
    """The first defect of each row that holds, or None."""
    out: list[str | None] = [None] * len(o)
    rest = []
    for i, (a, b) in enumerate(zip(o, t)):
        if has_words(a):
            if b and LETTER_OR_DIGIT.search(b):
                rest.append(i)
            else:
                out[i] = "empty"
    if not rest:
        return out
    pick = lambda xs: [xs[i] for i in rest]
    x, of_t, of_o = features.of(pick(o), pick(t), pick(source), pick(target), pick(co), pick(ct))
    holds = model.probabilities(x, of_t, of_o) >= model.cut
    # A copy is checked against the text itself.
    holds[:, LABELS.index("copy")] &= x[:, 14] >= 0.8
    # What was cut short ends in the open or has fewer sentences; leaving words out is a free rendering.
    holds[:, LABELS.index("truncated")] &= (x[:, 8] > 0) | (x[:, 11] > 0)
    for i, any_, label in zip(rest, holds.any(axis=1), holds.argmax(axis=1)):
        if any_:
            out[i] = LABELS[label]
    return out


def length_ratios(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """(median, spread) of the log of translation length over original length of each language pair (pair, original, translation), to a hundredth."""
    length = lambda c: F.greatest(F.lit(1), F.length(c))
    ratio = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.log(length("translation") / length("original"))))
    # A pair has 2,001 steps at most.
    steps = fetch(rows.groupBy("pair", F.bround(ratio * 100).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")))
    out = {}
    for pair, part in steps.groupby("pair"):
        part = part.sort_values("step")
        upto = part["n"].cumsum().to_numpy() / part["n"].sum()
        low, middle, high = (float(part["step"].to_numpy()[np.searchsorted(upto, q - 1e-12)]) / 100 for q in (0.25, 0.5, 0.75))
        out[pair] = (middle, max(0.05, (high - low) / 1.35))
    return out


def sample_texts(rows: DataFrame, size: int = SAMPLE) -> list[tuple[str, str, str, str]]:
    """About `size` rows (original, translation, languages), each as often as its share of all rows asks for.

    A text pair is drawn by the hash of its texts against its share, so copies of the corpus
    give the same sample, and what recurs is met as often in training as it is in the corpus.
    """
    texts = ["original", "translation", "source_lang", "target_lang"]
    hashed = rows.select(F.xxhash64(*texts).alias("h"), *texts)
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    if not total:
        return []
    chance = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 31)) / float(1 << 31)
    # The draws of all pairs add up to `size` on average, so that many rows at most come through.
    drawn = counts.withColumn("k", F.floor(F.col("n") * F.lit(size / total) + chance).cast("int")).filter("k > 0").select("h", "k")
    found = hashed.join(F.broadcast(drawn), "h").groupBy("h", "k").agg(*[F.min(c).alias(c) for c in texts]).collect()
    return [(r[2], r[3], r[4] or "", r[5] or "") for r in sorted(found, key=lambda r: r[0]) for _ in range(r[1])]


def train(rows: DataFrame) -> tuple[Features, Classifier]:
    """Tables over all rows and the classifier of a bounded sample (SAMPLE rows, by hash).

    `rows` have the texts, their languages and the cells of both (co, ct), and are checkpointed.
    """
    usable = rows.filter(~is_blank(F.col("translation")))
    pair = F.concat_ws("-", F.coalesce("source_lang", F.lit("")), F.coalesce("target_lang", F.lit("")))
    lex = lexicon.train(usable.select(pair.alias("pair"), F.array_distinct("co").alias("s"), F.array_distinct("ct").alias("t")), lasting=True)
    ratio = length_ratios(usable.select(pair.alias("pair"), "original", "translation"))
    side = lambda lang, cells: usable.select(F.coalesce(lang, F.lit("")).alias("k"), F.explode(F.array_distinct(cells)).alias("c"))
    counts = side("source_lang", "co").unionByName(side("target_lang", "ct")).groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    # CELLS rows a language at most.
    features = Features(lex, languages(fetch(counts)), ratio)
    some = [r for r in sample_texts(usable) if has_words(r[0])]
    sound: list[tuple[str, str, str, str]] = []
    if some:
        o, t, s, k = (list(c) for c in zip(*some))
        x, _, _ = features.sliced(o, t, s, k)
        # It renders some of the original, ends as that does, has as many sentences, is no copy and is in the language wanted; words may be left out.
        looks = (x[:, 1] >= RENDERED) & (x[:, 8] == 0) & (x[:, 11] == 0) & (x[:, 14] < 0.3) & (x[:, 16] > -0.2)
        sound = [row for row, good in zip(some, looks) if good]
    return features, fit(synthetic(sound), features)


def defects(segments: DataFrame) -> DataFrame:
    """(doc_id, seq, defect): rows whose translation is defective, one defect each.

    `segments` has one row per (doc_id, seq). Null or blank originals and those
    without a word to translate are never a case; a null or blank translation
    is `empty`; null languages count as one unknown language. An empty table gives an
    empty one.
    """
    wanted = segments.select("doc_id", "seq", "original", "translation", "source_lang", "target_lang")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(co=[lexicon.ordered_cells(x) for x in pdf["original"]], ct=[lexicon.ordered_cells(x) for x in pdf["translation"]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    rows = materialize(spread(wanted.filter(~is_blank(F.col("original")))).mapInPandas(cut, fields + ", co array<int>, ct array<int>"))
    features, model = train(rows)
    shared = segments.sparkSession.sparkContext.broadcast((features, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, m = shared.value
        for pdf in batches:
            found = []
            for first in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[first : first + AT_ONCE]
                found += classify(*(list(part[c]) for c in ("original", "translation")), *(list(part[c].fillna("")) for c in ("source_lang", "target_lang")), list(part["co"]), list(part["ct"]), f, m)
            out = pdf[["doc_id", "seq"]].assign(defect=found)
            yield out[out["defect"].notna()]

    return rows.mapInPandas(run, "doc_id bigint, seq int, defect string")
