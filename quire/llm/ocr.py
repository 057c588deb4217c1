"""Repair of text from scanned pages.

Method: the lines of a page's body text become one stream of characters. Dynamic
programming over the stream decodes words jointly with the line ends between them: at
a line end a word may go on (with or without a hyphen put in), a compound
may keep its own hyphen, or a word may end; within lines words may be split or
run together, and characters may have been confused. Costs are shares of words
among all words of the body text, so they are the same for a corpus of any size. A second
dynamic program chooses where paragraphs begin. Blocks in the margin of a page
are told apart before: running lines by what repeats over the pages of a document,
numbers of pages by their sequence.

Every task holds the words of a share of COMMON or more, of which there can be one over
COMMON at most. Counts of rarer words are joined to the pages that ask for them.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.skew import join_groups
from quire.session import fetch, materialize, spread

#: Height of a page, and the shares of it above and below which only marginal lines are printed.
PAGE_HEIGHT, TOP, BOTTOM = 842.0, 0.073, 0.932
#: Kinds of blocks that are paragraphs of their own.
ALONE = ("heading", "cell", "footnote")
#: Share of all words from which a word is common: every task holds the common ones, a million at most, and only they are taken for what was printed.
COMMON = 1e-6
#: A word is a misreading of another if it is rarer than this share of the other's count: by confused characters, of short words of letters alone, by any one character.
RARE, RARE_SHORT, RARE_ANY = 0.04, 0.002, 1 / 60
#: A word this frequent is never a misreading by any one character.
SELDOM = 1e-5
#: Shares from which the half of a cut word is a word of its own, and from which a whole is well known.
HALF, WHOLE = 2e-5, 4e-6
#: Cost of a word that was never seen, without and with each of its letters; and of two words run together.
UNSEEN, UNSEEN_LETTER, RUN_TOGETHER = 16.0, 0.3, 6.0
#: Longest paragraph length (characters) that counts as short, and what a paragraph that short costs.
SHORT_PARAGRAPH, SHORT_COST = 25, 1.0

#: What recognisers confuse, as read and as printed; the same in both directions.
CONFUSED = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("ri", "n"), ("nn", "m"), ("lc", "k"), ("ni", "m"), ("iii", "m"), ("in", "m"), ("r1", "n"), ("c1", "d"), ("c|", "d"), ("1i", "h"), ("l1", "h"), ("|i", "h"), ("l|", "h"), ("tt", "h")]

HYPHENS = "-‐‑‒–—¬­"
WORD_EDGE = " \t\r\n.,;:!?“”„«»()[]’‘\"'…¿¡‚‹›·•"
TOKEN = regex.compile(r"\S+")
LINE_END = regex.compile(r"\r\n|\r|\n")
LETTER = regex.compile(r"\p{L}")
NUMERAL = regex.compile(r"\p{N}")
NUMBER_BODY = regex.compile(r"[\dOoQDlI|!iSsBZzGg.,:/%]+")
CODE = regex.compile(r"\p{Lu}\d+")
CODE_LIKE = regex.compile(r"\p{Lu}[\dOolI|SBZ]+")
PAGE_WORD = r"(?:p|pp|page|pages|pag|pagina|página|pág|seite|s|blatt|feuille|folio|f)"
DIGITS = r"[\dOoQlI|!SsBZzgq]{1,5}"
ROMAN = r"[ivxlcdmIVXLCDM1!|]{1,9}"
PAGE_NUMBER = regex.compile(rf"^[\W_]*(?:{PAGE_WORD}\.?\s*)?(?:{DIGITS}|{ROMAN})(?:\s*(?:/|of|von|de|sur|-|–)\s*(?:{DIGITS}|{ROMAN}))?[\W_]*$", regex.I)
HEADING = regex.compile(r"^\s*\p{L}{3,12}\S?\s+[\dOolI|SBZ]{1,3}\s*(?::|\r?\n|$)")
FOOTNOTE = regex.compile(r"^\s*[\dOlI|]{1,3}[.)]?\s+\S")
CELL = regex.compile(r"^[\W\d\sOolI|SBZ%€$£]*$")
STOP = regex.compile(r"[.!?。！？][\"'”’»›)\]“]*\s*$")
TERMINAL = regex.compile(r"[.!?…:。！？][\"'”’»›)\]“]*\s*$")


def in_margin(top: float | None, page_height: float = PAGE_HEIGHT) -> bool:
    """Whether a block stands where marginal lines are printed."""
    return top is not None and not math.isnan(top) and (top < TOP * page_height or top > BOTTOM * page_height)


def kind_of(text: str | None, top: float | None, height: float | None, repeated: bool = False, page_height: float = PAGE_HEIGHT) -> str:
    """page_number, running_line, heading, cell, footnote, blank or body, by place on the page, form, and whether other pages have the like in their margins.

    In the margin a number alone is the page's; so are letters that make a Roman number as front matter has them, greater ones
    only where other margins of the document have such numbers. What repeats there is a running line, and so is what is no running text:
    a whole sentence of several words that no other page has is body.
    """
    if text is None or not text.strip():
        return "blank"
    top = page_height / 2 if top is None or math.isnan(top) else top
    if in_margin(top, page_height):
        t = text.strip()
        if PAGE_NUMBER.match(t):
            value = roman("".join(c for c in t if c.isalnum() or c in "!|"))
            return "page_number" if repeated or any(c.isdigit() for c in t) or value is not None and 0 < value <= ROMAN_PAGES else "running_line"
        if repeated or not (STOP.search(t) and len(TOKEN.findall(t)) >= 6):
            return "running_line"
    elif HEADING.match(text) and len(text) < 90 and not TERMINAL.search(text):
        return "heading"
    if not LETTER.search(text) or len(text) < 12 and CELL.match(text):
        return "cell"
    if top > 0.895 * page_height and FOOTNOTE.match(text):
        return "footnote"
    return "body"


#: Greatest Roman number that is a page's without any other in the margins of the document.
ROMAN_PAGES = 200
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(t: str) -> int | None:
    """Value of a Roman number; None if it is none."""
    values = [ROMAN_VALUES.get(c) for c in t.lower().replace("1", "i").replace("!", "i").replace("|", "i")]
    if not values or None in values:
        return None
    return sum(-v if k + 1 < len(values) and values[k + 1] > v else v for k, v in enumerate(values))


def margin_keys(text: str, page: int) -> list[str]:
    """What a marginal block has in common with those of other pages: its letters without numbers and, of a number, how far it is from the page's."""
    t = text.strip()
    out = []
    letters = skeleton("".join(c for c in t if c.isalpha()))
    if PAGE_NUMBER.match(t):
        digits = regex.search(r"\d+", t)
        value = int(digits[0]) if digits else roman("".join(c for c in t if c.isalnum() or c in "!|"))
        if value is not None:
            # Misread Roman numbers do not count on, but stand among others.
            out.append(f"n{value - page}" if digits else "r")
    elif letters:
        # Numbers in a running line change from page to page, and misread digits look like letters.
        words = [w for w in (skeleton(bare(w)) for w in t.split()) if w and not any(c.isdigit() for c in w)]
        out.append("t" + (" ".join(words) or letters))
    return out


def bare(token: str) -> str:
    """A token without the marks around it."""
    return token.strip(WORD_EDGE)


def hyphenated(token: str) -> str | None:
    """The part of a word before the hyphen at a line's end, or None."""
    t = token.rstrip()
    if len(t) > 1 and t[-1] in HYPHENS and (t[-2].isalpha() or t[-2] in "@|0159"):
        return t[:-1].lstrip(WORD_EDGE)
    return None


_CLASS: dict[str, str] = {}
for _group in ("ce", "ft", "1liI|!", "0oOa@Q", "5sS$", "9gq", "8B", "6b", "2zZ"):
    for _c in _group:
        _CLASS.setdefault(_c, _group[0])
_TABLE = str.maketrans(_CLASS)


def skeleton(word: str) -> str:
    """A word with characters that look alike made one."""
    return word.translate(_TABLE).lower().translate(_TABLE)


@functools.lru_cache(maxsize=4_000)
def variants(word: str, most: int = 3) -> tuple[str, ...]:
    """Skeletons of a word as it may have been printed: up to `most` groups of characters exchanged."""
    low = word.lower()
    spots = []
    for i in range(len(low)):
        for a, b in CONFUSED:
            if low.startswith(a, i):
                spots.append((i, len(a), b))
            if low.startswith(b, i):
                spots.append((i, len(b), a))
    out = {skeleton(low)}
    # Of words with very many such places fewer are exchanged at once, so that the work for one word is bounded.
    for n in range(1, min(most, 3 if len(spots) <= 40 else 2 if len(spots) <= 200 else 1) + 1):
        for chosen in combinations(spots, n):
            if any(x[0] + x[1] > y[0] for x, y in zip(chosen, chosen[1:])):
                continue
            parts, at = [], 0
            for i, size, new in chosen:
                parts += [low[at:i], new]
                at = i + size
            out.add(skeleton("".join([*parts, low[at:]])))
    return tuple(sorted(out))


def unmangled(word: str) -> str | None:
    """A word whose letters were decoded in the wrong character set, as it was; or None."""
    if not any("\u0080" <= c for c in word):
        return None
    for wrong in ("latin-1", "cp1252"):
        try:
            right = word.encode(wrong).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if right != word:
            return right
    return None


@dataclass
class Words:
    """Counts of the common words in lower case and, by skeleton, those words; counts of rarer ones that a page asks for."""

    count: dict[str, int]
    total: int = 0
    index: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    memo: dict[str, str | None] = field(default_factory=dict)
    rare: dict[str, int] = field(default_factory=dict)
    read: dict[str, tuple[float, str | None, bool]] = field(default_factory=dict)

    @classmethod
    def of(cls, count: dict[str, int], total: int | None = None) -> Words:
        out = cls(count, total or sum(count.values()))
        for w, n in count.items():
            out.index.setdefault(skeleton(w), []).append((n, w))
        for row in out.index.values():
            row.sort(reverse=True)
        return out

    def __call__(self, word: str) -> int:
        low = word.lower()
        n = self.count.get(low)
        return self.rare.get(low, 0) if n is None else n

    def share(self, word: str) -> float:
        """Share of a word among all words."""
        return self(word) / self.total if self.total else 0.0

    def cost(self, n: int) -> float:
        """Cost of a word seen n times, n > 0: the less, the greater its share."""
        return min(UNSEEN - 0.5, max(1.0, 1.2 + math.log(self.total / n)))

    def printed(self, word: str) -> str | None:
        """What a word was printed as, if it was read otherwise; None if it stands as printed or nothing better is known."""
        low = word.lower()
        if low in self.memo:
            return self.memo[low]
        right = unmangled(word)
        found = right if right and self(right) > self(word) else self._printed(low)
        if len(self.memo) < 200_000:
            self.memo[low] = found
        return found

    def _printed(self, low: str) -> str | None:
        own = self(low)
        best, most = None, 0
        # Short words of letters alone are often words in their own right.
        share = RARE if len(low) > 3 or not low.isalpha() else RARE_SHORT
        for v in variants(low):
            for n, w in self.index.get(v, ()):
                if w != low and n > most and own <= share * n:
                    best, most = w, n
        if best is None and own <= SELDOM * self.total and len(low) >= 5:
            # One character taken for any other.
            for i in range(len(low)):
                for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíáú":
                    w = low[:i] + c + low[i + 1 :]
                    n = self.count.get(w, 0)
                    if n > most and own < n * RARE_ANY and w != low:
                        best, most = w, n
        return best

    def apart(self, core: str) -> tuple[float, tuple[str, ...]] | None:
        """(cost, words) of a token as several common words run together, by dynamic programming over its characters; None if it is not."""
        low, n = core.lower(), len(core)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - 24), j):
                # A letter alone is too little to tell a word by.
                k = self.count.get(low[i:j], 0) if j - i > 1 else 0
                if k and best[i][0] + (c := self.cost(k) + (RUN_TOGETHER if i else 0.0)) < best[j][0]:
                    best[j] = (best[i][0] + c, i)
        if best[n][0] == math.inf or not best[n][1]:
            return None
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        return best[n][0], tuple(core[a:b] for b, a in zip(cuts, cuts[1:]))[::-1]


def misread_number(token: str) -> bool:
    """Whether a number, version or code has letters where digits were printed."""
    t = token.strip(WORD_EDGE + "%")
    if not t or not NUMERAL.search(t) or not LETTER.search(t) and "|" not in t and "!" not in t:
        return False
    if CODE.fullmatch(t):
        return False
    if CODE_LIKE.fullmatch(t):
        return True
    return bool(NUMBER_BODY.fullmatch(t)) and sum(c.isdigit() for c in t) * 2 >= sum(c.isalnum() or c in "|!" for c in t)


@dataclass
class Piece:
    """A word of the decoded stream: text as read, as printed, blocks it starts and ends in, whether a line end cuts it."""

    text: str
    printed: str
    first: int
    last: int
    cut: bool
    wrong: tuple[int, ...] = ()


def _word_cost(core: str, words: Words) -> tuple[float, str | None]:
    """(cost of reading a core word, what it was printed as)."""
    if not LETTER.search(core) or CODE.fullmatch(core) or misread_number(core):
        return 4.0, None
    n = words(core)
    better = words.printed(core)
    if better is None:
        if n:
            return words.cost(n), None
        if "-" in core and all(words(p) for p in core.split("-") if p):
            return 8.0, None
        whole = UNSEEN + UNSEEN_LETTER * len(core)
        if core.isalpha() and (found := words.apart(core)) and found[0] < whole:
            return found[0], " ".join(found[1])
        return whole, None
    return words.cost(max(1, words(better))) + 5.0, better


def _read(core: str, words: Words) -> tuple[float, str | None, bool]:
    """(cost, what a core word was printed as, whether that has other characters); kept for the words met most recently."""
    found = words.read.get(core)
    if found is None:
        cost, better = _word_cost(core, words) if core else (1.0, None)
        # Words run together have the characters that were printed.
        found = cost, better, better is not None and " " not in better or misread_number(core)
        if len(words.read) > 200_000:
            words.read.clear()
        words.read[core] = found
    return found


def _tokens(blocks: list[tuple[int, str]], before: str | None, after: str | None) -> list[tuple[str, int, bool]]:
    """(token, block, last of its line) of the de-lined stream; blocks -1 and -2 stand for what comes before and after."""
    stream: list[tuple[str, int, bool]] = []
    if before is not None:
        stream.append((before, -1, True))
    for k, text in blocks:
        for line in LINE_END.split(text):
            tokens = TOKEN.findall(line)
            stream += [(t, k, i + 1 == len(tokens)) for i, t in enumerate(tokens)]
    if after is not None:
        stream.append((after, -2, True))
    return stream


def asked(blocks: list[tuple[int, str]], common: Container[str], before: str | None = None, after: str | None = None) -> set[str]:
    """Every word outside `common` whose count decode may need, in lower case; what it joins without a hyphen is always common."""
    stream = _tokens(blocks, before, after)
    out: set[str] = set()
    for i, (token, _, ends) in enumerate(stream):
        core = bare(token).lower()
        if core not in common:
            out |= {core, *core.split("-")}
        if ends and (head := hyphenated(token)) is not None:
            head = head.lower()
            out.add(head)
            if i + 1 < len(stream):
                tail = stream[i + 1][0].strip(WORD_EDGE).lower()
                out |= {tail, head + tail, f"{head}-{tail}"}
    out |= {right.lower() for w in list(out) if (right := unmangled(w))}
    return {w for w in out if w not in common and LETTER.search(w)}


def decode(blocks: list[tuple[int, str]], words: Words, before: str | None = None, after: str | None = None) -> list[Piece]:
    """Words of the body blocks (number, text) of a page in reading order.

    `before` is the last token of the body text before the page, `after` the
    first one after it; a word they share with the page is decoded with them.
    Block numbers -1 and -2 stand for these two.
    """
    stream = _tokens(blocks, before, after)
    n = len(stream)
    best = [0.0] + [math.inf] * n
    step: list[Piece | None] = [None] * (n + 1)
    back = [0] * (n + 1)
    for i in range(n):
        token, k, ends = stream[i]
        core = bare(token)
        cost, better, wrong = _read(core, words)
        if best[i] + cost < best[i + 1]:
            best[i + 1] = best[i] + cost
            # A hyphen after what is no word: the rest is missing.
            torn = ends and (part := hyphenated(token)) is not None and words.share(part) < HALF
            if torn:
                wrong = False
            step[i + 1] = Piece(token, token if better is None or torn else token.replace(core, better), k, k, torn, (k,) if wrong else ())
            back[i + 1] = i
        if i + 1 >= n:
            continue
        follow, k2, _ = stream[i + 1]
        if ends:
            head, tail = hyphenated(token), follow.strip(WORD_EDGE)
            if not tail or not (tail[0].isalpha() or tail[0] in "@|0159!"):
                continue
            options = []
            if head is not None and head:
                joined = head + tail
                c, right = _word_cost(joined, words)
                options.append((c + 1.0, joined, right, True))
                # A compound keeps its hyphen if the corpus writes it so.
                pair = f"{head}-{tail}"
                m = words(pair)
                if m:
                    options.append((words.cost(m) - (2.0 if m >= words(joined) else -2.0), pair, None, False))
                elif min(words.share(head), words.share(tail)) > HALF and words(joined) * 1000 < min(words(head), words(tail)):
                    options.append((9.0, pair, None, False))
            elif head is None and LETTER.search(core):
                joined = core + tail
                m = words(joined)
                # Cut without a hyphen: only where the whole is well known and a half is not.
                if words.share(joined) >= WHOLE and token.rstrip()[-1:].isalpha() and (words(core) * 20 < m or words(tail) * 20 < m):
                    options.append((words.cost(m) + 3.0, joined, None, True))
            for c, whole, right, cut in options:
                bad: tuple[int, ...] = ()
                if right is not None and head is not None:
                    bad = (k2,) if right.startswith(head.lower()) else (k,) if right.endswith(tail.lower()) else (k, k2)
                if best[i] + c < best[i + 2]:
                    best[i + 2] = best[i] + c
                    shown = whole if right is None else right
                    tail_marks = follow[follow.find(tail) + len(tail) :]
                    lead = token[: token.find(head)] if head and head in token else ""
                    step[i + 2] = Piece(whole, lead + shown + tail_marks, k, k2, cut, bad)
                    back[i + 2] = i
        else:
            # A word split by a blank: the whole is well known, and its parts are not.
            joined = core + follow.strip(WORD_EDGE)
            if token[-1:].isalpha() and follow[:1].isalpha() and words.share(joined) >= WHOLE and max(words(core), words(follow.strip(WORD_EDGE))) * 20 < words(joined):
                c = words.cost(words(joined)) + 4.0
                if best[i] + c < best[i + 2]:
                    best[i + 2] = best[i] + c
                    step[i + 2] = Piece(joined, token + follow, k, k2, False)
                    back[i + 2] = i
    out = []
    i = n
    while i:
        out.append(step[i])
        i = back[i]
    return out[::-1]


def seam_costs(ended: bool, lower: bool, wide: bool = False, headed: bool = False, cut: bool = False) -> tuple[float, float]:
    """(cost of going on, cost of breaking) between a body block and the one before it.

    Breaking is free after a finished sentence (`ended`) and costs in the middle of
    one or before a small letter (`lower`); going on costs where a sentence ended,
    the gap is `wide` or a heading stands between. None is broken within a `cut` word.
    """
    join = (6.0 if ended else 0.0) + (2.0 if wide else 0.0) + (5.0 if headed else 0.0)
    split = (0.0 if ended else 4.0) + (6.0 if lower else 0.0) + (50.0 if cut else 0.0)
    return join, split


def goes_on(ended: bool, lower: bool, wide: bool = False, headed: bool = False, cut: bool = False) -> bool:
    """Whether a block goes on with the paragraph of the body block before it, told by their seam alone."""
    join, split = seam_costs(ended, lower, wide, headed, cut)
    return join <= split


def _lower(text: str) -> bool:
    return text.lstrip()[:1].islower()


def paragraph_starts(pieces: list[Piece], blocks: list[tuple[int, str, float, float]], headed: frozenset[int] = frozenset()) -> list[bool]:
    """For each body block whether a paragraph begins with it; `headed` are the numbers of blocks right after a heading.

    Dynamic programming over the blocks: a way to part them costs its seams and, for each paragraph,
    what a paragraph of its length costs, so a short rest goes on where the seam alone would not say.
    """
    n = len(blocks)
    if not n:
        return []
    spans = {p.first for p in pieces if p.first != p.last and p.first >= 0}
    gaps = [blocks[i][2] - blocks[i - 1][2] - blocks[i - 1][3] for i in range(1, n)]
    usual = sorted(gaps)[len(gaps) // 2] if gaps else 0.0
    seams = [(0.0, 0.0)]
    for i in range(1, n):
        prev, text = blocks[i - 1], blocks[i]
        seams.append(seam_costs(bool(TERMINAL.search(prev[1])), _lower(text[1]), gaps[i - 1] > 2.5 * max(usual, 1.0), text[0] in headed, prev[0] in spans))
    # State of a block: length of its paragraph so far, as far as it matters for the cost, with the cheapest way there.
    states: dict[int, tuple[float, tuple | None]] = {min(len(blocks[0][1]), SHORT_PARAGRAPH): (0.0, None)}
    for i in range(1, n):
        join, split = seams[i]
        size = len(blocks[i][1])
        new: dict[int, tuple[float, tuple | None]] = {}
        for length, (cost, path) in states.items():
            ended = cost + split + (SHORT_COST if length < SHORT_PARAGRAPH else 0.0)
            for key, c, begins in ((min(length + size, SHORT_PARAGRAPH), cost + join, False), (min(size, SHORT_PARAGRAPH), ended, True)):
                if key not in new or c < new[key][0]:
                    new[key] = (c, (begins, path))
        states = new
    _, path = min(((c + (SHORT_COST if length < SHORT_PARAGRAPH else 0.0), p) for length, (c, p) in states.items()), key=lambda x: x[0])
    out: list[bool] = []
    while path:
        begins, path = path
        out.append(begins)
    return [not _lower(blocks[0][1]), *out[::-1]]


def _first_last(text: str) -> tuple[str | None, str | None]:
    tokens = TOKEN.findall(text)
    return (tokens[0], tokens[-1]) if tokens else (None, None)


def _count(rows: DataFrame) -> DataFrame:
    """(word, n) over all body blocks; words at line ends with a hyphen are left out, as are their other halves and what stands in margins."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for pdf in batches:
            for text, top, height in zip(pdf["text"], pdf["top_y"], pdf["height"]):
                if in_margin(top) or kind_of(text, top, height) != "body":
                    continue
                open_ = False
                for line in LINE_END.split(text):
                    tokens = TOKEN.findall(line)
                    for i, t in enumerate(tokens):
                        if i == 0 and open_:
                            continue
                        if i + 1 == len(tokens) and hyphenated(t) is not None:
                            continue
                        w = bare(t).lower()
                        if LETTER.search(w):
                            counts[w] += 1
                    open_ = bool(tokens) and hyphenated(tokens[-1]) is not None
            if len(counts) > 300_000:
                yield pd.DataFrame(list(counts.items()), columns=["word", "n"])
                counts = Counter()
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])

    return rows.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, common: float = COMMON) -> tuple[Words, DataFrame]:
    """(the word model of the common words, counts of the rarer ones) over all body text."""
    counts = materialize(_count(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = common * total
    # At most one over `common` words have that share.
    top = fetch(counts.filter(F.col("n") >= least))
    return Words.of(dict(zip(top.word, (int(n) for n in top.n))), int(total)), counts.filter(F.col("n") < least)


#: One page, or slice of one, with what its margins share with other pages.
PAGES = "origin string, doc_id bigint, page int, slice int, blocks array<struct<idx:int,text:string,kind:string,top_y:double,height:double>>, head string, tail string, led boolean, tailed boolean"
#: Stands for a null in a key while pages are put together.
NONE = -(2**31)
#: Blocks of a page that are decoded at once; what claims to be a longer page is cut.
SLICE = 1000
#: Pages of one group that a window sorts at once; what groups hand on to one another is one row each.
GROUP = 1000


def _repeated(rows: DataFrame) -> DataFrame:
    """(origin, doc_id, page, slice, again): numbers of the marginal blocks of a page that have their like on another page of the document."""
    margin = rows.filter((F.col("top_y") < TOP * PAGE_HEIGHT) | (F.col("top_y") > BOTTOM * PAGE_HEIGHT)).filter(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf[["origin", "doc_id", "page", "idx"]].assign(key=[margin_keys(t, p) for t, p in zip(pdf["text"], pdf["page"])])
            yield at.explode("key").dropna(subset=["key"])

    keys = margin.select("origin", "doc_id", "page", "idx", "text").mapInPandas(run, "origin string, doc_id bigint, page int, idx int, key string")
    keys = materialize(keys.select(F.xxhash64("origin", "doc_id", "key").alias("what"), "*"))
    # Pages are counted, not blocks: one row for each page and key before they meet.
    shared = keys.select("what", "page").distinct().groupBy("what").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    again = join_groups(keys, shared, "what", "pages", keys.count())
    return again.groupBy("origin", "doc_id", "page", _slice()).agg(F.collect_set("idx").alias("again"))


def _slice() -> Column:
    return F.floor(F.col("idx") / SLICE).cast("int").alias("slice")


def _pages(rows: DataFrame) -> DataFrame:
    """One row per page (or slice of SLICE blocks) with its blocks in reading order, kinds, the first and last token of its body text, and whether headings stand before and after that."""
    place = ["origin", "doc_id", "page", "slice"]
    grouped = rows.groupBy("origin", "doc_id", "page", _slice()).agg(F.collect_list(F.struct("idx", "text", "top_y", "height")).alias("blocks"))
    grouped = grouped.join(_repeated(rows), place, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for origin, doc, page, part, blocks, again in pdf.itertuples(index=False):
                seen = set() if again is None else set(again)
                ordered = sorted((dict(b) if isinstance(b, dict) else b.asDict() for b in blocks), key=lambda b: b["idx"])
                for b in ordered:
                    b["kind"] = kind_of(b["text"], b["top_y"], b["height"], b["idx"] in seen)
                body = [b["text"] for b in ordered if b["kind"] == "body"]
                head = _first_last(body[0])[0] if body else None
                tail = _first_last(body[-1])[1] if body else None
                kinds = [b["kind"] for b in ordered]
                at = [i for i, kind in enumerate(kinds) if kind == "body"] or [len(kinds), -1]
                led, tailed = "heading" in kinds[: at[0]], "heading" in kinds[at[-1] + 1 :]
                out.append((origin, doc, page, part, [{k: b[k] for k in ("idx", "text", "kind", "top_y", "height")} for b in ordered], head, tail, led, tailed))
            yield pd.DataFrame(out, columns=["origin", "doc_id", "page", "slice", "blocks", "head", "tail", "led", "tailed"])

    return spread(grouped).mapInPandas(run, PAGES)


def _group() -> Column:
    return F.floor(F.col("page").cast("bigint") / GROUP)


def _with_neighbours(pages: DataFrame) -> DataFrame:
    """Adds the last body token before each page, the first one after it, and whether a heading stands between the body text before and that of the page.

    Windows are over groups of GROUP pages, so no task sorts more than that however
    long a document is; one row per group tells what lies in the groups before and after.
    """
    small = pages.select("origin", "doc_id", "page", "slice", "head", "tail", "led", "tailed", _group().alias("group"))
    place = F.struct("page", "slice")
    body, heading = F.when(F.col("tail").isNotNull(), place), F.when(F.col("tailed"), place)
    groups = small.groupBy("origin", "doc_id", "group").agg(F.max(body).alias("body"), F.max(heading).alias("heading"), F.max_by("tail", body).alias("tail"), F.min_by("head", F.when(F.col("head").isNotNull(), place)).alias("head"))
    w = Window.partitionBy("origin", "doc_id").orderBy("group")
    above, below = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    groups = groups.select("origin", "doc_id", "group", F.max("body").over(above).alias("_body"), F.max("heading").over(above).alias("_heading"), F.last("tail", ignorenulls=True).over(above).alias("_tail"), F.first("head", ignorenulls=True).over(below).alias("_head"))
    w = Window.partitionBy("origin", "doc_id", "group").orderBy("page", "slice")
    above, below = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    near = small.withColumns({"before": F.last("tail", ignorenulls=True).over(above), "after": F.first("head", ignorenulls=True).over(below), "body": F.max(body).over(above), "heading": F.max(heading).over(above)})
    near = near.join(groups, ["origin", "doc_id", "group"])
    between = F.coalesce(F.coalesce("heading", "_heading") >= F.coalesce("body", "_body"), F.lit(False))
    near = near.select("origin", "doc_id", "page", "slice", F.coalesce("before", "_tail").alias("before"), F.coalesce("after", "_head").alias("after"), (F.col("led") | between).alias("headed"))
    return pages.drop("led", "tailed").join(near, ["origin", "doc_id", "page", "slice"])


def _stream(blocks: list[dict], before: str | None, after: str | None) -> tuple[list[tuple[int, str]], str | None, str | None]:
    """(body blocks, word before and after them that a line end of the page may cut)."""
    body = [(b["idx"], b["text"]) for b in blocks if b["kind"] == "body"]
    # The word before belongs to the page only if it was cut there.
    lead = before if before and hyphenated(before) is not None else None
    trail = after if body and (last := _first_last(body[-1][1])[1]) and hyphenated(last) is not None else None
    return body, lead, trail


def _page_pieces(blocks: list[dict], before: str | None, after: str | None, words: Words) -> tuple[list[tuple[int, str]], list[Piece]]:
    body, lead, trail = _stream(blocks, before, after)
    return body, decode(body, words, lead, trail) if body else []


def _with_rare(pages: DataFrame, words: Words, rarer: DataFrame) -> DataFrame:
    """Adds rare: counts of the words of a page that are not common, which every task knows.

    A word that is not common stands on few of all pages, so no key of this join is hot.
    """
    place = ["origin", "doc_id", "page", "slice"]
    known = pages.sparkSession.sparkContext.broadcast(words.count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = known.value
        for pdf in batches:
            found = []
            for blocks, before, after in zip(pdf["blocks"], pdf["before"], pdf["after"]):
                body, lead, trail = _stream(list(blocks), before, after)
                alone = [(b["idx"], b["text"]) for b in blocks if b["kind"] in ALONE]
                found.append(asked(body, common, lead, trail) | asked(alone, common))
            yield pdf[place].assign(word=[sorted(x) for x in found]).explode("word").dropna(subset=["word"])

    wanted = pages.mapInPandas(run, "origin string, doc_id bigint, page int, slice int, word string")
    got = wanted.join(rarer, "word").groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("rare"))
    return pages.join(got, place, "left")


def _counts(rare) -> dict[str, int]:
    """Counts of a page's rare words as Arrow hands them over: a dictionary, pairs, or nothing."""
    return {} if rare is None else dict(rare)


def _nulls(df: DataFrame) -> DataFrame:
    """Nulls back in the keys."""
    return df.select(*[F.nullif(F.col(c), F.lit(NONE).cast(df.schema[c].dataType)).alias(c) if c in ("doc_id", "page", "idx") else F.col(c) for c in df.columns])


def repair(rows: DataFrame, common: float = COMMON) -> tuple[DataFrame, Words]:
    """(pages with neighbours and counts of their rare words, word model) of block rows (origin, doc_id, page, idx, text, top_y, height)."""
    keys = [F.coalesce(c, F.lit(NONE).cast(kind)).alias(c) for c, kind in (("doc_id", "bigint"), ("page", "int"), ("idx", "int"))]
    rows = materialize(spread(rows.select(F.coalesce("origin", F.lit("")).alias("origin"), *keys, "text", "top_y", "height")))
    words, rarer = train(rows, common)
    pages = materialize(_with_neighbours(materialize(_pages(rows))))
    return _with_rare(pages, words, rarer), words


def defects(rows: DataFrame, common: float = COMMON) -> DataFrame:
    """(origin, doc_id, page, idx, defect) of the blocks affected by page layout or recogniser.

    Expects one row per (origin, doc_id, page, idx). Null and blank blocks are
    no case; a null position counts as the middle of the page; rows of a null page
    are one page; an empty table gives an empty one.
    """
    pages, words = repair(rows, common)
    shared = rows.sparkSession.sparkContext.broadcast((words.count, words.total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Words.of(*shared.value)
        for pdf in batches:
            out = []
            for origin, doc, page, blocks, before, after, rare in zip(*(pdf[c] for c in ("origin", "doc_id", "page", "blocks", "before", "after", "rare"))):
                model.rare = _counts(rare)
                found: set[tuple[int, str]] = set()
                for b in blocks:
                    if b["kind"] in ("page_number", "running_line"):
                        found.add((b["idx"], b["kind"]))
                for p in _page_pieces(list(blocks), before, after, model)[1]:
                    if p.cut and p.first >= 0:
                        found.add((p.first, "broken_word"))
                    found |= {(k, "misread") for k in p.wrong if k >= 0}
                out += [(origin, doc, page, k, d) for k, d in sorted(found)]
            yield pd.DataFrame(out, columns=["origin", "doc_id", "page", "idx", "defect"])

    return _nulls(pages.mapInPandas(run, "origin string, doc_id bigint, page int, idx int, defect string"))


def _alone(block: dict, words: Words) -> str:
    """The text of a heading, cell or footnote in one line; cells hold no words to decode."""
    if block["kind"] == "cell":
        return " ".join(TOKEN.findall(block["text"]))
    return " ".join(p.printed for p in decode([(block["idx"], block["text"])], words))


FRAGMENTS = "origin string, doc_id bigint, page int, slice int, para_no int, kind string, continues boolean, text string"


def _fragments(rows: DataFrame) -> DataFrame:
    """(origin, doc_id, page, slice, para_no, kind, continues, text): paragraphs of each page, nulls in keys as NONE."""
    pages, words = repair(rows)
    shared = rows.sparkSession.sparkContext.broadcast((words.count, words.total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Words.of(*shared.value)
        for pdf in batches:
            out = []
            for origin, doc, page, part, blocks, before, after, headed, rare in zip(*(pdf[c] for c in ("origin", "doc_id", "page", "slice", "blocks", "before", "after", "headed", "rare"))):
                model.rare = _counts(rare)
                blocks = list(blocks)
                body, pieces = _page_pieces(blocks, before, after, model)
                at = {b["idx"]: b for b in blocks}
                lines = [(k, t, at[k]["top_y"] or 0.0, at[k]["height"] or 0.0) for k, t in body]
                under, seen = set(), False
                for b in blocks:
                    if b["kind"] == "body":
                        under |= {b["idx"]} if seen else set()
                        seen = False
                    seen = seen or b["kind"] == "heading"
                starts = dict(zip((k for k, _ in body), paragraph_starts(pieces, lines, frozenset(under))))
                if body:
                    starts[body[0][0]] = before is None or not goes_on(bool(TERMINAL.search(before)), _lower(body[0][1]), headed=headed)
                texts: list[tuple[int, bool, list[str]]] = []
                opened: set[int] = set()
                for p in pieces:
                    if p.first == -2 or p.first == -1 and p.last == -1:
                        continue
                    if p.first == -1:
                        # Its beginning, and so the whole word, is on the page before.
                        opened.add(p.last)
                        texts.append((p.last, True, []))
                        continue
                    if p.first not in opened:
                        opened.add(p.first)
                        if starts.get(p.first, True) or not texts:
                            texts.append((p.first, not starts.get(p.first, True), []))
                    texts[-1][2].append(p.printed)
                units = [(k, "body", go, " ".join(ws)) for k, go, ws in texts if ws]
                units += [(b["idx"], b["kind"], False, _alone(b, model)) for b in blocks if b["kind"] in ALONE]
                out += [(origin, doc, page, part, i + 1, *unit[1:]) for i, unit in enumerate(sorted(units, key=lambda u: u[0]))]
            yield pd.DataFrame(out, columns=["origin", "doc_id", "page", "slice", "para_no", "kind", "continues", "text"])

    return pages.mapInPandas(run, FRAGMENTS)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(origin, doc_id, page, para_no, kind, continues, text): clean paragraphs of each page in order.

    Headings, cells and footnotes are paragraphs of their own, told by `kind`; a
    body paragraph stands where its first block does. Only margins and blanks are left out.
    `continues` tells that the first body paragraph of a page (or of a slice of it, where
    para_no starts again) goes on from the body text before; `continuous` joins these.
    A word cut by the end of a page stands whole where it begins.
    """
    return _nulls(_fragments(rows).drop("slice"))


def continuous(rows: DataFrame) -> DataFrame:
    """(origin, doc_id, para_no, page, kind, text): clean paragraphs of each document, whole across pages.

    para_no counts through the document, in order of where paragraphs begin; page is
    the one a paragraph begins on. Headings, cells and footnotes met on the way come after it.
    """
    parts = materialize(_fragments(rows).withColumn("group", _group()))
    opens = (F.col("kind") == "body") & ~F.col("continues")
    begins = (F.col("kind") != "body") | opens
    w = Window.partitionBy("origin", "doc_id", "group").orderBy("page", "slice", "para_no").rowsBetween(Window.unboundedPreceding, 0)
    # Within a group: how many paragraphs began so far, and the number of the body paragraph that is open.
    parts = parts.withColumn("n", F.sum(begins.cast("bigint")).over(w)).withColumn("open", F.last(F.when(opens, F.col("n")), ignorenulls=True).over(w))
    groups = parts.groupBy("origin", "doc_id", "group").agg(F.max("n").alias("n"), F.max("open").alias("open"))
    w = Window.partitionBy("origin", "doc_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_n", F.coalesce(F.sum("n").over(w), F.lit(0)))
    groups = groups.select("origin", "doc_id", "group", "_n", F.coalesce(F.max(F.col("_n") + F.col("open")).over(w), F.lit(0)).alias("_open"))
    number = F.when(begins, F.col("_n") + F.col("n")).otherwise(F.coalesce(F.col("_n") + F.col("open"), F.col("_open")))
    parts = parts.join(groups, ["origin", "doc_id", "group"]).withColumn("number", number)
    place = F.struct("page", "slice", "para_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "slice", "para_no", "text"))), lambda x: x["text"]), " ")
    whole = parts.groupBy("origin", "doc_id", F.col("number").alias("para")).agg(F.min("page").alias("page"), F.min_by("kind", place).alias("kind"), text.alias("text"))
    return _nulls(whole.select("origin", "doc_id", F.col("para").alias("para_no"), "page", "kind", "text"))
