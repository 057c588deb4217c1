"""From the words of a page to its text blocks: lines, blocks, merges, roles and regions.

What is merged next depends on what was merged before, so each page is one fold in Python;
paper bounds its input. Words come with boxes (origin at the bottom left), font, size and colour.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import spread
from quire.settings import LAYOUT, Layout

_HYPHEN = regex.compile(r"\s*[-‐‑‒–﹣－­]\s*$")
_STOP = regex.compile(r"[.!?。！？]\s*$")
_OPEN_END = regex.compile(r"[^.!?。！？:：;；)\]}\"'\s]\s*$")
_OPEN_START = regex.compile(r"\s*(?:[\p{Ll}\p{Nd})\]}\"',.;:!?]|(?i:and|or|but|that|which|who) )")
_CAPITAL = regex.compile(r"\s*[\"'(\[{]*[\p{Lu}㐀-䶿一-鿿豈-﫿぀-ヿ＀-￯　-〿]")
_SMALL = regex.compile(r"\s*[\"'(\[{]*\p{Ll}")
_WIDE = regex.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿ＀-￯　-〿]")
_LISTED = regex.compile(r"\s*(?:(?:\p{Nd}{1,3}[.)、]|[(（]\p{Nd}{1,3}[)）])|[•\-·◦▪■★→►▸‣⦿⁃]|[a-zA-Z][.)])\s")
_ONE_WIDTH = regex.compile(r"courier|consolas|mono|menlo|fira code|source code|jetbrains|inconsolata|hack")
_MARKS = ("()", "{}", "[]", "=>", "->", "::", "//", "/*", "#include", "import ", "def ", "class ", "function ")


@dataclass(frozen=True)
class Word:
    """A word with its box and the look of its letters; `letters` is their number, 0 where nothing is known of them."""

    text: str
    l: float
    r: float
    t: float
    b: float
    font: str = ""
    size: float = 0.0
    letters: int = 0
    bold: bool = False
    italic: bool = False

    @property
    def height(self) -> float:
        return max(8.0, self.t - self.b)

    @property
    def width(self) -> float:
        return max(1.0, self.r - self.l)


@dataclass
class Block:
    """A line or what lines were merged into."""

    text: str
    l: float
    r: float
    t: float
    b: float
    lh: float
    align: str
    font: str = ""
    size: float = 0.0
    bold: bool = False
    italic: bool = False
    kind: str = "Normal"
    region: str = "Body"
    lines: int = 1
    formula: bool | None = field(default=None, compare=False)

    @property
    def width(self) -> float:
        return self.r - self.l

    def merged(self, other: Block) -> Block:
        """Both in one: hyphen-aware text, common box, taller line, the first one's alignment, type and region, and its style unless that is unknown."""
        style = other if (not self.font.strip() and other.font.strip()) or (self.size <= 0 < other.size) else self
        return replace(
            self, text=joined(self.text, other.text), l=min(self.l, other.l), r=max(self.r, other.r), t=max(self.t, other.t), b=min(self.b, other.b), lh=max(self.lh, other.lh),
            font=style.font, size=style.size, bold=style.bold, italic=style.italic, lines=self.lines + other.lines, formula=None,
        )


def joined(a: str, b: str) -> str:
    """Two texts in one, without the hyphen between them."""
    a, b = a.rstrip(), b.lstrip()
    if not a or not b:
        return a or b
    return _HYPHEN.sub("", a) + b if _HYPHEN.search(a) else f"{a} {b}"


def line_text(words: list[Word]) -> str:
    """Words of a line in order: no blank between ideographs or at a hyphen, two at a wide gap."""
    out = words[0].text
    for before, word in zip(words, words[1:]):
        letter = (before.width + word.width) / max(1, len(before.text) + len(word.text))
        if _HYPHEN.search(before.text):
            out = _HYPHEN.sub("", out) + (word.text.lstrip() if _SMALL.match(word.text) else word.text)
        elif before.text and word.text and _WIDE.match(before.text[-1]) and _WIDE.match(word.text[0]):
            out += word.text
        else:
            out += ("  " if word.l - before.r > letter * 2.5 else " ") + word.text
    return out


def line_height(words: list[Word]) -> float:
    """Height of a line from the sizes of its letters and their boxes; eight at least where little is known."""
    known = [w for w in words if w.letters]
    sizes = [(w.size, w.letters) for w in known if w.size > 0]
    if not sizes:
        return max(8.0, sum(w.height for w in words) / len(words))
    size = sum(s * n for s, n in sizes) / sum(n for _, n in sizes)
    heights = [(w.t - w.b, w.letters) for w in known if w.t > w.b]
    if heights:
        return max(sum(h * n for h, n in heights) / sum(n for _, n in heights), size * 1.15)
    return max(8.0, size * 1.2)


def in_rows(words: list[Word]) -> bool:
    """Whether the words of a line stand in columns: two or more gaps of half again a word's mean width that are 30 % of all."""
    ordered = sorted(words, key=lambda w: w.l)
    gaps = [b.l - a.r for a, b in zip(ordered, ordered[1:])]
    if len(gaps) < 2:
        return False
    mean = sum(w.r - w.l for w in words) / len(words)
    large = sum(g > mean * 1.5 for g in gaps)
    return large >= 2 and large >= 0.3 * len(gaps)


def kind_of(words: list[Word], text: str) -> str:
    """ListItem, Code, TableRow or Normal."""
    if _LISTED.match(text.strip()):
        return "ListItem"
    letters = sum(w.letters for w in words)
    mono = sum(w.letters for w in words if _ONE_WIDTH.search(w.font.lower()))
    indent = len(text) - len(text.lstrip())
    if letters and mono / letters > 0.7 or indent >= 4 and any(m in text for m in _MARKS):
        return "Code"
    return "TableRow" if in_rows(words) else "Normal"


def align_of(l: float, r: float, page_width: float) -> str:
    """Center, Right or Left by the space at both sides."""
    left, right, near = l, page_width - r, page_width * 0.03
    uneven = abs(left - right)
    if uneven < near:
        return "Center"
    if right < near and left > page_width * 0.15:
        return "Right"
    if left < near or left < page_width * 0.12 and right > page_width * 0.1:
        return "Left"
    return "Center" if (r - l) / page_width < 0.6 and uneven < page_width * 0.08 else "Left"


def style_of(words: list[Word]) -> tuple[str, float, bool, bool]:
    """(font, mean size, bold, italic) most letters have; of equally frequent fonts the first, letter case aside."""
    fonts: Counter[str] = Counter()
    first: dict[str, str] = {}
    for w in words:
        if w.font.strip() and w.letters:
            fonts[w.font.lower()] += w.letters
            first.setdefault(w.font.lower(), w.font)
    sizes = [(w.size, w.letters) for w in words if w.size > 0 and w.letters]
    total = sum(w.letters for w in words)
    mean = sum(s * n for s, n in sizes) / sum(n for _, n in sizes) if sizes else 0.0
    most = lambda flag: sum(w.letters for w in words if flag(w)) > total // 2
    return first[max(fonts, key=fonts.get)] if fonts else "", mean, most(lambda w: w.bold), most(lambda w: w.italic)


def lines_of(words: list[Word], page_width: float) -> list[Block]:
    """Lines of a column from the top: a word joins the first line whose mean bottom is near its own."""
    lines: list[list[Word]] = []
    means: list[float] = []
    for w in sorted(words, key=lambda w: (-w.t, w.l)):
        low, reach = w.b, max(3.0, w.height * 0.4)
        at = next((k for k, mean in enumerate(means) if -reach < mean - low < reach), -1)
        if at < 0:
            lines.append([w])
            means.append(low)
        else:
            lines[at].append(w)
            means[at] += (low - means[at]) / len(lines[at])
    out = []
    for line in sorted((sorted(x, key=lambda w: w.l) for x in lines), key=lambda x: -max(w.t for w in x)):
        text = line_text(line)
        if text.strip():
            l, r, t, b = min(w.l for w in line), max(w.r for w in line), max(w.t for w in line), min(w.b for w in line)
            font, size, bold, italic = style_of(line)
            out.append(Block(text, l, r, t, b, line_height(line), align_of(l, r, page_width), font, size, bold, italic, kind_of(line, text)))
    return out


def _shared(a: Block, b: Block) -> float:
    return (min(a.r, b.r) - max(a.l, b.l)) / max(1.0, min(a.width, b.width))


def _ends_paragraph(prev: Block, line: Block, height: float, page_width: float) -> bool:
    """Whether a line starts a paragraph after a block that ended a sentence: by its indent, or by that block being short."""
    short = prev.width < max(page_width * 0.3, line.width * 0.82)
    if not _STOP.search(prev.text):
        return False
    if _CAPITAL.match(line.text) and (line.l - prev.l > height * 0.8 or short):
        return True
    return abs(prev.l - line.l) < max(12.0, height) and short and prev.b - line.t > height * 0.2


def joins_line(prev: Block, line: Block, page_width: float, settings: Layout = LAYOUT) -> bool:
    """Whether a line belongs to the block above it."""
    height = max(prev.lh, line.lh)
    near = abs((prev.t + prev.b) - (line.t + line.b)) / 2 < height * 1.9
    beside = _shared(prev, line) > 0.45 or abs(prev.l - line.l) < max(12.0, line.lh) or abs(prev.r - line.r) < max(18.0, line.lh * 1.5)
    alike = prev.kind == line.kind or "Normal" in (prev.kind, line.kind)
    gap = prev.b - line.t
    open_ = prev.kind not in ("TableRow", "ListItem", "Code") and -2 <= gap <= height * settings.line_gap
    return near and beside and alike and open_ and not _ends_paragraph(prev, line, height, page_width)


def is_formula(block: Block, judge) -> bool:
    """Whether a block is nothing but a formula, asked once for each text."""
    if block.formula is None:
        block.formula = judge(block.text)
    return block.formula


def joins_block(prev: Block, cur: Block, page_width: float, judge) -> bool:
    """Whether two blocks in reading order are one: of like type, size and column, near each other, and one going on from the other."""
    if is_formula(prev, judge) or is_formula(cur, judge):
        return False
    if "Normal" not in (prev.kind, cur.kind) and prev.kind != cur.kind or prev.region != cur.region:
        return False
    height, gap = max(prev.lh, cur.lh), prev.b - cur.t
    close = -2 <= gap < height * 1.5
    if prev.kind == cur.kind == "Code":
        return close
    if prev.kind == cur.kind == "TableRow":
        return False
    if not 0.67 <= max(prev.size, 1.0) / max(cur.size, 1.0) <= 1.5:
        return False
    left = abs(prev.l - cur.l) < max(14.0, height * 1.2)
    column = _shared(prev, cur) > 0.55 or left or abs(prev.r - cur.r) < max(20.0, height * 1.8)
    if column and close and _HYPHEN.search(prev.text) and _SMALL.match(cur.text):
        return True
    indented = abs(prev.l - cur.l) > height * 1.5 and prev.width < page_width * 0.7
    if indented and not left:
        return False
    ended = bool(_STOP.search(prev.text))
    short = prev.width < max(page_width * 0.3, cur.width * 0.82)
    if ended and _CAPITAL.match(cur.text) and (indented or short or gap > height * 0.25):
        return False
    goes_on = bool(_OPEN_END.search(prev.text) or _OPEN_START.match(cur.text))
    if close and goes_on and column:
        return True
    if not (column and close and prev.align == cur.align):
        return False
    if prev.align == "Center" and max(prev.width, cur.width) < page_width * 0.85:
        return True
    even = abs(prev.lh - cur.lh) < height * 0.3
    if ended:
        return cur.text.lstrip()[:1].islower() or min(prev.width, cur.width) > page_width * 0.45 and even and goes_on
    return even


def lies_below(prev: Block, cur: Block, height: float, settings: Layout = LAYOUT) -> bool:
    """Whether two blocks lie as lines of one paragraph do (the rule of goes_on_below)."""
    s = settings
    if _shared(prev, cur) > s.overlap or abs(prev.l - cur.l) < max(18.0, height * s.left_align) or abs(prev.r - cur.r) < max(26.0, height * s.right_align):
        return True
    if min(prev.width, cur.width) <= height * s.min_width:
        return False
    related = max(24.0, height * s.range_relation)
    beside = cur.l - prev.r < max(28.0, height * s.horizontal_gap) and cur.r > prev.l + related and prev.r > cur.l - related
    return beside or cur.l <= prev.r + max(42.0, height * s.wrap_forward) and cur.r >= prev.l + max(30.0, height * s.wrap_backward)


def continues(prev: Block, cur: Block, judge, settings: Layout = LAYOUT) -> bool:
    """Whether a plain block goes on from the plain one before it on the page, in the middle of a sentence."""
    for x in (prev, cur):
        if x.kind != "Normal" or not x.text.strip() or x.region == "Margin" or is_formula(x, judge):
            return False
    height, gap = max(prev.lh, cur.lh), prev.b - cur.t
    if prev.region != cur.region or not -2 <= gap <= height * settings.continuation_gap or not lies_below(prev, cur, height, settings):
        return False
    ended = bool(_STOP.search(prev.text))
    if ended and _CAPITAL.match(cur.text):
        return False
    if _HYPHEN.search(prev.text) and _SMALL.match(cur.text):
        return True
    return not ended and bool(_OPEN_START.match(cur.text) or _SMALL.match(cur.text))


def fold(blocks: list[Block], joins) -> list[Block]:
    """Blocks in order, each merged into the one before it where `joins` holds."""
    out: list[Block] = []
    for b in blocks:
        if out and joins(out[-1], b):
            out[-1] = out[-1].merged(b)
        else:
            out.append(b)
    return out


def reading_order(blocks: list[Block]) -> list[Block]:
    """Blocks from the top; those whose tops differ by no more than half a line are one row, from the left."""
    rows: list[list[Block]] = []
    for b in sorted(blocks, key=lambda b: (-b.t, b.l)):
        if rows and abs(rows[-1][0].t - b.t) <= max(rows[-1][0].lh, b.lh) * 0.5:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [b for row in rows for b in sorted(row, key=lambda b: b.l)]


_NAMED = regex.compile(r"(?i:Figure|Fig\.?|Table|Chart|Source|Appendix|Algorithm|图|表|附录|来源)\s*[\p{Nd}A-Za-z.\-:：]")
_PAGED = regex.compile(r"(?i:page\s+\p{Nd}+|\p{Nd}+\s*/\s*\p{Nd}+|\p{Nd}+)")
_NOTED = regex.compile(r"(?:\p{Nd}+[.)]|\*|†|‡|\[\p{Nd}+\])\s")


def with_roles(blocks: list[Block], page_width: float, page_height: float) -> list[Block]:
    """Types and regions once the page is known: captions, running lines, footnotes and titles; margins, and captions that belong to a table."""
    size = lambda b: b.size if b.size > 0 else b.lh
    median = sorted(size(b) for b in blocks)[len(blocks) // 2] if blocks else 0.0
    out = []
    for b in blocks:
        t, kind, region = b.text.strip(), b.kind, "Body"
        top, bottom = b.t / page_height, b.b / page_height
        if _NAMED.match(t):
            kind = region = "Caption"
        elif len(t) <= 24 and (top > 0.9 or bottom < 0.1) and (_PAGED.fullmatch(t) or len(t) <= 18):
            kind = region = "HeaderFooter"
        elif bottom < 0.18 and size(b) <= median * 0.92 and (_NOTED.match(t) or len(t) <= 100):
            kind = region = "Footnote"
        elif len(t) <= 80 and b.width < page_width * 0.8 and not _STOP.search(b.text) and (b.align == "Center" or top > 0.58 and size(b) >= median * 1.15):
            kind = "Title"
        middle = (b.l + b.r) / 2
        if kind == "TableRow":
            region = "Table"
        elif region == "Body" and not 0.12 * page_width <= middle <= 0.88 * page_width and b.width < page_width * 0.22 and len(t) <= 60 and b.t > page_height * 0.08 and b.b < page_height * 0.92:
            region = "Margin"
        out.append(replace(b, kind=kind, region=region))
    rows = [b for b in out if b.kind == "TableRow"]
    near = lambda c, b: abs((b.t + b.b) - (c.t + c.b)) / 2 < 6 * max(c.lh, b.lh) and _shared(c, b) > 0.2
    return [replace(b, region="Table") if b.kind == "Caption" and any(near(b, x) for x in rows) else b for b in out]


def page_of(columns: list[list[Word]], page_width: float, page_height: float, judge, settings: Layout = LAYOUT) -> list[Block]:
    """Blocks of a page from the words of its columns."""
    made = [b for words in columns for b in fold(lines_of(words, page_width), lambda p, c: joins_line(p, c, page_width, settings))]
    return with_roles(fold(reading_order(made), lambda p, c: joins_block(p, c, page_width, judge)), page_width, page_height)


_BLOCK = [("text", T.StringType()), *[(k, T.DoubleType()) for k in "lrtb"], ("lh", T.DoubleType()), ("align", T.StringType()), ("font", T.StringType()), ("size", T.DoubleType()), ("bold", T.BooleanType()), ("italic", T.BooleanType()), ("kind", T.StringType()), ("region", T.StringType()), ("lines", T.IntegerType())]


def formula_judge():
    """Whether a text is nothing but a formula, in Python: the rule of formula_flags for the folds."""
    from quire.functions.formula import analyse

    memo: dict[str, bool] = {}

    def judge(text: str) -> bool:
        if text not in memo:
            if len(memo) > 50_000:
                memo.clear()
            memo[text] = analyse(text)[0]
        return memo[text]

    return judge


def words_of(words: DataFrame) -> list:
    """Columns of a word as the fold expects them; what a table of words lacks is unknown."""
    unknown = {"font": F.lit(""), "size": F.lit(0.0), "letters": F.lit(0), "bold": F.lit(False), "italic": F.lit(False)}
    return ["text", *[F.col(c).cast("double").alias(c) for c in "lrtb"], *[F.coalesce(F.col(n), v).alias(n) if n in words.columns else v.alias(n) for n, v in unknown.items()]]


def build_blocks(pages: DataFrame, keys: list[str], page_width: float, page_height: float, settings: Layout = LAYOUT) -> DataFrame:
    """(keys, idx, text, l, r, t, b, lh, align, font, size, bold, italic, kind, region, lines): blocks of every page in reading order.

    Expects one row per page with `words`, an array of words_of with column_no (as page_columns gives it). A page without words gives no row.
    """
    schema = T.StructType([*[pages.schema[k] for k in keys], T.StructField("idx", T.IntegerType()), *[T.StructField(n, t) for n, t in _BLOCK]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = formula_judge()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                columns: dict[int, list[Word]] = {}
                for w in row[-1]:
                    if w["text"].strip():
                        columns.setdefault(w["column_no"], []).append(Word(w["text"], w["l"], w["r"], w["t"], w["b"], w["font"], float(w["size"]), int(w["letters"]), w["bold"], w["italic"]))
                blocks = page_of([columns[k] for k in sorted(columns)], page_width, page_height, judge, settings)
                out += [(*row[:-1], i, *(getattr(b, n) for n, _ in _BLOCK)) for i, b in enumerate(blocks)]
            yield pd.DataFrame(out, columns=schema.names)

    return spread(pages.select(*keys, "words")).mapInPandas(run, schema)


def merge_continuations(blocks: DataFrame, keys: list[str], settings: Layout = LAYOUT) -> DataFrame:
    """The blocks of build_blocks (or any with idx, text, l, r, t, b, lh, kind, region) with plain ones that go on from another merged into it, page by page."""
    pages = blocks.groupBy(*keys).agg(F.collect_list(F.struct("idx", "text", "l", "r", "t", "b", "lh", "kind", "region")).alias("_blocks"))
    out_fields = [("idx", T.IntegerType()), ("text", T.StringType()), *[(k, T.DoubleType()) for k in "lrtb"], ("lh", T.DoubleType()), ("kind", T.StringType()), ("region", T.StringType()), ("merged", T.IntegerType())]
    schema = T.StructType([*[pages.schema[k] for k in keys], *[T.StructField(n, t) for n, t in out_fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = formula_judge()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                made = [Block(b["text"] or "", b["l"], b["r"], b["t"], b["b"], b["lh"], "Left", kind=b["kind"], region=b["region"]) for b in sorted(row[-1], key=lambda b: b["idx"])]
                for i, b in enumerate(fold(made, lambda p, c: continues(p, c, judge, settings))):
                    out.append((*row[:-1], i, b.text, b.l, b.r, b.t, b.b, b.lh, b.kind, b.region, b.lines))
            yield pd.DataFrame(out, columns=schema.names)

    return spread(pages).mapInPandas(run, schema)
