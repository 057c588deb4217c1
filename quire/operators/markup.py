"""Pages in markup as blocks of styled runs, and places where lines may break."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements that are blocks, give style, or hold no text.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote div section pre td th caption figcaption dt dd title".split())
STYLE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "sup": "superscript", "sub": "subscript", "code": "code"}
SILENT = frozenset(("script", "style", "template"))
VOID = frozenset(("br", "img", "hr", "meta", "link", "input"))
#: Marks that may not begin a line, end one, and after which one may break.
NO_START = "!),.:;?]}。，、；：？！）》」』】〉〗〙〛·…—～"
NO_END = "([{（《「『【〈〖〘〚"
BREAK_AFTER = ",，.。;；!！?？:：、)]}>）》」』】〉…—～\"'"


class _Flattener(HTMLParser):
    """Collects blocks (tag, list depth, marker, runs); tolerant of unclosed elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str, list[tuple[str, str]]]] = []
        self.lists: list[list] = []  # kind, next number
        self.open: list[str] = []
        self.runs: list[tuple[str, str]] = []
        self.tag, self.marker = "p", ""

    def flush(self) -> None:
        if "".join(t for t, _ in self.runs).strip():
            self.blocks.append((self.tag, len(self.lists), self.marker, self.runs))
            self.marker = ""
        self.runs = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 1])
            return
        if tag == "br":
            self.runs.append(("\n", "|".join(self.styles())))
            return
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.flush()
            self.tag = tag
            if tag == "li" and self.lists:
                kind, number = self.lists[-1]
                self.marker = f"{number}." if kind == "ol" else "•"
                self.lists[-1][1] += 1
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            return
        if tag in BLOCKS:
            self.flush()
            self.tag = "p"
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def styles(self) -> list[str]:
        return sorted({STYLE[t] for t in self.open if t in STYLE})

    def handle_data(self, data: str) -> None:
        if not any(t in SILENT for t in self.open):
            self.runs.append((data, "|".join(self.styles())))


def flatten_page(html: str) -> list[tuple[str, int, str, list[tuple[str, str]]]]:
    """Blocks (tag, list depth, list marker, runs of text and style) of a page in order; text of nested blocks is kept."""
    f = _Flattener()
    f.feed(html)
    f.close()
    f.flush()
    return f.blocks


def flatten(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, tag, depth, marker, run_no, text, style): styled runs of all pages; null and blank pages have none."""
    source = pages.select(key, html)
    schema = T.StructType([source.schema[key], *[T.StructField(n, t) for n, t in (("pos", T.IntegerType()), ("tag", T.StringType()), ("depth", T.IntegerType()), ("marker", T.StringType()), ("run_no", T.IntegerType()), ("text", T.StringType()), ("style", T.StringType()))]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (k, i, tag, depth, marker, j, text, style)
                for k, page in zip(pdf.iloc[:, 0], pdf.iloc[:, 1])
                if isinstance(page, str)
                for i, (tag, depth, marker, runs) in enumerate(flatten_page(page), 1)
                for j, (text, style) in enumerate(runs)
            ]
            yield pd.DataFrame(out, columns=schema.names)

    return source.mapInPandas(run, schema)


#: Ideographs and their punctuation, by which a line may part without a blank.
_DENSE = "㐀-䶿一-鿿豈-﫿　-ヿ＀-￯"
#: Places at which a line may part: before a blank; beside an ideograph; after a mark. None leaves a closing mark at a line's start or an opening one at its end.
_SEAM = regex.compile(rf"(?= )|(?![{regex.escape(NO_START)}])(?:(?=[{_DENSE}])|(?<=[{_DENSE}])(?<![{regex.escape(NO_END)}])|(?<=[{regex.escape(BREAK_AFTER)}]))")


def break_at(text: str, start: int, end: int) -> int:
    """Where a line from `start` that has room up to `end` should break: at the last seam of its last third, eight characters at least; else at `end`."""
    if end >= len(text):
        return len(text)
    low = max(start + 1, end - max(8, (end - start) // 3))
    seams = [m.start() for m in _SEAM.finditer(text, low, end + 1) if m.start() <= end]
    return seams[-1] if seams else end


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most `width` characters (one at least); joined they give the text."""
    out, at = [], 0
    while at < len(text):
        end = max(break_at(text, at, at + max(1, width)), at + 1)
        out.append(text[at:end])
        at = end
    return out
