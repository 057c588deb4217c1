"""One consistent form for text that looks alike, and terms seen in it.

Method: characters are brought to their plain width and composed form,
invisible ones are taken out and every kind of space becomes a blank. For each
token the scripts in which each of its characters can be written are intersected:
a token of several scripts is spelt in the one script that all its characters
share, if there is one (mixed-script confusable); a token of one script that
could as well be written in another (whole-script confusable) takes the script
in which the other tokens of the text are written. Accents are never dropped.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import spread

#: Letters of other scripts with the shape of a Latin letter, in pairs.
CYRILLIC = "аa вʙ еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv ԍg ԋn АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҺH ԌG ԚQ ԜW ӀI ѴV ZZ ҮY үy"
GREEK = "αa γy ιi κk νv οo ρp τt υu χx ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo սu հh ոn գq զq ցg յj ԱU ՍU ՕO ՏS ԼL"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᎾO ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ"
COPTIC = "ⲞO ⲟo ⲤC ⲥc ⲢP ⲣp ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲨY ⲬX"

SCRIPTS = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Coptic": COPTIC}
#: Compatibility forms that look different from the plain character and so are kept.
DISTINCT = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>")

TO_LATIN = {pair[0]: pair[1] for listing in SCRIPTS.values() for pair in listing.split() if pair[0] != pair[1]}
SCRIPT_OF = {pair[0]: name for name, listing in SCRIPTS.items() for pair in listing.split() if pair[0] != pair[1]}
FROM_LATIN = {name: {} for name in SCRIPTS}
for _c, _l in TO_LATIN.items():
    FROM_LATIN[SCRIPT_OF[_c]].setdefault(_l, _c)

FOREIGN = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}\p{Script=Cherokee}\p{Script=Coptic}]")
TOKEN = regex.compile(r"[\p{L}\p{M}]+")


class _Plain(dict):
    """Code point to its plain decomposed form; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if c in "\r\n\t\v\f\x85" or kind in ("Zs", "Zl", "Zp") or code in (0x2800, 0x3164, 0x115F, 0x1160, 0xFFA0):
            out = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x17B4, 0x17B5) or 0x180B <= code <= 0x180F:
            out = ""
        elif unicodedata.decomposition(c).startswith(DISTINCT):
            out = c
        else:
            out = unicodedata.normalize("NFKD", c)
            # A compatibility form may bring a space (spacing accents): such a character stays itself.
            if " " in out:
                out = c
        self[code] = out
        return out


_PLAIN = _Plain()


@functools.lru_cache(maxsize=65536)
def _script(c: str) -> str:
    if c in SCRIPT_OF:
        return SCRIPT_OF[c]
    name = unicodedata.name(c, "").split(" ")[0].title()
    return name


def _scripts(c: str) -> frozenset[str]:
    """Scripts in which a character can be written: its own, and those of its look-alikes."""
    own = _script(c)
    if c in TO_LATIN:
        same = {own, "Latin"} | {s for s, m in FROM_LATIN.items() if TO_LATIN[c] in m}
        return frozenset(same)
    if own == "Latin":
        return frozenset({"Latin"} | {s for s, m in FROM_LATIN.items() if c in m})
    return frozenset({own})


def _spell(token: str, script: str) -> str:
    if script == "Latin":
        return "".join(TO_LATIN.get(c, c) for c in token)
    table = FROM_LATIN[script]
    return "".join(c if _script(c) == script else table.get(TO_LATIN.get(c, c), c) for c in token)


@functools.lru_cache(maxsize=262144)
def _resolve(token: str) -> tuple[frozenset[str], frozenset[str]]:
    """(scripts the token's letters are of, scripts in which the whole token can be written)."""
    letters = [c for c in token if not unicodedata.combining(c) and unicodedata.category(c)[0] == "L"]
    own = frozenset(_script(c) for c in letters)
    shared: frozenset[str] | None = None
    for c in letters:
        s = _scripts(c)
        shared = s if shared is None else shared & s
    return own, shared or frozenset()


def respell(text: str, latin_first: bool = False) -> str:
    """Spells each token in one script; the text must be decomposed.

    With `latin_first` a token that could be Latin as a whole is always spelt so,
    whatever stands around it: the form for comparisons, in which no context may
    keep two tokens of one shape apart.
    """
    if not FOREIGN.search(text):
        return text
    weight: Counter[str] = Counter()
    for m in TOKEN.finditer(text):
        own, shared = _resolve(m[0])
        if len(shared) == 1 and len(own) >= 1:
            weight[next(iter(shared))] += len(m[0])
    # Without a token that settles it, Latin: the script all the others imitate.
    order = sorted({"Latin", *SCRIPTS}, key=lambda s: (latin_first and s != "Latin", -weight[s], s != "Latin", s))

    def one(m: regex.Match) -> str:
        own, shared = _resolve(m[0])
        if not shared:
            # No script holds all of it. With Latin letters in it, what can be Latin is.
            return _spell(m[0], "Latin") if "Latin" in own else m[0]
        if own == {"Latin"} or len(own) == 1 and len(shared) == 1:
            return m[0]
        for script in order:
            if script in shared:
                return m[0] if own == {script} else _spell(m[0], script)
        return m[0]

    return TOKEN.sub(one, text)


def unify(text: str | None, latin_first: bool = False) -> str | None:
    """The consistent form of a text: width, composition, spaces, invisible characters and scripts; letter case stays."""
    if text is None or text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", respell(text.translate(_PLAIN), latin_first))


def unify_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds `out`, the consistent form of `column`; nulls stay null, an empty text stays empty."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [unify(t) if isinstance(t, str) else None for t in pdf[column]]
            yield pdf.assign(**{out: values})[schema.names]

    return df.mapInPandas(run, schema)


def _key(text: str) -> str:
    return unicodedata.normalize("NFC", unify(text, latin_first=True).casefold())


def build_automaton(terms: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Automaton over the consistent, case-folded forms of (line_no, source); terms of blanks are left out."""
    lines: dict[str, list[tuple[int, str]]] = {}
    for line, source in terms:
        key = _key(source).strip(" ")
        if key:
            lines.setdefault(key, []).append((line, source.lower()))
    auto = ahocorasick.Automaton()
    for key, found in lines.items():
        auto.add_word(key, (len(key), found))
    auto.make_automaton()
    return auto


def _edge(text: str, at: int) -> bool:
    """Whether no letter, digit or accent stands at this place."""
    if at < 0 or at >= len(text):
        return True
    return not (text[at].isalnum() or unicodedata.category(text[at])[0] in "LMN")


def seen_terms(original: str, auto: ahocorasick.Automaton, disguised_only: bool) -> set[int]:
    """Line numbers of the terms seen as whole words in a text."""
    if not original or not len(auto):
        return set()
    text = _key(original)
    plain: str | None = None
    out: set[int] = set()
    for end, (length, found) in auto.iter(text):
        if _edge(text, end - length) and _edge(text, end + 1):
            for line, source in found:
                if line in out:
                    continue
                if disguised_only:
                    if plain is None:
                        plain = original.lower()
                    if source in plain:
                        continue
                out.add(line)
    return out


def find_terms(
    chunks: DataFrame,
    glossary: DataFrame,
    key: str = "chunk_id",
    text: str = "original",
    disguised_only: bool = False,
    block_terms: int = 100_000,
) -> DataFrame:
    """(chunk_id, line_no): each glossary line whose source is seen in a text as whole words.

    Seen means equal in the consistent form, letter case aside. With
    `disguised_only`, terms that a plain case-insensitive search finds as stored
    are left out. Each chunk row gives its rows (chunk ids are unique); null and
    blank texts and terms match nothing; several lines with one source
    all match. The glossary, a small table kept by hand, is read in blocks of
    `block_terms` lines, each compiled to one automaton and searched in one
    pass, so what a task holds is bounded however large the glossary grows.
    """
    lines = glossary.filter(F.col("source").isNotNull()).select("line_no", "source")
    blocks: list[list[tuple[int, str]]] = [[]]
    for r in lines.toLocalIterator():
        if len(blocks[-1]) >= block_terms:
            blocks.append([])
        blocks[-1].append((r[0], r[1]))
    source = spread(chunks.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)))
    schema = T.StructType([T.StructField(key, source.schema[0].dataType), T.StructField("line_no", lines.schema["line_no"].dataType)])
    out = None
    for block in blocks:
        terms = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], terms=terms) -> Iterator[pd.DataFrame]:
            auto = build_automaton(terms.value)
            for pdf in batches:
                rows = [(k, n) for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for n in sorted(seen_terms(t, auto, disguised_only))]
                yield pd.DataFrame(rows, columns=[key, "line_no"])

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
