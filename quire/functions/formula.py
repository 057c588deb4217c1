"""The formula rule of functions.layout for folds in Python: the same fixed values, the same result."""

from __future__ import annotations

import regex

from quire.functions.layout import CITED, LEAD_IN, MATH_SIGNS, MATH_WORDS, PROSE, VERBS
from quire.functions.text import WORD


def _words(alternatives: str) -> regex.Pattern:
    return regex.compile(rf"(?i)(?<!{WORD})(?:{alternatives})(?!{WORD})")


_LATEX = regex.compile(r"\\[A-Za-z]+(?:\{|\s|$)")
_KEYWORD = _words(MATH_WORDS.format(s=r"\s"))
_MEMBER = regex.compile(rf"(?<!{WORD})[A-Za-z]\s*[∈∉]\s*[A-Za-z]")
_SCRIPT = regex.compile(rf"(?<!{WORD})[A-Za-z]+(?:_\{{?{WORD}+\}}?|\^\{{?[-+]?{WORD}+\}}?)")
_EQUATION = regex.compile(rf"(?<!{WORD})[A-Za-z]\s*[=<>]\s*[-+]?(?:[A-Za-z0-9]|\([^)]+\))")
_CITED = regex.compile(rf"(?i)(?<!{WORD})(?:{CITED})(?!{WORD})[\s.:,\-]*\(?[\p{{Nd}}A-Za-z][\p{{Nd}}A-Za-z.\-]*\)?")
_VERSION = regex.compile(r"[vV]?[\p{Nd}.]+[a-z]?")
_LATIN = regex.compile(rf"(?<!{WORD})[A-Za-z]{{2,}}(?!{WORD})")
_PROSE, _VERB, _LEAD_IN = _words(PROSE), _words(VERBS), _words(LEAD_IN)
_SIGNS, _BRACKETS, _OPERATORS = frozenset(MATH_SIGNS), frozenset("()[]{}"), frozenset("=+*/^_|<>%")


def analyse(text: str) -> tuple[bool, bool]:
    """(pure, contains) of a text."""
    t = text.strip()
    compact = t.replace(" ", "").replace("\n", "")
    n = len(compact)
    if not t or n > 160:
        return False, False
    count = lambda chars: sum(c in chars for c in compact)
    signs, brackets, operators = count(_SIGNS), count(_BRACKETS), count(_OPERATORS)
    marks = brackets + operators + compact.count("-")
    letters = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in compact)
    digits = len(regex.findall(r"\p{Nd}", compact))
    symbols = 1 - len(regex.findall(r"[\p{L}\p{Nd}]", compact)) / n if n else 0.0
    latex, keyword, member, script, equation = (bool(rx.search(t)) for rx in (_LATEX, _KEYWORD, _MEMBER, _SCRIPT, _EQUATION))
    dense = n <= 40 and marks >= 2 and symbols >= 0.45
    contains = latex or member or script or equation or keyword or signs > 0 or dense or (letters > 0 and digits > 0 and (operators >= 1 or brackets >= 2))
    words = len(_LATIN.findall(t))
    if _CITED.search(t) or _VERSION.fullmatch(t) or n > 80 and words >= 3:
        return False, contains
    prose, verb, lead_in = words >= 2 or bool(_PROSE.search(t)), bool(_VERB.search(t)), bool(_LEAD_IN.search(t))
    if contains and (prose or verb or lead_in) and (words >= 2 or any(c in t for c in ",，:：") or len(t) > 32):
        return False, True
    even = all(t.count(a) == t.count(b) for a, b in ("()", "[]", "{}"))
    expression = letters > 0 and digits > 0 and operators >= 1 and brackets >= 2 and marks >= 3 and even and not prose and symbols >= 0.3 and len(t) <= 60
    short = equation and letters <= 12 and not (prose or verb or lead_in) and len(t) <= 24 and words <= 1 and digits <= 1 and not brackets
    pure = latex or member or script or (signs > 0 and marks >= 2) or (keyword and marks >= 1 and not prose) or short or dense or expression
    return pure, contains or pure
