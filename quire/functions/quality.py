"""Predicates on the quality of a translated text; boolean column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import BREAK_HYPHENS, BULLET_LINE, LONG_ENGLISH, SPACE, TRAILING_CONNECTIVE, WORD, comparable, english_ratio, has_cjk, is_blank, lines, strip, token_count

#: What a report says of a suspicious row.
REASONS = {
    "empty": "译文为空",
    "same": "译文与原文相同",
    "run": "译文包含较长连续英文",
    "english": "译文几乎全是英文",
    "continuation": "译文疑似直接保留了英文续句",
}
#: Numbering at the start of a line, clause numbers within a text, and superscript-like marks.
LINE_NUMBER = rf"(?imd)^{SPACE}*(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|(?:Chapter|Section|Article){SPACE}+\p{{Nd}}+[A-Za-z0-9.\-]*|(?:\p{{Nd}}{{1,3}}|[A-Za-z]|[IVXLC]+)(?:\.\p{{Nd}}{{1,3}}){{0,5}}[.)、]|[(（](?:\p{{Nd}}{{1,3}}|[A-Za-z]|[ivxlc]+)[)）]|[A-Za-z]\)|[•\-·▪■◆◦]){SPACE}*"
CLAUSE_NUMBER = rf"(?i)(?<!{WORD})(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{1,3}}){{1,5}}|(?:Article|Section){SPACE}+\p{{Nd}}+[A-Za-z0-9.\-]*)"
SUPERSCRIPT = rf"(?<=\p{{Nd}})[A-Za-z](?!{WORD})|(?<!{WORD})[A-Za-z](?=\p{{Nd}})|\[\p{{Nd}}+\]"


def no_words(original: Column) -> Column:
    """Nothing to translate: blank, or digits without any letter."""
    return is_blank(original) | (~original.rlike(r"\p{L}") & original.rlike(r"\p{Nd}"))


def reasons(original: Column, translation: Column) -> Column:
    """Why a row of a bilingual table looks untranslated, in a fixed order; empty for sound rows and blank originals."""
    o, t = strip(F.coalesce(original, F.lit(""))), strip(F.coalesce(translation, F.lit("")))
    same = (comparable(o) != "") & (comparable(o) == comparable(t))
    ratio, cjk = english_ratio(t), has_cjk(t)
    run = t.rlike(LONG_ENGLISH) & (~cjk | (ratio > 0.38) | F.contains(comparable(t), comparable(o)))
    head_t, head_o = F.substring(t, 1, 36), F.substring(o, 1, 36)
    continuation = (F.length(t) >= 12) & head_t.rlike(r"^[A-Za-z][A-Za-z,\-\s()0-9]{10,}$") & (comparable(head_t) != comparable(head_o))
    found = F.array_compact(
        F.array(
            F.when(same, REASONS["same"]),
            F.when(run, REASONS["run"]),
            F.when(~cjk & (ratio > 0.45), REASONS["english"]),
            F.when(continuation, REASONS["continuation"]),
        )
    )
    nothing = F.array().cast("array<string>")
    return F.when(o == "", nothing).when(t == "", F.array(F.lit(REASONS["empty"]))).when(no_words(o), nothing).otherwise(found)


def risky_fragment(c: Column) -> Column:
    """A text of 20 characters or more that looks like part of a sentence."""
    t = strip(c)
    return (F.length(t) >= 20) & (t.rlike(r"^\p{Ll}") | t.rlike(BREAK_HYPHENS + "$") | t.rlike(TRAILING_CONNECTIVE))


def mostly_english(c: Column) -> Column:
    """More than 55 % ASCII letters and no Han ideograph."""
    return ~is_blank(c) & (english_ratio(strip(c)) > 0.55) & ~has_cjk(c)


def untranslated_fragment(original: Column, translated: Column) -> Column:
    """A risky fragment that came back as it was, or in English."""
    return ~is_blank(original) & ~is_blank(translated) & risky_fragment(original) & ((comparable(original) == comparable(translated)) | mostly_english(translated))


def truncated(original: Column, translated: Column) -> Column:
    """A quarter of the words and of the length, or less, of an original of 32 characters or more."""
    o, t = strip(original), strip(translated)
    few = token_count(t) <= F.greatest(F.lit(1), F.floor(token_count(o) / 4))
    short = F.length(t) <= F.greatest(F.lit(12), F.floor(F.length(o) / 4))
    return (F.length(o) >= 32) & (t != "") & few & short


def list_broken(original: Column, translated: Column) -> Column:
    """More than one line, or more than one bullet, of a list is missing."""
    lo, lt = lines(original), lines(translated)
    bullets = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(BULLET_LINE)))
    fewer = F.size(lt) < F.greatest(F.lit(1), F.size(lo) - 1)
    return (F.size(lo) >= 2) & (fewer | ((bullets(lo) > 0) & (bullets(lt) < F.greatest(F.lit(1), bullets(lo) - 1))))


def cell_expanded(original: Column, translated: Column) -> Column:
    """A compact table cell that lost its lines or grew out of proportion."""
    o, t = strip(original), strip(translated)
    rows = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x != ""))
    collapsed = (rows(o) > 1) & (rows(t) == 1) & (F.length(o) <= 80)
    compact = (token_count(o) <= 10) & (F.length(o) <= 80)
    grown = (token_count(t) > F.greatest(F.lit(14), token_count(o) * 2)) & (F.length(t) > F.greatest(F.lit(80.0), F.length(o) * 2.4))
    return (o != "") & (t != "") & (collapsed | (compact & grown))


def numbering_broken(original: Column, translated: Column) -> Column:
    """More than one line number, or clause number, is missing."""
    count = lambda c, rx: F.regexp_count(c, F.lit(rx))
    po, pt, co, ct = count(original, LINE_NUMBER), count(translated, LINE_NUMBER), count(original, CLAUSE_NUMBER), count(translated, CLAUSE_NUMBER)
    return (po > 0) & ((pt < F.greatest(F.lit(1), po - 1)) | ((co > 0) & (ct < F.greatest(F.lit(1), co - 1))))


def superscripts(c: Column) -> Column:
    """Number of superscript-like marks."""
    return F.regexp_count(c, F.lit(SUPERSCRIPT))


def boundary_broken(original: Column, translated: Column, superscript: Column, text_box: Column) -> Column:
    """Superscripts lost, or a short text box grown out of proportion."""
    o, t = strip(original), strip(translated)
    grown = (F.length(o) <= 80) & (F.length(t) > F.greatest(F.lit(100.0), F.length(o) * 2.5))
    return (superscript & (superscripts(original) > superscripts(translated))) | (text_box & grown)


def needs_retry(original: Column, translated: Column, kind: Column, missing: Column | None = None, lost: Column | None = None) -> Column:
    """Whether a translation should be asked for again; `kind` is table, caption, list, cell, superscript, text box or plain.

    `missing` tells that the raw answer lacks a placeholder of a protected span, `lost` that a protected span is not in the translation.
    """
    english = mostly_english(translated)
    none = F.lit(False)
    return (
        (none if missing is None else F.coalesce(missing, none))
        | untranslated_fragment(original, translated)
        | (kind.isin("table", "cell") & (english | truncated(original, translated)))
        | (kind.isin("caption", "superscript", "text box") & (english | (none if lost is None else F.coalesce(lost, none))))
        | ((kind == "list") & list_broken(original, translated))
        | ((kind == "cell") & cell_expanded(original, translated))
        | boundary_broken(original, translated, kind == "superscript", kind == "text box")
        | numbering_broken(original, translated)
    )
