"""String functions as column expressions; all stay in the JVM.

Nulls give null unless a function says otherwise; an empty text is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script.
SPACE = r"[\t\n\x0B\f\r \x85\p{Z}]"
#: A character of a word: letters, marks without width, digits and connectors.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
#: Character classes and patterns that decide results.
CJK_NARROW = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
CJK_WIDE = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{FF00}-\x{FFEF}\x{3000}-\x{303F}]"
HYPHENS = r"[\-\x{2010}\x{2011}\x{2012}\x{2013}\x{FE63}\x{FF0D}\x{AD}]"
LONG_ENGLISH = r"(^|[^\p{L}\p{N}_])[A-Za-z][A-Za-z\-]{7,}($|[^\p{L}\p{N}_])"
BULLET_LINE = r"^(?:[\x{2022}\x{25E6}\x{25AA}\x{25A0}\x{2043}\-\x{B7}\x{2605}]|(?:[0-9]{1,3}|[A-Za-z])[.)\x{3001}])"
TRAILING_CONNECTIVE = r"(^|[^\p{L}\p{N}_])(?i:in|of|for|to|with|from|by|and|or|but)$"
BREAK_HYPHENS = r"[\-\x{2010}\x{2011}\x{2012}\x{2013}]"
LIST_MARKER = r"^[\t\n\x0B\f\r \x85\p{Z}]*(?:\p{Nd}{1,3}[.)、]|[(（]\p{Nd}{1,3}[)）]|[a-zA-Z][.)]|[•\-·◦▪■★→►▸‣⦿⁃])"


def strip(c: Column) -> Column:
    """White space of any script taken off both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(strip(c) == "", F.lit(True))


def comparable(c: Column) -> Column:
    """Letters and digits in lower case: the form in which two texts count as the same."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def english_ratio(c: Column) -> Column:
    """ASCII letters over characters that are no white space; 0 for a text without any."""
    visible = F.length(F.regexp_replace(c, SPACE, ""))
    letters = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.when(visible > 0, letters / visible).otherwise(F.when(c.isNotNull(), 0.0))


def has_cjk(c: Column) -> Column:
    """Whether a Han ideograph occurs."""
    return c.rlike(CJK_NARROW)


def has_wide_cjk(c: Column) -> Column:
    """Whether a Han, kana, full-width or CJK punctuation character occurs."""
    return c.rlike(CJK_WIDE)


def lines(c: Column) -> Column:
    """Non-empty lines, stripped, in order."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def table_segments(c: Column) -> Column:
    """Cells of a table row: split at tabs, runs of white space and bars between blanks; a single one is the whole text."""
    parts = F.filter(F.transform(F.split(c, r"\t+|[\s]{2,}| \| "), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(c))


def ends_with_hyphen(c: Column) -> Column:
    """Whether a hyphen of any kind ends the text, white space aside."""
    return c.rlike(HYPHENS + SPACE + r"*$")


def drop_hyphen(c: Column) -> Column:
    """Takes a hyphen off the end, with the white space around it."""
    return F.regexp_replace(c, SPACE + "*" + HYPHENS + SPACE + "*$", "")


def join_hyphenated(left: Column, right: Column) -> Column:
    """Two texts in one: without their hyphen and blank where the first ends in one, with a blank else; blank parts are skipped."""
    return (
        F.when(is_blank(left), F.coalesce(right, F.lit("")))
        .when(is_blank(right), F.coalesce(left, F.lit("")))
        .when(ends_with_hyphen(left), F.concat(drop_hyphen(left), F.regexp_replace(right, f"^{SPACE}+", "")))
        .otherwise(F.concat(F.regexp_replace(left, f"{SPACE}+$", ""), F.lit(" "), F.regexp_replace(right, f"^{SPACE}+", "")))
    )


def leading_lower_word(c: Column) -> Column:
    """The ASCII lower-case word at the start, white space before it aside; empty if there is none."""
    return F.regexp_extract(c, f"^{SPACE}*([a-z]+)", 1)


def preview(c: Column, limit: int) -> Column:
    """White space collapsed, cut after `limit` characters with three dots."""
    flat = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def leading_space(c: Column) -> Column:
    """White space at the start."""
    return F.regexp_extract(c, f"^({SPACE}*)", 1)


def trailing_space(c: Column) -> Column:
    """White space at the end."""
    return F.regexp_extract(c, f"({SPACE}*)$", 1)


def keep_edges(original: Column, new: Column) -> Column:
    """A new text with the outer white space of the original; an original of white space alone gives it twice."""
    return F.concat(leading_space(original), strip(F.coalesce(new, F.lit(""))), trailing_space(original))


def cell_text(c: Column) -> Column:
    """Text of a table cell: carriage returns as line feeds, at most one empty line in a row, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\r", "\n"), "\n{3,}", "\n\n"))


def list_marker(c: Column) -> Column:
    """The list marker a line begins with, stripped; empty if there is none."""
    return strip(F.regexp_extract(c, LIST_MARKER, 0))


def token_count(c: Column) -> Column:
    """Number of runs of visible characters."""
    return F.regexp_count(c, F.lit(r"[^\t\n\x0B\f\r \x{85}\p{Z}]+"))


def ends_sentence(c: Column) -> Column:
    """Whether the last visible character ends a sentence."""
    return c.rlike(rf"[.!?。！？]{SPACE}*$")


def ends_open(c: Column) -> Column:
    """Whether a text ends in anything but the end of a sentence, a colon, a semicolon, a closing bracket or a quotation mark."""
    return c.rlike(rf"[^.!?。！？:：;；)\]}}\"'\t\n\x0B\f\r \x85\p{{Z}}]{SPACE}*$")


def starts_open(c: Column) -> Column:
    """Whether a text begins as the rest of another does: in lower case, with a digit, a mark or a word that joins."""
    return c.rlike(rf"^{SPACE}*(?:[\p{{Ll}}\p{{Nd}})\]}}\"',.;:!?]|(?i:and|or|but|that|which|who) )")


#: Opening marks that stand before the first letter.
_LEADING = r"[\"'(\[{]*"


def starts_sentence(c: Column) -> Column:
    """Whether a text begins with a capital or an ideograph, opening marks aside."""
    return c.rlike(rf"^{SPACE}*{_LEADING}(?:\p{{Lu}}|{CJK_WIDE})")


def starts_lower(c: Column) -> Column:
    """Whether a text begins with a small letter, opening marks aside."""
    return c.rlike(rf"^{SPACE}*{_LEADING}\p{{Ll}}")


def context_preview(c: Column, limit: int = 180) -> Column:
    """Line breaks as blanks, blanks collapsed, cut after `limit` characters with three dots."""
    flat = F.trim(F.regexp_replace(c, "[\r\n ]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def text_weight(c: Column) -> Column:
    """Stripped length, 1 at least: the share a target gets of a text that is dealt out."""
    return F.greatest(F.lit(1), F.length(strip(F.coalesce(c, F.lit("")))))


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def css_declarations(c: Column) -> Column:
    """Map of the declarations of an inline style: names in lower case, values stripped, the last of a name wins."""
    parts = F.filter(F.split(c, ";"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(strip(F.substring_index(p, ":", 1))).alias("k"), strip(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    named = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    # The last of a name: those that no later one repeats.
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def css_twips(c: Column) -> Column:
    """A length in twentieths of a point: px x 15, pt x 20, em x 240, half to even, not negative; null for other units."""
    number = F.regexp_extract(F.lower(strip(c)), r"^(-?[0-9]+(?:\.[0-9]+)?)(px|pt|em)$", 1)
    unit = F.regexp_extract(F.lower(strip(c)), r"^(-?[0-9]+(?:\.[0-9]+)?)(px|pt|em)$", 2)
    factor = F.when(unit == "px", 15).when(unit == "pt", 20).when(unit == "em", 240)
    return F.greatest(F.lit(0), F.bround(F.when(number != "", number).cast("double") * factor).cast("int")) + F.when(number != "", 0)


#: Named colours.
COLOUR_NAMES = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "gray": "808080", "grey": "808080"}


def colour_hex(c: Column) -> Column:
    """A colour as six upper-case hex digits: #rgb, #rrggbb and seven names; null for anything else."""
    t = F.lower(strip(c))
    out = F.when(t.rlike("^#[0-9a-f]{6}$"), F.upper(F.substring(t, 2, 6))).when(t.rlike("^#[0-9a-f]{3}$"), F.upper(F.regexp_replace(F.substring(t, 2, 3), "(.)", "$1$1")))
    for name, value in COLOUR_NAMES.items():
        out = out.when(t == name, value)
    return out


def message_endpoint(base: Column) -> Column:
    """Address of the messages service below a base address; null for blank ones."""
    b = F.regexp_replace(strip(base), "/+$", "")
    low = F.lower(b)
    return F.when(is_blank(base), F.lit(None)).when(low.endswith("/v1/messages"), b).when(low.endswith("/v1"), F.concat(b, F.lit("/messages"))).otherwise(F.concat(b, F.lit("/v1/messages")))


def chat_endpoints(base: Column) -> Column:
    """Candidate addresses of the chat service below a base address, the likeliest first; none for blank ones."""
    b = F.regexp_replace(strip(base), "/+$", "")
    low, chat = F.lower(b), "/chat/completions"
    return (
        F.when(is_blank(base), F.array().cast("array<string>"))
        .when(low.endswith(chat), F.array(b))
        .when(low.rlike("/v[123]$"), F.array(F.concat(b, F.lit(chat))))
        .otherwise(F.array(*[F.concat(b, F.lit(v + chat)) for v in ("", "/v1", "/v2", "/v3")]))
    )


def href_target(href: Column, folder: Column) -> Column:
    """Key of a link target: the path below `folder` without query, with its anchor; null for absolute addresses and nulls."""
    bare = F.regexp_replace(href, r"\?[^#]*", "")
    path, anchor = F.substring_index(bare, "#", 1), F.regexp_extract(bare, "#(.*)$", 1)
    full = F.lower(F.url_decode(F.when(is_blank(folder) | (path == ""), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), path))))
    return F.when(href.rlike("^(?i:https?:)"), F.lit(None)).otherwise(F.when(anchor != "", F.concat(full, F.lit("#"), anchor)).otherwise(full))
