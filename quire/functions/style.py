"""Fonts, colours and image sizes; column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

#: Name parts of fonts and the family that stands for them, in order; only YaHei comes before Hei, which it contains.
FAMILIES = [
    ("Times New Roman", ("times new roman", "timesroman", "times")),
    ("Times New Roman", ("georgia", "cambria", "palatino", "book antiqua", "garamond")),
    ("Arial", ("arial", "helvetica")),
    ("Arial", ("calibri", "segoe", "verdana", "tahoma", "trebuchet")),
    ("Courier New", ("courier",)),
    ("Courier New", ("consolas", "menlo", "monaco", "fira code", "source code")),
    ("SimSun", ("simsun", "song", "宋体", "songti")),
    ("Microsoft YaHei", ("yahei", "微软雅黑")),
    ("SimHei", ("simhei", "hei", "黑体")),
    ("DengXian", ("deng", "等线")),
    ("DengXian", ("kaiti", "楷体")),
    ("DengXian", ("fangsong", "仿宋")),
    ("SimSun", ("mincho", "明朝")),
    ("SimHei", ("gothic", "ゴシック")),
    ("DengXian", ("noto sans",)),
    ("SimSun", ("noto serif",)),
]
#: Words of a font's name that tell its style.
STYLE_WORDS = r"(?i)(^|[^\p{L}\p{N}_])(?:Bold|Italic|Oblique|Light|Medium|Regular|Semibold|Demibold|Condensed|Expanded|Thin|Heavy|Black|ExtraBold|UltraBold|ExtraLight|UltraLight)($|[^\p{L}\p{N}_])"
BOLD = r"bold|heavy|black|700|800|900"
ITALIC = r"italic|oblique|slanted|inclined"
MONO = r"courier|consolas|mono|menlo|fira code|source code|jetbrains|inconsolata|hack"
#: Units of a picture's size, its size where none is known, and the widest.
EMU_PER_PIXEL, DEFAULT_WIDTH, DEFAULT_HEIGHT, MAX_WIDTH_EMU, LEAST_HEIGHT = 9525, 480, 320, 6_000_000, 32


def font_base(name: Column) -> Column:
    """First name of a list without its subset prefix and its style words."""
    first = F.trim(F.regexp_replace(F.regexp_extract(strip(name), r"^[,;\s]*([^,;\r\n]*)", 1), "^[\"' ]+|[\"' ]+$", ""))
    bare = F.when(F.instr(first, "+").between(2, 9), F.regexp_replace(first, r"^[^+]*\+", "")).otherwise(first)
    plain = F.trim(F.regexp_replace(bare, "[-_]", " "))
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, STYLE_WORDS, "$1$2"), STYLE_WORDS, "$1$2"), " +", " "))
    return F.when(base == "", plain).otherwise(base)


def font_family(name: Column) -> Column:
    """The family that stands for a font, or its plain name; empty for a blank or null name."""
    base = font_base(F.coalesce(name, F.lit("")))
    low = F.lower(base)
    out = F.when(base == "", "")
    for family, parts in FAMILIES:
        found = F.lit(False)
        for p in parts:
            found = found | low.contains(p)
        out = out.when(found, family)
    return out.otherwise(base)


def font_flags(name: Column) -> Column:
    """struct<bold, italic, mono> by the name of a font."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.struct(low.rlike(BOLD).alias("bold"), low.rlike(ITALIC).alias("italic"), low.rlike(MONO).alias("mono"))


def colour_byte(share: Column) -> Column:
    """A share of one as a byte, half to even, within 0 and 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(share * 255).cast("int")))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct<r, g, b> of a printing colour; shares are cut to 0 and 1."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    part = lambda x: colour_byte((1 - unit(x)) * (1 - unit(k)))
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))


def brightness(r: Column, g: Column, b: Column) -> Column:
    """Share of white of a colour in bytes."""
    return (r + g + b) / 765.0


def html_pixels(value: Column) -> Column:
    """Pixels of an attribute, with or without px: one at least; null if it is no number."""
    number = F.regexp_extract(F.lower(strip(value)), r"^([0-9]+(?:\.[0-9]+)?)(?:px)?$", 1)
    return F.when(number != "", F.greatest(F.lit(1), F.bround(number.cast("double")).cast("int")))


def image_size(width: Column, height: Column, own_width: Column, own_height: Column) -> Column:
    """struct<width, height> in EMU: wanted pixels, a missing one by the picture's own shape, defaults, and the widest at most."""
    unit = F.lit(EMU_PER_PIXEL).cast("bigint")
    known = own_width.isNotNull() & own_height.isNotNull() & (own_width > 0) & (own_height > 0)
    w0, h0 = width * unit, height * unit
    w = F.coalesce(w0, F.when(known & h0.isNull(), own_width * unit).when(known, F.bround(h0 * own_width / own_height)), F.lit(DEFAULT_WIDTH) * unit).cast("bigint")
    h = F.coalesce(h0, F.when(known & w0.isNull(), own_height * unit).when(known, F.bround(w0 * own_height / own_width)), F.lit(DEFAULT_HEIGHT) * unit).cast("bigint")
    wide = w > MAX_WIDTH_EMU
    scaled = F.greatest(F.lit(LEAST_HEIGHT) * unit, F.bround(h * (F.lit(float(MAX_WIDTH_EMU)) / w)).cast("bigint"))
    return F.struct(F.least(w, F.lit(MAX_WIDTH_EMU)).alias("width"), F.when(wide, scaled).otherwise(h).alias("height"))


def cover_lines(authors: Column, publisher: Column, facts: Column) -> Column:
    """Lines below a title: authors joined by slashes, the publisher, facts four blanks apart; blank ones are left out."""
    tidy = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), strip), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = F.array(F.array_join(tidy(authors), " / "), strip(F.coalesce(publisher, F.lit(""))), F.array_join(tidy(facts), "    "))
    return F.filter(rows, lambda x: x != "")


def css_alignment(css: Column, classes: Column) -> Column:
    """center, right, both or left by the style's text-align, else center or right by the class; null if neither tells."""
    wanted = F.lower(strip(F.try_element_at(css, F.lit("text-align"))))
    low = F.lower(F.coalesce(classes, F.lit("")))
    by_style = F.when(wanted.isin("center", "right"), wanted).when(wanted == "justify", "both").otherwise("left")
    return F.when(wanted.isNotNull(), by_style).when(low.contains("center"), "center").when(low.contains("right"), "right")


def header_map(block: Column) -> Column:
    """Headers of lines `name: value` as a map; lines without a colon are left out, the first of a name counts."""
    pairs = F.filter(F.transform(F.split(block, "\r?\n"), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, "^[^:]*:?", "")).alias("v"), x.contains(":").alias("c"))), lambda p: p["c"] & (p["k"] != ""))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))
