"""Rules on lines and blocks of a page; column expressions on boxes with the origin at the bottom left."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, WORD, ends_sentence, strip
from quire.settings import LAYOUT, RECOGNITION, Layout, Recognition

#: Patterns of list items (numbers, bullets, letters), captions, page marks, page numbers and footnotes.
LIST_ITEMS = (rf"^{SPACE}*(?:\p{{Nd}}{{1,3}}[.)、]|[(（]\p{{Nd}}{{1,3}}[)）]){SPACE}", rf"^{SPACE}*[•\-·◦▪■★→►▸‣⦿⁃]{SPACE}", rf"^{SPACE}*[a-zA-Z][.)]{SPACE}")
CODE_MARKS = ("()", "{}", "[]", "=>", "->", "::", "//", "/*", "#include", "import ", "def ", "class ", "function ")
CAPTION = rf"^(?i:Figure|Fig\.?|Table|Chart|Source|Appendix|Algorithm|图|表|附录|来源){SPACE}*[\p{{Nd}}A-Za-z.\-:：]"
PAGE_MARK = rf"^(?i:page{SPACE}+\p{{Nd}}+|\p{{Nd}}+{SPACE}*/{SPACE}*\p{{Nd}}+|\p{{Nd}}+)$"
FOOTNOTE_MARK = rf"^(?:\p{{Nd}}+[.)]|\*|†|‡|\[\p{{Nd}}+\]){SPACE}"
#: Shares of a page's size that bound margins, heads and feet.
CAPTION_REACH, CAPTION_OVERLAP = 6.0, 0.2


def is_list_item(line: Column) -> Column:
    """Whether a line begins with a number, a bullet or a letter of a list."""
    return functools.reduce(operator.or_, (line.rlike(p) for p in LIST_ITEMS))


def is_code(line: Column, mono_share: Column | float = 0.0) -> Column:
    """Whether more than seven tenths of the letters are of one width, or a mark of code stands in a line indented by four or more."""
    share = F.lit(mono_share) if isinstance(mono_share, float) else mono_share
    marked = functools.reduce(operator.or_, (line.contains(m) for m in CODE_MARKS))
    return (share > 0.7) | (marked & line.rlike(rf"^{SPACE}{{4,}}[^\t\n\x0B\f\r \x85\p{{Z}}]"))


def line_type(line: Column, mono_share: Column | float = 0.0, table_row: Column | None = None) -> Column:
    """ListItem, Code, TableRow or Normal, the first that holds."""
    out = F.when(is_list_item(line), "ListItem").when(is_code(line, mono_share), "Code")
    return (out if table_row is None else out.when(table_row, "TableRow")).otherwise("Normal")


def is_caption(text: Column) -> Column:
    """Whether a text names a figure, table, chart, source or the like with its number."""
    return strip(text).rlike(CAPTION)


def is_page_mark(text: Column) -> Column:
    """Whether a text is nothing but the number of a page."""
    return strip(text).rlike(PAGE_MARK)


def has_footnote_mark(text: Column) -> Column:
    """Whether a text begins with the mark of a footnote."""
    return strip(text).rlike(FOOTNOTE_MARK)


def block_role(block_type: Column, text: Column, left: Column, right: Column, top: Column, bottom: Column, size: Column, median_size: Column, centered: Column, width: float, height: float) -> Column:
    """Caption, HeaderFooter, Footnote or Title, the first that holds, else the type as it was.

    `size` is the font size of the block (its line height where that is not known), `median_size` the upper median of its page.
    """
    t = strip(text)
    n = F.length(t)
    edge = (top / height > 0.9) | (bottom / height < 0.1)
    running = (n <= 24) & edge & (t.rlike(PAGE_MARK) | (n <= 18))
    note = (bottom / height < 0.18) & (size <= median_size * 0.92) & (t.rlike(FOOTNOTE_MARK) | (n <= 100))
    title = (n <= 80) & (right - left < width * 0.8) & ~ends_sentence(text) & (centered | ((top / height > 0.58) & (size >= median_size * 1.15)))
    return F.when(t.rlike(CAPTION), "Caption").when(running, "HeaderFooter").when(note, "Footnote").when(title, "Title").otherwise(block_type)


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two spans over the width of the narrower, which counts 1 at least; 0 if they do not meet."""
    common = F.least(a2, b2) - F.greatest(a1, b1)
    return F.when(common > 0, common / F.greatest(F.lit(1.0), F.least(a2 - a1, b2 - b1))).otherwise(0.0)


def flip_y(y: Column, page_height: Column | float) -> Column:
    """A height measured from the other edge of the page, within the page."""
    h = F.lit(page_height) if isinstance(page_height, float) else page_height
    return F.least(h, F.greatest(F.lit(0.0), h - y))


def alignment(left: Column, right: Column, page_width: float) -> Column:
    """Center, Right or Left by the space a block leaves at both sides."""
    after = page_width - right
    uneven = F.abs(left - after)
    near = page_width * 0.03
    return (
        F.when(uneven < near, "Center")
        .when((after < near) & (left > page_width * 0.15), "Right")
        .when((left < near) | ((left < page_width * 0.12) & (after > page_width * 0.1)), "Left")
        .when(((right - left) / page_width < 0.6) & (uneven < page_width * 0.08), "Center")
        .otherwise("Left")
    )


def region(block_type: Column, text: Column, left: Column, right: Column, top: Column, bottom: Column, width: float, height: float) -> Column:
    """Region of a block by its type, else Margin for short narrow ones at the sides that stand clear of head and foot, else Body."""
    middle = (left + right) / 2
    side = (middle < width * 0.12) | (middle > width * 0.88)
    narrow = ((right - left) < width * 0.22) & (F.length(strip(text)) <= 60)
    band = (top > height * 0.08) & (bottom < height * 0.92)
    return (
        F.when(block_type == "HeaderFooter", "HeaderFooter")
        .when(block_type == "Footnote", "Footnote")
        .when(block_type == "Caption", "Caption")
        .when(block_type == "TableRow", "Table")
        .when(side & narrow & band, "Margin")
        .otherwise("Body")
    )


def marginal_noise(text: Column, left: Column, right: Column, top: Column, bottom: Column, page_width: float, settings: Layout = LAYOUT) -> Column:
    """Words at the sides of a page that stand upright, are very short or belong to an archive's stamp."""
    wide, high = F.greatest(F.lit(1.0), right - left), F.greatest(F.lit(1.0), top - bottom)
    middle = (left + right) / 2
    side = (middle < page_width * settings.noise_side) | (middle > page_width * (1 - settings.noise_side))
    low = F.lower(text)
    return side & ((high > wide * settings.noise_aspect) | (F.length(strip(text)) <= settings.noise_length) | low.contains("arxiv") | low.contains("[cs."))


def keep_ocr_block(text: Column, left: Column, top: Column, width: Column, height: Column, page_width: float, page_height: float) -> Column:
    """False for blank texts, page numbers, tiny blocks at the sides and short ones that reach into the head or foot of a page (origin at the top)."""
    t = strip(F.coalesce(text, F.lit("")))
    middle = left + width / 2
    tiny = ((middle < page_width * 0.08) | (middle > page_width * 0.92)) & (F.length(t) <= 2) & (width < page_width * 0.08)
    zone = ((top < page_height * 0.06) | (top + height > page_height * 0.94)) & (F.length(t) <= 10)
    return (t != "") & ~(t.rlike(PAGE_MARK) | tiny | zone)


def needs_ocr(blocks: Column, words: Column, coverage: Column, settings: Recognition = RECOGNITION) -> Column:
    """Whether a page has too little text of its own: no block, few words, or few words on little of its area in few blocks."""
    few = settings.native_words
    return (blocks == 0) | (words < few) | ((words < 2 * few) & (coverage < settings.sparse_coverage) & (blocks <= settings.sparse_blocks))


def goes_on_below(prev: Column, cur: Column, line_height: Column, settings: Layout = LAYOUT) -> Column:
    """Whether two blocks (structs with l and r) lie as lines of one paragraph do.

    They overlap, share an edge, or are both as wide as paragraphs and near enough for
    a short last line to wrap back to the left edge.
    """
    s = settings
    at_least = lambda least, share: F.greatest(F.lit(float(least)), line_height * share)
    pl, pr, cl, cr = prev["l"], prev["r"], cur["l"], cur["r"]
    shared = (F.least(pr, cr) - F.greatest(pl, cl)) / F.greatest(F.lit(1.0), F.least(pr - pl, cr - cl))
    edges = (F.abs(pl - cl) < at_least(18, s.left_align)) | (F.abs(pr - cr) < at_least(26, s.right_align))
    wide = (pr - pl > line_height * s.min_width) & (cr - cl > line_height * s.min_width)
    beside = (cl - pr < at_least(28, s.horizontal_gap)) & (cr > pl + at_least(24, s.range_relation)) & (pr > cl - at_least(24, s.range_relation))
    wraps = (cl <= pr + at_least(42, s.wrap_forward)) & (cr >= pl + at_least(30, s.wrap_backward))
    return (shared > s.overlap) | edges | (wide & (beside | wraps))


#: Signs of mathematics, brackets, operators, and the words that tell prose, sentences and definitions.
MATH_SIGNS = "∑∫∇√≈≤≥≠≃≅∞∈∉∀∃∂∆∏∝⊂⊃⊆⊇∪∩∧∨⊕⊗"
MATH_WORDS = "arg{s}*min|arg{s}*max|min|max|lim|sin|cos|tan|log|ln|exp"
CITED = "see|table|fig|figure|section|sec|eq|equation|ref|appendix"
PROSE = "the|and|for|are|with|this|that|see|table|fig|figure|section|sec|eq|equation|ref|below|above|where|when|given|then|thus|let"
VERBS = "is|are|was|were|be|can|may|shows?|denotes?|represents?"
LEAD_IN = "where|when|if|for|given|let|then|thus"


def formula_flags(text: Column) -> Column:
    """struct<pure, contains>: whether a text is nothing but a formula, and whether it has one; texts over 160 visible characters are neither."""
    t = strip(text)
    compact = F.regexp_replace(t, "[ \n]", "")
    n = F.length(compact)
    count = lambda chars: F.regexp_count(compact, F.lit(chars))
    whole = lambda words: t.rlike(rf"(?i)(?<!{WORD})(?:{words})(?!{WORD})")
    signs, brackets, operators = count(f"[{MATH_SIGNS}]"), count(r"[()\[\]{}]"), count(r"[=+*/^_|<>%]")
    marks = brackets + operators + count("-")
    letters, digits = count("[A-Za-z]"), count(r"\p{Nd}")
    symbols = F.when(n > 0, 1 - count(r"[\p{L}\p{Nd}]") / n).otherwise(0.0)
    latex = t.rlike(rf"\\[A-Za-z]+(?:\{{|{SPACE}|$)")
    keyword = whole(MATH_WORDS.format(s=SPACE))
    member = t.rlike(rf"(?<!{WORD})[A-Za-z]{SPACE}*[∈∉]{SPACE}*[A-Za-z]")
    script = t.rlike(rf"(?<!{WORD})[A-Za-z]+(?:_\{{?{WORD}+\}}?|\^\{{?[-+]?{WORD}+\}}?)")
    equation = t.rlike(rf"(?<!{WORD})[A-Za-z]{SPACE}*[=<>]{SPACE}*[-+]?(?:[A-Za-z0-9]|\([^)]+\))")
    cited = t.rlike(rf"(?i)(?<!{WORD})(?:{CITED})(?!{WORD})(?:{SPACE}|[.:,\-])*\(?[\p{{Nd}}A-Za-z][\p{{Nd}}A-Za-z.\-]*\)?")
    version = t.rlike(r"^[vV]?[\p{Nd}.]+[a-z]?$")
    even = functools.reduce(operator.and_, (F.regexp_count(t, F.lit("\\" + a)) == F.regexp_count(t, F.lit("\\" + b)) for a, b in ("()", "[]", "{}")))
    dense = (n <= 40) & (marks >= 2) & (symbols >= 0.45)
    words = F.regexp_count(t, F.lit(rf"(?<!{WORD})[A-Za-z]{{2,}}(?!{WORD})"))
    prose = (words >= 2) | whole(PROSE)
    verb, lead_in = whole(VERBS), whole(LEAD_IN)
    clauses = t.rlike("[,，:：]")
    signal = latex | member | script | equation | keyword | (signs > 0) | dense | ((letters > 0) & ((operators >= 1) | (brackets >= 2)) & (digits > 0))
    ascii_ = (letters > 0) & (digits > 0) & (operators >= 1) & (brackets >= 2) & (marks >= 3) & even & ~prose & (symbols >= 0.3) & (F.length(t) <= 60)
    short = equation & (letters <= 12) & ~prose & ~verb & ~lead_in & (F.length(t) <= 24) & (words <= 1) & (digits <= 1) & (brackets == 0)
    mixed = signal & (prose | verb | lead_in) & ((words >= 2) | clauses | (F.length(t) > 32))
    formula = latex | member | script | ((signs > 0) & (marks >= 2)) | (keyword & (marks >= 1) & ~prose) | short | dense | ascii_
    considered = F.coalesce((t != "") & (n <= 160), F.lit(False))
    open_ = ~cited & ~version & ~((n > 80) & (words >= 3))
    pure = considered & open_ & ~mixed & formula
    return F.struct(pure.alias("pure"), (considered & (signal | pure)).alias("contains"))


def is_formula(text: Column) -> Column:
    """Whether a text is nothing but a formula."""
    return formula_flags(text)["pure"]


def gives_context(text: Column, block_type: Column, region: Column, formula: Column | None = None) -> Column:
    """Whether a block may stand before or after others as their context: text that is no formula, margin, running line or footnote.

    `formula` may hand over is_formula(text) where that is a column already.
    """
    pure = is_formula(text) if formula is None else formula
    return F.coalesce(strip(text) != "", F.lit(False)) & ~block_type.isin("HeaderFooter", "Footnote") & (region != "Margin") & ~pure


def is_groupable(text: Column, block_type: Column, region: Column, formula: Column | None = None) -> Column:
    """Whether a block may be part of a paragraph of several blocks."""
    return (block_type == "Normal") & (region == "Body") & gives_context(text, block_type, region, formula)


def passed_through(text: Column, translation: Column) -> Column:
    """A formula as it is, any other text translated; a missing translation is empty."""
    return F.when(is_formula(text), text).otherwise(F.coalesce(translation, F.lit("")))
