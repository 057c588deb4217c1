"""What a translator is told of a unit: where it stands and what to keep; column expressions. Texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import is_blank

#: Names of regions, and requirements by region and type of a block.
REGION_NAMES = {"Body": "正文区", "Caption": "图注区", "Table": "表格区", "Margin": "边注区", "HeaderFooter": "页眉页脚区", "Footnote": "脚注区"}
BLOCK_REQUIREMENTS = {
    "Title": "类型：标题。请保持标题风格，译文尽量简洁，不要擅自补充说明或改写成正文语气。",
    "Caption": "类型：图注。请保留图号、表号、子图编号（如(a)/(b)）、单位、变量名和引用标记；语言保持简洁，不要扩写。",
    "TableRow": "类型：表格。请严格保持列顺序、数字、单位、百分比、正负号和变量符号，不要把多列内容合并成解释性整句。",
    "ListItem": "类型：列表。请保留项目符号、编号层级和换行结构，不要把多个条目合并成一段。",
    "Code": "类型：代码。只翻译自然语言说明，保留代码、路径、API 名称、命令行参数和符号原样。",
    "Footnote": "类型：脚注。请保留脚注编号/符号与引用关系，语言可简洁但不要漏译。",
    "HeaderFooter": "类型：页眉页脚。请保留页码、编号、期刊信息和短标题的结构，不要扩写。",
}
HAS_FORMULA = "当前片段含公式或变量。请仅翻译自然语言部分，严格保留公式、变量名、上下标、编号、引用、单位和符号。"
RECOGNISED = "当前片段来自 OCR。请结合上下文纠正明显断词，但不要臆造原文中不存在的数字、公式或专有名词。"
ACROSS_PAGES = "当前文本很可能是跨页续句。请结合前后文完整翻译当前片段，但不要把前后文一并输出。"
FORMULA_NEAR = "；当前片段包含公式、变量或编号。请翻译可翻译的正文内容，并严格保留公式、变量名、运算符、编号和引用格式。"
#: Kinds of a word document's units, what they are called and what they require.
WORD_NAMES = {"Heading": "Word 标题段落", "ListItem": "Word 列表项", "TableCell": "Word 表格单元格", "TextBox": "Word 文本框", "Header": "Word 页眉", "Footer": "Word 页脚", "Footnote": "Word 脚注", "Endnote": "Word 尾注", "Comment": "Word 批注"}
WORD_REQUIREMENTS = {
    "Heading": "类型：标题。请保持标题风格，译文简洁，不要扩写成正文。",
    "ListItem": "类型：列表。请保留列表层级、编号/项目符号和换行结构，不要把多个条目合并成一段。",
    "TableCell": "类型：表格单元格。请保留数字、单位、百分号、缩写和换行，不要把表格短语扩写成解释性整句。",
    "TextBox": "类型：文本框。请保留短句、标签和版式紧凑性，不要无故扩写。",
    "Header": "类型：页眉页脚。请保留页码、短标题、日期和编号结构，不要扩写。",
    "Footer": "类型：页眉页脚。请保留页码、短标题、日期和编号结构，不要扩写。",
    "Footnote": "类型：脚注/尾注。请保留编号、引用关系、URL、DOI、作者年份等结构。",
    "Endnote": "类型：脚注/尾注。请保留编号、引用关系、URL、DOI、作者年份等结构。",
    "Comment": "类型：批注。请保持批注语气简洁明确，不要改变批注意图。",
}
WORD_FLAGS = {
    "link": "当前片段包含超链接显示文本。请翻译可见文字，但保留链接文本边界，不要把链接前后的正文合并改写。",
    "script": "当前片段包含上标或下标。请保留上标/下标对应的结构边界，不要把编号、脚注标记、化学式或公式索引并入普通正文。",
    "field": "当前片段邻近 Word 字段结果。请只翻译可见文本，不要补写字段代码或破坏引用/域结果结构。",
    "textbox": "当前片段位于文本框中。请保持短标签、紧凑布局和独立边界，不要扩写成段落。",
}
#: Roles of an e-book's elements and what they require.
EBOOK_ROLES = {"title": "文档标题", **{f"h{k}": "章节标题" for k in range(1, 7)}, "li": "列表项", "figcaption": "图表说明", "caption": "图表说明", "td": "表格单元格", "th": "表格单元格", "blockquote": "引用块"}
_TITLE = "类型：电子书标题。请保持标题风格和层级感，译文简洁，不要扩写成正文。"
_LIST = "类型：电子书列表。请保留条目边界、编号/项目符号和换行结构，不要把多个条目合并成一段。"
_FIGURE = "类型：电子书图表说明。请保留图号、子图编号、单位、括号和短说明风格。"
_CELL = "类型：电子书表格单元格。请保留数字、单位、缩写和换行，不要把短语扩写成解释性整句。"
EBOOK_REQUIREMENTS = {"title": _TITLE, **{f"h{k}": _TITLE for k in range(1, 7)}, "li": _LIST, "dd": _LIST, "dt": _LIST, "figcaption": _FIGURE, "caption": _FIGURE, "td": _CELL, "th": _CELL, "blockquote": "类型：引用块。请保留引用语气和段落边界，不要混入解释性说明。"}
EBOOK_TEXT = "类型：电子书正文。请保留段落边界、内联强调边界和链接文本边界，不要无故扩写。"
EBOOK_LINKS = "当前片段包含链接文本。请翻译可见文字，但不要破坏链接边界，也不要把链接前后的内容并到一起。"
EBOOK_EMPHASIS = "当前片段包含强调样式。请尽量保持强调部分的语义边界，不要把强调片段并入相邻短语。"


def _lookup(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def _joined(glue: str, *parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), glue)


def _named(label: str, c: Column) -> Column:
    return F.when(~is_blank(c), F.concat(F.lit(label), c))


def block_hint(page: Column, idx: Column, region: Column, before: Column, after: Column, across: Column, formula: Column) -> Column:
    """Where a block of a page stands: page and number (both from 1), region, what comes before and after, whether it crosses pages, and whether it has a formula."""
    place = F.concat(F.lit("PDF 第 "), page.cast("string"), F.lit(" 页文本块 "), idx.cast("string"))
    where = F.when(region != "Body", F.concat(F.lit("区域："), _lookup(region, REGION_NAMES, "正文区")))
    hint = _joined("；", place, where, _named("前文：", before), _named("后文：", after), F.when(across, F.lit(ACROSS_PAGES)))
    return F.concat(hint, F.when(formula, F.lit(FORMULA_NEAR)).otherwise(F.lit("")))


def block_requirements(block_type: Column, region: Column, formula: Column, recognised: Column) -> Column:
    """What to keep of a block of a page, a line for each requirement."""
    area = F.when(region != "Body", F.concat(F.lit("页面区域："), _lookup(region, REGION_NAMES, "正文区"), F.lit("。请保持该区域常见的表达方式和结构，不要把它改写成普通正文。")))
    return _joined("\n", area, _lookup(block_type, BLOCK_REQUIREMENTS), F.when(formula, F.lit(HAS_FORMULA)), F.when(recognised, F.lit(RECOGNISED)))


def word_kind(scope: Column, in_box: Column, in_cell: Column, numbered: Column, style: Column, outlined: Column) -> Column:
    """Kind of a paragraph of a word document: by its part, its frame, its numbering and its style, in this order."""
    return (
        F.when(scope.isin("Comment", "Footnote", "Endnote"), scope)
        .when(in_box, "TextBox")
        .when(in_cell, "TableCell")
        .when(numbered, "ListItem")
        .when(F.coalesce(F.lower(style).startswith("heading"), F.lit(False)) | outlined, "Heading")
        .when(scope.isin("Header", "Footer"), scope)
        .otherwise("Paragraph")
    )


def heading_level(style: Column, outline: Column) -> Column:
    """Level of a heading by the number of its style, else by its outline level, which counts from 0; null for other paragraphs."""
    number = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)Heading\s*([0-9]+)", 1)
    return F.when(number != "", number.cast("int")).otherwise(outline + 1)


def run_boundary(link: Column, box: Column, raised: Column, lowered: Column, field: Column) -> Column:
    """Key of what must not be merged with its neighbours: link, textbox, sup or sub, field; plain if none holds."""
    key = _joined("|", F.when(link, F.lit("link")), F.when(box, F.lit("textbox")), F.when(raised, F.lit("sup")).when(lowered, F.lit("sub")), F.when(field, F.lit("field")))
    return F.when(key == "", "plain").otherwise(key)


def word_hint(kind: Column, scope: Column, heading: Column, extra: Column) -> Column:
    """Where a unit of a word document stands: kind, heading above it, and what else is known."""
    name = F.coalesce(_lookup(kind, WORD_NAMES), F.when(scope == "Main", F.lit("Word 段落")).otherwise(F.concat(F.lit("Word "), scope, F.lit(" 段落"))))
    return _joined("；", name, _named("章节上下文：", heading), F.when(~is_blank(extra), extra))


def word_requirements(kind: Column, scope: Column, link: Column, script: Column, field: Column, box: Column, extra: Column) -> Column:
    """What to keep of a unit of a word document, a line for each requirement."""
    part = F.when(scope != "Main", F.concat(F.lit("当前内容来自 Word "), scope, F.lit(" 区域，请保持该区域常见的简短表达方式。")))
    flags = [F.when(c, F.lit(WORD_FLAGS[n])) for n, c in (("link", link), ("script", script), ("field", field), ("textbox", box))]
    return _joined("\n", _lookup(kind, WORD_REQUIREMENTS), part, *flags, F.when(~is_blank(extra), extra))


def is_heading_like(tag: Column, *names: Column) -> Column:
    """Whether an element of an e-book may be a heading: by its tag, or by a word in its class, type or id."""
    hint = F.lower(F.concat_ws(" ", *names))
    return tag.rlike("^h[1-6]$") | (F.lower(tag) == "title") | hint.contains("chapter") | hint.contains("title") | hint.contains("heading")


def ebook_hint(tag: Column, chapter: Column, heading: Column, file: Column) -> Column:
    """Where a unit of an e-book stands: role and tag, chapter, heading above it, file."""
    role = F.concat(F.lit("EPUB "), _lookup(tag, EBOOK_ROLES, "正文块"), F.lit(" <"), tag, F.lit(">"))
    return _joined("；", role, F.when(~is_blank(chapter), chapter), _named("章节上下文：", heading), F.concat(F.lit("来源文件："), file))


def ebook_requirements(tag: Column, links: Column, emphasis: Column) -> Column:
    """What to keep of a unit of an e-book, a line for each requirement."""
    return _joined("\n", _lookup(tag, EBOOK_REQUIREMENTS, EBOOK_TEXT), F.when(links, F.lit(EBOOK_LINKS)), F.when(emphasis, F.lit(EBOOK_EMPHASIS)))
