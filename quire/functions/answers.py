"""Texts in the answers of models, and prompts; column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import is_blank, strip

#: Where an answer may hold its text, the first that does counts.
PATHS = ("$.content", "$.content[0].text", "$.content[0].content", "$.completion", "$.message", "$.choices[0].message.content", "$.choices[0].text")


def answer_text(json: Column) -> Column:
    """The text of an answer in any accepted shape; null if there is none, or no JSON."""
    found = [F.get_json_object(json, p) for p in PATHS]
    plain = [F.when(~f.startswith("[") & ~f.startswith("{") & (f != ""), f) for f in found]
    parts = F.from_json(F.get_json_object(json, "$.content"), "array<struct<text:string,content:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["content"], F.lit(""))), "")
    return F.coalesce(plain[0], F.when(joined != "", joined), *plain[1:])


#: The default template of a request, what a request asks for, and what stands before its parts.
TEMPLATE = "你是一名专业文档翻译助手。请把下面内容从{source}翻译为{target}。仅返回译文，不要解释，不要添加标题，不要补充说明。请保留原有段落、列表、换行、数字、符号和占位符，不要漏译正文内容。"
CONTEXT_LABEL = "文档上下文（仅供理解，不要翻译这一部分）：\n"
RULES = """翻译要求：
1. 只翻译“待翻译文本”部分，仅返回译文。
2. 保留原文段落、换行、列表和占位符结构，不要把多个段落合并成一整段。
3. 不要遗漏任何可翻译英文；若当前片段是跨页续句，请结合上下文把当前片段完整译成中文。
4. 若待翻译文本是英文残句、断词续句或句中片段，也必须译成自然中文，不要原样照抄英文。
5. 除公认缩写、公式、代码、文献编号等必须保留的内容外，不要残留未翻译英文。
"""
REQUIREMENTS_LABEL, TEXT_LABEL = "补充要求：\n", "待翻译文本：\n<<<TEXT\n"


def system_prompt(template: Column, source: Column, target: Column, glossary: Column) -> Column:
    """The template and the glossary below it, stripped, with {source} and {target} filled in, letter case aside."""
    whole = strip(F.concat(template, F.lit("\n"), F.coalesce(glossary, F.lit(""))))
    plain = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(whole, F.lit(r"(?i)\{source\}"), plain(source)), F.lit(r"(?i)\{target\}"), plain(target))


def user_prompt(text: Column, context: Column, requirements: Column) -> Column:
    """Context, rules, further requirements if there are any, and the fenced text of a request."""
    more = F.when(is_blank(requirements), F.lit("\n")).otherwise(F.concat(F.lit(REQUIREMENTS_LABEL), strip(requirements), F.lit("\n\n")))
    return F.concat(F.lit(CONTEXT_LABEL), F.coalesce(context, F.lit("")), F.lit("\n\n" + RULES), more, F.lit(TEXT_LABEL), F.coalesce(text, F.lit("")), F.lit("\nTEXT"))
