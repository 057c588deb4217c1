"""DuckDB SQL of the rules on lines and blocks, worded apart from the operators: its patterns have no look-around and share no constant with them."""

from __future__ import annotations

#: White space, characters of words, and what is no character of a word.
S = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
VISIBLE = r"[^\t\n\x0B\f\r \x{85}\p{Z}]"
W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
N = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}]"
#: A hyphen of any kind.
HYPHEN = r"[\-‐‑‒–﹣－\x{AD}]"
CJK = "[㐀-䶿一-鿿豈-﫿぀-ヿ＀-￯　-〿]"


def trimmed(x: str) -> str:
    """SQL: white space taken off both ends."""
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _word(x: str, words: str) -> str:
    return _has(x, f"(?i)(?:^|{N})(?:{words})(?:$|{N})")


def formula(rel: str, x: str = "text") -> str:
    """SQL: rows of `rel` with pure_formula and has_formula of the text `x`."""
    prose = "the|and|for|are|with|this|that|see|table|fig|figure|section|sec|eq|equation|ref|below|above|where|when|given|then|thus|let"
    return rf"""SELECT * EXCLUDE (z, k, kn, m_sign, m_brk, m_op, m_gen, m_asc, m_dig, m_sym, f_latex, f_key, f_mem, f_script, f_eq, f_cite, f_ver, f_dense, n_word, f_prose, f_verb, f_lead, f_even, f_sig, f_open) FROM (
SELECT *, {trimmed(f"coalesce({x}, '')")} AS z, replace(replace(z, ' ', ''), chr(10), '') AS k, length(k) AS kn,
 {_count('k', '[∑∫∇√≈≤≥≠≃≅∞∈∉∀∃∂∆∏∝⊂⊃⊆⊇∪∩∧∨⊕⊗]')} AS m_sign, {_count('k', '[()[{}' + chr(92) + ']]')} AS m_brk, {_count('k', '[=+*/^_|<>%]')} AS m_op, m_brk + m_op + {_count('k', '-')} AS m_gen,
 {_count('k', '[A-Za-z]')} AS m_asc, {_count('k', chr(92) + 'p{Nd}')} AS m_dig, CASE WHEN kn > 0 THEN 1 - {_count('k', '[' + chr(92) + 'p{L}' + chr(92) + 'p{Nd}]')} / kn::DOUBLE ELSE 0 END AS m_sym,
 {_has('z', r'\\[A-Za-z]+(?:\{|' + S + '|$)')} AS f_latex, {_word('z', f'arg{S}*min|arg{S}*max|min|max|lim|sin|cos|tan|log|ln|exp')} AS f_key,
 {_has('z', f'(?:^|{N})[A-Za-z]{S}*[∈∉]{S}*[A-Za-z]')} AS f_mem, {_has('z', f'(?:^|{N})[A-Za-z]+(?:_' + r'\{?' + W + r'+|\^\{?[-+]?' + W + '+)')} AS f_script,
 {_has('z', f'(?:^|{N})[A-Za-z]{S}*[=<>]{S}*[-+]?(?:[A-Za-z0-9]|' + r'\([^)]+\))')} AS f_eq,
 {_has('z', f'(?i)(?:^|{N})(?:see|table|fig|figure|section|sec|eq|equation|ref|appendix)(?:(?:{S}|[.:,-])+' + r'\(?|\()[\p{Nd}A-Za-z]')} AS f_cite, {_has('z', r'^[vV]?[\p{Nd}.]+[a-z]?$')} AS f_ver,
 kn <= 40 AND m_gen >= 2 AND m_sym >= 0.45 AS f_dense, len(list_filter(regexp_extract_all(z, '{W}+'), lambda q: regexp_matches(q, '^[A-Za-z]{{2,}}$'))) AS n_word,
 n_word >= 2 OR {_word('z', prose)} AS f_prose, {_word('z', 'is|are|was|were|be|can|may|shows?|denotes?|represents?')} AS f_verb, {_word('z', 'where|when|if|for|given|let|then|thus')} AS f_lead,
 {" AND ".join(f"length(replace(z, '{a}', '')) = length(replace(z, '{b}', ''))" for a, b in ('()', '[]', '{}'))} AS f_even,
 f_latex OR f_mem OR f_script OR f_eq OR f_key OR m_sign > 0 OR f_dense OR (m_asc > 0 AND (m_op >= 1 OR m_brk >= 2) AND m_dig > 0) AS f_sig,
 NOT f_cite AND NOT f_ver AND NOT (kn > 80 AND n_word >= 3) AND NOT (f_sig AND (f_prose OR f_verb OR f_lead) AND (n_word >= 2 OR {_has('z', '[,，:：]')} OR length(z) > 32)) AS f_open,
 z <> '' AND kn <= 160 AND f_open AND (f_latex OR f_mem OR f_script OR (m_sign > 0 AND m_gen >= 2) OR (f_key AND m_gen >= 1 AND NOT f_prose) OR f_dense
  OR (f_eq AND m_asc <= 12 AND NOT f_prose AND NOT f_verb AND NOT f_lead AND length(z) <= 24 AND n_word <= 1 AND m_dig <= 1 AND m_brk = 0)
  OR (m_asc > 0 AND m_dig > 0 AND m_op >= 1 AND m_brk >= 2 AND m_gen >= 3 AND f_even AND NOT f_prose AND m_sym >= 0.3 AND length(z) <= 60)) AS pure_formula,
 z <> '' AND kn <= 160 AND (f_sig OR pure_formula) AS has_formula FROM {rel})"""


def eligible(rel: str) -> str:
    """SQL: blocks with `ok`, whether they give context, and `plain`, whether they may be part of a paragraph."""
    return f"SELECT *, {trimmed('text')} <> '' AND NOT pure_formula AND block_type NOT IN ('HeaderFooter', 'Footnote') AND region <> 'Margin' AS ok, ok AND block_type = 'Normal' AND region = 'Body' AS plain FROM ({formula(rel)})"


def ends_sentence(x: str) -> str:
    """SQL: whether a text ends a sentence."""
    return _has(trimmed(x), "[.!?。！？]$")


def ends_open(x: str) -> str:
    """SQL: whether a text ends in the open."""
    return f"({trimmed(x)} <> '' AND NOT {_has(trimmed(x), '[.!?。！？:：;；)' + chr(92) + ']}' + chr(34) + chr(39) * 2 + ']$')})"


def starts_open(x: str) -> str:
    """SQL: whether a text begins as the rest of another."""
    return _has(f"regexp_replace({x}, '^{S}+', '')", r"^(?:[\p{Ll}\p{Nd})\]}" + '"' + "''" + r",.;:!?]|(?i:and|or|but|that|which|who) )")


def starts_lower(x: str) -> str:
    """SQL: whether a text begins with a small letter."""
    return _has(f"regexp_replace({x}, '^{S}+', '')", r"^[" + '"' + "''" + r"(\[{]*\p{Ll}")


def ends_hyphen(x: str) -> str:
    """SQL: whether a text ends with a hyphen."""
    return _has(trimmed(x), f"{HYPHEN}$")


def below(p: str, c: str, h: str) -> str:
    """SQL: whether two boxes (prefixes of l, r) lie as lines of one paragraph; `h` is the line height."""
    wide = f"({p}r - {p}l > {h} * 10.0 AND {c}r - {c}l > {h} * 10.0)"
    return f"""((least({p}r, {c}r) - greatest({p}l, {c}l)) / greatest(1.0, least({p}r - {p}l, {c}r - {c}l)) > 0.3 OR abs({p}l - {c}l) < greatest(18.0, {h} * 1.6) OR abs({p}r - {c}r) < greatest(26.0, {h} * 2.4)
 OR ({wide} AND (({c}l - {p}r < greatest(28.0, {h} * 4.5) AND {c}r > {p}l + greatest(24.0, {h} * 4.0) AND {p}r > {c}l - greatest(24.0, {h} * 4.0)) OR ({c}l <= {p}r + greatest(42.0, {h} * 6.5) AND {c}r >= {p}l + greatest(30.0, {h} * 5.0)))))"""


def list_item(x: str) -> str:
    """SQL: whether a line begins an item of a list."""
    return " OR ".join(_has(x, f"^{S}*{p}{S}") for p in (r"(?:\p{Nd}{1,3}[.)、]|[(（]\p{Nd}{1,3}[)）])", r"[•\-·◦▪■★→►▸‣⦿⁃]", r"[a-zA-Z][.)]"))


def caption(x: str) -> str:
    """SQL: whether a text is a caption."""
    return _has(trimmed(x), f"^(?i:Figure|Fig\\.?|Table|Chart|Source|Appendix|Algorithm|图|表|附录|来源){S}*[\\p{{Nd}}A-Za-z.\\-:：]")


def page_mark(x: str) -> str:
    """SQL: whether a text is the number of a page."""
    return _has(trimmed(x), f"^(?i:page{S}+\\p{{Nd}}+|\\p{{Nd}}+{S}*/{S}*\\p{{Nd}}+|\\p{{Nd}}+)$")


def footnote_mark(x: str) -> str:
    """SQL: whether a text begins with the mark of a footnote."""
    return _has(trimmed(x), f"^(?:\\p{{Nd}}+[.)]|\\*|†|‡|\\[\\p{{Nd}}+\\]){S}")


#: SQL patterns of numbering at line starts and of clauses within a text; the latter with what stands before.
LINE_PREFIX = f"(?im)^{S}*(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|(?:Chapter|Section|Article){S}+\\p{{Nd}}+[A-Za-z0-9.\\-]*|(?:\\p{{Nd}}{{1,3}}|[A-Za-z]|[IVXLC]+)(?:\\.\\p{{Nd}}{{1,3}}){{0,5}}[.)、]|[(（](?:\\p{{Nd}}{{1,3}}|[A-Za-z]|[ivxlc]+)[)）]|[A-Za-z]\\)|[•\\-·▪■◆◦]){S}*"
CLAUSE = f"(?i)(?:^|{N})(?:第[一二三四五六七八九十百千万0-9]+[章节条款部分]|\\p{{Nd}}{{1,3}}(?:\\.\\p{{Nd}}{{1,3}}){{1,5}}|(?:Article|Section){S}+\\p{{Nd}}+[A-Za-z0-9.\\-]*)"
