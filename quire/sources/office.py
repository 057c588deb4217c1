"""Document formats as rows: word, excel, powerpoint and e-book files (zip and XML).

`read(spark, path, "quire_docx")` reads files of any file system Spark knows, in
parallel. For files every executor has at the same path there are Python data sources as well:
`register(spark)`, then `spark.read.format("quire_docx").load(glob)`. A file that
cannot be read gives one row with its error and no text, and the others are
read all the same.
"""

from __future__ import annotations

import glob
import io
import posixpath
import unicodedata
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

#: Elements of a page that are units, and those whose text is none.
LEAVES = frozenset("title p h1 h2 h3 h4 h5 h6 li blockquote dd dt figcaption caption td th div".split())
SKIPPED = frozenset("script style code pre math svg rt rp".split())


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations by id, as names within the archive."""
    folder, name = posixpath.split(part)
    rels = posixpath.join(folder, "_rels", name + ".rels")
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target").startswith("/") else r.get("Target").lstrip("/") for r in ET.fromstring(z.read(rels))}


class _Reader(DataSourceReader):
    """Reads each file with the function the format gives."""

    def __init__(self, options: dict, parse, width: int):
        self.pattern, self.parse, self.width = options.get("path", ""), parse, width

    def partitions(self) -> list[InputPartition]:
        pattern = self.pattern.removeprefix("file://")
        return [_File(p) for p in sorted(glob.glob(pattern))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        width = self.width
        try:
            for row in self.parse(partition.value):
                yield (partition.value, *row, None)
        except BROKEN as e:
            yield (partition.value, *[None] * width, f"{type(e).__name__}: {e}")


#: Parts of a word document in order: scope, and what their names begin with.
_PARTS = (("Header", "word/header"), ("Footer", "word/footer"), ("Footnote", "word/footnotes"), ("Endnote", "word/endnotes"), ("Comment", "word/comments"))


def _on(props: ET.Element | None, name: str) -> ET.Element | None:
    return None if props is None else props.find(W + name)


def read_docx(file) -> Iterator[tuple]:
    """(scope, para, run_no, style, outline, format_key, in_cell, in_box, numbered, link, raised, lowered, field, breaks, new_page, text) of each run.

    The body comes first, then headers, footers, notes and comments. `breaks` are the page breaks a paragraph holds, `new_page`
    tells that it begins a page; both go with its first run, which may have no text.
    """
    with zipfile.ZipFile(file) as z:
        names = sorted(z.namelist())
        parts = [("Main", "word/document.xml")] + [(scope, n) for scope, start in _PARTS for n in names if n.startswith(start) and n.endswith(".xml")]
        para = 0
        for scope, name in parts:
            root = ET.fromstring(z.read(name))
            inside = {tag: {id(x) for e in root.iter(W + tag) for x in e.iter()} for tag in ("tc", "txbxContent", "hyperlink", "fldSimple")}
            for p in root.iter(W + "p"):
                para += 1
                props = p.find(W + "pPr")
                style, outline = _on(props, "pStyle"), _on(props, "outlineLvl")
                section = _on(_on(props, "sectPr"), "type")
                breaks = sum(1 for _ in p.iter(W + "lastRenderedPageBreak")) + sum(b.get(W + "type") == "page" for b in p.iter(W + "br"))
                new_page = _on(props, "pageBreakBefore") is not None or section is not None and section.get(W + "val") in ("nextPage", "oddPage", "evenPage")
                # Runs of a text box belong to its own paragraphs.
                runs = [r for r in p.iter(W + "r") if id(r) not in inside["txbxContent"] or id(p) in inside["txbxContent"]]
                first = True
                for k, run in enumerate(runs or [None]):
                    text = "" if run is None else "".join(t.text or "" for t in run.findall(W + "t"))
                    if not text and not (first and (breaks or new_page)):
                        continue
                    form = None if run is None else run.find(W + "rPr")
                    key = "" if form is None else "|".join(sorted(_local(x.tag) + ":" + ",".join(sorted(x.attrib.values())) for x in form))
                    level = _on(form, "vertAlign")
                    up = "" if level is None else level.get(W + "val")
                    field = run is not None and (run.find(W + "fldChar") is not None or run.find(W + "instrText") is not None or id(run) in inside["fldSimple"])
                    yield (
                        scope, para, k, "" if style is None else style.get(W + "val"), None if outline is None else int(outline.get(W + "val")), key, id(p) in inside["tc"], id(p) in inside["txbxContent"],
                        _on(props, "numPr") is not None, id(run) in inside["hyperlink"], up == "superscript", up == "subscript", field, breaks if first else 0, new_page and first, text,
                    )
                    first = False


def read_xlsx(file) -> Iterator[tuple[int, str, str, str, int, str]]:
    """(sheet_no, sheet, cell, kind, string_index, text) of each text cell: shared strings, with or without runs, and inline ones; sheets in workbook order."""
    with zipfile.ZipFile(file) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(S + "si")]
        targets = _related(z, "xl/workbook.xml")
        for n, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"), 1):
            root = ET.fromstring(z.read(targets[sheet.get(R + "id")]))
            for c in root.iter(S + "c"):
                if c.get("t") == "s" and c.find(S + "v") is not None:
                    i = int(c.find(S + "v").text)
                    if i < len(shared):
                        yield n, sheet.get("name"), c.get("r"), "shared", i, shared[i]
                elif c.get("t") == "inlineStr":
                    yield n, sheet.get("name"), c.get("r"), "inline", None, "".join(t.text or "" for t in c.iter(S + "t"))


def read_pptx(file) -> Iterator[tuple[int, int, int, str, str]]:
    """(slide, para, run_no, format_key, text) of each run of non-blank paragraphs; slides in the order of the presentation."""
    with zipfile.ZipFile(file) as z:
        targets = _related(z, "ppt/presentation.xml")
        slides = [targets[s.get(R + "id")] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(P + "sldId")]
        for n, name in enumerate(slides, 1):
            for k, p in enumerate(ET.fromstring(z.read(name)).iter(A + "p"), 1):
                runs = [("|".join(f"{a}:{v}" for a, v in sorted((r.find(A + "rPr").attrib if r.find(A + "rPr") is not None else {}).items())), "".join(t.text or "" for t in r.iter(A + "t"))) for r in p.iter(A + "r")]
                if "".join(t for _, t in runs).strip():
                    for i, (key, text) in enumerate(runs):
                        yield n, k, i, key, text


def _within(folder: str, href: str) -> str:
    """Name within the archive of an address relative to a folder of it; an address that leaves the archive is refused."""
    name = posixpath.normpath(posixpath.join("/", folder, unquote(href).strip()))
    plain = posixpath.normpath(posixpath.join(folder, unquote(href).strip()))
    if plain.startswith("../") or plain == ".." or plain.startswith("/"):
        raise ValueError(f"outside the archive: {href}")
    return unicodedata.normalize("NFC", name.lstrip("/"))


class _Book:
    """An e-book's package: manifest, spine and pages in reading order."""

    def __init__(self, z: zipfile.ZipFile):
        self.z = z
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        self.package, self.folder = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
        self.items = [e for e in self.package.iter() if _local(e.tag) == "item" and (e.get("id") or "").strip() and (e.get("href") or "").strip()]
        by_id = {e.get("id"): e for e in self.items}
        html = lambda e: (e.get("media-type") or "").lower() in ("application/xhtml+xml", "text/html")
        spine = [by_id[e.get("idref")] for e in self.package.iter() if _local(e.tag) == "itemref" and e.get("idref") in by_id]
        paths = [self.path(e) for e in [*spine, *self.items] if html(e)]
        # Pages of the spine may come twice, others follow once; letter case does not tell pages apart.
        count = sum(html(e) for e in spine)
        seen = {p.lower() for p in paths[:count]}
        self.pages = paths[:count]
        for p in paths[count:]:
            if p.lower() not in seen:
                seen.add(p.lower())
                self.pages.append(p)

    def path(self, item: ET.Element) -> str:
        return _within(self.folder, item.get("href"))

    def special(self, test) -> list[str]:
        """Paths of the items a test holds for, each once, letter case aside."""
        return list({self.path(e).lower(): self.path(e) for e in reversed(self.items) if test(e)}.values())[::-1]


def read_epub(file) -> Iterator[tuple]:
    """(doc_no, href, pos, tag, id, names, link, links, emphasis, text) of each leaf with letters: content documents in spine order, then other pages of the manifest, navigation aside.

    names are class, type and id in one text, link is the address of the first link around any of its text.
    """
    with zipfile.ZipFile(file) as z:
        book = _Book(z)
        guides = {p.lower() for p in book.special(lambda e: "nav" in (e.get("properties") or "").lower())}
        for n, href in enumerate((p for p in book.pages if p.lower() not in guides), 1):
            for pos, row in enumerate(_leaves(ET.fromstring(z.read(href)), False, None), 1):
                yield n, href, pos, *row


def read_epub_guide(file) -> Iterator[tuple]:
    """(kind, href, pos, target, label) of each entry of navigation pages (nav) and of the older control file (ncx); target is null for outside addresses."""
    with zipfile.ZipFile(file) as z:
        book = _Book(z)
        for href in book.special(lambda e: "nav" in (e.get("properties") or "").lower()):
            links = [e for e in ET.fromstring(z.read(href)).iter() if isinstance(e.tag, str) and _local(e.tag) == "a"]
            for pos, a in enumerate(links, 1):
                yield "nav", href, pos, target_of(href, a.get("href")), " ".join("".join(a.itertext()).split())
        for href in book.special(lambda e: (e.get("media-type") or "").lower() == "application/x-dtbncx+xml"):
            points = [e for e in ET.fromstring(z.read(href)).iter() if isinstance(e.tag, str) and _local(e.tag) == "navpoint"]
            for pos, point in enumerate(points, 1):
                label = next((" ".join("".join(x.itertext()).split()) for x in point if _local(x.tag) == "navlabel"), "")
                source = next((x.get("src") for x in point if _local(x.tag) == "content"), None)
                yield "ncx", href, pos, target_of(href, source), label


def target_of(page: str, href: str | None) -> str | None:
    """Key of a link's target: path within the archive and anchor, both unescaped and composed; null for blank and outside addresses."""
    if not href or not href.strip() or href.lower().startswith("http"):
        return None
    # Whatever follows a question mark is dropped, an anchor included.
    path, _, anchor = href.strip().partition("?")[0].partition("#")
    name = _within(posixpath.dirname(page), path) if path.strip() else unicodedata.normalize("NFC", page)
    anchor = unicodedata.normalize("NFC", unquote(anchor).strip())
    return f"{name}#{anchor}" if anchor else name


def read_epub_book(file) -> Iterator[tuple]:
    """(title, creators, publisher, language, date, identifier, description, cover_image, cover_page) of a book."""
    with zipfile.ZipFile(file) as z:
        book = _Book(z)
        meta = next((e for e in book.package.iter() if _local(e.tag) == "metadata"), None)
        inner = [(_local(e.tag), " ".join((e.text or "").split())) for e in meta if isinstance(e.tag, str)] if meta is not None else []
        first = lambda *names: next((v for k, v in inner if k in names), "")
        image = next((book.path(e) for e in book.items if "cover-image" in (e.get("properties") or "").lower()), None)
        if image is None:
            named = next((e.get("content") for e in book.package.iter() if _local(e.tag) == "meta" and (e.get("name") or "").lower() == "cover"), None)
            image = next((book.path(e) for e in book.items if named and e.get("id") == named), None)
        page = next((p for p in book.pages if "cover" in p.lower() or image and image.lower() in _images(z, p)), None)
        yield first("title"), [v for k, v in inner if k == "creator" and v], first("publisher"), first("language"), first("date", "modified"), first("identifier"), first("description"), image, page


def _images(z: zipfile.ZipFile, page: str) -> set[str]:
    sources = [e.get("src") for e in ET.fromstring(z.read(page)).iter() if isinstance(e.tag, str) and _local(e.tag) == "img" and e.get("src")]
    return {_within(posixpath.dirname(page), x).lower() for x in sources}


def _leaves(e: ET.Element, skip: bool, link: str | None) -> Iterator[tuple]:
    tag = _local(e.tag) if isinstance(e.tag, str) else ""
    skip = skip or tag in SKIPPED
    if tag == "a" and (e.get("href") or "").strip():
        link = e.get("href")
    inner = [x for x in e.iter() if x is not e and isinstance(x.tag, str)]
    if tag in LEAVES and not skip and not any(_local(x.tag) in LEAVES for x in inner):
        text = " ".join(_texts(e).split())
        if any(c.isalpha() for c in text):
            kinds = {_local(x.tag) for x in inner}
            names = " ".join(v for k, v in ((_local(k), v) for k, v in e.attrib.items()) if k in ("class", "type", "id"))
            around = link or next((x.get("href") for x in inner if _local(x.tag) == "a" and (x.get("href") or "").strip() and _texts(x).strip()), None)
            yield tag, e.get("id") or "", names, around, "a" in kinds, bool(kinds & {"em", "strong", "b", "i"}), text
        return
    for child in e:
        yield from _leaves(child, skip, link)


def _texts(e: ET.Element) -> str:
    if isinstance(e.tag, str) and _local(e.tag) in SKIPPED:
        return ""
    return (e.text or "") + "".join(_texts(c) + (c.tail or "") for c in e)


def read_bilingual(file) -> Iterator[tuple[int, str, str, str]]:
    """(row_no, context, original, translation) of the first table of a word file, its header left out; rows of fewer than three cells are skipped."""
    with zipfile.ZipFile(file) as z:
        tables = list(ET.fromstring(z.read("word/document.xml")).iter(W + "tbl"))
    for n, row in enumerate(tables[0].iter(W + "tr") if tables else []):
        cells = ["\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p")) for c in row.iter(W + "tc")]
        if n and len(cells) >= 3:
            yield n, cells[0].strip(), cells[1].strip(), cells[2].strip()


def _source(name: str, columns: str, parse) -> type[DataSource]:
    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"path string, {columns}, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, parse, columns.count(",") + 1)

    Format.__name__ = Format.__qualname__ = name
    return Format


FORMATS = {
    "quire_docx": ("scope string, para int, run_no int, style string, outline int, format_key string, in_cell boolean, in_box boolean, numbered boolean, link boolean, raised boolean, lowered boolean, field boolean, breaks int, new_page boolean, text string", read_docx),
    "quire_xlsx": ("sheet_no int, sheet string, cell string, kind string, string_index int, text string", read_xlsx),
    "quire_pptx": ("slide int, para int, run_no int, format_key string, text string", read_pptx),
    "quire_epub": ("doc_no int, href string, pos int, tag string, id string, names string, link string, links boolean, emphasis boolean, text string", read_epub),
    "quire_epub_guide": ("kind string, href string, pos int, target string, label string", read_epub_guide),
    "quire_epub_book": ("title string, creators array<string>, publisher string, language string, date string, identifier string, description string, cover_image string, cover_page string", read_epub_book),
    "quire_bilingual": ("row_no int, context string, original string, translation string", read_bilingual),
}
#: What a broken file raises.
BROKEN = (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, ValueError, StopIteration)


def register(spark: SparkSession) -> None:
    """Makes all formats known to a session."""
    for name, (columns, parse) in FORMATS.items():
        spark.dataSource.register(_source(name, columns, parse))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, columns of the format, error) of all files of a path or pattern on any file system: Spark reads them, tasks parse them."""
    columns, parse = FORMATS[name]
    schema = T.StructType.fromDDL(f"path string, {columns}, error string")
    width = len(schema) - 2
    nothing = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    rows += [(where, *row, None) for row in parse(io.BytesIO(content))]
                except BROKEN as e:
                    rows.append((where, *[None] * width, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=schema.names).astype(object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, nothing)
