"""Results: the bilingual table as word files, and the report of an audit."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.sequence import join_ordered

#: Parts of the smallest word file.
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _cell(text: str) -> str:
    clean = "".join(c for c in text if c in "\t\n" or c >= " ")
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in clean.split("\n"))
    return f"<w:tc>{paragraphs}</w:tc>"


def _table(rows: Iterator[tuple[str, str, str]]) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body><w:tbl>'
    for row in [("Context", "Original", "Translation")]:
        yield "<w:tr>" + "".join(map(_cell, row)) + "</w:tr>"
    for row in rows:
        yield "<w:tr>" + "".join(map(_cell, row)) + "</w:tr>"
    yield "</w:tbl><w:p/></w:body></w:document>"


def write_bilingual_docx(segments: DataFrame, folder: str, per_file: int = 20_000) -> DataFrame:
    """Writes `<doc_id>.bilingual.docx` per document (and part, of `per_file` segments) to a shared folder; (doc_id, part, path, rows).

    Expects doc_id, seq and the three texts; documents without segments get no
    file. A file is written aside and moved into place, so a repeated task
    leaves one whole file. Long documents are cut into parts, which bounds a task.
    """
    part = F.floor((F.col("seq") - 1) / per_file).cast("int")
    rows = segments.select("doc_id", part.alias("part"), "seq", *[F.coalesce(c, F.lit("")).alias(c) for c in ("context", "original", "translation")])

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        doc, n = int(pdf["doc_id"].iloc[0]), int(pdf["part"].iloc[0])
        path = os.path.join(folder, f"{doc}.bilingual.docx" if not n else f"{doc}.part{n}.bilingual.docx")
        aside = f"{path}.{os.getpid()}.tmp"
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", TYPES)
            z.writestr("_rels/.rels", RELS)
            with z.open("word/document.xml", "w", force_zip64=True) as f:
                for text in _table(zip(pdf["context"], pdf["original"], pdf["translation"])):
                    f.write(text.encode("utf-8"))
        os.replace(aside, path)
        return pd.DataFrame({"doc_id": [doc], "part": [n], "path": [path], "rows": [len(pdf)]})

    return rows.groupBy("doc_id", "part").applyInPandas(write, "doc_id bigint, part int, path string, rows bigint")


def write_epub(folder: str, path: str) -> None:
    """Packs an unpacked e-book: the mimetype first and stored, the rest compressed, names relative with slashes."""
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(folder, "mimetype"), "mimetype", zipfile.ZIP_STORED)
        for root, dirs, files in os.walk(folder):
            dirs.sort()
            for name in sorted(files):
                full = os.path.join(root, name)
                inner = os.path.relpath(full, folder).replace(os.sep, "/")
                if inner != "mimetype":
                    z.write(full, inner, zipfile.ZIP_DEFLATED)


def write_back(runs: DataFrame, keys: list[str], run_no: str, text: str, new: str) -> DataFrame:
    """Adds written: the first run of each group holds the new text with the outer white space of the group's old text, the others are empty."""
    from quire.functions.text import keep_edges

    groups = runs.groupBy(*keys).agg(F.min(run_no).alias("_first"), join_ordered(F.col(run_no), F.col(text)).alias("_old"))
    joined = runs.join(groups, keys)
    return joined.withColumn("written", F.when(F.col(run_no) == F.col("_first"), keep_edges(F.col("_old"), F.col(new))).otherwise(F.lit(""))).drop("_first", "_old")


def report_lines(findings: DataFrame) -> DataFrame:
    """One JSON line for each finding (doc_id, seq, reasons), to be written with write.text."""
    return findings.select(F.to_json(F.struct("doc_id", "seq", "reasons")).alias("value"))
