"""File formats: which reader takes a file and where its result goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and their readers.
READERS = {"docx": "word", "xlsx": "excel", "pptx": "powerpoint", "pdf": "pdf", "epub": "ebook", "mobi": "ebook", "azw3": "ebook"}


def extension(path: Column) -> Column:
    """Extension in lower case without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def reader_of(path: Column) -> Column:
    """Name of the reader, or failed for formats nobody reads."""
    out = F
    for name, reader in READERS.items():
        out = out.when(extension(path) == name, reader)
    return out.otherwise("failed")


def output_path(path: Column, folder: Column | None = None) -> Column:
    """The path of the translated file: `.translated` before the extension, in `folder` or beside the source."""
    stem, ext = F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    beside = F.concat(stem, F.lit(".translated"), ext)
    if folder is None:
        return beside
    name = F.regexp_extract(beside, r"([^/]*)$", 1)
    return F.when(F.trim(F.coalesce(folder, F.lit(""))) != "", F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), name)).otherwise(beside)
