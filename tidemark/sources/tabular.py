"""Sheets as frames: XLSX, CSV and TSV files wherever Spark can read them, and a banded sector sheet.

Files are read by Spark's binary source and taken apart in tasks, one file at a time, so
a folder of exports is read in parallel and no path has to be local.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of file, by the ending of their name.
SHEETS = frozenset({".xlsx", ".xlsm"})
SEPARATORS = {".csv": ",", ".tsv": "\t", ".tab": "\t"}


def _elements(stream: IO[bytes], *kinds: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """(kind, element) of the named kinds as they end, whatever their name space; each is forgotten afterwards."""
    for _, element in ElementTree.iterparse(stream):
        kind = element.tag.rpartition("}")[2]
        if kind in kinds:
            yield kind, element
            element.clear()


def _spoken(element: ElementTree.Element) -> str:
    """The text runs of a string item; phonetic readings (rPh) are not part of it."""
    out = []
    for part in element:
        kind = part.tag.rpartition("}")[2]
        if kind == "t":
            out.append(part.text or "")
        elif kind == "r":
            out.append(_spoken(part))
    return "".join(out)


def _place(reference: str) -> int:
    """The column's number, from 0, of a reference such as AB12: letters are digits to base 26 from 1 to 26."""
    letters = reference.rstrip("0123456789")
    return sum((ord(letter) - 64) * 26**k for k, letter in enumerate(reversed(letters))) - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the sheet the workbook lists first."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        with book.open("xl/workbook.xml") as stream:
            first = next((v for _, e in _elements(stream, "sheet") for k, v in e.attrib.items() if k.endswith("}id")), None)
        with book.open("xl/_rels/workbook.xml.rels") as stream:
            for _, relation in _elements(stream, "Relationship"):
                if relation.get("Id") == first:
                    target = relation.get("Target", "")
                    return target.lstrip("/") if target.startswith("/") else str(PurePosixPath("xl") / target)
    return min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))


def _sheet_rows(content: bytes) -> Iterator[list[str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                strings = [_spoken(item) for _, item in _elements(stream, "si")]
        with book.open(_first_sheet(book)) as stream:
            row: dict[int, str] = {}
            inline = raw = ""
            for kind, element in _elements(stream, "is", "v", "c", "row"):
                if kind == "is":
                    inline = _spoken(element)
                elif kind == "v":
                    raw = element.text or ""
                elif kind == "c":
                    at = _place(element.get("r")) if element.get("r") else max(row, default=-1) + 1
                    row[at] = strings[int(raw)] if element.get("t") == "s" and raw else inline or raw
                    inline = raw = ""
                else:
                    yield [row.get(i, "") for i in range(max(row, default=-1) + 1)]
                    row = {}


def _kind(name: str) -> str:
    kind = Path(name).suffix.lower()
    if kind not in SHEETS and kind not in SEPARATORS:
        raise ValueError(f"{name}: only {', '.join(sorted(SHEETS | set(SEPARATORS)))} are read")
    return kind


def rows_of(content: bytes, name: str) -> Iterator[list[str]]:
    """The cells of a file as text, row by row; missing ones are empty. Of a workbook, the first sheet."""
    kind = _kind(name)
    return _sheet_rows(content) if kind in SHEETS else csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter=SEPARATORS[kind])


def read_rows(path: str) -> list[list[str]]:
    """One small file on the driver."""
    _kind(path)
    return list(rows_of(Path(path).read_bytes(), path))


def grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of all files that ``path`` names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                cells = list(rows_of(content.as_py(), name))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["path", "row", "cells"])

    return files.mapInArrow(take_apart, "path string, row int, cells array<string>")


def frame(spark: SparkSession, path: str) -> DataFrame:
    """The rows under the header row of files that have the same one, as strings; short rows are filled up with empty ones."""
    grid = grids(spark, path)
    head = [h.strip() for h in grid.where("row = 0").select("cells").first()["cells"]]
    cells = F.transform(F.sequence(F.lit(0), F.lit(len(head) - 1)), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return grid.where("row > 0").select(cells.alias("cells")).select(*(F.col("cells")[i].alias(h) for i, h in enumerate(head)))


def sections(grid: list[list[str]]) -> list[tuple[str, list[str]]]:
    """(title, tickers) of a banded sheet: a row with one text is a title, rows under it begin with a ticker."""
    out: list[tuple[str, list[str]]] = []
    for row in grid:
        cells = [c.strip() for c in row if c and c.strip()]
        if len(cells) == 1 and not re.fullmatch(r"[A-Z0-9]{3,6}", cells[0]):
            out.append((cells[0], []))
        elif cells and out and re.fullmatch(r"[A-Z0-9]{3,6}", cells[0]):
            out[-1][1].append(cells[0])
    return out


def sector_tree(parts: list[tuple[str, list[str]]]) -> list[tuple[str, str | None]]:
    """(title, parent): a section whose members all are in the last main section is one of its sub-sectors."""
    out, main = [], None
    for title, own in parts:
        if main and own and set(own) <= set(main[1]) and len(own) < len(main[1]):
            out.append((title, main[0]))
        else:
            main = (title, own)
            out.append((title, None))
    return out


def codes(titles: list[str]) -> list[str]:
    """A slug for each title; later equal ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for t in titles:
        base = re.sub(r"[^a-z0-9]+", "-", t.translate(str.maketrans("İıŞşÇçĞğÖöÜü", "IiSsCcGgOoUu")).lower()).strip("-")
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}-{seen[base]}")
    return out
