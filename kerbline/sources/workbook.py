"""Sheets of spreadsheet workbooks (zipped XML) as rows of text.

Workbooks are read as binary files, so any store will do, and parsed as a stream in the task that has the file; in memory are
its shared strings and a batch of rows. Whole numbers are written without a fraction, dates and times as ISO dates, truth values as true and false;
blank cells, errors and broken files are null or no rows.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
ROWS = "file string, row int, cells array<string>"
BATCH = 2000
# The numbers of built-in formats that show dates or times, and what a number of days counts from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH, EPOCH_1904 = datetime.date(1899, 12, 30), datetime.date(1904, 1, 1)


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(book: zipfile.ZipFile, path: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of that name, one at a time; what has been seen is forgotten."""
    if path not in book.namelist():
        return
    with book.open(path) as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e.tag) == wanted:
                yield e
                e.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of its runs, without phonetic ones."""
    out = []
    for child in e:
        if _name(child.tag) == "t":
            out.append(child.text or "")
        elif _name(child.tag) == "r":
            out += [t.text or "" for t in child if _name(t.tag) == "t"]
    return "".join(out)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates."""
    own = {}
    for e in _elements(book, "xl/styles.xml", "numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", "")).lower()
        own[int(e.get("numFmtId", -1))] = bool(re.search(r"[dmyh]", bare)) and "general" not in bare
    for xfs in _elements(book, "xl/styles.xml", "cellXfs"):
        ids = [int(x.get("numFmtId", 0)) for x in xfs]
        return {i for i, f in enumerate(ids) if own.get(f, f in DATE_FORMATS)}
    return set()


def _sheet_path(book: zipfile.ZipFile, sheet: int) -> tuple[str, datetime.date]:
    """The file of the sheet at that place, and the day from which days count."""
    links = {e.get("Id"): e.get("Target", "") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    ids = [next((v for k, v in e.attrib.items() if _name(k) == "id"), None) for e in _elements(book, "xl/workbook.xml", "sheet")]
    since = [e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr")]
    target = links[ids[sheet]]
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    return path, EPOCH_1904 if any(since) else EPOCH


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """The number (from 1) and the cells of each row that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        path, epoch = _sheet_path(book, sheet)
        number = 0
        for row in _elements(book, path, "row"):
            number = int(row.get("r", number + 1))
            cells: list[str | None] = []
            for cell in row:
                at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = cell.get("t", "n"), next((x.text for x in cell if _name(x.tag) == "v"), None)
                if kind == "inlineStr":
                    cells[at] = next((_text(x) for x in cell if _name(x.tag) == "is"), None)
                elif value is None or kind == "e":
                    continue
                elif kind == "s":
                    cells[at] = shared[int(value)]
                elif kind == "b":
                    cells[at] = "true" if value.strip() == "1" else "false"
                elif kind == "n" and int(cell.get("s", 0)) in dates:
                    cells[at] = (epoch + datetime.timedelta(days=int(float(value)))).isoformat()
                elif kind == "n":
                    exact = Decimal(value)
                    cells[at] = str(int(exact)) if exact == exact.to_integral_value() else repr(float(value))
                else:
                    cells[at] = value
            if any(x is not None and x.strip() for x in cells):
                yield number, cells


def read_rows(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """file, row and cells of the workbooks' sheets at that place (from 0)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        frame = lambda: pd.DataFrame(held, columns=["file", "row", "cells"])
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for number, cells in sheet_rows(content, sheet):
                        held.append((file, number, cells))
                        if len(held) >= BATCH:
                            yield frame()
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, LookupError, ValueError):
                    continue  # a broken workbook has the rows before the break
        if held:
            yield frame()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content").mapInPandas(parse, ROWS)


def read_sheet(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A text column for each name in the workbooks' header rows (their first ones), trimmed and in lower case; of equal names the last one counts.

    The names are read first. Workbooks may order their columns differently.
    """
    rows = read_rows(spark, path, sheet)
    first = rows.groupBy("file").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("top"))
    heads = first.select("file", "top", F.transform("header", lambda h: F.lower(F.trim(F.coalesce(h, F.lit(""))))).alias("header"))
    names = [r["n"] for r in heads.select(F.explode("header").alias("n")).where("n <> ''").distinct().orderBy("n").collect()]
    body = rows.join(heads, "file").where(c("row") > c("top"))
    place = lambda n: F.size("header") - F.array_position(F.reverse("header"), n).cast("int")
    return body.select(*(F.when(F.array_contains("header", n), F.nullif(F.trim(F.get("cells", place(n))), F.lit(""))).alias(n) for n in names))
