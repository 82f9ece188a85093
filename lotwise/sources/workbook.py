"""Workbook sheets as a Spark data source, one task per file and sheet.

Uses the zip and XML modules of the standard library inside the tasks; sheets
are streamed, so a task holds the shared texts of one workbook and one row.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse, parse

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lotwise.errors import InputError
from lotwise.functions.names import unique_names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "file string, sheet string, sheet_position int, row int, cells array<string>"
DATE_STYLES = {14, 15, 16, 17, 22}  # fixed numbers of the built-in date formats


@dataclass
class SheetPartition(InputPartition):
    file: str
    sheet: str
    position: int
    member: str


def sheets_of(path: str) -> list[SheetPartition]:
    with zipfile.ZipFile(path) as book:
        targets = {
            r.get("Id"): r.get("Target") for r in parse(book.open("xl/_rels/workbook.xml.rels")).getroot()
        }
        sheets = parse(book.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet")
        found = []
        for position, sheet in enumerate(sheets):
            target = targets[sheet.get(REL_ID)]
            member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            found.append(SheetPartition(path, sheet.get("name"), position, member))
        return found


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    for _, item in iterparse(book.open("xl/sharedStrings.xml")):
        if item.tag == f"{MAIN}si":
            texts.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
            item.clear()
    return texts


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = parse(book.open("xl/styles.xml")).getroot()
    own = {
        int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
        if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))
    }
    formats = root.find(f"{MAIN}cellXfs")
    return {
        i for i, x in enumerate(formats if formats is not None else [])
        if int(x.get("numFmtId", 0)) in DATE_STYLES | own
    }


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _rows(part: SheetPartition) -> Iterator[tuple]:
    with zipfile.ZipFile(part.file) as book:
        texts, dates = _shared_texts(book), _date_styles(book)
        count = 0
        for _, row in iterparse(book.open(part.member)):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                cells.extend([None] * (at - len(cells)))
                value, kind = cell.findtext(f"{MAIN}v"), cell.get("t")
                if kind == "s" and value is not None:
                    value = texts[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif kind is None and value is not None and int(cell.get("s", 0)) in dates:
                    value = str(datetime(1899, 12, 30) + timedelta(days=float(value)))
                cells.append(value)
            number = int(row.get("r", count + 1))
            count = number
            row.clear()
            yield part.file, part.sheet, part.position, number, cells


class _SheetReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.sheet = options.get("sheet")
        self.list_only = options.get("listonly", "false").lower() == "true"

    def partitions(self):
        parts = [s for p in self.paths for s in sheets_of(p)]
        return [p for p in parts if self.sheet is None or p.sheet == self.sheet]

    def read(self, partition):
        if self.list_only:
            yield partition.file, partition.sheet, partition.position, 0, []
        else:
            yield from _rows(partition)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("path", "a.xlsx,b.xlsx")``"""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _SheetReader(self.options)


def _scan(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    wrong = [p for p in paths if not p.lower().endswith((".xlsx", ".xlsm"))]
    if wrong:
        raise InputError(f"not a workbook that can be read: {', '.join(wrong)}")
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", ",".join(paths))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def list_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, sheet, sheet_position``; the first sheet is the suggestion."""
    return _scan(spark, paths, listOnly="true").select("file", "sheet", "sheet_position")


def read_sheet(
    spark: SparkSession, paths: Sequence[str], sheet: str | None = None, header_row: int = 0,
) -> DataFrame:
    """One sheet of each workbook, all columns as text; header row counted from 0."""
    rows = _scan(spark, paths, **({"sheet": sheet} if sheet else {}))
    if sheet is None:
        rows = rows.filter(F.col("sheet_position") == 0)
    heads = rows.filter(F.col("row") == header_row + 1).select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise InputError("the workbooks need one common header row")
    fresh, _ = unique_names([c or "" for c in heads[0].cells])
    used = F.exists("cells", lambda c: c.isNotNull())
    return rows.filter((F.col("row") > header_row + 1) & used).select(
        *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(fresh)]
    )
