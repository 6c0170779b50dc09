"""`.xlsx` scan without an Excel package: `binaryFile` + `mapInPandas` over the zip/XML.

Each workbook is one file row; a task unpacks its first worksheet with the standard
library and emits text cells, some thousand rows at a time. Numbers stay as their stored
text and cells with a date format become date text; the cleaner coerces types afterwards.
Legacy `.xls` is not read.
"""

from __future__ import annotations

import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
ROWS_AT_ONCE = 5_000
REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


#: Fixed values of the format: built-in number formats that are dates, the day before day 1, and
#: the marks of a date in a custom format (outside quotes, escapes and brackets).
DATE_FORMAT_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')
_DATE_MARK = re.compile(r"[ymdhs]", re.IGNORECASE)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format is a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.findall("m:numFmts/m:numFmt", NS)
              if _DATE_MARK.search(_LITERAL.sub("", f.get("formatCode") or ""))}
    plain = {int(f.get("numFmtId")) for f in root.findall("m:numFmts/m:numFmt", NS)} - custom
    dates = (DATE_FORMAT_IDS | custom) - plain
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)) if int(xf.get("numFmtId") or 0) in dates}


def _date_text(serial: str, since_1904: bool) -> str:
    """A serial day number as `yyyy-MM-dd` or, with a time, `yyyy-MM-dd HH:mm:ss`."""
    when = EPOCH[since_1904] + timedelta(seconds=round(float(serial) * 86400))
    return when.strftime("%Y-%m-%d" if when.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """(path of the first worksheet, whether days count from 1904)."""
    wb = ET.fromstring(book.read("xl/workbook.xml"))
    first, props = wb.find("m:sheets/m:sheet", NS), wb.find("m:workbookPr", NS)
    target = "xl/worksheets/sheet1.xml"
    if first is not None and "xl/_rels/workbook.xml.rels" in book.namelist():
        rid = first.get(f"{{{NS['r']}}}id")
        for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{REL_NS}Relationship"):
            if rel.get("Id") == rid:
                t = rel.get("Target").lstrip("/")
                target = t if t.startswith("xl/") else "xl/" + t
    return target, props is not None and props.get("date1904") in ("1", "true")


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Cell text of the first worksheet, row by row (missing cells None; dates as text)."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
        dates, (target, since_1904) = _date_styles(book), _sheet(book)
        with book.open(target) as xml:
            for _, row in ET.iterparse(xml):
                if row.tag != f"{{{NS['m']}}}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.findall("m:c", NS)):
                    kind, v = c.get("t"), c.find("m:v", NS)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                    elif v is None or v.text is None:
                        value = None
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind in (None, "n") and int(c.get("s") or 0) in dates:
                        value = _date_text(v.text, since_1904)
                    else:
                        value = v.text
                    cells[_col_index(c.get("r")) if c.get("r") else i] = value
                yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]
                row.clear()


def first_sheet_rows(data: bytes) -> list[list[str | None]]:
    return list(sheet_rows(data))


def _header(row: list[str | None]) -> list[str]:
    return [c.strip() if c is not None and c.strip() else f"column_{i}" for i, c in enumerate(row)]


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read every `.xlsx` under `path` (first sheet, first row = header) as text columns.

    Cells are matched by their workbook's own header. The result has all columns of all
    workbooks, in order of name of file and place (`columns`: just these); a column that a
    workbook lacks is null there.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    if columns is None:
        # only distinct header cells reach the driver
        def headers(batches):
            for pdf in batches:
                for name, content in zip(pdf["path"], pdf["content"], strict=True):
                    head = _header(next(sheet_rows(bytes(content)), []))
                    yield pd.DataFrame({"name": head, "file": name, "pos": range(len(head))})
        found = (files.select("path", "content").mapInPandas(headers, "name string, file string, pos int")
                 .groupBy("name").agg(F.min(F.struct("file", "pos")).alias("first")).orderBy("first").collect())
        if not found:
            raise ValueError(f"no .xlsx files with a header under {path}")
        columns = [r.name for r in found]
    names = list(columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])

    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = sheet_rows(bytes(content))
                place = {name: i for i, name in reversed(list(enumerate(_header(next(rows, [])))))}
                at = [place.get(n) for n in names]
                while chunk := [[r[i] if i is not None and i < len(r) else None for i in at]
                                for r in itertools.islice(rows, ROWS_AT_ONCE)]:
                    yield pd.DataFrame(chunk, columns=names)

    return files.select("content").mapInPandas(parse, schema)
