"""XLSX workbooks as a data source: a partition for each sheet, read as a stream of rows."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from scorewright.shipping import ship

#: Headers that are read in lower case whatever their spelling. Fixed values.
KNOWN_HEADERS = ("id", "index", "question", "answer", "prediction", "hit", "category", "l2_category", "bench", "log")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def header(cell: str | None, at: int) -> str:
    """A column's name: stripped, of known names in lower case, of an empty cell by its place."""
    name = (cell or "").strip() or f"col_{at}"
    return name.lower() if name.lower() in KNOWN_HEADERS else name


def opened(path: str):
    """A file to read at random, of any file system that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


class Workbook:
    """Sheets of an XLSX file; shared strings are in memory, rows are not."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(opened(path))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        view = book.find(f".//{_MAIN}workbookView")
        self.active = int(view.get("activeTab", "0")) if view is not None else 0
        self.sheets = {s.get("name"): "xl/" + links[s.get(_LINK)].removeprefix("/xl/").removeprefix("xl/") for s in book.iter(f"{_MAIN}sheet")}
        self._strings: list[str] | None = None

    def _shared(self, at: int) -> str:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{_MAIN}si":
                            self._strings.append("".join(t.text or "" for r in (e, *e.findall(f"{_MAIN}r")) for t in r.findall(f"{_MAIN}t")))
                            e.clear()
        return self._strings[at]

    def _cell(self, c: ElementTree.Element) -> str | None:
        kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if value is None:
            return None
        if kind == "s":
            return self._shared(int(value))
        return {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        """The rows of a sheet by the places of their cells; gaps are null."""
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.findall(f"{_MAIN}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._cell(c)
                row.clear()
                yield cells


class Sheet(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class XlsxSource(DataSource):
    """Options: path; sheet: a name, or * for all sheets, by default the active one. Cells are strings."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def chosen(self) -> tuple[Workbook, list[str]]:
        book = Workbook(self.options["path"])
        wanted = self.options.get("sheet")
        names = list(book.sheets) if wanted == "*" else [wanted or list(book.sheets)[book.active]]
        if missing := [n for n in names if n not in book.sheets]:
            raise ValueError(f"no sheet {missing[0]!r} in {self.options['path']}")
        return book, names

    def schema(self) -> StructType:
        book, names = self.chosen()
        found = [header(c, i) for name in names for i, c in enumerate(next(book.rows(name), []))]
        return StructType([StructField(n, StringType()) for n in dict.fromkeys(found)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], self.chosen()[1], schema)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], schema: StructType):
        self.path, self.names, self.fields = path, names, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [Sheet(self.path, n) for n in self.names]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        rows = Workbook(partition.path).rows(partition.name)
        at = {header(c, i): i for i, c in enumerate(next(rows, []))}  # of equal headers the last one holds
        places = [at.get(n, -1) for n in self.fields]
        for row in rows:
            if any(c is not None for c in row):
                yield tuple(row[i] if 0 <= i < len(row) else None for i in places)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a workbook's active or named sheet, or of all with *, as strings: the first row names the columns, rows
    without any cell are left out, and a sheet without rows gives none."""
    ship(spark)
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("path", path)
    return (reader.option("sheet", sheet) if sheet else reader).load()
