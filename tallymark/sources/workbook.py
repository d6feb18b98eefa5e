"""Workbooks (.xlsx) as rows, and rows as workbooks.

A workbook is a zip of XML parts. Spark reads the files (any file system that it knows); a task streams the chosen sheet of each of
its workbooks, cell by cell, so it holds a workbook's bytes, its shared strings and one row. Cells come as text, as they
are stored: numbers by their digits, dates by their day numbers, truth values as TRUE and FALSE, empty cells as null. Files that
are no workbooks give no rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the format's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
ROWS = "file_path string, sheet string, row long, layout long, cells array<string>"
STEP_ROWS = 5000


def column_number(ref: str) -> int:
    """A, B, ... Z, AA, ... as 0, 1, ..."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, last = divmod(n - 1, 26)
        out = chr(65 + last) + out
    return out


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {x.get("name"): place(targets[x.get(f"{LINKS}id")]) for x in book.iter(f"{MAIN}sheet") if x.get(f"{LINKS}id") in targets}
        self.sheets = {k: v for k, v in self.sheets.items() if v in names}
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as part:
                for _, x in ElementTree.iterparse(part):
                    if x.tag == f"{MAIN}si":
                        self.strings.append(self.text(x))
                        x.clear()

    @staticmethod
    def text(x: ElementTree.Element) -> str:
        """A string's runs, without the readings that may stand beside them."""
        return "".join(t.text or "" for run in x if run.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([run] if run.tag == f"{MAIN}t" else run.iter(f"{MAIN}t")))

    def value(self, cell: ElementTree.Element) -> str | None:
        kind, stored = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            inner = cell.find(f"{MAIN}is")
            return self.text(inner) if inner is not None else None
        if stored is None or stored.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(stored.text)]
        return {"0": "FALSE", "1": "TRUE"}.get(stored.text, stored.text) if kind == "b" else stored.text

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        """The rows of a sheet that have a cell."""
        with self.zip.open(self.sheets[sheet]) as part:
            for _, x in ElementTree.iterparse(part):
                if x.tag == f"{MAIN}row":
                    out: list[str | None] = []
                    for nth, cell in enumerate(x.iter(f"{MAIN}c")):
                        at = column_number(cell.get("r")) if cell.get("r") else nth
                        out += [None] * (at + 1 - len(out))
                        out[at] = self.value(cell)
                    x.clear()
                    if any(v is not None for v in out):
                        yield out


def sheet_rows(books: DataFrame, choose: Callable[[list[str], str], str | None]) -> DataFrame:
    """(file_path, sheet, row, layout, cells) of the sheet that `choose` takes of each workbook (file_path, content), given the names of its
    sheets and the file's path. Row 0 is the header; layout tells equal headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column("file_path")[i].as_py(), batch.column("content")[i].as_py()
                try:
                    book = Workbook(content or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                if not book.sheets or (sheet := choose(list(book.sheets), path)) is None:
                    continue
                held, first, layout = [], 0, None
                for n, cells in enumerate(book.rows(sheet)):
                    layout = zlib.crc32("\0".join("" if c is None else c for c in cells).encode()) if layout is None else layout
                    held.append(cells)
                    if len(held) == STEP_ROWS:
                        yield rows_of(path, sheet, first, layout, held)
                        held, first = [], n + 1
                if held:
                    yield rows_of(path, sheet, first, layout, held)

    return books.select("file_path", "content").mapInArrow(read, ROWS)


def rows_of(path: str, sheet: str, first: int, layout: int, cells: list) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([sheet] * n), pa.array(range(first, first + n)), pa.array([layout] * n), pa.array(cells, pa.list_(pa.string()))], [x.split()[0] for x in ROWS.split(", ")])


def by_layout(rows: DataFrame, most: int = 1000) -> list[tuple[list[str], DataFrame]]:
    """(columns, frame) for each header that sheets have: the sheet's columns, file_path and _row. Headers are few, whatever the
    number of files. `rows` is read once for each: checkpoint it before."""
    headers = rows.where("row = 0").select("layout", "cells").distinct().limit(most + 1).collect()
    if len(headers) > most:
        raise ValueError(f"over {most} different headers")
    out = []
    for h in sorted(headers, key=lambda h: [c or "" for c in h.cells]):
        names = [c if c else f"_c{i}" for i, c in enumerate(h.cells)]
        names = [c if c not in names[:i] else f"{c}{i}" for i, c in enumerate(names)]
        own = rows.where((F.col("layout") == h.layout) & (F.col("row") > 0))
        out.append((names, own.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)], "file_path", "row")))
    return out


def written(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets of cells (text, numbers, truth values, None)."""
    strings: dict[str, int] = {}

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'

    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, rows in enumerate(sheets.values(), 1):
            lines = [f'<row r="{i}">{"".join(cell(f"{column_name(j)}{i}", v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows, 1)]
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        said = "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in strings)
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{MAIN[1:-1]}">{said}</sst>')
        names = "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, x in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS[1:-1]}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{LINKS[1:-1]}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}">{links}<Relationship Id="rId0" Type="{LINKS[1:-1]}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{LINKS[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
    return out.getvalue()


def as_workbooks(df: DataFrame, n: int, order: str, sheet: str, path: Column, more: dict[str, list[list]] | None = None) -> DataFrame:
    """(file_path, content): at most n workbooks of a frame, each a range of the rows by `order`, in a sheet behind others. path: from
    the column `part`, the workbook's number."""
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows: list[list] = [names]
        for batch in batches:
            rows += [list(r.values()) for r in batch.to_pylist()]
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([written({**(more or {}), sheet: rows})], pa.binary())], ["part", "content"])

    return df.repartitionByRange(n, order).sortWithinPartitions(order).mapInArrow(write, "part int, content binary").select(path.alias("file_path"), "content")
