"""Rows of the first sheet of xlsx files. Files are read with their bytes by Spark, so that they can
be in any store; a task unzips one at a time and reads its sheet as a stream of XML events, holding the
shared strings and one row. A Python data source would have to open the files itself, which it can
not in a store that only Spark's readers reach."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def files(spark: SparkSession, roots: list[str], glob: str = "*.xlsx") -> DataFrame:
    """(path, content) of the workbooks below roots."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots).select("path", "content")


def _column(reference: str) -> int:
    """The place of a cell's column, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    return "".join(t.text or "" for x in element for t in ([x] if x.tag == f"{MAIN}t" else x.iter(f"{MAIN}t") if x.tag == f"{MAIN}r" else []))


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells) of the first sheet of a workbook; missing cells are empty. Strings, numbers
    and errors are as they stand, booleans TRUE and FALSE."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        sheets = [e.attrib.get(RELATION) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        if not sheets:
            return
        targets = {e.attrib["Id"]: e.attrib["Target"] for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[0]].lstrip("/")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{MAIN}si":
                        shared.append(_text(e))
                        e.clear()
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                number = int(e.attrib.get("r", number + 1))
                cells: list[str] = []
                for c in e.iter(f"{MAIN}c"):
                    at = _column(c.attrib["r"]) if "r" in c.attrib else len(cells)
                    kind, v = c.attrib.get("t", "n"), c.find(f"{MAIN}v")
                    inner = c.find(f"{MAIN}is")
                    text = _text(inner) if inner is not None else (v.text or "") if v is not None else ""
                    text = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = text
                yield number, cells
                e.clear()


def rows(files: DataFrame, columns: list[str], header: bool = True, batch: int = 4096) -> DataFrame:
    """(path, row, *columns) of files(path, content): the first sheet's cells from column A on, as text;
    header: the first row is skipped. A file that is no workbook has no rows and does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "row", *columns]

        def told(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.int64()), *(pa.array([x[2][k] for x in held], pa.string()) for k in range(len(columns)))], names)

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                held, first = [], header
                try:
                    for number, cells in sheet_rows(content.as_py() or b""):
                        if first:
                            first = False
                            continue
                        held.append((path.as_py(), number, [*cells, *[""] * len(columns)][: len(columns)]))
                        if len(held) == batch:
                            yield told(held)
                            held = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    held = []
                if held:
                    yield told(held)

    return files.select("path", "content").mapInArrow(run, ", ".join(["path string", "row bigint", *(f"`{c}` string" for c in columns)]))
