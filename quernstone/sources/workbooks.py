"""Workbooks as cells: (file, sheet, row, col, kind, value, bold)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row int, col int, kind string, value string, bold boolean"
#: Names of the parts and elements of a workbook file.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_KINDS = {"b": "boolean", "e": "error", "s": "string", "str": "string", "inlineStr": "string"}


def list_sources(spark: SparkSession, folder: str, const: str = "const", enum: str = "enum") -> DataFrame:
    """(path, content, kind) of the workbooks in a folder: lock files left out; const and enum by name prefix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    kind = F.when(F.startswith(name, F.lit(const)), F.lit("const")).when(F.startswith(name, F.lit(enum)), F.lit("enum")).otherwise(F.lit("data"))
    return files.where(~F.startswith(name, F.lit("~$"))).select("path", "content", kind.alias("kind"))


def workbook_cells(sources: DataFrame, cells_at_once: int = 10_000) -> DataFrame:
    """Cells of all sheets but those named ``#...``.

    A task reads its files one at a time and gives a sheet in frames of ``cells_at_once``. A sheet is pulled through the
    parser, so of a file no more than its compressed bytes and its shared texts stand in memory.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for sheet, rows in _sheets(content):
                    for some in batched(rows, cells_at_once):
                        yield pd.DataFrame([(path.rsplit("/", 1)[-1], sheet, *r) for r in some], columns=[c.split()[0] for c in CELLS.split(", ")])

    return sources.select("path", "content").mapInPandas(read, CELLS)


def _pulled(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements ``tag`` of a part, each dropped with all around it once it is done with."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
        if above and not any(a.tag == tag for a in above):
            above[-1].remove(element)


def _sheets(content: bytes) -> Iterator[tuple[str, Iterator[tuple]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        tree = lambda part: ElementTree.fromstring(book.read(part))
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in _pulled(book.open("xl/sharedStrings.xml"), f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        bold = _bold_styles(tree("xl/styles.xml")) if "xl/styles.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for s in tree("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            if not s.get("name").startswith("#"):
                with book.open("xl/" + targets[s.get(_REL)].removeprefix("/xl/")) as part:
                    yield s.get("name"), _cells(_pulled(part, f"{_MAIN}c"), shared, bold)


def _bold_styles(styles: ElementTree.Element) -> list[bool]:
    fonts = [f.find(f"{_MAIN}b") is not None for f in styles.iterfind(f"{_MAIN}fonts/*")]
    return [fonts[int(x.get("fontId", 0))] if fonts else False for x in styles.iterfind(f"{_MAIN}cellXfs/*")]


def _cells(found: Iterator[ElementTree.Element], shared: list[str], bold: list[bool]) -> Iterator[tuple]:
    for c in found:
        letters, row = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
        col = 0
        for x in letters:
            col = col * 26 + ord(x) - 64
        kind, v = _KINDS.get(c.get("t", "n"), "numeric"), c.find(f"{_MAIN}v")
        text = None if v is None else v.text
        if c.get("t") == "s":
            text = shared[int(text)]
        elif c.get("t") == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif kind == "boolean" and text is not None:
            text = "true" if text == "1" else "false"
        style = int(c.get("s", 0))
        yield int(row) - 1, col - 1, "blank" if text is None else kind, text, bool(bold[style]) if style < len(bold) else False
