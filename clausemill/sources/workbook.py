"""Sheets of workbooks (Office Open XML), read as zipped XML in tasks: no library, any file system that the engine reads.

A file is one row of its content, as archives cannot be cut; its sheet is parsed as a stream, element by element, beside
the table of shared strings. Cells come as texts, as the file holds them: numbers and dates as their numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PLACE = re.compile(r"[A-Z]+")


def column_of(place: str) -> int:
    """The number of a cell's column, from 0: A is 0, AA is 26."""
    n = 0
    for c in _PLACE.match(place).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """The text of a string item or an inline string, its runs joined; phonetic runs are no text."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t") if part.tag == f"{_MAIN}r" else []))


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _member(z: zipfile.ZipFile, sheet: str) -> str:
    """The part of the archive that holds a sheet, by its name."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in book.iter(f"{_MAIN}sheet"):
        if s.get("name") == sheet:
            target = links[s.get(_LINK)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet} among {', '.join(s.get('name') for s in book.iter(f'{_MAIN}sheet'))}")


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, cells by column) of a sheet, in order; cells without a value are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = _shared(z)
        with z.open(_member(z, sheet)) as f:
            at = 0
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                at = int(node.get("r") or at + 1)
                cells, last = {}, -1
                for c in node.iter(f"{_MAIN}c"):
                    last = column_of(c.get("r")) if c.get("r") else last + 1
                    value, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                    if inline is not None:
                        cells[last] = _text(inline)
                    elif value is not None and value.text is not None:
                        kind = c.get("t")
                        cells[last] = strings[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text
                yield at, cells
                node.clear()


def header_of(cells: dict[int, str]) -> list[str]:
    """Names of the columns: empty ones by their number, repeated ones with a count behind."""
    names, seen = [], {}
    for k in range(max(cells, default=-1) + 1):
        name = cells.get(k) or f"Unnamed: {k}"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
    return names


def workbook_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str] | None = None, row: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of all .xlsx files of a folder, as texts; the first row names the columns.

    The names are those of the first file by path; columns of others are taken by name. Only ``columns`` are made where
    they are given. ``row`` names a column for the row's number in its sheet.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content")

    def first(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"names": [header_of(next(sheet_rows(c, sheet), (0, {}))[1]) for c in pdf["content"]]})

    found = files.orderBy("path").limit(1).mapInPandas(first, "names array<string>").first()
    names = list(found.names) if found else []
    if missing := [c for c in columns or [] if c not in names]:
        raise ValueError(f"no columns {', '.join(missing)} in sheet {sheet}")
    wanted = columns or names

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            for content in pdf["content"]:
                rows = sheet_rows(content, sheet)
                own = header_of(next(rows, (0, {}))[1])
                places = [own.index(c) if c in own else -1 for c in wanted]
                held = []
                for number, cells in rows:
                    held.append([*([number] if row else []), *[cells.get(p) for p in places]])
                    if len(held) >= 10_000:
                        yield pd.DataFrame(held, columns=[*([row] if row else []), *wanted], dtype=object)
                        held = []
                yield pd.DataFrame(held, columns=[*([row] if row else []), *wanted], dtype=object)

    fields = ([T.StructField(row, T.LongType())] if row else []) + [T.StructField(c, T.StringType()) for c in wanted]
    return files.mapInPandas(run, T.StructType(fields))
