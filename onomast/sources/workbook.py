"""Sheets of workbooks (Office Open XML), with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(reference: str) -> int:
    """The column (from 0) of a cell reference like AB12."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as lists of text; whole numbers without a decimal point."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): s.get(LINK) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if sheet not in found:
            raise ValueError(f"sheet {sheet} is missing")
        shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        target = links[found[sheet]]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _place(cell.get("r") or "") if cell.get("r") else len(out)
                    out.extend([None] * (at + 1 - len(out)))
                    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        out[at] = _text(cell)
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(value.text) if kind == "b" else re.sub(r"\.0$", "", value.text)
                yield out
                row.clear()


def read(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")
    header = next(iter(rows(bytes(files.first()["content"]), sheet)), [])
    names = {i: name.strip() for i, name in enumerate(header) if name and name.strip()}

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                body = rows(data, sheet)
                next(body, None)
                chunk: list[list[str | None]] = []
                for row in body:
                    if any(x is not None for x in row):
                        chunk.append([row[i] if i < len(row) else None for i in names])
                    if len(chunk) == 10_000:
                        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*chunk, strict=True)], list(names.values()))
                        chunk = []
                if chunk:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*chunk, strict=True)], list(names.values()))

    return files.mapInArrow(parse, T.StructType([T.StructField(n, T.StringType()) for n in names.values()]))
