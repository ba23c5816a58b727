"""NumPy arrays and archives, and spreadsheets: read in the tasks from the bytes of each file, one row per array row.

Object arrays are refused (they would be unpickled). A file that cannot be read is an error, or with ``strict=False`` a row with
its message and no values.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_ROWS = "file string, name string, row long, shape array<long>, values array<double>, error string"


def _read(spark: SparkSession, root: str, pattern: str, rows_of: Callable[[bytes], Iterator[tuple]], schema: str, strict: bool) -> DataFrame:
    names = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "content")

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                out = []
                try:
                    for r in rows_of(bytes(content)):
                        out.append((path, *r, None))
                        if len(out) == 4096:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except Exception as e:
                    if strict:
                        raise
                    out.append((path, *[None] * (len(names) - 2), str(e)))
                yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(work, schema)


def _array_rows(a: np.ndarray, name: str) -> Iterator[tuple]:
    if a.dtype.kind not in "biuf":
        raise ValueError(f"no numbers: {a.dtype}")
    flat = a.reshape(len(a), a.size // max(1, len(a))) if a.ndim else a.reshape(1, 1)
    for i, v in enumerate(flat):
        yield name, i, list(a.shape), v.astype(float).tolist()


def read_npy(spark: SparkSession, root: str, pattern: str = "*.npy", strict: bool = True) -> DataFrame:
    """file, name (empty), row, shape, values, error: a row per entry of each array's first axis, further axes flattened."""
    return _read(spark, root, pattern, lambda b: _array_rows(np.load(io.BytesIO(b), allow_pickle=False), ""), _ROWS, strict)


def read_npz(spark: SparkSession, root: str, pattern: str = "*.npz", strict: bool = True) -> DataFrame:
    """The same for every array of each archive; ``name`` is the array's."""

    def rows(b: bytes) -> Iterator[tuple]:
        with np.load(io.BytesIO(b), allow_pickle=False) as z:
            for name in z.files:
                yield from _array_rows(z[name], name)

    return _read(spark, root, pattern, rows, _ROWS, strict)


def write_npz(df: DataFrame, folder: str, by: str, arrays: list[str], order: list[str]) -> DataFrame:
    """One compressed archive per value of ``by`` in ``folder``, with an array per column of ``arrays`` (numbers or arrays of one
    length), rows in ``order``; returns ``by``, file and n_rows. Runs now.

    ``folder`` must be a path that all executors see. A group is one archive and so one task. Files appear under their final name
    in one step, so a task that is repeated does no harm.
    """
    root = re.sub(r"^file:/*", "/", folder)
    kind = dict(df.dtypes)[by]

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        key = pdf[by].iloc[0]
        os.makedirs(root, exist_ok=True)
        name = os.path.join(root, re.sub(r"[^\w.=-]", "_", f"{by}={key}") + ".npz")
        part = f"{name}.{uuid.uuid4().hex}"
        stack = lambda c: np.stack([np.asarray(v, float) for v in pdf[c]]) if pdf[c].map(np.ndim).any() else pdf[c].to_numpy(float)
        with open(part, "wb") as f:
            np.savez_compressed(f, **{c: stack(c) for c in arrays})
        os.replace(part, name)
        return pd.DataFrame({by: [key], "file": [name], "n_rows": [len(pdf)]})

    done = df.select(*dict.fromkeys([by, *arrays, *order])).groupBy(by).applyInPandas(save, f"`{by}` {kind}, file string, n_rows long")
    return df.sparkSession.createDataFrame(done.collect(), done.schema)  # one row per archive


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet_rows(b: bytes) -> Iterator[tuple]:
    """sheet, row (from 1), cells by column letter."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
        shared = [text(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").iter(f"{_NS}sheet"):
            where = target[sheet.get(f"{_REL}id")]
            for row in tree(where.lstrip("/") if where.startswith("/") else f"xl/{where}").iter(f"{_NS}row"):
                cells = {}
                for c in row.iter(f"{_NS}c"):
                    v = c.find(f"{_NS}v")
                    kind = c.get("t")
                    value = text(c) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else v.text if v is not None else None
                    if value is not None:
                        cells[re.sub(r"\d", "", c.get("r"))] = value
                yield sheet.get("name"), int(row.get("r")), cells


def read_sheets(spark: SparkSession, root: str, pattern: str = "*.xlsx", strict: bool = True) -> DataFrame:
    """file, sheet, row, cells (column letter to text as stored), error: the rows of all sheets of workbooks."""
    return _read(spark, root, pattern, _sheet_rows, "file string, sheet string, row long, cells map<string,string>, error string", strict)


def sheet_table(rows: DataFrame, sheet: str, columns: dict[str, str], header: int = 1) -> DataFrame:
    """The rows of one sheet below its header, as columns: ``columns`` maps a column letter to a name."""
    r = rows.where((F.col("sheet") == sheet) & (F.col("row") > header))
    return r.select(*[F.col("cells")[c].alias(n) for c, n in columns.items()])


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1", most_rows: int = 100_000) -> int:
    """A small reference table as a workbook with one sheet of text cells, its header in row 1; returns the rows written.

    Spreadsheets are for tables that people read: more than ``most_rows`` rows are an error, never cut. Null cells stay empty.
    """
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a spreadsheet")
    book = ElementTree.Element(f"{_NS}workbook")
    ElementTree.SubElement(ElementTree.SubElement(book, f"{_NS}sheets"), f"{_NS}sheet", {"name": sheet, "sheetId": "1", f"{_REL}id": "rId1"})
    data = ElementTree.Element(f"{_NS}worksheet")
    body = ElementTree.SubElement(data, f"{_NS}sheetData")
    for i, values in enumerate([df.columns, *rows], 1):
        line = ElementTree.SubElement(body, f"{_NS}row", {"r": str(i)})
        for k, v in enumerate(values):
            if v is not None:
                c = ElementTree.SubElement(line, f"{_NS}c", {"r": f"{_letters(k)}{i}", "t": "inlineStr"})
                ElementTree.SubElement(ElementTree.SubElement(c, f"{_NS}is"), f"{_NS}t").text = str(v)
    pack = "http://schemas.openxmlformats.org/package/2006/"
    links = ElementTree.Element(f"{{{pack}relationships}}Relationships")
    ElementTree.SubElement(links, f"{{{pack}relationships}}Relationship", {"Id": "rId1", "Type": _REL[1:-1] + "/worksheet", "Target": "worksheets/sheet1.xml"})
    tops = ElementTree.Element(f"{{{pack}relationships}}Relationships")
    ElementTree.SubElement(tops, f"{{{pack}relationships}}Relationship", {"Id": "rId1", "Type": _REL[1:-1] + "/officeDocument", "Target": "xl/workbook.xml"})
    types = ElementTree.Element(f"{{{pack}content-types}}Types")
    for ext, kind in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml")):
        ElementTree.SubElement(types, f"{{{pack}content-types}}Default", {"Extension": ext, "ContentType": kind})
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    for part, kind in (("/xl/workbook.xml", "sheet.main+xml"), ("/xl/worksheets/sheet1.xml", "worksheet+xml")):
        ElementTree.SubElement(types, f"{{{pack}content-types}}Override", {"PartName": part, "ContentType": main + kind})
    where = re.sub(r"^file:/*", "/", path)
    os.makedirs(os.path.dirname(where), exist_ok=True)
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for name, root in (("[Content_Types].xml", types), ("_rels/.rels", tops), ("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/worksheets/sheet1.xml", data)):
            z.writestr(name, ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8"))
    return len(rows)


def _letters(k: int) -> str:
    """Column letters: 0 is A, 26 is AA."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out
