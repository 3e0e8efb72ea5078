"""Workbooks (.xlsx) read and written with what the standard library offers. A sheet has at most 1,048,576 rows, so it fits the driver."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS = 1_048_576


def _column(reference: str) -> int:
    """Place of a cell's column, 0 for A."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.attrib["r"]) if "r" in c.attrib else k
                v = c.find(f"{_MAIN}v")
                if c.attrib.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if c.attrib.get("t") == "s" else v.text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, its first row as header, every column a string; ValueError if the file is no such workbook."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise ValueError(f"{path} is no .xlsx workbook")
    rows = rows_of(bytes(content))
    header = [h or f"column_{i}" for i, h in enumerate(rows[0])] if rows else ["column_0"]
    body = [tuple((r + [None] * len(header))[: len(header)]) for r in rows[1:] if any(x is not None for x in r)]
    return spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in header))


def _sheet(df: DataFrame) -> str:
    lines = [df.columns, *[list(r) for r in df.limit(ROWS - 1).collect()]]
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    body = "".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines)
    return f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def pack(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook with one sheet per small frame."""
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name="{escape(name)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(df) for i, df in zip(n, sheets.values())}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def write(sheets: dict[str, DataFrame], path: str) -> None:
    """Writes a workbook to any file system the session knows."""
    spark = next(iter(sheets.values())).sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(pack(sheets)))
    finally:
        stream.close()

