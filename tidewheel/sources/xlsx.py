"""Tables as sheets of one XLSX workbook: tasks write the rows of their partitions, and the workbook takes them in order.

A sheet holds 1,048,576 rows at most, which bounds what is brought together; more rows are an error, never cut.
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewheel.sources.files import located

#: The most rows of a sheet, with its header, and characters of a cell; the day that dates count from.
ROWS, CHARACTERS = 1 << 20, 32767
DAY_0 = datetime.datetime(1899, 12, 30)
MAIN, RELS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def cell(value: object) -> str:
    """A value as a cell: numbers, truth values, days and moments as such, all else as text; nothing for NULL and NaN."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | decimal.Decimal) and math.isfinite(value):
        return f"<c><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"<c><v>{value}</v></c>"
    if isinstance(value, datetime.datetime):
        return f'<c s="2"><v>{(value.replace(tzinfo=None) - DAY_0) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(value, datetime.date):
        return f'<c s="1"><v>{(datetime.datetime(value.year, value.month, value.day) - DAY_0).days}</v></c>'
    text = str(value)
    if len(text) > CHARACTERS:
        raise ValueError(f"a cell holds {CHARACTERS} characters at most")
    # Characters that XML has no place for are written as the format's escapes.
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


@dataclass
class Part(WriterCommitMessage):
    """A file of rows."""

    path: str
    rows: int


class SheetWriter(DataSourceWriter):
    """Rows of one sheet, a file for each task, and a list of the files in the order of their partitions."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        system, at = located(self.path)
        name = f"{at}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.xml"
        n = 0
        with system.open_output_stream(name) as f:
            for row in rows:
                f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.path)
        if sum(p.rows for p in parts) >= ROWS:
            raise ValueError(f"a sheet holds {ROWS - 1} rows at most")
        system, at = located(self.path)
        with system.open_output_stream(f"{at}/_parts") as f:
            f.write("\n".join(p.path for p in parts).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


class SheetSink(DataSource):
    """Option ``path``: an existing folder for the files of rows."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options["path"], schema)


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: 31 characters, without []:*?/\\, each once whatever the case."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:31] or "Sheet"
        new, k = base, 2
        while new.lower() in {x.lower() for x in out}:
            new, k = f"{base[: 30 - len(str(k))]} {k}", k + 1
        out.append(new)
    return out


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table, its column names first; a file that is there is replaced."""
    if not sheets:
        raise ValueError("a workbook has one sheet at least")
    names, system, at = sheet_names(list(sheets)), *located(path)
    work = f"{at}.{uuid.uuid4().hex}"
    for i, df in enumerate(sheets.values()):
        df.sparkSession.dataSource.register(SheetSink)
        system.create_dir(f"{work}/{i}")
        df.write.format("sheet").mode("append").option("path", f"{work}/{i}").save()
    with system.open_output_stream(at) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
        each = list(enumerate(names, 1))
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in each) + "</Types>")
        book.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in each) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in each) + f'<Relationship Id="rId{len(each) + 1}" Type="{RELS}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for (i, _), df in zip(each, sheets.values(), strict=True):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData><row>{"".join(map(cell, df.columns))}</row>'.encode())
                with system.open_input_stream(f"{work}/{i - 1}/_parts") as f:
                    parts = [p for p in f.read().decode().split("\n") if p]
                for part in parts:
                    with system.open_input_stream(part) as f:
                        while block := f.read(1 << 20):
                            out.write(block)
                out.write(b"</sheetData></worksheet>")
    system.delete_dir(work)
