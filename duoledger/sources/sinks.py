"""Report files: workbooks, and CSV as spreadsheets here read it. Reports are of a reader's size and are written by the driver."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_money


def sheet_name(name: str) -> str:
    """Without the signs that workbooks forbid, 31 long at most."""
    return re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"


def column_name(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def slug(text: str) -> str:
    """Small letters and digits without accents, dashes for the rest."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "-", plain.lower()).strip("-")


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """Rows of strings, numbers (cents are given as decimals) and nulls; a workbook has one sheet at least."""
    if not sheets:
        raise ValueError("a workbook needs a sheet")
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(
            f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(n)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(
            f'<sheet name="{escape(sheet_name(name), {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, name in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = []
            for y, row in enumerate(rows):
                cells = []
                for x, v in enumerate(row):
                    ref = f"{column_name(x)}{y + 1}"
                    if v is None:
                        continue
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>')
                body.append(f'<row r="{y + 1}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def csv_text(rows: list[list]) -> str:
    """Byte-order mark, semicolons, decimal commas; quoted where a value has a semicolon, quote or line end; null is empty."""
    def cell(v) -> str:
        if v is None:
            return ""
        text = v if isinstance(v, str) else str(v).replace(".", ",")
        return '"' + text.replace('"', '""') + '"' if re.search('[;"\n]', text) else text

    return "﻿" + "".join(";".join(map(cell, row)) + "\r\n" for row in rows)


def matrix(report: DataFrame, line: str, column: str, value: str, columns: list) -> DataFrame:
    """Long form to one row for each line, a column for each of `columns`."""
    return report.groupBy(line).pivot(column, columns).agg(F.first(value))


def export_csv(report: DataFrame, path: str, money: list[str]) -> None:
    """A distributed report as CSV files, each with a byte-order mark and a header, money columns shown as money."""
    first = report.columns[0]
    shown = report.select(*[(format_money(F.col(c)) if c in money else F.col(c)).alias(f"\ufeff{c}" if c == first else c) for c in report.columns])
    shown.write.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def sheet(report: DataFrame) -> list[list]:
    """Header and rows of a report, which is of a reader's size."""
    return [report.columns, *[[v if v is None or isinstance(v, (int, float, Decimal)) else str(v) for v in r] for r in report.collect()]]


def export(sheets: dict[str, DataFrame], fmt: str) -> bytes:
    """A report's file: a workbook of all its sheets, or the first one as text."""
    if fmt == "xlsx":
        return workbook({name: sheet(df) for name, df in sheets.items()})
    if fmt == "csv":
        return csv_text(sheet(next(iter(sheets.values())))).encode()
    raise ValueError(f"no such format: {fmt}")
