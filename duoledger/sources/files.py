"""Readers of files that Spark has no reader for: workbooks, documents, sniffed CSV. Files are read as binary rows, each parsed in its task."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "path string, sheet string, sheet_at int, row int, col int, text string"
#: Built-in number formats of workbooks that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DELIMITERS = ";,\t|"


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _day(serial: float) -> str:
    n = int(serial)
    return str(datetime.date(1899, 12, 31) + datetime.timedelta(n - (1 if n > 59 else 0)))


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, place, row, col, text) of non-empty cells, sheets in the workbook's order, rows and columns from 0."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    tree = lambda name: ElementTree.fromstring(book.read(name))
    shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = tree("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _local(f.tag) == "numFmt"}
        shows = lambda i: i in DATE_FORMATS or bool(re.search("[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")), re.I))
        dated = [shows(int(x.get("numFmtId", 0))) for c in styles if _local(c.tag) == "cellXfs" for x in c]
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in tree("xl/_rels/workbook.xml.rels")}
    out = []
    for at, sheet in enumerate(s for s in tree("xl/workbook.xml").iter() if _local(s.tag) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
        row = -1
        for r in (x for x in tree(target if target.startswith("xl/") else f"xl/{target}").iter() if _local(x.tag) == "row"):
            row, col = int(r.get("r", row + 2)) - 1, -1
            for c in (x for x in r if _local(x.tag) == "c"):
                col = _column(c.get("r")) if c.get("r") else col + 1
                kind = c.get("t", "n")
                value = next((v.text for v in c if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif value is not None and kind == "s":
                    value = shared[int(value)]
                elif value is not None and kind == "b":
                    value = "true" if value == "1" else "false"
                elif value is not None and kind == "n" and int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                    value = _day(float(value))
                if value not in (None, ""):
                    out.append((sheet.get("name"), at, row, col, value))
    return out


def _per_file(parse, columns: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in parse(content)], columns=columns)

    return run


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, sheet_at, row, col, text): cells of all workbooks under a path."""
    return binary(spark, path, "*.xlsx").mapInPandas(_per_file(workbook_cells, ["path", "sheet", "sheet_at", "row", "col", "text"]), CELLS)


def document_lines(content: bytes) -> list[tuple]:
    """(line, text) of a word-processor document: paragraphs and cells, one to a line."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    lines = ["".join((t.text or "") if _local(t.tag) == "t" else "\t" if _local(t.tag) == "tab" else "" for t in p.iter()) for p in root.iter() if _local(p.tag) == "p"]
    return [(i, text.strip()) for i, text in enumerate(lines) if text.strip()]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return binary(spark, path, "*.docx").mapInPandas(_per_file(document_lines, ["path", "line", "text"]), "path string, line int, text string")


def sniff_delimiter(head: str) -> str:
    """The commonest of the four delimiters in the first 4000 signs, ; where there is none."""
    head = head[:4000]
    return max(DELIMITERS, key=lambda d: (head.count(d), d == ";")) if any(d in head for d in DELIMITERS) else ";"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files of one kind, all columns text; the first file's head tells the delimiter."""
    head = spark.read.text(path).limit(50).agg(F.concat_ws("\n", F.collect_list("value"))).first()[0] or ""
    return spark.read.csv(path, sep=sniff_delimiter(head), quote='"', escape='"', multiLine=True, nullValue="", header=False)


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter, width) of each file: the commonest of the four delimiters in its first 4000 signs (; where there is none), and the most cells that a line of it can have."""
    text = F.col("content").cast("string")
    times = lambda t, d: F.length(t) - F.length(F.replace(t, F.lit(d), F.lit("")))
    each = [F.struct(times(F.substring(text, 1, 4000), d).alias("n"), F.lit(d == ";").alias("default"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)]
    found = binary(spark, path).withColumn("delimiter", F.array_max(F.array(*each))["d"])
    cells = F.transform(F.split(text, "\n"), lambda line: F.length(line) - F.length(F.replace(line, F.col("delimiter"), F.lit(""))) + 1)
    return found.select("path", "delimiter", F.coalesce(F.array_max(cells), F.lit(1)).alias("width"))


def read_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter, row, cells) of CSV files under a path, each read by its own delimiter.

    Files of one delimiter are one scan of Spark's reader (the list of files is what the driver
    lists anyway). Quoted cells may hold delimiters, doubled quotes and line ends; a byte
    order mark and carriage returns go; empty cells are null, and those at the end of a row
    are left out. Rows without any cell are left out; row counts those that stand, from 0. Files without rows have none.
    """
    groups: dict[str, tuple[list[str], int]] = {}
    for r in dialects(spark, path).collect():
        paths, width = groups.get(r["delimiter"], ([], 1))
        groups[r["delimiter"]] = [*paths, re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"])], max(width, r["width"])
    parts = []
    for d, (paths, width) in sorted(groups.items()):
        schema = ", ".join(f"_c{i} string" for i in range(width))
        rows = spark.read.schema(schema).csv(paths, sep=d, quote='"', escape='"', multiLine=True, header=False)
        cells = F.transform(F.array(*[F.col(f"_c{i}") for i in range(width)]), lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\ufeff"), F.lit("")))
        cells = F.transform(cells, lambda c: F.when(c != "", c))
        last = F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.lit(d).alias("delimiter"), F.monotonically_increasing_id().alias("at"), F.slice(cells, F.lit(1), last).alias("cells")).where(F.size("cells") > 0)
        parts.append(rows.select("path", "delimiter", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).alias("row"), "cells"))
    none = spark.createDataFrame([], "path string, delimiter string, row int, cells array<string>")
    return reduce(DataFrame.unionByName, parts) if parts else none


def contract_text(lines: DataFrame, least: int = 200) -> DataFrame:
    """(path, text, enough) of documents' lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("path").agg(text.alias("text")).withColumn("enough", F.length("text") >= least)


