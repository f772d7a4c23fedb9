"""Files of five dialects in one folder; lines that land in any order, once each, over restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from duoledger.operators.staging import with_occurrence
from duoledger.sources import files
from duoledger.streaming import ingest

FILES = {
    "a semi.csv": ('date;text;value\n2024-01-01;"a;b";1\n;;\n2024-01-02;"say ""x""";2\n', ";", [["date", "text", "value"], ["2024-01-01", "a;b", "1"], ["2024-01-02", 'say "x"', "2"]]),
    "b[1].csv": ('﻿date,text\r\n2024-01-01,"two\nlines, here"\r\n2024-01-02,\r\n', ",", [["date", "text"], ["2024-01-01", "two\nlines, here"], ["2024-01-02"]]),
    "c.csv": ("date\ttext\tmore\tand more\n1\t\t3\t4\n", "\t", [["date", "text", "more", "and more"], ["1", None, "3", "4"]]),
    "d.csv": ("x|y\n1|2,5\n", "|", [["x", "y"], ["1", "2,5"]]),
    "e.csv": ("only one column\nvalue\n", ";", [["only one column"], ["value"]]),
    "f.csv": ("", ";", []),
    "g.csv": ("a;b;c,d\n1;2;3\n", ";", [["a", "b", "c,d"], ["1", "2", "3"]]),
}


def test_each_file_has_its_own_dialect(spark, tmp_path):
    for name, (text, _, _) in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in files.read_dialects(spark, str(tmp_path)).orderBy("path", "row").collect():
        name = next(n for n in FILES if r.path.replace("%20", " ").replace("%5B", "[").replace("%5D", "]").endswith(n))
        got.setdefault(name, []).append((r.delimiter, r.row, list(r.cells)))
    assert got == {n: [(d, i, cells) for i, cells in enumerate(rows)] for n, (_, d, rows) in FILES.items() if rows}
    (tmp_path / "none").mkdir()
    assert files.read_dialects(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def landed(spark, tmp_path):
    rng = random.Random(5)

    def lines(n, day):
        rows = [(i, rng.randrange(2), datetime.date(2024, 1, 1 + rng.randrange(2)), 100 * rng.randrange(2), "in", rng.choice(["Café", "b", None]), None, datetime.datetime(2024, 2, day, i % 24)) for i in range(n)]
        return spark.createDataFrame(rows, ingest.LINES)

    own = {"one": lines(60, 5), "two": lines(90, 6), "late": lines(80, 1), "big": lines(300, 7)}
    return own | {"one again": own["one"]}


def test_lines_land_once_whatever_the_order(spark, landed, tmp_path):
    """Three runs over a growing folder, a file that lands twice and one that is late, against the batch operator over all files."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in (["one", "two"], ["late", "one again"], ["big"], []):
        for name in batch:
            landed[name].coalesce(1).write.mode("append").parquet(folder)
        if batch:
            ingest.write_once(ingest.landing(spark, folder), out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    want = None
    for name in ("one", "two", "late", "big"):
        own = with_occurrence(landed[name], ["line_no"]).select("dedup_hash", *ingest.CONTENT, F.col("occurrence").cast("int"))
        want = own if want is None else want.unionByName(own)
    want = want.distinct()
    assert got.count() == want.count() == got.select("dedup_hash").distinct().count()
    assert got.select("dedup_hash", *ingest.CONTENT, "occurrence").exceptAll(want).count() == 0
