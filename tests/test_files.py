import datetime

import pytest
from pyspark.sql import functions as F

from duoledger.operators import staging
from duoledger.sources import files, sinks, statements
from duoledger.streaming import ingest

D = datetime.date


def test_workbook_round_trip(spark, tmp_path):
    rows = [["Data", "Lançamento", "Valor (R$)"], ["01/02/2026", "a & b", -12.5], [None, "x", 3]]
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook({"A/[b]": rows, "two": [["z"] * 30]}))
    cells = files.read_workbooks(spark, str(tmp_path)).collect()
    got = {(r.sheet, r.row, r.col): r.text for r in cells}
    assert got["A  b", 1, 1] == "a & b" and got["A  b", 1, 2] == "-12.5" and ("A  b", 2, 0) not in got and got["two", 0, 29] == "z"
    with pytest.raises(ValueError):
        sinks.workbook({})


def test_csv(spark, tmp_path):
    assert sinks.csv_text([["a;b", None, 12.5, 'q"']]) == '﻿"a;b";;12,5;"q"""\r\n'
    assert [files.sniff_delimiter(x) for x in ("a,b,c;d", "a|b", "abc")] == [",", "|", ";"]
    (tmp_path / "x.csv").write_text('a;"b;c"\nd;\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [("a", "b;c"), ("d", None)]


def test_report_files_begin_with_a_mark(spark, tmp_path):
    sinks.export_csv(spark.createDataFrame([("a;b", 123456)], "name string, cents long").coalesce(1), str(tmp_path / "r"), ["cents"])
    assert next((tmp_path / "r").glob("*.csv")).read_bytes().decode() == '﻿name;cents\n"a;b";1.234,56\n'


def test_statement(spark):
    table = [["Conta 1"], ["Data", "Lançamento", "Valor (R$)", "Saldo (R$)"], ["01/02/2026", "PIX", "-10,00", None], ["01/02/2026", "SALDO", None, "90,00"], ["02/02/2026", "RES APLIC AUT MAIS", "5,00", None], ["x", "y", "1,00", None], ["03/02/2026", "z", "0,00", None], ["04/02/2026", "VENDA", "1.000,00", None]]
    cells = [("f", i, j, v) for i, row in enumerate(table) for j, v in enumerate(row) if v is not None]
    got = {r.row: (r.kind, r.cents, r.direction, r.reason) for r in statements.parse_statement(spark.createDataFrame(cells, "path string, row int, col int, text string")).collect()}
    assert got == {2: ("movement", 1000, "out", None), 3: ("balance", None, None, None), 4: ("discarded", 500, "in", "sweep"), 5: ("discarded", 100, "in", "no date"), 6: ("discarded", 0, "in", "zero"), 7: ("movement", 100000, "in", None)}


def test_card_bill(spark):
    left = ["Lançamentos final 1234", "03/02 LOJA 01/03 50,00", "11/02 CAFE 40,00", "20/12 TAXI 30,00", "Próximas faturas", "03/03 LOJA 02/03 50,00"]
    items = [("f", 1, 148.0, 700.0 - 12 * i, 100.0, t) for i, t in enumerate(left)] + [("f", 1, 364.0, 700.0 - 12 * i, 100.0, f"n{i}") for i in range(3)]
    lines = statements.layout(spark.createDataFrame(items, "path string, page int, x double, y double, width double, text string")).select("path", "page", "line_at", "line").distinct()
    got = statements.parse_card(lines, "2026-02-25")
    assert [(r.card, r.occurred_on, r.cents) for r in got.orderBy("line_at").collect()] == [("1234", D(2026, 2, 3), 5000), ("1234", D(2026, 2, 11), 4000), ("1234", D(2025, 12, 20), 3000)]
    total = statements.reconcile_card(got, spark.createDataFrame([("f", 12000), ("g", 1)], "path string, printed long"))
    assert {r.path: r.exact for r in total.collect()} == {"f": True, "g": False}


def test_landing_files_are_staged_once(spark, tmp_path):
    now = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, 1, D(2026, 1, 1), 100, "out", "a", None, now), (2, 1, D(2026, 1, 1), 100, "out", "a", None, now)], ingest.LINES)
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.stage_stream(ingest.landing(spark, str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "ledger"))
    assert out.count() == 2 and out.agg(F.countDistinct("dedup_hash")).first()[0] == 2
    assert staging.stage(rows, out, ["line_no"]).where("not duplicate").count() == 0
