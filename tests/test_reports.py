"""Card bills by position, report files, files that are verified, approvals: figures worked out by hand."""

import datetime
import io
import zipfile

from pyspark.sql import functions as F

from duoledger.operators import approval, exports, verify
from duoledger.sources import sinks, statements

D = datetime.date


def bill(spark, lines):
    """Lines of (y, [(x, text), ...]) in one column."""
    items = [("f", 1, i, " ".join(t for _, t in row), 0, float(x), float(y), t) for i, (y, row) in enumerate(lines) for x, t in row]
    return spark.createDataFrame(items, "path string, page int, line_at int, line string, column_at int, x double, y double, text string")


def test_amount_is_the_one_nearest_to_its_heading(spark):
    got = statements.parse_invoice(bill(spark, [
        (700, [(10, "Lançamentos: compras e saques")]), (690, [(10, "F DA SILVA (final 2227)")]), (680, [(10, "DATA"), (60, "ESTABELECIMENTO"), (300, "VALOR EM R$")]),
        (670, [(10, "02/02"), (60, "ADOBE"), (305, "139,01"), (420, "Limite máximo"), (520, "7.220,00")]), (658, [(60, "SERVICOS")]), (646, [(60, "SAO PAULO")]), (600, [(60, "far below")]),
        (590, [(10, "03/02"), (60, "ESTORNO"), (300, "-10,00")]), (580, [(10, "04/02"), (60, "NO AMOUNT"), (500, "5,00")]), (570, [(10, "05/12"), (60, "LOJA 02/03"), (300, "1.000,00")]),
        (560, [(10, "Repasse de IOF em R$"), (300, "4,86")]), (550, [(10, "L Total dos lançamentos atuais"), (300, "1.133,87")]), (540, [(10, "06/02"), (60, "CLOSED"), (300, "1,00")]),
        (530, [(10, "Compras parceladas - próximas faturas")]), (520, [(10, "05/03"), (60, "LOJA 03/03"), (300, "1.000,00")])]), "2026-02-25").orderBy("line_at").collect()
    assert [(r.kind, r.description, r.cents, r.direction, r.occurred_on) for r in got if r.kind == "charge"] == [
        ("charge", "ADOBE", 13901, "out", D(2026, 2, 2)), ("charge", "ESTORNO", 1000, "in", D(2026, 2, 3)), ("charge", "LOJA 02/03", 100000, "out", D(2025, 12, 5)), ("charge", "Repasse de IOF", 486, "out", D(2026, 2, 25))]
    assert [r.detail for r in got if r.kind == "charge"] == ["SERVICOS · SAO PAULO", None, None, None]
    assert {r.card for r in got} == {"2227"}
    assert [r.cents for r in got if r.kind == "total"] == [113387]
    assert sorted(r.line_at for r in got if r.kind == "discarded") == [8, 14]
    assert [(r.instalment.current, r.instalment.total) for r in got if r.instalment] == [(2, 3), (3, 3)]


def test_without_heading_the_last_amount_counts(spark):
    got = statements.parse_invoice(bill(spark, [(700, [(10, "Lançamentos internacionais")]), (690, [(10, "02/02"), (60, "HOST"), (200, "10,00"), (300, "55,00")])]), "2026-02-25").collect()
    assert [(r.section, r.description, r.cents) for r in got] == [("international", "HOST 10,00", 5500)]


def test_bills_without_rows(spark):
    assert statements.parse_invoice(bill(spark, [(700, [(10, "nothing here")])]).where("false"), "2026-02-25").count() == 0


def test_report_files(spark):
    one = spark.createDataFrame([("a;b", 1.5), (None, None)], "name string, sum double")
    text = sinks.export({"Receita por cliente": one, "Other": one}, "csv").decode()
    assert text == '﻿name;sum\r\n"a;b";1,5\r\n;\r\n'
    with zipfile.ZipFile(io.BytesIO(sinks.export({"Receita por cliente": one, "Other": one}, "xlsx"))) as z:
        assert "xl/worksheets/sheet2.xml" in z.namelist()
    assert exports.file_name("acme", "receita", "2026-01-01", "2026-03-01", ["Receita por cliente", "Receita diferida"], "csv") == "acme_receita_2026-01_2026-03_receita-por-cliente.csv"
    assert exports.file_name("acme", "folha", "2026-01-01", "2026-03-01", ["Folha"], "xlsx") == "acme_folha_2026-01_2026-03.xlsx"


def test_statements_are_verified_by_file(spark):
    row = lambda f, n, day, cents, way, balance: (f, n, D(2026, 1, day), cents, way, balance, "balance" if balance is not None else "movement")
    rows = spark.createDataFrame([row("good", 1, 1, None, None, 100), row("good", 2, 2, 50, "in", None), row("good", 3, 2, None, None, 150), row("bad", 1, 1, None, None, 100), row("bad", 2, 2, 50, "out", None), row("bad", 3, 2, None, None, 51),
                                  row("none", 1, 1, None, None, 7)], "path string, row int, occurred_on date, cents long, direction string, balance_cents long, kind string")
    assert {(r.path, r.n, r.ok) for r in verify.statements(rows).collect()} == {("good", 1, True), ("bad", 1, False)}


def test_rows_without_a_hash_are_admitted_and_only_chosen_ones_move(spark):
    staged = spark.createDataFrame([(1, 0, "a", "pending", 5), (2, 0, "a", "pending", 5), (3, 0, None, "pending", None), (4, 1, "a", "pending", 6), (5, 0, "z", "pending", 6)], "id long, entity_id int, dedup_hash string, status string, suggested_category_id long")
    chosen = spark.createDataFrame([(1, None), (2, 9), (3, None), (4, 8), (9, 1)], "id long, category_id long")
    ledger = spark.createDataFrame([(1, "a"), (0, None)], "entity_id int, dedup_hash string")
    got = {r.id: (r.status, r.category_id) for r in approval.approve(staged, chosen, ledger, ["id"]).collect()}
    assert got == {1: ("approved", 5), 2: ("duplicate", 9), 3: ("approved", None), 4: ("duplicate", 8), 5: ("pending", None)}
    assert approval.approve(staged.where("false"), chosen, ledger.where("false"), ["id"]).agg(F.count("*")).first()[0] == 0
