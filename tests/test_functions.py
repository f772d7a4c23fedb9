import datetime

from pyspark.sql import functions as F

from duoledger.functions import calendar, json, money, text

D = datetime.date


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_mul_ratio_rounds_half_away_from_zero(spark):
    cases = [(600000, 16, 30, 320000), (5000000, 20, 100, 1000000), (5000000, -5, 100, -250000), (1, 1, 2, 1), (-1, 1, 2, -1), (1, 4, 10, 0)]
    rows = spark.createDataFrame(cases, "v long, n long, d long, want long").select("want", money.mul_ratio(F.col("v"), F.col("n"), F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_parse_money(spark):
    cases = [("1.234,56", 123456), ("R$ 1.234,56", 123456), ("-50,00", -5000), ("(50,00)", -5000), ("1,234.56", 123456), ("1.200,00 D", -120000), ("1.200,00 C", 120000),
             ("1.234", 123400), ("1.5", 150), ("-50,00 D", 5000), ("1,234", 123), ("abc", None), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want long").select("t", "want", money.parse_money(F.col("t")).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == []
    declared = [("1.234", 123), ("800", 80000), ("30714.28571", 3071429), ("8166.666667", 816667)]
    rows = spark.createDataFrame(declared, "t string, want long").select("want", money.parse_money(F.col("t"), ".").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_money_and_percent_are_shown(spark):
    assert one(spark, money.format_money(F.lit(-123456)), money.format_brl(F.lit(5)), money.parse_percent(F.lit("12,3456 %")), money.basis_points(F.lit(1), F.lit(0))) == ("-1.234,56", "R$ 0,05", 12345, None)


def test_allocate_loses_nothing(spark):
    rows = [(f"{t}/{n}", i, t, 1 + i % 3) for t in (1, 7, 99, -100001, 5000000) for n in (2, 3, 7, 12, 13) for i in range(n)]
    out = money.allocate(spark.createDataFrame(rows, "k string, i int, total long, w int"), ["k"], "i", "total", "w").groupBy("k").agg(F.sum("share").alias("s"), F.max("total").alias("t")).collect()
    assert all(r.s == r.t for r in out)
    third = money.allocate(spark.createDataFrame([("a", i, 100, 1) for i in range(3)], "k string, i int, total long, w int"), ["k"], "i", "total", "w").orderBy("i").collect()
    assert [r.share for r in third] == [34, 33, 33]
    zero = money.allocate(spark.createDataFrame([("a", 0, 100, 0)], "k string, i int, total long, w int"), ["k"], "i", "total", "w").first()
    assert zero.share is None


def test_calendar(spark):
    day = lambda s: F.lit(s).cast("date")
    april = day("2026-04-01")
    assert one(spark, calendar.covered_days(april, day("2026-04-15"), F.lit(None).cast("date")), calendar.covered_days(day("2026-06-01"), april, day("2026-06-10")), calendar.covered_days(april, day("2026-05-01"), F.lit(None).cast("date"))) == (16, 10, 0)
    assert one(spark, calendar.each_period(day("2026-01-31"), day("2026-03-01")), calendar.each_period(day("2026-03-01"), day("2026-01-01"))) == ([D(2026, 1, 1), D(2026, 2, 1), D(2026, 3, 1)], [])
    assert one(spark, calendar.parse_br(F.lit("31/02/2026")), calendar.parse_br(F.lit("1/2/2026")), calendar.parse_iso(F.lit("2026-02-30")), calendar.excel_serial(F.lit(46023)), calendar.month_label(april), calendar.months_between(day("2025-12-31"), april)) == (
        None, D(2026, 2, 1), None, D(2026, 1, 1), "abr/26", 4)
    assert one(spark, calendar.card_date(F.lit("28/12"), day("2026-01-10")), calendar.card_date(F.lit("05/01"), day("2026-01-10"))) == (D(2025, 12, 28), D(2026, 1, 5))


def _tax_id(nine):
    d = [int(c) for c in nine]
    for _ in range(2):
        r = sum(x * w for x, w in zip(d, range(len(d) + 1, 1, -1))) % 11
        d.append(0 if r < 2 else 11 - r)
    return "".join(map(str, d))


def test_text(spark):
    good = _tax_id("314159265")
    assert one(spark, text.normalize(F.lit("  São  Paulo ção ")), text.supplier_key(F.lit("Uber 123 *TRIP a help")), text.valid_tax_id(F.lit(good)), text.valid_tax_id(F.lit("11111111111")), text.valid_tax_id(F.lit(good[:-1] + str((int(good[-1]) + 1) % 10)))) == (
        "SAO PAULO CAO", "UBER TRIP", True, False, False)
    assert one(spark, text.propose_pattern(F.lit("PIX recebido ciclo -06/01"), F.lit(None).cast("string")), text.propose_pattern(F.lit("x"), F.lit("12")), text.automatic_sweep(F.lit("RES APLIC AUT MAIS")), text.automatic_sweep(F.lit("RENDIMENTO REND PAGO APLIC AUT MAIS"))) == ("PIX RECEBIDO CICLO", "*", True, False)
    assert one(spark, text.instalment(F.lit("LOJA 03/10 x"))["total"], text.instalment(F.lit("em 16/07"))["total"], text.instalment(F.lit("a 1/3 b 2/5"), at_end=True)["current"]) == (10, None, 2)


def test_json(spark):
    reply = "Here:\n```json\n[{\"a\": 1}]\n```\nthanks"
    assert one(spark, json.extract_json(F.lit(reply)), json.extract_json(F.lit("none"))) == ('[{"a": 1}]', None)
    changed = one(spark, json.changed_fields(F.lit('{"a":1,"b":2,"updated_at":3}'), F.lit('{"a":1,"b":5,"c":7,"updated_at":4}')), json.changed_fields(F.lit(None).cast("string"), F.lit("{}")))
    assert [tuple(x) for x in changed[0]] == [("b", "2", "5"), ("c", None, "7")] and changed[1] == []
