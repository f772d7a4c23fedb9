import datetime

import pytest
from pyspark.sql import functions as F

from duoledger.operators import audit, cashflow, categorize, mirror, pl, recognition, recurrence, staging
from duoledger.sources.proxy import CHART_SCHEMA

D = datetime.date
CHART = [(1, "3.01", "r", "revenue", "receita_bruta", 0), (2, "6.02", "s", "expense", "pessoal", 10), (3, "7.01", "t", "expense", "ferramentas", 20), (4, "99.02", "c", "transfer", "transferencias", 90), (5, "99.03", "i", "transfer", "transferencias", 91)]
ENTRY = "account_id long, occurred_on date, cents long, direction string, category_id long, entity_id int, competence_period date"
ACCOUNT = "account_id long, type string, opening_cents long"


@pytest.fixture
def chart(spark):
    return spark.createDataFrame(CHART, CHART_SCHEMA)


def flow(spark, chart, accounts, entries, start, end):
    a, e = spark.createDataFrame(accounts, ACCOUNT), spark.createDataFrame([(*x, 0, None) for x in entries], ENTRY)
    return {r.period: r for r in cashflow.monthly(cashflow.classified(e, a, chart), a, start, end).collect()}


def test_cash_month(spark, chart):
    got = flow(spark, chart, [(1, "bank", 1000000)], [(1, D(2026, 1, 10), 10000000, "in", 1), (1, D(2026, 1, 20), 6000000, "out", 2), (1, D(2026, 1, 25), 123456, "out", 3)], "2026-01-01", "2026-12-01")
    r = got[D(2026, 1, 1)]
    assert (r.inflow, r.outflow, r.closing) == (10000000, 6123456, 4876544)


def test_transfers_stand_apart(spark, chart):
    got = flow(spark, chart, [(1, "bank", 0)], [(1, D(2025, 12, 1), 1000000, "in", 1), (1, D(2026, 1, 2), 1000000, "in", 1), (1, D(2026, 1, 3), 400000, "out", 4), (1, D(2026, 1, 4), 300000, "out", 5), (1, D(2026, 1, 5), 300000, "in", 5)], "2026-01-01", "2026-01-01")
    r = got[D(2026, 1, 1)]
    assert (r.opening, r.operating, r.transfers, r.net, r.closing) == (1000000, 1000000, -400000, 600000, 1600000)


def test_card_is_cost_at_once_and_cash_when_paid(spark, chart):
    entries = [(9, D(2026, 2, 3), 50000, "out", 3), (9, D(2026, 2, 11), 40000, "out", 3), (9, D(2026, 2, 20), 30000, "out", 3), (1, D(2026, 3, 10), 120000, "out", 4)]
    got = flow(spark, chart, [(1, "bank", 10000000), (9, "credit_card", 0)], entries, "2026-02-01", "2026-03-01")
    assert sorted(got) == [D(2026, 2, 1), D(2026, 3, 1)] and got[D(2026, 3, 1)].closing == 9880000
    assert (got[D(2026, 2, 1)].net, got[D(2026, 2, 1)].closing) == (0, 10000000)  # a month without moves of cash stands too
    e = spark.createDataFrame([(*x, 0, None) for x in entries], ENTRY)
    costs = {r.period: r.c for r in mirror.mirror(e, chart).groupBy("period").agg(F.sum("cents").alias("c")).collect()}
    assert costs == {D(2026, 2, 1): 120000}


def test_override_moves_the_cost_and_not_the_cash(spark, chart):
    e = spark.createDataFrame([(1, D(2026, 2, 5), 6000000, "out", 2, 0, D(2026, 1, 1)), (1, D(2026, 2, 6), 50000, "in", 2, 0, None)], ENTRY)
    assert sorted((r.period, r.cents) for r in mirror.mirror(e, chart).collect()) == [(D(2026, 1, 1), 6000000), (D(2026, 2, 1), -50000)]


def test_profit_and_loss_ladder(spark):
    rows = [("receita_bruta", 10000000), ("deducoes", 340000), ("custos_diretos", 500000), ("pessoal", 4000000), ("ferramentas", 400000), ("socios", 1000000), ("transferencias", 5), (None, 30000)]
    df = spark.createDataFrame(rows, "dre_group string, cents long").withColumn("period", F.lit("x"))
    got = {r.line: r.cents for r in pl.lines(df, "period").collect()}
    assert [got[x] for x in ("net-revenue", "gross-margin", "operating", "ebitda", "result", "no-group")] == [9660000, 9160000, 4400000, 4760000, 3760000, 30000]


def test_consolidation_eliminates_both_sides(spark):
    rows = [("receita_bruta", 10000000, 1, False), ("receita_bruta", 4000000, 2, False), ("receita_bruta", 1000000, 1, True), ("ferramentas", 1000000, 2, True)]
    got = {(r.line, r.col): r.cents for r in pl.consolidated(spark.createDataFrame(rows, "dre_group string, cents long, entity_id int, is_intercompany boolean")).collect()}
    assert got["receita_bruta", "entity-1"] == 11000000 and got["receita_bruta", "total"] == 14000000 and got["receita_bruta", "eliminations"] == -1000000
    assert got["ferramentas", "eliminations"] == -1000000 and got["result", "total"] == 14000000


CONTRACT = "contract_id long, status string, method string, total_cents long, monthly_cents long, start_date date, end_date date, prorate boolean"


def test_percent_of_completion(spark):
    c = spark.createDataFrame([(1, "active", "poc", 5000000, None, D(2026, 3, 1), D(2026, 7, 31), True), (2, "completed", "poc", 5000000, None, D(2026, 3, 1), D(2026, 7, 31), True)], CONTRACT)
    r = spark.createDataFrame([(1, D(2026, 3, 1), 30000), (1, D(2026, 4, 1), 25000), (1, D(2026, 5, 1), 120000), (2, D(2026, 3, 1), 60000)], "contract_id long, period date, cumulative_millipercent long")
    got = sorted((x.contract_id, x.period, x.cents) for x in recognition.plan_poc(c, r).collect())
    assert got == [(1, D(2026, 3, 1), 1500000), (1, D(2026, 4, 1), -250000), (2, D(2026, 3, 1), 3000000), (2, D(2026, 7, 1), 2000000)]
    missing = {x.period for x in recognition.missing_reports(c.where("contract_id = 1"), r, "2026-06-30").collect()}
    assert missing == {D(2026, 6, 1)}


def test_straight_line(spark):
    c = spark.createDataFrame([(1, "active", "straight_line", None, 600000, D(2026, 4, 15), None, True), (2, "active", "straight_line", 1000000, None, D(2026, 1, 1), D(2026, 3, 31), False)], CONTRACT)
    assert sorted((x.period.month, x.cents) for x in recognition.straight_monthly(c, "2026-05-31").collect()) == [(4, 320000), (5, 600000)]
    assert [x.cents for x in recognition.straight_total(c, "2026-12-01").orderBy("period").collect()] == [333334, 333333, 333333]
    assert [x.cents for x in recognition.straight_total(c, "2026-01-01").collect()] == [333334]
    assert [x.cents for x in recognition.straight_total(c, "2026-01-01", parity=True).collect()] == [1000000]
    gated = {x.contract_id: x.warning for x in recognition.gate(c.withColumn("status", F.when(F.col("contract_id") == 1, "draft").otherwise("active")), "2025-01-01").collect()}
    assert gated == {1: "draft", 2: "not-started"}


def test_merge_keeps_what_was_edited_by_hand(spark):
    key = "contract_id long, period date, source string, kind string, "
    p = D(2026, 1, 1)
    plan = spark.createDataFrame([(1, p, "engine", "revenue", 10), (1, p, "engine", "revenue", 5), (2, p, "engine", "revenue", 7), (3, p, "engine", "revenue", 7), (4, p, "engine", "revenue", 7)], key + "cents long")
    old = spark.createDataFrame([(2, p, "engine", "revenue", 7, False), (3, p, "engine", "revenue", 1, True), (4, p, "engine", "revenue", 1, False), (5, p, "engine", "revenue", 1, False)], key + "cents long, manually_edited boolean")
    got = {r.contract_id: (r.action, r.planned) for r in recognition.merge_actions(plan, old).collect()}
    assert got == {1: ("insert", 15), 2: ("keep", 7), 3: ("skip", 7), 4: ("update", 7), 5: ("remove", None)}


LINE = "line_no long, account_id long, occurred_on date, cents long, direction string, description string, counterparty string"


def test_a_file_that_comes_twice_adds_nothing(spark):
    d = D(2026, 1, 1)
    lines = spark.createDataFrame([(1, 1, d, 100, "out", "Café", None), (2, 1, d, 100, "out", "CAFE ", None), (3, 1, d, 101, "out", "Café", None), (4, 1, d, 100, "in", "Café", None), (5, 1, d, 100, "out", "Café", "X")], LINE)
    first = staging.with_occurrence(lines, ["line_no"])
    assert [r.occurrence for r in first.orderBy("line_no").collect()] == [0, 1, 0, 0, 0] and first.select("dedup_hash").distinct().count() == 5
    assert staging.stage(lines, first, ["line_no"]).where("not duplicate").count() == 0


def test_statement_anchors_again_at_each_declared_day(spark):
    day = lambda n: D(2026, 1, n)
    m = spark.createDataFrame([("f", day(1), 10), ("f", day(2), 5), ("f", day(3), 5), ("f", day(4), 0), ("f", day(5), 1)], "path string, day date, signed_cents long")
    d = spark.createDataFrame([("f", day(1), 110), ("f", day(2), 115), ("f", day(4), 125), ("f", day(5), 126)], "path string, day date, balance long")
    got = [(r.day.day, r.expected, r.difference) for r in staging.reconcile_statement(m, d, 100, ["path"]).orderBy("day").collect()]
    assert got == [(1, 110, 0), (2, 115, 0), (4, 120, 5), (5, 126, 0)]
    assert staging.reconcile_statement(m, d, None, ["path"]).count() == 3


def test_suggestions_by_trust(spark):
    s = spark.createDataFrame([(1, "Uber trip", 100, 1, "11"), (2, "Uber trip", 100, 1, None), (3, "old one", 5, 1, None), (4, "pix maria silva", 5, 1, None), (5, "maria", 5, 1, None)], "id long, description string, cents long, account_id long, counterparty_tax_id string")
    schema = "id string, priority int, match_type string, pattern string, counterparty_tax_id string, amount_min long, amount_max long, account_id long, category_id long, active boolean"
    rules = spark.createDataFrame([("a", 1, "contains", "uber", None, None, None, None, 7, True), ("b", 9, "contains", "*", "11", None, None, None, 8, True), ("c", 0, "regex", "([", None, None, None, None, 9, True), ("d", 0, "contains", "uber", None, None, None, 2, 9, True)], schema)
    history = spark.createDataFrame([("Old One", None, 3, D(2026, 1, 1)), ("old one", None, 4, D(2026, 1, 2))], "description string, counterparty_tax_id string, category_id long, occurred_on date")
    people = spark.createDataFrame([("p", "Maria da Silva")], "id string, name string")
    got = {r.subject_id: (r.source, r.category_id) for r in categorize.suggest(s, rules, history, people, 6).collect()}
    assert got == {1: ("rule_tax_id", 8), 2: ("rule_text", 7), 3: ("history_description", 4), 4: ("person", 6), 5: ("none", None)}


def test_subscriptions(spark):
    rows = [("monthly", D(2026, m, 5), 3000) for m in range(1, 7)] + [("two", D(2026, m, 5), 3000) for m in (1, 2)] + [("odd", D(2026, 1, d), 10) for d in (1, 3, 20)]
    rows += [("yearly", D(y, 3, 1), 12000) for y in (2023, 2024, 2025)] + [("rise", D(2026, m, 1), c) for m, c in ((1, 400000), (2, 400000), (3, 409089), (4, 409089))]
    got = {r.supplier: (r.cadence, r.typical, r.monthly_cost, r.active) for r in recurrence.detect(spark.createDataFrame(rows, "supplier string, occurred_on date, cents long"), "supplier", "2026-06-20").collect()}
    assert got == {"monthly": ("monthly", 3000, 3000, True), "yearly": ("annual", 12000, 1000, True), "rise": ("monthly", 400000, 400000, False)}


def test_violations(spark):
    rows = spark.createDataFrame([(-1, "in", D(2026, 1, 2)), (1, "up", None), (1, "in", None)], "cents long, direction string, competence_period date")
    assert sorted(r.violation for r in audit.violations(rows, audit.entry_checks()).collect()) == ["amount-sign", "competence-month", "direction"]


def test_lower_median_of_repeated_values(spark):
    import random

    draw = random.Random(5)
    rows = [(k, draw.choice([None, *range(7)])) for k in "abc" for _ in range(draw.randint(1, 60))] + [("hot", draw.randint(0, 9)) for _ in range(2000)] + [("none", None)]
    got = {r.k: (r.n, r.typical) for r in recurrence.lower_median(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    known = {k: sorted(v for o, v in rows if o == k and v is not None) for k in {k for k, _ in rows}}
    assert got == {k: (len(v), v[(len(v) - 1) // 2]) for k, v in known.items() if v}


def test_charges_of_one_day_are_gaps_of_none(spark):
    """As listing all charges in order does."""
    import random
    import statistics

    draw = random.Random(11)
    rows = []
    for k in range(40):
        day = D(2025, 1, 3)
        for _ in range(draw.randint(1, 14)):
            rows += [(k, day, 1000)] * draw.choice([1, 1, 1, 1, 2, 3])
            day += datetime.timedelta(days=draw.choice([30, 31, 29, 30, 12]))
    rows += [(0, None, 1000), (1, D(2025, 1, 3), None)]
    want = {}
    for k in range(40):
        days = sorted(d for o, d, c in rows if o == k and d and c)
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        if len(days) >= 3:
            middle = int(statistics.median(gaps) + 0.5)
            if abs(middle - 30) <= 8 and 2 * sum(abs(g - middle) <= 5 for g in gaps) >= len(gaps):
                want[k] = (len(days), middle, days[0], days[-1])
    found = recurrence.detect(spark.createDataFrame(rows, "supplier long, occurred_on date, cents long"), "supplier", "2026-01-01")
    assert {r.supplier: (r.charges, r.gap_days, r.first_on, r.last_on) for r in found.collect()} == want and want


def test_matrix_has_every_month_and_its_lines_sum(spark, chart):
    a = spark.createDataFrame([(1, "bank", 0)], ACCOUNT)
    e = spark.createDataFrame([(1, D(2026, 1, 5), 100, "in", 1, 0, None), (1, D(2026, 3, 5), 30, "in", None, 0, None), (1, D(2026, 3, 6), 7, "out", 4, 0, None), (1, D(2026, 9, 6), 9, "out", 3, 0, None)], ENTRY)
    rows = cashflow.classified(e, a, chart)
    got = {(r.section, r.line, r.period.month): r.cents for r in cashflow.matrix(rows, "2026-01-01", "2026-03-01").collect()}
    want = {("in", "3.01"): [100, 0, 0], ("in", "none"): [0, 0, 30], ("in", "total"): [100, 0, 30], ("transfer", "99.02"): [0, 0, -7], ("transfer", "total"): [0, 0, -7]}
    assert got == {(*k, m + 1): v for k, vs in want.items() for m, v in enumerate(vs)}
    assert [r.cents for r in cashflow.drilled(rows, chart, None, "2026-03-01").collect()] == [30]
    assert [r.cents for r in cashflow.drilled(rows, chart, "99.02", "2026-03-01").collect()] == [7]
