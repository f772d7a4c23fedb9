"""Drafts of every kind of reply; clients, merged charts, warnings and last charges on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from duoledger.operators import cashflow, clients, recurrence, replies


def draft_of(reply):
    """Fields, in plain words."""
    try:
        found = json.loads(reply)
    except (TypeError, ValueError):
        found = None
    found, out = found if isinstance(found, dict) else {}, {}
    text = lambda v: v.strip() or None if isinstance(v, str) else (f"{v:.0f}" if v == int(v) else str(v)) if isinstance(v, int | float) and not isinstance(v, bool) else None
    for name in replies.DRAFT:
        raw = found.get(name)
        value, snippet = (text(raw.get("value")), text(raw.get("snippet"))) if isinstance(raw, dict) else (text(raw), None)
        strange = name == "type" and value is not None and value not in ("retainer", "project")
        out[name] = (None, None, True, "unknown type") if strange else (value, snippet[:400] if value and snippet else None, value is None, "no snippet" if value and not snippet else None)
    return out


@pytest.mark.parametrize("reply", [
    '{"name": "Bare", "clientName": {"value": 5}}', '{"totalValue": 1e3, "monthlyValue": 12.50, "scope": {"value": "  x ", "snippet": "' + "y" * 500 + '"}}', '{"type": "retainer", "name": {"value": null, "snippet": "s"}}',
    '{"type": {"value": "lease", "snippet": "s"}}', '{"name": {"snippet": "s"}, "scope": [], "endDate": false, "startDate": ""}', "[1]", "{}", '"x"', "no json", "", None, '{"name": {"value": {"value": "deep"}}}', '{"title": "old name"}'])
def test_contract_drafts(spark, reply):
    told = spark.createDataFrame([(1, reply)], "id int, reply string")
    got = {r.field: (r.value, r.snippet, r.missing, r.warning) for r in replies.contract_draft(told).collect()}
    assert got == draft_of(reply)
    said = [r.warning for r in replies.draft_warnings(told).collect()]
    plain = reply if reply and reply[0] in "[{" else None
    assert said == (["no json"] if plain is None else ["no object"] if plain[0] == "[" else ["no fields"] if all(v[2] for v in got.values()) else [])


def test_contract_rules_name_all_fields():
    assert all(name in replies.contract_rules() for name in [*replies.DRAFT, *replies.KINDS])


def test_revenue_and_margin(spark):
    cash = spark.createDataFrame([(1, "2024-01-01", 100), (1, "2024-02-01", 50), (None, "2024-01-01", 7), (2, "2024-01-01", 10), (2, "2024-01-01", -10)], "client_id long, period string, cents long")
    earned = spark.createDataFrame([(1, "2024-01-01", 30), (3, "2024-02-01", 5)], cash.schema)
    got = {(r.level, r.client_id, r.period): (r.received, r.recognised) for r in clients.revenue(cash, earned).collect()}
    assert got == {("cell", 1, "2024-01-01"): (100, 30), ("cell", 1, "2024-02-01"): (50, 0), ("cell", None, "2024-01-01"): (7, 0), ("cell", 3, "2024-02-01"): (0, 5), ("client", 1, None): (150, 30), ("client", None, None): (7, 0),
                   ("client", 3, None): (0, 5), ("month", None, "2024-01-01"): (107, 30), ("month", None, "2024-02-01"): (50, 5), ("all", None, None): (157, 35)}
    paid = spark.createDataFrame([(7, 40), (8, 20), (9, 6), (None, 4), (7, 10)], "person_id long, cents long")
    people = spark.createDataFrame([(7, 1), (8, 5), (9, None)], "person_id long, client_id long")
    got = {(r.kind, r.client_id): (r.revenue, r.cost, r.people, r.margin, r.margin_bp) for r in clients.margin(cash.select("client_id", "cents"), paid, people).collect()}
    assert got == {("client", 1): (150, 50, 1, 100, 6667), ("client", 2): (0, 0, 0, 0, None), ("client", 5): (0, 20, 1, -20, None), ("unallocated", None): (0, 10, 0, -10, None), ("total", None): (157, 80, 2, 77, 4904)}
    none = clients.margin(cash.select("client_id", "cents").where("false"), paid.where("false"), people).collect()
    assert [(r.kind, r.revenue, r.cost) for r in none] == [("total", 0, 0)]


def test_merged_charts_and_warnings(spark):
    charts = spark.createDataFrame([(1, 0, "7.01", "B", "expense", 5), (2, 1, "7.01", "A", "transfer", 5), (3, 1, "8", "C", "expense", 1)], "category_id long, entity_id int, code string, name string, kind string, sort_order int")
    assert {tuple(r) for r in cashflow.merged_chart(charts).collect()} == {(1, 0, "7.01", "B", "expense"), (2, 1, "7.01", "B", "expense"), (3, 1, "8", "C", "expense")}
    accounts = spark.createDataFrame([(1, "bank", "2024-01-20", 10), (2, "credit_card", "2025-01-01", 0)], "account_id long, type string, opened_on string, opening_cents long").withColumn("opened_on", F.col("opened_on").cast("date"))
    entries = spark.createDataFrame([(1, 0, 1, "2024-01-31", "in", 5), (1, 1, 2, "2024-03-31", "out", 3), (1, 1, None, "2024-03-01", "out", 1), (2, 0, 1, "2024-02-01", "out", 9), (77, 0, 1, "2024-02-01", "out", 9)], "account_id long, entity_id int, category_id long, d string, direction string, cents long").withColumn("occurred_on", F.col("d").cast("date"))
    said = {tuple(r) for r in cashflow.warnings(entries, accounts, charts, "2024-01-01", "2024-03-01").collect()}
    assert said == {("empty-month", "2024-02-01", 0), ("dropped-account", "2", 1), ("dropped-account", "77", 1), ("uncategorised", None, 1), ("late-opening", "1", 1)}
    flow = {(r.section, r.line, str(r.period)): r.cents for r in cashflow.consolidated(entries, accounts, charts, "2024-01-01", "2024-03-01").where("cents <> 0").collect()}
    assert flow == {("in", "7.01", "2024-01-01"): 5, ("in", "total", "2024-01-01"): 5, ("out", "7.01", "2024-03-01"): 3, ("out", "none", "2024-03-01"): 1, ("out", "total", "2024-03-01"): 4, ("balance", "opening", "2024-01-01"): 10, ("balance", "net", "2024-01-01"): 5,
                    ("balance", "closing", "2024-01-01"): 15, ("balance", "opening", "2024-02-01"): 15, ("balance", "closing", "2024-02-01"): 15, ("balance", "opening", "2024-03-01"): 15, ("balance", "net", "2024-03-01"): -4, ("balance", "closing", "2024-03-01"): 11}


def test_last_charge(spark):
    rows = [("s", f"2024-0{m}-05", 1000, f"month {m}") for m in range(1, 6)] + [("s", "2024-06-01", 9000, "far off"), ("t", "2024-01-01", 5, "once")]
    charges = spark.createDataFrame(rows, "supplier string, d string, cents long, label string").withColumn("occurred_on", F.col("d").cast("date"))
    got = recurrence.last_charge(charges, recurrence.detect(charges, "supplier", "2024-06-10"), "supplier", ["label"]).collect()
    assert [(r.supplier, r.charges, str(r.last_on), r.label) for r in got] == [("s", 5, "2024-05-05", "month 5")]
