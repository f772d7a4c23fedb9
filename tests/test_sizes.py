"""Queries and operators on what only larger tables hold: long keys, many partitions, groups of many rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, TABLES, plain

from duoledger.functions import money
from duoledger.operators import clients, intervals, recognition
from duoledger.plans import contracts, papers, registry
from duoledger.sources import statements


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, folder, name):
    """A query over a folder's tables and its SQL, as sorted rows."""
    con = duckdb.connect()
    for t in TABLES:
        if (folder / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str), sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_account_numbers_of_more_than_four_digits_stay_whole(spark, tmp_path):
    spark.range(9_990, 10_060).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(str(SF / "nation.parquet")).write.parquet(str(tmp_path / "nation.parquet"))
    got, told = against_sql(spark, tmp_path, "p18_mismatches")
    assert got == told and len(got) == 70


def test_listed_weights_are_allotted_as_rows_are(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([0, -1, 1]) * rng.randrange(10**rng.randrange(1, 17)), [rng.choice([0, 1, 28, 30, 31]) for _ in range(rng.randrange(0, 40))]) for i in range(300)] + [(300, 100, [0, 0])]
    df = spark.createDataFrame(data, "k long, total long, w array<long>")
    got = {r.k: r.s for r in money.allocate_listed(df, "total", "w", "s").collect()}
    told = {}
    for r in money.allocate(df.select("k", "total", F.posexplode("w").alias("i", "x")), ["k"], "i", "total", "x").orderBy("k", "i").collect():
        told.setdefault(r.k, []).append(r.share)
    assert got == {k: told.get(k, []) for k, _, _ in data}


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["a14_reconciliation_totals", "c13_reconcile", "c12_deferred"])
def test_parts_of_contracts_grow_in_number(spark, monkeypatch, name):
    """Whatever is grouped by contract stays in the parts that contracts were dealt into; nothing meets in the session's few."""
    monkeypatch.setattr(contracts, "parts_for", lambda table: 9)
    plan = plan_of(registry.queries()[name](spark, str(SF)))
    assert plan.count("hashpartitioning(contract_id") == plan.count(", 9), REPARTITION_BY_NUM") > 0


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_a_merge_meets_in_parts_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(contracts, "parts_for", lambda table, rows=0: 9)
    plan = plan_of(registry.queries()["c11_merge_actions"](spark, str(SF)))
    assert plan.count(", 9), REPARTITION_BY_NUM") == 1 == plan.count("Exchange hashpartitioning(")


def test_a_merge_keeps_what_stands_twice_and_keys_with_a_null(spark):
    plan = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 8)], "contract_id long, cents long").withColumns({"period": F.lit("2026-01-01").cast("date"), "source": F.lit("a"), "kind": F.lit("b")})
    old = spark.createDataFrame([(1, 11, False), (1, 12, True), (3, 1, None), (None, 8, False)], "contract_id long, cents long, manually_edited boolean").withColumns({"period": F.lit("2026-01-01").cast("date"), "source": F.lit("a"), "kind": F.lit("b")})
    for parts in (None, 3):
        got = sorted(((r.contract_id, r.planned, r.was, r.action) for r in recognition.merge_actions(plan, old, parts).collect()), key=str)
        assert got == sorted([(1, 11, 11, "keep"), (1, 11, 12, "skip"), (2, 7, None, "insert"), (3, None, 1, "remove"), (None, 8, None, "insert"), (None, None, 8, "remove")], key=str)


def test_layout_reads_many_pages_at_once(spark):
    """Lines of pages of one and two columns, by the letter; no page is a group of its own in Python."""
    items = [(f"f{p % 7}", p, 40.0 + 300 * c + 60 * k, 700.0 - 12 * r - 2 * k, 50.0, f"{p}.{c}.{r}.{k}") for p in range(200) for c in range(1 + p % 2) for r in range(4) for k in range(2)]
    df = spark.createDataFrame(items, "path string, page int, x double, y double, width double, text string").repartition(5)
    laid = statements.layout(df)
    assert "FlatMapGroupsInPandas" not in plan_of(laid) and "MapInPandas" in plan_of(laid)
    got = {(r.path, r.page, r.line_at, r.column_at, r.line, r.x, r.y, r.text) for r in laid.collect()}
    line = lambda p, c, r: f"{p}.{c}.{r}.0 {p}.{c}.{r}.1"
    assert got == {(f, p, int(t.split(".")[1]) * 4 + int(t.split(".")[2]), int(t.split(".")[1]), line(p, *t.split(".")[1:3]), x, y, t) for f, p, x, y, _, t in items}


def test_layout_reads_pages_in_small_batches(spark, monkeypatch):
    """What a Python task holds at once doesn't grow with the pages that it is dealt."""
    real, most = statements._pages, 500

    def few(file, batches):
        for pages in batches:
            assert len(pages) <= most
            yield from real(file, iter([pages]))

    monkeypatch.setattr(statements, "_pages", few)
    items = spark.range(3_000).selectExpr("'f' as path", "cast(id as int) as page", "40.0D as x", "700.0D as y", "50.0D as width", "'t' as text")
    assert statements.layout(items.coalesce(1)).count() == 3_000


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_pages_are_dealt_into_parts_that_grow_in_number(spark, monkeypatch):
    """Events are dealt by path, then by page, so a path of many pages is many tasks; pages are listed and laid out where they are."""
    monkeypatch.setattr(papers, "parts_for", lambda table, rows=0: 9)
    plan = plan_of(registry.queries()["c24_layout"](spark, str(SF)))
    assert plan.count(", 9), REPARTITION_BY_NUM") == 2 == plan.count("Exchange ") and "Join" not in plan


@pytest.mark.parametrize("name", ["c24_layout", "w12_lines_of_pages"])
def test_pages_of_no_path_and_texts_of_no_kind_stay(spark, tmp_path, name):
    events = [(i, None if i % 3 == 0 else i % 3, None if i % 11 == 0 else "view") for i in range(200)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got, told = against_sql(spark, tmp_path, name)
    assert got == told and any(None in r for r in got)


def test_points_of_no_interval_are_left_out_before_they_are_spread(spark, monkeypatch):
    points = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("at"))
    terms = spark.createDataFrame([(k, 10 * k, 10 * k + n) for k in (1, 2, None) if k for n in (0, 5, 90)] + [(None, 1, 2)], "k long, a long, b long")
    told = sorted((i % 40, i, a, b) for i in range(400) for k, a, b in [(k, 10 * k, 10 * k + n) for k in (1, 2) for n in (0, 5, 90)] if i % 40 == k and a <= i <= b)
    for few in (100_000, 1):
        monkeypatch.setattr(intervals, "FEW", few)
        joined = intervals.in_interval(points, terms, ["k"], "at", "a", "b")
        assert sorted((r.k, r.at, r.a, r.b) for r in joined.collect()) == told and "LeftSemi" in plan_of(joined)


def test_levels_of_revenue_are_sums_of_stored_cells(spark):
    rows = spark.createDataFrame([(c, m, c or 7) for c in (1, 2, None) for m in (1, 2)], "client_id long, m int, cents long").selectExpr("client_id", "make_date(2026, m, 1) as period", "cents")
    got = clients.revenue(rows, rows.where("client_id = 2"), 5)
    assert any("cells-" in f for f in got.inputFiles())
    assert sorted((r.level, r.client_id, r.received, r.recognised) for r in got.where("level in ('client', 'all')").collect() if r.level == "all" or r.client_id) == [("all", None, 20, 4), ("client", 1, 2, 0), ("client", 2, 4, 4)]
