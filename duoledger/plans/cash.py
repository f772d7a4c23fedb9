"""Queries of the cash ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cashflow
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from .registry import query

START, END = "1997-01-01", "1997-12-01"
CLASSIFIED = SQL_LEDGER + """, own AS (
  SELECT e.*, c.code, CASE WHEN coalesce(c.kind, '') = 'transfer' THEN 'transfer' ELSE direction END AS section,
    CAST(date_trunc('month', occurred_on) AS DATE) AS period, CASE WHEN direction = 'in' THEN cents ELSE -cents END AS signed_cents
  FROM entries e LEFT JOIN chart c USING (category_id)
  WHERE account_id IN (SELECT account_id FROM accounts WHERE type <> 'credit_card'))"""


def rows(spark, sf_dir):
    return cashflow.classified(proxy.entries(spark, sf_dir), proxy.accounts(spark, sf_dir), proxy.chart(spark))


@query("s1_cash_scan", SQL_LEDGER + """
SELECT account_id, occurred_on, cents, direction, category_id, entity_id FROM entries
WHERE occurred_on BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' AND entity_id IN (0, 1) AND direction = 'out' AND category_id IS NULL""")
def s1(spark, sf_dir):
    e = proxy.entries(spark, sf_dir).where(F.col("occurred_on").between("1997-03-01", "1997-06-30") & F.col("entity_id").isin(0, 1) & (F.col("direction") == "out") & F.col("category_id").isNull())
    return e.select("account_id", "occurred_on", "cents", "direction", "category_id", "entity_id")


@query("p3_section", CLASSIFIED + " SELECT section, direction, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM own GROUP BY ALL")
def p3(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("section", "direction").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("j3_cash_accounts_semi", SQL_LEDGER + """
SELECT (account_id IN (SELECT account_id FROM accounts WHERE type <> 'credit_card')) AS in_cash, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM entries GROUP BY 1""")
def j3(spark, sf_dir):
    cash = cashflow.cash_accounts(proxy.accounts(spark, sf_dir)).select("account_id", F.lit(True).alias("in_cash"))
    return proxy.entries(spark, sf_dir).join(F.broadcast(cash) if cash.limit(100_001).count() <= 100_000 else cash, "account_id", "left").groupBy(
        F.coalesce("in_cash", F.lit(False)).alias("in_cash")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("a5_cash_sections", CLASSIFIED + """
SELECT section, code, period, sum(CASE WHEN section = 'transfer' THEN signed_cents ELSE cents END)::BIGINT AS cents FROM own GROUP BY ALL""")
def a5(spark, sf_dir):
    return cashflow.sections(rows(spark, sf_dir))


@query("c1_cash_matrix", CLASSIFIED + f""", cells AS (
  SELECT section, unnest([coalesce(code, 'none'), 'total']) AS line, period, CASE WHEN section = 'transfer' THEN signed_cents ELSE cents END AS cents FROM own WHERE period BETWEEN DATE '{START}' AND DATE '{END}'),
shells AS (SELECT section, line, CAST(month AS DATE) AS period FROM (SELECT DISTINCT section, line FROM cells), generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH) g(month))
SELECT s.section, s.line, s.period, coalesce(sum(cents), 0)::BIGINT AS cents FROM shells s LEFT JOIN cells c ON s.section = c.section AND s.line = c.line AND s.period = c.period GROUP BY ALL""")
def c1(spark, sf_dir):
    return cashflow.matrix(rows(spark, sf_dir), START, END)


DRILLED = "SELECT account_id, occurred_on, direction, cents FROM own WHERE period = DATE '1997-04-01' AND "


@query("p14_cell_entries", CLASSIFIED + DRILLED + "category_id IN (SELECT category_id FROM chart WHERE code = '7.01')")
def p14(spark, sf_dir):
    return cashflow.drilled(rows(spark, sf_dir), proxy.chart(spark), "7.01", "1997-04-01").select("account_id", "occurred_on", "direction", "cents")


@query("p14_cell_uncategorised", CLASSIFIED + DRILLED + "category_id IS NULL")
def p14_none(spark, sf_dir):
    return cashflow.drilled(rows(spark, sf_dir), proxy.chart(spark), None, "1997-04-01").select("account_id", "occurred_on", "direction", "cents")


@query("w1_running_balance", CLASSIFIED + f""", first AS (
  SELECT (SELECT coalesce(sum(opening_cents), 0) FROM accounts WHERE type <> 'credit_card') + (SELECT coalesce(sum(signed_cents), 0) FROM own WHERE occurred_on < DATE '{START}') AS first),
months AS (
  SELECT CAST(month AS DATE) AS period, coalesce(sum(cents) FILTER (section = 'in'), 0) AS inflow, coalesce(sum(cents) FILTER (section = 'out'), 0) AS outflow,
    coalesce(sum(signed_cents) FILTER (section = 'transfer'), 0) AS transfers
  FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH) g(month) LEFT JOIN own ON period = CAST(month AS DATE) GROUP BY 1),
run AS (SELECT *, inflow - outflow AS operating, inflow - outflow + transfers AS net, first + sum(inflow - outflow + transfers) OVER (ORDER BY period) AS closing FROM months, first)
SELECT period, (closing - net)::BIGINT AS opening, inflow::BIGINT AS inflow, outflow::BIGINT AS outflow, operating::BIGINT AS operating, transfers::BIGINT AS transfers, net::BIGINT AS net, closing::BIGINT AS closing FROM run""")
def w1(spark, sf_dir):
    return cashflow.monthly(rows(spark, sf_dir), proxy.accounts(spark, sf_dir), START, END)


@query("a7_account_balance", SQL_LEDGER + """
SELECT a.account_id, type, (opening_cents + coalesce(sum(CASE WHEN direction = 'in' THEN cents ELSE -cents END), 0))::BIGINT AS balance
FROM accounts a LEFT JOIN entries e ON a.account_id = e.account_id AND occurred_on <= DATE '1998-06-30' GROUP BY a.account_id, type, opening_cents""")
def a7(spark, sf_dir):
    return cashflow.balances(proxy.entries(spark, sf_dir), proxy.accounts(spark, sf_dir), "1998-06-30")


@query("j4_consolidated_codes", SQL_LEDGER + """, charts AS (
  SELECT r_regionkey AS entity_id, category_id * 10 + r_regionkey AS id, code, name || '-' || r_regionkey AS name, sort_order + r_regionkey AS sort_order FROM chart, region),
firsts AS (SELECT code, name FROM charts QUALIFY row_number() OVER (PARTITION BY code ORDER BY sort_order, entity_id) = 1)
SELECT f.code, f.name, sum(cents)::BIGINT AS cents FROM entries e JOIN charts c ON e.entity_id = c.entity_id AND e.category_id * 10 + e.entity_id = c.id JOIN firsts f ON c.code = f.code GROUP BY ALL""")
def j4(spark, sf_dir):
    """Entities keep charts of their own; the consolidated view goes by code, and the first chart names it."""
    from pyspark.sql import Window

    regions = proxy.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("entity_id"))
    charts = proxy.chart(spark).withColumn("entity_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(F.broadcast(regions), "entity_id").select(
        "entity_id", (F.col("category_id") * 10 + F.col("entity_id")).alias("id"), "code", F.concat("name", F.lit("-"), F.col("entity_id").cast("string")).alias("name"), (F.col("sort_order") + F.col("entity_id")).alias("sort_order"))
    first = charts.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("sort_order", "entity_id"))).where("k = 1").select("code", "name")
    e = proxy.entries(spark, sf_dir).withColumn("id", F.col("category_id") * 10 + F.col("entity_id"))
    return e.join(F.broadcast(charts.select("id", "entity_id", "code")), ["id", "entity_id"]).groupBy("code").agg(F.sum("cents").alias("cents")).join(first, "code").select("code", "name", "cents")


@query("a21_entry_totals", SQL_LEDGER + """
SELECT entity_id, sum(CASE WHEN direction = 'in' THEN cents ELSE 0 END)::BIGINT AS total_in, sum(CASE WHEN direction = 'out' THEN cents ELSE 0 END)::BIGINT AS total_out FROM entries GROUP BY 1""")
def a21(spark, sf_dir):
    part = lambda d: F.sum(F.when(F.col("direction") == d, F.col("cents")).otherwise(0))
    return proxy.entries(spark, sf_dir).groupBy("entity_id").agg(part("in").alias("total_in"), part("out").alias("total_out"))


@query("a18_category_usage", SQL_LEDGER + " SELECT c.code, c.dre_group, count(e.cents)::BIGINT AS n FROM chart c LEFT JOIN entries e USING (category_id) GROUP BY ALL")
def a18(spark, sf_dir):
    used = proxy.entries(spark, sf_dir).groupBy("category_id").count()
    return proxy.chart(spark).join(used, "category_id", "left").select("code", "dre_group", F.coalesce("count", F.lit(0)).alias("n"))
