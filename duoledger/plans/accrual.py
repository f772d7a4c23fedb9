"""Queries of the recognition ledger and of both ledgers together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..functions.money import basis_points
from ..operators import mirror, pl
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from .registry import query

MIRROR = SQL_LEDGER + """, mirrored AS (
  SELECT entity_id, category_id, code, dre_group, coalesce(competence_period, CAST(date_trunc('month', occurred_on) AS DATE)) AS period,
    CASE WHEN direction = 'out' THEN cents ELSE -cents END AS cents, 'cost' AS entry_kind
  FROM entries JOIN chart USING (category_id) WHERE kind IN ('cost', 'expense', 'tax') AND cents <> 0),
earned AS (
  SELECT entity_id, category_id, code, dre_group, CAST(date_trunc('month', occurred_on) AS DATE) AS period, cents, 'revenue' AS entry_kind, client_id % 20 = 0 AS is_intercompany
  FROM entries JOIN chart USING (category_id) WHERE direction = 'in'),
recognition AS (SELECT entity_id, category_id, code, dre_group, period, cents, entry_kind, is_intercompany FROM earned
  UNION ALL SELECT entity_id, category_id, code, dre_group, period, cents, entry_kind, false FROM mirrored)"""


def _subtotals(column: str) -> str:
    terms = [f"SELECT CASE WHEN dre_group IN ({', '.join(map(repr, pl.GROUPS))}) THEN dre_group ELSE 'no-group' END AS line, {column}, cents FROM src WHERE coalesce(dre_group, '') <> 'transferencias'"]
    for name, (plus, minus) in pl.SUBTOTALS.items():
        c = f"CASE WHEN dre_group IN ({', '.join(map(repr, plus))}) THEN cents" + (f" WHEN dre_group IN ({', '.join(map(repr, minus))}) THEN -cents" if minus else "") + " ELSE 0 END"
        terms.append(f"SELECT '{name}', {column}, {c} FROM src WHERE coalesce(dre_group, '') <> 'transferencias'")
    order = " ".join(f"WHEN '{line}' THEN {i + 1}" for i, line in enumerate(pl.LINES))
    return f"SELECT line, CASE line {order} END::INTEGER AS ord, {column}, sum(cents)::BIGINT AS cents FROM ({' UNION ALL '.join(terms)}) GROUP BY line, {column} HAVING line <> 'no-group' OR sum(cents) <> 0"


def recognition(spark, sf_dir):
    """Revenue as it comes in, and the mirrored costs."""
    e, chart = proxy.entries(spark, sf_dir), proxy.chart(spark)
    earned = e.where("direction = 'in'").join(F.broadcast(chart), "category_id").select(
        "entity_id", "category_id", "code", "dre_group", period_of(F.col("occurred_on")).alias("period"), "cents", F.lit("revenue").alias("entry_kind"), (F.col("client_id") % 20 == 0).alias("is_intercompany"))
    return earned.unionByName(mirror.mirror(e, chart).withColumn("is_intercompany", F.lit(False)))


@query("c5_cash_mirror", MIRROR + " SELECT entity_id, code, period, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM mirrored GROUP BY ALL")
def c5(spark, sf_dir):
    return mirror.mirror(proxy.entries(spark, sf_dir), proxy.chart(spark)).groupBy("entity_id", "code", "period").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("c3_pl_monthly", MIRROR + ", src AS (SELECT * FROM recognition) " + _subtotals("period"))
def c3(spark, sf_dir):
    return pl.lines(recognition(spark, sf_dir), "period")


FAN = """, src AS (
  SELECT dre_group, 'entity-' || entity_id AS col, cents FROM recognition UNION ALL SELECT dre_group, 'total', cents FROM recognition
  UNION ALL SELECT dre_group, 'eliminations', -cents FROM recognition WHERE is_intercompany UNION ALL SELECT dre_group, 'total', -cents FROM recognition WHERE is_intercompany) """


@query("c4_pl_consolidated", MIRROR + FAN + _subtotals("col"))
def c4(spark, sf_dir):
    return pl.consolidated(recognition(spark, sf_dir))


def _categories(column: str) -> str:
    return f"""SELECT CASE WHEN dre_group IN ({', '.join(map(repr, pl.GROUPS))}) THEN dre_group ELSE 'no-group' END AS line, code, {column}, sum(cents)::BIGINT AS cents
FROM src WHERE coalesce(dre_group, '') <> 'transferencias' GROUP BY ALL"""


@query("a2_category_lines", MIRROR + ", src AS (SELECT * FROM recognition) " + _categories("period"))
def a2(spark, sf_dir):
    return pl.category_lines(recognition(spark, sf_dir), "period")


@query("c4_category_lines", MIRROR + FAN.replace("SELECT dre_group,", "SELECT dre_group, code,") + _categories("col"))
def c4_categories(spark, sf_dir):
    return pl.category_lines(pl.fanned(recognition(spark, sf_dir)), "col")


@query("p19_cell_entries", MIRROR + """ SELECT entity_id, category_id, period, cents, entry_kind FROM recognition
WHERE period BETWEEN DATE '1997-03-01' AND DATE '1997-05-01' AND category_id IN (SELECT category_id FROM chart WHERE code IN ('7.01', '3.02'))""")
def p19(spark, sf_dir):
    """What stands behind a cell of the statement: all categories of a line's codes, a month or a range."""
    ids = proxy.chart(spark).where(F.col("code").isin("7.01", "3.02")).select("category_id")
    r = recognition(spark, sf_dir).where(F.col("period").between("1997-03-01", "1997-05-01"))
    return r.join(F.broadcast(ids), "category_id", "left_semi").select("entity_id", "category_id", "period", "cents", "entry_kind")


@query("a22_accrual_totals", MIRROR + """ SELECT entity_id, coalesce(sum(cents) FILTER (entry_kind = 'revenue'), 0)::BIGINT AS revenue, coalesce(sum(cents) FILTER (entry_kind = 'cost'), 0)::BIGINT AS cost
FROM recognition GROUP BY 1""")
def a22(spark, sf_dir):
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("entry_kind") == kind, F.col("cents"))), F.lit(0))
    return recognition(spark, sf_dir).groupBy("entity_id").agg(part("revenue").alias("revenue"), part("cost").alias("cost"))


@query("x3_elimination", MIRROR + FAN + "SELECT col, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM src WHERE dre_group = 'receita_bruta' GROUP BY 1")
def x3(spark, sf_dir):
    r = recognition(spark, sf_dir).where("dre_group = 'receita_bruta'")
    pair = lambda c, v: F.struct(c.alias("col"), v.alias("cents"))
    own = F.array(pair(F.concat(F.lit("entity-"), F.col("entity_id").cast("string")), F.col("cents")), pair(F.lit("total"), F.col("cents")))
    both = F.array(pair(F.lit("eliminations"), -F.col("cents")), pair(F.lit("total"), -F.col("cents")))
    return r.select(F.inline(F.when(F.col("is_intercompany"), F.concat(own, both)).otherwise(own))).groupBy("col").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("a8_compare_ledgers", MIRROR + """, both_ledgers AS (
  SELECT CAST(date_trunc('month', occurred_on) AS DATE) AS period, 'cash_' || direction AS what, cents FROM entries UNION ALL SELECT period, 'recognised_' || entry_kind, cents FROM recognition)
SELECT period, coalesce(sum(cents) FILTER (what = 'cash_in'), 0)::BIGINT AS cash_in, coalesce(sum(cents) FILTER (what = 'cash_out'), 0)::BIGINT AS cash_out,
  coalesce(sum(cents) FILTER (what = 'recognised_revenue'), 0)::BIGINT AS recognised_revenue, coalesce(sum(cents) FILTER (what = 'recognised_cost'), 0)::BIGINT AS recognised_cost
FROM both_ledgers GROUP BY ROLLUP (period)""")
def a8(spark, sf_dir):
    cash = proxy.entries(spark, sf_dir).select(period_of(F.col("occurred_on")).alias("period"), "direction", "cents")
    return pl.compare(cash, recognition(spark, sf_dir))


@query("j6_receipt_client", SQL_LEDGER + """
SELECT coalesce(CASE WHEN client_id % 3 <> 0 THEN client_id END, c_custkey) AS client_id, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents
FROM entries LEFT JOIN customer ON client_id = c_custkey WHERE direction = 'in' GROUP BY 1""")
def j6(spark, sf_dir):
    """Receipts without a client take their contract's: here each third one lost it."""
    contracts = proxy.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"), F.col("c_custkey").alias("contract_client"))
    e = proxy.entries(spark, sf_dir).where("direction = 'in'").select(F.col("client_id").alias("contract_id"), F.when(F.col("client_id") % 3 != 0, F.col("client_id")).alias("client_id"), "cents")
    return e.join(contracts, "contract_id", "left").groupBy(F.coalesce("client_id", "contract_client").alias("client_id")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("a9_revenue_by_client", SQL_LEDGER + """
SELECT client_id, CAST(date_trunc('month', occurred_on) AS DATE) AS period, sum(cents)::BIGINT AS received FROM entries WHERE direction = 'in' AND client_id IS NOT NULL GROUP BY ALL HAVING sum(cents) <> 0""")
def a9(spark, sf_dir):
    e = proxy.entries(spark, sf_dir).where("direction = 'in' and client_id is not null")
    return e.groupBy("client_id", period_of(F.col("occurred_on")).alias("period")).agg(F.sum("cents").alias("received")).where("received <> 0")


PAY = SQL_LEDGER + """, pay AS (SELECT e.*, CASE WHEN account_id % 10 < 8 THEN account_id END AS person_id FROM entries e WHERE category_id = 4 AND direction = 'out')"""


def _pay(spark, sf_dir):
    return proxy.entries(spark, sf_dir).where("category_id = 4 and direction = 'out'").withColumn("person_id", F.when(F.col("account_id") % 10 < 8, F.col("account_id")))


@query("a10_payroll", PAY + " SELECT person_id, CAST(date_trunc('month', occurred_on) AS DATE) AS period, sum(cents)::BIGINT AS paid FROM pay GROUP BY ALL")
def a10(spark, sf_dir):
    """Payroll by person and month; a null person is the unattributed rest."""
    return _pay(spark, sf_dir).groupBy("person_id", period_of(F.col("occurred_on")).alias("period")).agg(F.sum("cents").alias("paid"))


@query("a11_margin", PAY + """, cost AS (SELECT person_id AS client_id, sum(cents) AS cost, count(DISTINCT person_id) AS people FROM pay WHERE person_id IS NOT NULL GROUP BY 1),
gained AS (SELECT client_id, sum(cents) AS revenue FROM entries WHERE direction = 'in' GROUP BY 1), j AS (
  SELECT coalesce(g.client_id, c.client_id) AS client_id, coalesce(revenue, 0) AS revenue, coalesce(cost, 0) AS cost, coalesce(people, 0) AS people FROM gained g FULL JOIN cost c ON g.client_id = c.client_id)
SELECT client_id, revenue::BIGINT AS revenue, cost::BIGINT AS cost, people::BIGINT AS people, (revenue - cost)::BIGINT AS margin,
  CASE WHEN revenue <> 0 THEN ((CASE WHEN revenue - cost < 0 THEN -1 ELSE 1 END) * ((2 * abs(revenue - cost)::HUGEINT * 10000 + revenue) // (2 * revenue)))::BIGINT END AS margin_bp FROM j""")
def a11(spark, sf_dir):
    """Revenue less the payroll of the people on each client (a person stands on the client of the same number), in basis points too."""
    cost = _pay(spark, sf_dir).where("person_id is not null").groupBy(F.col("person_id").alias("client_id")).agg(F.sum("cents").alias("cost"), F.countDistinct("person_id").alias("people"))
    gained = proxy.entries(spark, sf_dir).where("direction = 'in'").groupBy("client_id").agg(F.sum("cents").alias("revenue"))
    j = gained.join(cost, "client_id", "full_outer").na.fill(0, ["revenue", "cost", "people"])
    return j.withColumn("margin", F.col("revenue") - F.col("cost")).withColumn("margin_bp", basis_points(F.col("margin"), F.col("revenue")))


@query("a26_overview", MIRROR + """, r AS (SELECT coalesce(sum(cents) FILTER (dre_group = 'receita_bruta'), 0) AS revenue,
  coalesce(sum(CASE WHEN dre_group = 'receita_bruta' THEN cents WHEN dre_group IN ('deducoes', 'custos_diretos', 'pessoal', 'ferramentas', 'servicos', 'viagem', 'outras', 'financeiras') THEN -cents ELSE 0 END), 0) AS ebitda
  FROM recognition WHERE period BETWEEN DATE '1997-01-01' AND DATE '1997-12-01'), c AS (SELECT coalesce(sum(CASE WHEN direction = 'in' THEN cents ELSE -cents END), 0) AS net_cash, count(*) FILTER (category_id IS NULL) AS uncategorised FROM entries WHERE occurred_on BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
SELECT revenue::BIGINT AS revenue, ebitda::BIGINT AS ebitda, CASE WHEN revenue <> 0 THEN ((CASE WHEN ebitda < 0 THEN -1 ELSE 1 END) * ((2 * abs(ebitda)::HUGEINT * 10000 + revenue) // (2 * revenue)))::BIGINT END AS ebitda_bp, net_cash::BIGINT AS net_cash, uncategorised::BIGINT AS uncategorised FROM r, c""")
def a26(spark, sf_dir):
    """One row of figures of a year."""
    r = recognition(spark, sf_dir).where(F.col("period").between("1997-01-01", "1997-12-01"))
    minus = [pl.DEDUCTIONS, pl.DIRECT, *pl.OPERATING]
    r = r.agg(F.coalesce(F.sum(F.when(F.col("dre_group") == pl.REVENUE, F.col("cents"))), F.lit(0)).alias("revenue"),
              F.coalesce(F.sum(F.when(F.col("dre_group") == pl.REVENUE, F.col("cents")).when(F.col("dre_group").isin(minus), -F.col("cents"))), F.lit(0)).alias("ebitda"))
    c = proxy.entries(spark, sf_dir).where(F.col("occurred_on").between("1997-01-01", "1997-12-31")).agg(
        F.coalesce(F.sum(F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents"))), F.lit(0)).alias("net_cash"), F.count(F.when(F.col("category_id").isNull(), 1)).alias("uncategorised"))
    return r.join(c, F.lit(True)).select("revenue", "ebitda", basis_points(F.col("ebitda"), F.col("revenue")).alias("ebitda_bp"), "net_cash", "uncategorised")
