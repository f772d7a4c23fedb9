"""Queries of whole screens: consolidated cash flow, warnings, revenue in two columns, margin with what is not allotted, last charges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..operators import cashflow, clients, recurrence
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from ..sources.store import parts_for
from .accrual import PAY, _pay
from .cash import END, START
from .contracts import RECOGNISED, dealt, recognised
from .imports import RECURRING
from .registry import query

CHARTS = """charts AS (SELECT r_regionkey AS entity_id, category_id * 10 + r_regionkey AS id, code, name || '-' || r_regionkey AS name, kind, sort_order + r_regionkey AS sort_order FROM chart, region WHERE NOT (r_regionkey = 0 AND category_id = 5)),
firsts AS (SELECT code, name, kind FROM charts QUALIFY row_number() OVER (PARTITION BY code ORDER BY sort_order, entity_id, id) = 1)"""


def charts(spark, sf_dir):
    """Entities keep charts of their own; the first has no software."""
    regions = proxy.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("entity_id"))
    own = regions.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("n"), F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(order).alias("sort_order")) for i, code, name, kind, _, order in proxy.CHART])))
    return own.where("not (entity_id = 0 and _c.n = 5)").select("entity_id", (F.col("_c.n") * 10 + F.col("entity_id")).alias("category_id"), "_c.code", F.concat("_c.name", F.lit("-"), F.col("entity_id").cast("string")).alias("name"), "_c.kind", (F.col("_c.sort_order") + F.col("entity_id")).alias("sort_order"))


@query("c2_cash_flow_consolidated", SQL_LEDGER + f""", {CHARTS}, own AS (
  SELECT e.entity_id, coalesce(f.code, 'none') AS line, f.name, CASE WHEN coalesce(f.kind, '') = 'transfer' THEN 'transfer' ELSE direction END AS section, CAST(date_trunc('month', occurred_on) AS DATE) AS period, cents, CASE WHEN direction = 'in' THEN cents ELSE -cents END AS signed_cents, occurred_on
  FROM entries e LEFT JOIN charts c ON e.entity_id = c.entity_id AND e.category_id * 10 + e.entity_id = c.id LEFT JOIN firsts f ON f.code = c.code WHERE account_id IN (SELECT account_id FROM accounts WHERE type <> 'credit_card')),
cells AS (SELECT section, unnest([line, 'total']) AS line, unnest([name, NULL]) AS name, period, CASE WHEN section = 'transfer' THEN signed_cents ELSE cents END AS cents FROM own WHERE period BETWEEN DATE '{START}' AND DATE '{END}'),
axis AS (SELECT CAST(month AS DATE) AS period FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH) g(month)),
shells AS (SELECT * FROM (SELECT DISTINCT section, line, name FROM cells), axis),
first AS (SELECT (SELECT coalesce(sum(opening_cents), 0) FROM accounts WHERE type <> 'credit_card') + (SELECT coalesce(sum(signed_cents), 0) FROM own WHERE occurred_on < DATE '{START}') AS first),
months AS (SELECT a.period, coalesce(sum(signed_cents), 0) AS net FROM axis a LEFT JOIN own o ON o.period = a.period GROUP BY 1),
run AS (SELECT period, net, first + sum(net) OVER (ORDER BY period) AS closing FROM months, first)
SELECT s.section, s.line, s.name, s.period, coalesce(sum(cents), 0)::BIGINT AS cents FROM shells s LEFT JOIN cells c ON s.section = c.section AND s.line = c.line AND s.period = c.period GROUP BY ALL
UNION ALL SELECT 'balance', unnest(['opening', 'net', 'closing']), NULL, period, unnest([closing - net, net, closing])::BIGINT FROM run""")
def c2(spark, sf_dir):
    e = proxy.entries(spark, sf_dir).withColumn("category_id", F.col("category_id") * 10 + F.col("entity_id"))
    return cashflow.consolidated(e, proxy.accounts(spark, sf_dir), charts(spark, sf_dir), START, END)


@query("c1_warnings", SQL_LEDGER.replace("entries AS (", "every AS (", 1) + """, entries AS (SELECT * FROM every WHERE NOT occurred_on BETWEEN DATE '1997-05-01' AND DATE '1997-06-30'), told AS (SELECT account_id, type, DATE '1996-12-01' + CAST(account_id % 60 AS INTEGER) AS opened_on FROM accounts),
j AS (SELECT e.*, type IS NOT NULL AS cash FROM entries e LEFT JOIN told a ON e.account_id = a.account_id AND type <> 'credit_card' WHERE occurred_on BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
SELECT 'empty-month' AS code, CAST(CAST(month AS DATE) AS VARCHAR) AS subject, 0::BIGINT AS n FROM generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH) g(month) WHERE CAST(month AS DATE) NOT IN (SELECT CAST(date_trunc('month', occurred_on) AS DATE) FROM j WHERE cash)
UNION ALL SELECT 'dropped-account', CAST(account_id AS VARCHAR), count(*) FROM j WHERE NOT cash GROUP BY account_id
UNION ALL SELECT 'uncategorised', NULL, count(*) FROM j WHERE cash AND category_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'late-opening', CAST(account_id AS VARCHAR), 1 FROM told WHERE type <> 'credit_card' AND opened_on > DATE '1997-01-01'""")
def c1_warnings(spark, sf_dir):
    """A ledger with nothing in May and June, and accounts that opened in the winter before."""
    e = proxy.entries(spark, sf_dir).where("not occurred_on between date '1997-05-01' and date '1997-06-30'")
    a = proxy.accounts(spark, sf_dir).withColumn("opened_on", F.date_add(F.lit("1996-12-01").cast("date"), (F.col("account_id") % 60).cast("int")))
    return cashflow.warnings(e, a, proxy.chart(spark), START, END)


@query("a9_revenue_two_columns", RECOGNISED + """, who AS (SELECT o_orderkey AS contract_id, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS client_id FROM orders),
both_sides AS (SELECT client_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(round(o_totalprice * 100) AS BIGINT) AS received, 0 AS recognised FROM orders JOIN who ON o_orderkey = contract_id
  UNION ALL SELECT client_id, period, 0, cents FROM recognised JOIN who USING (contract_id))
SELECT CASE grouping_id(client_id, period) WHEN 0 THEN 'cell' WHEN 1 THEN 'client' WHEN 2 THEN 'month' ELSE 'all' END AS level, client_id, period, sum(received)::BIGINT AS received, sum(recognised)::BIGINT AS recognised
FROM both_sides GROUP BY CUBE (client_id, period) HAVING sum(received) <> 0 OR sum(recognised) <> 0""")
def a9_two(spark, sf_dir):
    """Receipts beside recognised revenue; contracts of each thirteenth client have lost their client."""
    o = proxy.table(spark, sf_dir, "orders")
    from ..functions.money import cents

    who = o.select(F.col("o_orderkey").alias("contract_id"), F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")).alias("client_id"))
    received = o.select(F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")).alias("client_id"), period_of(F.col("o_orderdate").cast("date")).alias("period"), cents(F.col("o_totalprice")).alias("cents"))
    return clients.revenue(received, recognised(spark, sf_dir).join(dealt(spark, sf_dir, who), "contract_id").select("client_id", "period", "cents"), parts_for(o))


@query("j7_margin_with_rest", PAY + """, people AS (SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS client_id FROM supplier),
cost AS (SELECT p.client_id, sum(cents) AS cost, count(DISTINCT CASE WHEN p.client_id IS NOT NULL THEN pay.person_id END) AS people FROM pay LEFT JOIN people p ON p.person_id = pay.person_id AND p.client_id IS NOT NULL GROUP BY 1),
gained AS (SELECT client_id, sum(cents) AS revenue FROM entries WHERE direction = 'in' GROUP BY 1),
own AS (SELECT coalesce(g.client_id, c.client_id) AS client_id, coalesce(revenue, 0) AS revenue, coalesce(cost, 0) AS cost, coalesce(people, 0) AS people FROM gained g FULL JOIN cost c ON g.client_id = c.client_id),
every AS (SELECT 'client' AS kind, * FROM own WHERE client_id IS NOT NULL UNION ALL SELECT 'unallocated', NULL, 0, cost, people FROM own WHERE client_id IS NULL AND cost <> 0 UNION ALL SELECT 'total', NULL, sum(revenue), sum(cost), sum(people) FROM own)
SELECT kind, client_id, revenue::BIGINT AS revenue, cost::BIGINT AS cost, people::BIGINT AS people, (revenue - cost)::BIGINT AS margin,
  CASE WHEN revenue <> 0 THEN ((CASE WHEN revenue - cost < 0 THEN -1 ELSE 1 END) * ((2 * abs(revenue - cost)::HUGEINT * 10000 + revenue) // (2 * revenue)))::BIGINT END AS margin_bp FROM every""")
def j7(spark, sf_dir):
    """Suppliers as people, of whom two in three work for a client; payroll of the others, and of nobody, is the rest."""
    people = proxy.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("client_id"))
    gained = proxy.entries(spark, sf_dir).where("direction = 'in'").select("client_id", "cents")
    return clients.margin(gained, _pay(spark, sf_dir).select("person_id", "cents"), people)


@query("w6_last_charge", f"""WITH found AS ({RECURRING}), told AS (SELECT l_suppkey % 40 * 1000 + l_partkey % 997 AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(l_suppkey % 20 AS INTEGER) AS occurred_on, 300000 + (l_partkey % 997) * 10 + l_linenumber % 2 * 100 AS cents,
  'line ' || l_orderkey AS label, l_partkey % 14 AS category_id, l_suppkey AS account_id FROM lineitem),
last AS (SELECT t.supplier, max(struct_pack(a := t.occurred_on, b := t.cents, c := t.label, d := t.category_id, e := t.account_id)) AS x FROM told t JOIN found f ON t.supplier = f.supplier WHERE abs(t.cents - typical) <= (2 * typical * 25 + 100) // 200 GROUP BY 1)
SELECT f.*, x.c AS label, x.d AS category_id, x.e AS account_id FROM found f JOIN last USING (supplier)""")
def w6(spark, sf_dir):
    """Subscriptions with the label, category and account of their last charge."""
    rows = proxy.table(spark, sf_dir, "lineitem")
    charges = rows.select((F.col("l_suppkey") % 40 * 1000 + F.col("l_partkey") % 997).alias("supplier"), F.date_add(F.trunc(F.col("l_shipdate").cast("date"), "MM"), (F.col("l_suppkey") % 20).cast("int")).alias("occurred_on"),
                          (300000 + (F.col("l_partkey") % 997) * 10 + F.col("l_linenumber") % 2 * 100).alias("cents"), F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("label"), (F.col("l_partkey") % 14).alias("category_id"), F.col("l_suppkey").alias("account_id"))
    found = recurrence.detect(charges.select("supplier", "occurred_on", "cents"), "supplier", "2001-09-01")
    return recurrence.last_charge(charges, found, "supplier", ["label", "category_id", "account_id"])
