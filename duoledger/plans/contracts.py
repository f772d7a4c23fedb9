"""Queries of contracts: plans, deferred revenue, reconciliation, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..functions.money import allocate, cents
from ..operators import recognition as rec
from ..sources import proxy
from ..sources.store import parts_for, written
from .registry import query

THROUGH = "1999-06-01"
CONTRACTS = """WITH contracts AS (
  SELECT o_orderkey AS contract_id, o_custkey AS client_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) // (1 + o_orderkey % 12) END AS monthly_cents,
    CAST(o_orderdate AS DATE) AS start_date, last_day(CAST(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 12 AS INTEGER)) AS DATE)) AS end_date,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'draft' END AS status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'poc' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'manual' ELSE 'straight_line' END AS method, o_orderkey % 3 <> 0 AS prorate
  FROM orders),
months AS (SELECT c.*, CAST(unnest(generate_series(date_trunc('month', start_date), date_trunc('month', end_date), INTERVAL 1 MONTH)) AS DATE) AS period FROM contracts c),
covered AS (SELECT *, greatest(0, date_diff('day', greatest(start_date, period), least(end_date, last_day(period))) + 1) AS covered, day(last_day(period)) AS days FROM months)"""
REPORTS = """, shipped AS (SELECT l_orderkey AS contract_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
reports AS (SELECT contract_id, period, CAST(CASE WHEN contract_id % 17 = 0 AND month(period) = 5 THEN 120000 ELSE (sum(q) OVER (PARTITION BY contract_id ORDER BY period) - CASE WHEN month(period) = 3 THEN q ELSE 0 END) * 100000
  // (sum(q) OVER (PARTITION BY contract_id) + contract_id % 5) END AS BIGINT) AS cumulative FROM shipped),
valid AS (SELECT *, lag(cumulative, 1, 0) OVER (PARTITION BY contract_id ORDER BY period) AS previous FROM reports WHERE cumulative BETWEEN 0 AND 100000),
steps AS (SELECT v.contract_id, v.period, cumulative, previous,
    ((CASE WHEN cumulative < previous THEN -1 ELSE 1 END) * ((2 * total_cents::HUGEINT * abs(cumulative - previous) + 100000) // 200000))::BIGINT AS cents, cumulative < previous AS falls
  FROM valid v JOIN contracts c ON v.contract_id = c.contract_id WHERE method = 'poc' AND status <> 'draft')"""
ALLOCATED = """, parts AS (SELECT contract_id, period, total_cents, CASE WHEN prorate THEN covered ELSE (covered > 0)::INTEGER END AS weight FROM covered WHERE monthly_cents IS NULL AND method = 'straight_line' AND status <> 'draft'),
shares AS (SELECT *, sum(weight) OVER (PARTITION BY contract_id) AS weights FROM parts),
cut AS (SELECT *, (total_cents::HUGEINT * weight) // weights AS part, (total_cents::HUGEINT * weight) % weights AS rest FROM shares),
allocated AS (SELECT contract_id, period, (part + CASE WHEN row_number() OVER (PARTITION BY contract_id ORDER BY rest DESC, period) <= total_cents - sum(part) OVER (PARTITION BY contract_id) THEN 1 ELSE 0 END)::BIGINT AS cents FROM cut)"""
MONTHLY = """, monthly AS (SELECT contract_id, period, CASE WHEN prorate AND covered < days THEN ((2 * monthly_cents::HUGEINT * covered + days) // (2 * days))::BIGINT ELSE monthly_cents END AS cents
  FROM covered WHERE monthly_cents IS NOT NULL AND method = 'straight_line' AND status <> 'draft' AND covered > 0 AND period <= DATE '1999-06-01')"""
RECOGNISED = CONTRACTS + REPORTS + ALLOCATED + MONTHLY + """, recognised AS (SELECT contract_id, period, cents FROM monthly UNION ALL SELECT contract_id, period, cents FROM allocated WHERE period <= DATE '1999-06-01'
  UNION ALL SELECT contract_id, period, cents FROM steps WHERE cumulative <> previous)"""


def contracts(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders")
    total, start = cents(F.col("o_totalprice")), F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("client_id"), total.alias("total_cents"),
        F.when(F.col("o_orderkey") % 2 == 0, F.floor(total / (1 + F.col("o_orderkey") % 12)).cast("long")).alias("monthly_cents"),
        start.alias("start_date"), F.last_day(F.add_months(F.trunc(start, "MM"), (F.col("o_orderkey") % 12).cast("int"))).alias("end_date"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("draft").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "poc").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "manual").otherwise("straight_line").alias("method"),
        (F.col("o_orderkey") % 3 != 0).alias("prorate"))


def dealt(spark, sf_dir, rows):
    """rows by contract, in parts that grow in number with the contracts and not in size; what is grouped, ordered or joined by contract then stays in its part."""
    return rows.repartition(parts_for(proxy.table(spark, sf_dir, "orders")), "contract_id")


def reports(spark, sf_dir):
    from pyspark.sql import Window

    lines = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), period_of(F.col("l_shipdate").cast("date")).alias("period"), F.col("l_quantity").cast("long").alias("q"))
    shipped = dealt(spark, sf_dir, lines).groupBy("contract_id", "period").agg(F.sum("q").alias("q"))
    w = Window.partitionBy("contract_id")
    upto = F.sum("q").over(w.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.month("period") == 3, F.col("q")).otherwise(0)
    share = F.floor((upto * 100_000).cast("decimal(20,0)") / (F.sum("q").over(w) + F.col("contract_id") % 5)).cast("long")
    odd = (F.col("contract_id") % 17 == 0) & (F.month("period") == 5)
    return shipped.select("contract_id", "period", F.when(odd, 120_000).otherwise(share).alias("cumulative_millipercent"))


def straight(spark, sf_dir):
    return contracts(spark, sf_dir).where("method = 'straight_line' and status <> 'draft'")


def poc(spark, sf_dir):
    return dealt(spark, sf_dir, contracts(spark, sf_dir).where("method = 'poc' and status <> 'draft'"))


def recognised(spark, sf_dir):
    own = dealt(spark, sf_dir, straight(spark, sf_dir))
    rows = rec.straight_monthly(own, "1999-06-30").unionByName(rec.straight_total(own, THROUGH))
    return rows.unionByName(rec.poc_deltas(poc(spark, sf_dir), reports(spark, sf_dir)).where("cumulative <> previous").select("contract_id", "period", "cents"))


@query("c6_straight_monthly", CONTRACTS + MONTHLY + " SELECT * FROM monthly")
def c6(spark, sf_dir):
    return rec.straight_monthly(straight(spark, sf_dir), "1999-06-30")


@query("c7_straight_total", CONTRACTS + ALLOCATED + f" SELECT * FROM allocated WHERE period <= DATE '{THROUGH}'")
def c7(spark, sf_dir):
    return rec.straight_total(straight(spark, sf_dir), THROUGH)


@query("c10_contract_periods", CONTRACTS + " SELECT contract_id, period FROM months")
def c10(spark, sf_dir):
    return rec.axis(contracts(spark, sf_dir), F.col("end_date")).select("contract_id", "period")


@query("w7_allocate", """WITH lines AS (SELECT l_orderkey AS contract_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(l_quantity AS BIGINT) AS weight,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
s AS (SELECT contract_id, k, weight, CAST(round(o_totalprice * 100) AS BIGINT) AS total, sum(weight) OVER (PARTITION BY contract_id) AS weights FROM lines JOIN orders ON contract_id = o_orderkey),
c AS (SELECT *, (total::HUGEINT * weight) // weights AS part, (total::HUGEINT * weight) % weights AS rest FROM s)
SELECT contract_id, k::INTEGER AS k, (part + CASE WHEN row_number() OVER (PARTITION BY contract_id ORDER BY rest DESC, k) <= total - sum(part) OVER (PARTITION BY contract_id) THEN 1 ELSE 0 END)::BIGINT AS share FROM c""")
def w7(spark, sf_dir):
    """Each order's total split over its lines by quantity, to the cent."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.row_number().over(order).alias("k"), F.col("l_quantity").cast("long").alias("weight"))
    totals = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), cents(F.col("o_totalprice")).alias("total"))
    return allocate(lines.join(totals, "contract_id"), ["contract_id"], "k", "total", "weight").select("contract_id", "k", "share")


@query("w2_poc_delta", CONTRACTS + REPORTS + " SELECT contract_id, period, cumulative, previous::BIGINT AS previous, cents, falls FROM steps")
def w2(spark, sf_dir):
    return rec.poc_deltas(poc(spark, sf_dir), reports(spark, sf_dir))


@query("c8_plan_poc", CONTRACTS + REPORTS + """, reached AS (SELECT contract_id, max_by(cumulative, period) AS reached, sum(cents) AS done FROM steps GROUP BY 1)
SELECT contract_id, period, cents, 'report' AS basis FROM steps WHERE cumulative <> previous
UNION ALL SELECT c.contract_id, CAST(date_trunc('month', end_date) AS DATE), (total_cents - coalesce(done, 0))::BIGINT, 'remainder' FROM contracts c LEFT JOIN reached r ON c.contract_id = r.contract_id
WHERE method = 'poc' AND status = 'completed' AND coalesce(reached, 0) < 100000 AND total_cents <> coalesce(done, 0)""")
def c8(spark, sf_dir):
    return rec.plan_poc(poc(spark, sf_dir), reports(spark, sf_dir))


@query("x4_missing_reports", CONTRACTS + REPORTS + """ SELECT contract_id, period FROM months m WHERE method = 'poc' AND status <> 'draft' AND period <= DATE '1999-06-01'
  AND NOT EXISTS (SELECT 1 FROM reports r WHERE r.contract_id = m.contract_id AND r.period = m.period)""")
def x4(spark, sf_dir):
    return rec.missing_reports(poc(spark, sf_dir), reports(spark, sf_dir), THROUGH)


@query("c9_plan_gate", CONTRACTS + """ SELECT CASE WHEN status = 'draft' THEN 'draft' WHEN method = 'manual' THEN 'manual' WHEN start_date > DATE '1999-06-30' THEN 'not-started' END AS warning, count(*)::BIGINT AS n FROM contracts GROUP BY 1""")
def c9(spark, sf_dir):
    return rec.gate(contracts(spark, sf_dir), THROUGH).groupBy("warning").agg(F.count("*").alias("n"))


OPEN = """, open AS (SELECT contract_id, CASE WHEN contract_id % 5 <> 1 THEN total_cents END AS total_cents, monthly_cents, end_date FROM contracts),
fees AS (SELECT c.contract_id, sum(CASE WHEN prorate AND covered < days THEN (2 * c.monthly_cents::HUGEINT * covered + days) // (2 * days) ELSE c.monthly_cents END) AS fees FROM covered c JOIN open o ON o.contract_id = c.contract_id WHERE o.total_cents IS NULL AND c.monthly_cents IS NOT NULL GROUP BY 1)"""


@query("c12_deferred", RECOGNISED + OPEN + """, done AS (SELECT contract_id, sum(cents) AS recognised FROM recognised GROUP BY 1),
j AS (SELECT o.contract_id, coalesce(o.total_cents, fees) AS contracted, coalesce(recognised, 0) AS recognised FROM open o LEFT JOIN fees f ON f.contract_id = o.contract_id LEFT JOIN done d ON o.contract_id = d.contract_id)
SELECT contract_id, contracted::BIGINT AS contracted, recognised::BIGINT AS recognised, CASE WHEN contracted IS NOT NULL THEN greatest(contracted - recognised, 0) END::BIGINT AS to_recognise,
  CASE WHEN contracted IS NOT NULL THEN greatest(recognised - contracted, 0) END::BIGINT AS to_invoice FROM j""")
def c12(spark, sf_dir):
    """Every fifth contract has no total: those of a monthly fee are worth its months, the others an unknown sum."""
    own = dealt(spark, sf_dir, contracts(spark, sf_dir)).withColumn("total_cents", F.when(F.col("contract_id") % 5 != 1, F.col("total_cents")))
    return rec.deferred(own, recognised(spark, sf_dir))


@query("a13_deferred_by_client", RECOGNISED + """, done AS (SELECT contract_id, sum(cents) AS recognised FROM recognised GROUP BY 1)
SELECT client_id, sum(greatest(total_cents - coalesce(recognised, 0), 0))::BIGINT AS to_recognise, sum(greatest(coalesce(recognised, 0) - total_cents, 0))::BIGINT AS to_invoice FROM contracts c LEFT JOIN done d ON c.contract_id = d.contract_id GROUP BY 1""")
def a13(spark, sf_dir):
    own = dealt(spark, sf_dir, contracts(spark, sf_dir))
    return rec.deferred(own, recognised(spark, sf_dir)).join(own.select("contract_id", "client_id"), "contract_id").groupBy("client_id").agg(F.sum("to_recognise").alias("to_recognise"), F.sum("to_invoice").alias("to_invoice"))


INVOICES = """, invoices AS (SELECT l_orderkey AS contract_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_returnflag <> 'R'),
receipts AS (SELECT o_orderkey AS contract_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


@query("c13_reconcile", RECOGNISED + INVOICES + """, r AS (SELECT contract_id, period, 'a' AS w, cents FROM recognised UNION ALL SELECT contract_id, period, 'b', cents FROM invoices UNION ALL SELECT contract_id, period, 'c', cents FROM receipts)
SELECT contract_id, period, coalesce(sum(cents) FILTER (w = 'a'), 0)::BIGINT AS recognised, coalesce(sum(cents) FILTER (w = 'b'), 0)::BIGINT AS invoiced, coalesce(sum(cents) FILTER (w = 'c'), 0)::BIGINT AS received FROM r GROUP BY ALL""")
def c13(spark, sf_dir):
    """Recognised, invoiced and received by contract and month; returned lines are cancelled invoices, each ninth receipt a refund."""
    invoices = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), period_of(F.col("l_shipdate").cast("date")).alias("service_period"), cents(F.col("l_extendedprice")).alias("gross_cents"),
                                                             F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("issued").alias("status"))
    receipts = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderdate").cast("date").alias("occurred_on"), cents(F.col("o_totalprice")).alias("cents"),
                                                           F.when(F.col("o_orderkey") % 9 == 0, "out").otherwise("in").alias("direction"))
    return rec.reconcile(recognised(spark, sf_dir), dealt(spark, sf_dir, invoices), dealt(spark, sf_dir, receipts))


EXISTING = """, existing AS (SELECT contract_id, period, sum(cents) + CASE WHEN contract_id % 4 = 0 THEN 1 ELSE 0 END AS cents, contract_id % 5 = 0 AS manually_edited FROM recognised WHERE contract_id % 7 <> 0 GROUP BY contract_id, period
  UNION ALL SELECT o_orderkey, DATE '2005-01-01', 100, o_orderkey % 5 = 0 FROM orders WHERE o_orderkey % 50 = 0),
plan AS (SELECT contract_id, period, sum(cents) AS planned FROM recognised GROUP BY ALL)"""


@query("c11_merge_actions", RECOGNISED + EXISTING + """
SELECT coalesce(p.contract_id, e.contract_id) AS contract_id, coalesce(p.period, e.period) AS period, 'engine' AS source, 'revenue' AS kind, planned::BIGINT AS planned, e.cents::BIGINT AS was,
  CASE WHEN e.cents IS NULL THEN 'insert' WHEN manually_edited THEN 'skip' WHEN planned IS NULL THEN 'remove' WHEN planned = e.cents THEN 'keep' ELSE 'update' END AS action
FROM plan p FULL JOIN existing e ON p.contract_id = e.contract_id AND p.period = e.period""")
def c11(spark, sf_dir):
    named = {"source": F.lit("engine"), "kind": F.lit("revenue")}
    plan = written(recognised(spark, sf_dir).groupBy("contract_id", "period").agg(F.sum("cents").alias("cents")), "plan")
    parts, plan = parts_for(plan, 400_000), plan.withColumns(named)
    old = plan.where("contract_id % 7 <> 0").withColumn("cents", F.col("cents") + F.when(F.col("contract_id") % 4 == 0, 1).otherwise(0))
    extra = proxy.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("contract_id"), F.lit("2005-01-01").cast("date").alias("period"), F.lit(100).cast("long").alias("cents")).withColumns(named)
    old = old.unionByName(extra).withColumn("manually_edited", F.col("contract_id") % 5 == 0)
    return rec.merge_actions(plan, old, parts)


@query("k9_apply", RECOGNISED + EXISTING + """
SELECT CASE WHEN e.cents IS NULL THEN 'insert' WHEN manually_edited THEN 'skip' WHEN planned IS NULL THEN 'remove' WHEN planned = e.cents THEN 'keep' ELSE 'update' END AS action, count(*)::BIGINT AS n,
  coalesce(sum(CASE WHEN manually_edited THEN e.cents ELSE planned END), 0)::BIGINT AS cents
FROM plan p FULL JOIN existing e ON p.contract_id = e.contract_id AND p.period = e.period GROUP BY 1""")
def k9(spark, sf_dir):
    """What a merge does, by action, and the cents that then stand."""
    kept = F.when(F.col("action") == "skip", F.col("was")).otherwise(F.col("planned"))
    return c11(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.coalesce(F.sum(kept), F.lit(0)).alias("cents"))


@query("a32_open_projects", CONTRACTS + REPORTS + """, done AS (SELECT contract_id, sum(cents) AS recognised FROM steps GROUP BY 1), last AS (SELECT contract_id, max_by(cumulative, period) AS latest, max(cumulative) FILTER (period = DATE '1998-05-01') AS this_month FROM reports GROUP BY 1)
SELECT c.contract_id, latest::BIGINT AS latest, this_month::BIGINT AS this_month, coalesce(recognised, 0)::BIGINT AS recognised FROM contracts c LEFT JOIN last l ON c.contract_id = l.contract_id LEFT JOIN done d ON c.contract_id = d.contract_id WHERE method = 'poc' AND status = 'active'""")
def a32(spark, sf_dir):
    """Open projects with their latest report, this month's, and what is recognised."""
    own, told = poc(spark, sf_dir), reports(spark, sf_dir)
    last = told.groupBy("contract_id").agg(F.max_by("cumulative_millipercent", "period").alias("latest"), F.max(F.when(F.col("period") == F.lit("1998-05-01").cast("date"), F.col("cumulative_millipercent"))).alias("this_month"))
    done = rec.poc_deltas(own, told).groupBy("contract_id").agg(F.sum("cents").alias("recognised"))
    return own.where("status = 'active'").join(last, "contract_id", "left").join(done, "contract_id", "left").select("contract_id", "latest", "this_month", F.coalesce("recognised", F.lit(0)).alias("recognised"))
