"""Queries of scopes, changes of tables, and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import audit, maintenance, replies, scope
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from .contracts import contracts
from .registry import query


@query("j16_scope", SQL_LEDGER + """
SELECT entity_id, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM entries WHERE entity_id IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 4 AND r_regionkey % 2 = 0) GROUP BY 1""")
def j16(spark, sf_dir):
    """A reader of the even entities; the last one is not active."""
    r = proxy.table(spark, sf_dir, "region")
    entities = r.select(F.col("r_regionkey").alias("entity_id"), (F.col("r_regionkey") != 4).alias("active"))
    grants = r.where("r_regionkey % 2 = 0").select(F.lit(1).alias("user_id"), F.col("r_regionkey").alias("entity_id"))
    return scope.scoped(proxy.entries(spark, sf_dir), entities, grants, scope.Scope(1, consolidated=True)).groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("p9_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%d w%' OR p_type ILIKE '%small%'")
def p9(spark, sf_dir):
    part = proxy.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return scope.search(part, "p_name", "D%w").unionByName(scope.search(part, "p_type", "Small")).distinct().select("p_partkey", "p_name")


@query("k10_upsert", """WITH o AS (SELECT c_custkey AS k, 'old' AS v, 0 AS "at" FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_custkey, 'new' || o_orderkey, o_orderkey + 1 FROM orders WHERE o_custkey % 2 = 0)
SELECT k, v, CAST(o."at" AS BIGINT) AS "at" FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY o."at" DESC) = 1""")
def k10(spark, sf_dir):
    old = proxy.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("at"))
    new = proxy.table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("v"), (F.col("o_orderkey") + 1).alias("at"))
    return maintenance.upsert(old, new, ["k"])


@query("k11_amend", """WITH c AS (SELECT o_orderkey AS contract_no, 1 AS version, CAST(round(o_totalprice * 100) AS BIGINT) AS total, CASE WHEN o_orderkey % 10 = 0 THEN DATE '1999-01-01' END AS superseded_at FROM orders)
SELECT contract_no, version, total, CASE WHEN contract_no % 4 = 0 AND superseded_at IS NULL THEN DATE '2000-01-01' ELSE superseded_at END AS superseded_at FROM c
UNION ALL SELECT contract_no, 2, total + 100, NULL FROM c WHERE contract_no % 4 = 0 AND superseded_at IS NULL""")
def k11(spark, sf_dir):
    c = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_no"), F.lit(1).alias("version"), cents(F.col("o_totalprice")).alias("total"),
                                                    F.when(F.col("o_orderkey") % 10 == 0, F.lit("1999-01-01").cast("date")).alias("superseded_at"))
    return maintenance.amend(c, c.where("contract_no % 4 = 0").select("contract_no", F.lit("2000-01-01").cast("date").alias("amended_at"), (F.col("total") + 100).alias("total")))


@query("k8_counterparts", """SELECT o_orderkey AS from_id, o_custkey % 7 AS account_id, CAST(o_orderdate AS DATE) AS occurred_on, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 'out' AS direction,
  CASE o_custkey % 3 WHEN 0 THEN 'card_payment' WHEN 1 THEN 'investment' ELSE 'internal' END AS pair_kind FROM orders WHERE o_custkey % 7 <> o_custkey % 5""")
def k8(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), (F.col("o_custkey") % 5).alias("account_id"), (F.col("o_custkey") % 7).alias("target_account_id"), F.col("o_orderdate").cast("date").alias("occurred_on"),
                                                    cents(F.col("o_totalprice")).alias("cents"), F.lit("in").alias("direction"), F.when(F.col("o_custkey") % 3 == 0, "99.02").when(F.col("o_custkey") % 3 == 1, "99.03").otherwise("99.01").alias("code"))
    return maintenance.counterparts(o)


@query("k6_delete_cascade", """SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey % 9 <> 0 AND NOT (o_orderkey % 9 = 1 AND (o_orderkey - 1) % 2 = 0 AND (o_orderkey - 1) IN (SELECT o_orderkey FROM orders))""")
def k6(spark, sf_dir):
    """Each ninth entry goes, and the next one where a transfer pairs them."""
    e = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"))
    pairs = e.where("entry_id % 2 = 0").select(F.col("entry_id").alias("from_id"), (F.col("entry_id") + 1).alias("to_id"))
    return maintenance.delete_with_pairs(e, pairs, e.where("entry_id % 9 = 0"))


@query("k14_import_status", """SELECT user_id AS import_id, count(*) FILTER (event_type = 'view')::BIGINT AS pending, count(*) FILTER (event_type IN ('click', 'purchase'))::BIGINT AS approved, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase'))::BIGINT AS rejected,
  sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT))::BIGINT AS signed, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'review' ELSE 'approved' END AS status FROM events GROUP BY 1""")
def k14(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type").isin("click", "purchase"), "approved").otherwise("rejected")
    signed = F.when(F.col("event_type") == "purchase", -cents(F.col("value"))).otherwise(cents(F.col("value")))
    return maintenance.import_status(proxy.table(spark, sf_dir, "events").select(F.col("user_id").alias("import_id"), kind.alias("status"), signed.alias("signed_cents")))


@query("k15_rule_hits", "SELECT r.k AS rule_id, (r.k * 10 + count(event_id))::BIGINT AS hits FROM range(8) r(k) LEFT JOIN events ON event_id % 11 = r.k GROUP BY r.k")
def k15(spark, sf_dir):
    rules = spark.range(8).select(F.col("id").alias("rule_id"), (F.col("id") * 10).alias("hits"))
    return maintenance.rule_hits(rules, proxy.table(spark, sf_dir, "events").select((F.col("event_id") % 11).alias("rule_id")))


@query("c30_contract_violations", """WITH v AS (SELECT o_orderkey, o_orderkey % 13 = 0 AS bad_end, o_orderpriority = '1-URGENT' AND o_orderkey % 6 = 0 AS bad_poc FROM orders)
SELECT o_orderkey AS contract_id, 'end-before-start' AS violation FROM v WHERE bad_end UNION ALL SELECT o_orderkey, 'poc-needs-total' FROM v WHERE bad_poc""")
def c30(spark, sf_dir):
    """Contracts of which each thirteenth ends before it begins, and some urgent ones have no total."""
    c = contracts(spark, sf_dir).withColumn("end_date", F.when(F.col("contract_id") % 13 == 0, F.date_sub("start_date", 1)).otherwise(F.col("end_date")))
    c = c.withColumn("total_cents", F.when((F.col("method") == "poc") & (F.col("contract_id") % 6 == 0), None).otherwise(F.col("total_cents")))
    return audit.violations(c, audit.contract_checks()).select("contract_id", "violation")


@query("a24_closing_balance", "SELECT user_id AS account_id, arg_max(CAST(round(value * 100) AS BIGINT), (CAST(ts AS DATE), -event_id)) AS closing, max(CAST(ts AS DATE)) AS last_on, min(CAST(ts AS DATE)) AS first_on FROM events GROUP BY 1")
def a24(spark, sf_dir):
    """The balance declared on the last day, the first of several, and the days that a statement spans."""
    e = proxy.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return e.groupBy(F.col("user_id").alias("account_id")).agg(F.max_by(cents(F.col("value")), F.struct("day", -F.col("event_id"))).alias("closing"), F.max("day").alias("last_on"), F.min("day").alias("first_on"))


@query("f37_checked_replies", """WITH s AS (SELECT user_id AS import_id, event_id AS ref FROM events), r AS (SELECT import_id, ref, row_number() OVER (PARTITION BY import_id ORDER BY ref) AS k FROM s)
SELECT import_id, CASE WHEN k % 5 = 1 THEN 'x' || ref ELSE ref::VARCHAR END AS ref, CASE WHEN k % 5 = 2 THEN '0.00' ELSE '6.02' END AS category_code, (CASE WHEN k % 5 = 3 THEN 1.5 ELSE 0.5 END)::DOUBLE AS confidence,
  CASE WHEN k % 5 = 1 THEN 'unknown ref' WHEN k % 5 = 2 THEN 'unknown code' WHEN k % 5 = 3 THEN 'bad confidence' END AS reason FROM r""")
def f37(spark, sf_dir):
    """A reply for each account, with bad references, codes and confidences among its suggestions."""
    from pyspark.sql import Window

    s = proxy.table(spark, sf_dir, "events").select(F.col("user_id").alias("import_id"), F.col("event_id").alias("ref"))
    k = F.row_number().over(Window.partitionBy("import_id").orderBy("ref")) % 5
    one = F.struct(F.when(k == 1, F.concat(F.lit("x"), F.col("ref").cast("string"))).otherwise(F.col("ref").cast("string")).alias("ref"), F.when(k == 2, "0.00").otherwise("6.02").alias("category_code"), F.when(k == 3, 1.5).otherwise(0.5).alias("confidence"))
    told = s.withColumn("one", one).groupBy("import_id").agg(F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.collect_list("one")), F.lit("\n```")).alias("reply"))
    return replies.checked_replies(told, s, proxy.chart(spark))


@query("f39_prompts", """WITH s AS (SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 120 AS batch FROM events)
SELECT user_id AS import_id, batch::INTEGER AS batch, string_agg(event_id || ': ' || event_type, chr(10) ORDER BY event_id) AS prompt FROM s GROUP BY ALL""")
def f39(spark, sf_dir):
    return replies.prompt_batches(proxy.table(spark, sf_dir, "events").select(F.col("user_id").alias("import_id"), F.col("event_id").alias("ref"), F.col("event_type").alias("description")))
