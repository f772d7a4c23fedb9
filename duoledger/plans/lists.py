"""Queries of plain lists, lookups, filters and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import audit, pl
from ..operators.recognition import revenue_category, totals
from ..operators.staging import reconcile_statement
from ..sources import proxy
from ..sources.proxy import SQL_CHART, SQL_LEDGER
from .accrual import MIRROR, _subtotals, recognition
from .contracts import CONTRACTS, INVOICES, RECOGNISED, c13, contracts
from .imports import subjects
from .registry import query

INVOICE_SQL = """WITH invoices AS (SELECT o_orderkey AS invoice_id, o_orderkey // 10 AS contract_id, o_custkey AS client_id, (o_custkey % 5)::INTEGER AS entity_id, CAST(o_orderdate AS DATE) AS issued_on,
  CAST(round(o_totalprice * 100) AS BIGINT) AS gross_cents, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'issued' ELSE 'cancelled' END AS status FROM orders)"""
AUDIT_SQL = """WITH audited AS (SELECT event_id AS id, (user_id % 5)::INTEGER AS entity_id, user_id AS actor, event_type AS table_name, ts AS created_at FROM events)"""


def invoices(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "issued").otherwise("cancelled")
    return proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.expr("o_orderkey div 10").alias("contract_id"), F.col("o_custkey").alias("client_id"), (F.col("o_custkey") % 5).cast("int").alias("entity_id"),
                                                       F.col("o_orderdate").cast("date").alias("issued_on"), cents(F.col("o_totalprice")).alias("gross_cents"), status.alias("status"))


def audited(spark, sf_dir):
    return proxy.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("int").alias("entity_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("table_name"), F.col("ts").alias("created_at"))


@query("s2_entry_by_id", "SELECT o_orderkey AS entry_id, o_custkey AS client_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey = 77")
def s2(spark, sf_dir):
    """Looked up by its id: the filter reaches the scan."""
    return proxy.table(spark, sf_dir, "orders").where("o_orderkey = 77").select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("client_id"), cents(F.col("o_totalprice")).alias("cents"))


@query("s3_transfer_pairs", "SELECT o.o_orderkey AS entry_id, p.o_orderkey AS pair_id FROM orders o LEFT JOIN orders p ON o.o_orderkey % 2 = 0 AND p.o_orderkey = o.o_orderkey + 1")
def s3(spark, sf_dir):
    """Entries with the other leg of their transfer; even ones are paired with the next, where there is one."""
    e = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"))
    pairs = e.where("entry_id % 2 = 1").select((F.col("entry_id") - 1).alias("entry_id"), F.col("entry_id").alias("pair_id"))
    return e.join(pairs, "entry_id", "left").select("entry_id", "pair_id")


@query("s4_recognition_range", MIRROR + " SELECT entity_id, period, code, cents, entry_kind FROM recognition WHERE entity_id IN (1, 2) AND period BETWEEN DATE '1996-11-01' AND DATE '1997-02-01'")
def s4(spark, sf_dir):
    r = recognition(spark, sf_dir).where(F.col("entity_id").isin(1, 2) & F.col("period").between("1996-11-01", "1997-02-01"))
    return r.select("entity_id", "period", "code", "cents", "entry_kind")


@query("s9_invoices", INVOICE_SQL + " SELECT invoice_id, client_id, issued_on, gross_cents, row_number() OVER (PARTITION BY entity_id ORDER BY issued_on DESC, invoice_id)::INTEGER AS place FROM invoices WHERE entity_id IN (1, 3) AND status <> 'cancelled'")
def s9(spark, sf_dir):
    """The newest first within an entity."""
    own = invoices(spark, sf_dir).where(F.col("entity_id").isin(1, 3) & (F.col("status") != "cancelled"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("issued_on"), "invoice_id"))).select("invoice_id", "client_id", "issued_on", "gross_cents", "place")


@query("s10_clients", "SELECT c_custkey AS client_id, c_name AS name FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def s10(spark, sf_dir):
    """Active clients of an entity."""
    nation = F.broadcast(proxy.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey")))
    return proxy.table(spark, sf_dir, "customer").where("c_acctbal >= 0").join(nation, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name"))


@query("s11_accounts", SQL_LEDGER + " SELECT account_id, type, opening_cents, row_number() OVER (PARTITION BY entity_id ORDER BY type, account_id)::INTEGER AS place FROM accounts WHERE opening_cents >= 0")
def s11(spark, sf_dir):
    """Active accounts, by type and then by number."""
    own = proxy.accounts(spark, sf_dir).where("opening_cents >= 0")
    return own.select("account_id", "type", "opening_cents", F.row_number().over(Window.partitionBy("entity_id").orderBy("type", "account_id")).alias("place"))


@query("s12_categories", SQL_LEDGER + """ SELECT c.category_id::BIGINT AS category_id, code, name, row_number() OVER (ORDER BY sort_order, code)::INTEGER AS place, count(e.cents)::BIGINT AS entries
FROM chart c LEFT JOIN entries e ON e.category_id = c.category_id WHERE kind <> 'transfer' GROUP BY c.category_id, code, name, sort_order""")
def s12(spark, sf_dir):
    """Categories in the order of the chart, which is a few rows, with how many entries have them."""
    own = proxy.chart(spark).where("kind <> 'transfer'")
    used = proxy.entries(spark, sf_dir).groupBy("category_id").agg(F.count("*").alias("entries"))
    return own.join(used, "category_id", "left").select("category_id", "code", "name", F.row_number().over(Window.orderBy("sort_order", "code")).alias("place"), F.coalesce("entries", F.lit(0)).alias("entries"))


@query("s16_staged", "SELECT user_id AS import_id, event_id AS id, event_type AS description FROM events WHERE user_id = 5 AND event_type IN ('view', 'click')")
def s16(spark, sf_dir):
    """Staged rows of one import that are not settled."""
    return proxy.table(spark, sf_dir, "events").where(F.col("user_id") == 5).where(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("import_id"), F.col("event_id").alias("id"), F.col("event_type").alias("description"))


@query("s17_import_by_hash", """WITH imports AS (SELECT p_partkey AS import_id, sha256(p_type) AS file_hash, CASE p_size % 4 WHEN 0 THEN 'discarded' WHEN 1 THEN 'failed' WHEN 2 THEN 'review' ELSE 'approved' END AS status FROM part)
SELECT file_hash, min(import_id) AS import_id FROM imports WHERE status NOT IN ('discarded', 'failed') GROUP BY 1""")
def s17(spark, sf_dir):
    """Of each file the first import that still counts."""
    k = F.col("p_size") % 4
    status = F.when(k == 0, "discarded").when(k == 1, "failed").when(k == 2, "review").otherwise("approved")
    own = proxy.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("import_id"), F.sha2("p_type", 256).alias("file_hash"), status.alias("status"))
    return own.where(~F.col("status").isin("discarded", "failed")).groupBy("file_hash").agg(F.min("import_id").alias("import_id"))


@query("s18_audit_log", AUDIT_SQL + " SELECT * FROM audited WHERE entity_id IN (0, 2) AND table_name = 'click' AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'")
def s18(spark, sf_dir):
    return audit.log(audited(spark, sf_dir), [0, 2], "click", first="2024-01-05", last="2024-01-20")


@query("s18_audit_trail", AUDIT_SQL + ", t AS (SELECT actor, id, row_number() OVER (PARTITION BY actor ORDER BY created_at DESC, id DESC)::INTEGER AS place FROM audited) SELECT * FROM t WHERE place <= 50")
def s18_trail(spark, sf_dir):
    """The last fifty rows of each actor, as the feature is."""
    return audit.trail(audited(spark, sf_dir), ["actor"]).select("actor", "id", "place")


@query("p12_audit_days", AUDIT_SQL + " SELECT actor, count(*)::BIGINT AS n FROM audited WHERE entity_id IN (0, 1, 2, 3, 4) AND created_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def p12(spark, sf_dir):
    return audit.log(audited(spark, sf_dir), [0, 1, 2, 3, 4], first="2024-01-10").groupBy("actor").agg(F.count("*").alias("n"))


@query("p13_accrual_drilldown", MIRROR + " SELECT entity_id, period, category_id, cents FROM recognition WHERE category_id IN (4, 5, 6) AND entry_kind = 'cost' AND period = DATE '1997-05-01'")
def p13(spark, sf_dir):
    r = recognition(spark, sf_dir).where(F.col("category_id").isin(4, 5, 6) & (F.col("entry_kind") == "cost") & (F.col("period") == F.lit("1997-05-01").cast("date")))
    return r.select("entity_id", "period", "category_id", "cents")


@query("p17_report_columns", "SELECT 'entity-' || r_regionkey AS key, r_name AS label FROM region UNION ALL VALUES ('eliminations', 'Eliminações'), ('total', 'Consolidado')")
def p17(spark, sf_dir):
    return pl.columns(None, proxy.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("entity_id"), F.col("r_name").alias("name")))


@query("p21_line", MIRROR + ", src AS (SELECT * FROM recognition), report AS (" + _subtotals("period") + ") SELECT period, cents FROM report WHERE line = 'ebitda'")
def p21(spark, sf_dir):
    return pl.lines(recognition(spark, sf_dir), "period").where("line = 'ebitda'").select("period", "cents")


@query("j5_revenue_category", f"""WITH {SQL_CHART}, c AS (SELECT o_orderkey AS contract_id, (o_custkey % 5)::INTEGER AS entity_id, CASE o_orderkey % 3 WHEN 0 THEN '3.01' WHEN 1 THEN '3.02' ELSE '3.99' END AS code FROM orders),
own AS (SELECT r_regionkey AS entity_id, code, category_id * 10 + r_regionkey AS category_id FROM chart, region WHERE r_regionkey <> 3)
SELECT contract_id, own.category_id::BIGINT AS category_id, own.category_id IS NULL AS refused FROM c LEFT JOIN own USING (entity_id, code)""")
def j5(spark, sf_dir):
    """Each entity but one has a chart of its own; a third of the contracts names a code that none has."""
    k = F.col("o_orderkey") % 3
    own = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 5).cast("int").alias("entity_id"), F.when(k == 0, "3.01").when(k == 1, "3.02").otherwise("3.99").alias("revenue_code"))
    charts = proxy.chart(spark).withColumn("entity_id", F.explode(F.array(*map(F.lit, (0, 1, 2, 4))))).select("entity_id", "code", (F.col("category_id") * 10 + F.col("entity_id")).alias("category_id"))
    return revenue_category(own, charts).select("contract_id", "category_id", "refused")


@query("a14_reconciliation_totals", RECOGNISED + INVOICES + """, r AS (SELECT contract_id, 'a' AS w, cents FROM recognised UNION ALL SELECT contract_id, 'b', cents FROM invoices UNION ALL SELECT contract_id, 'c', cents FROM receipts)
SELECT contract_id, coalesce(sum(cents) FILTER (w = 'a'), 0)::BIGINT AS recognised, coalesce(sum(cents) FILTER (w = 'b'), 0)::BIGINT AS invoiced, coalesce(sum(cents) FILTER (w = 'c'), 0)::BIGINT AS received FROM r GROUP BY ALL""")
def a14(spark, sf_dir):
    return totals(c13(spark, sf_dir), ["contract_id"])


@query("a19_staged_counts", """SELECT user_id AS import_id, event_type AS status, count(*)::BIGINT AS n, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT))::BIGINT AS signed FROM events GROUP BY ALL""")
def a19(spark, sf_dir):
    """Rows of each import by status, and their signed sum."""
    signed = F.when(F.col("event_id") % 2 == 0, cents(F.col("value"))).otherwise(-cents(F.col("value")))
    return proxy.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("import_id"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.sum(signed).alias("signed"))


@query("a23_invoice_total", INVOICE_SQL + " SELECT entity_id, coalesce(sum(gross_cents) FILTER (status <> 'cancelled'), 0)::BIGINT AS gross, count(*)::BIGINT AS n FROM invoices GROUP BY 1")
def a23(spark, sf_dir):
    """Gross of all invoices but the cancelled ones, which the count has."""
    return invoices(spark, sf_dir).groupBy("entity_id").agg(F.coalesce(F.sum(F.when(F.col("status") != "cancelled", F.col("gross_cents"))), F.lit(0)).alias("gross"), F.count("*").alias("n"))


@query("a34_chart_by_group", SQL_LEDGER + """, used AS (SELECT category_id, count(*) AS n FROM entries GROUP BY 1)
SELECT coalesce(dre_group, '') AS dre_group, count(*)::BIGINT AS categories, coalesce(sum(n), 0)::BIGINT AS entries, string_agg(code, ',' ORDER BY sort_order, code) AS codes FROM chart LEFT JOIN used USING (category_id) GROUP BY 1""")
def a34(spark, sf_dir):
    """The chart by block, each with its codes in order and how often they are used."""
    used = proxy.entries(spark, sf_dir).groupBy("category_id").agg(F.count("*").alias("used"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "code"))), lambda x: x["code"]), ",")
    return proxy.chart(spark).join(used, "category_id", "left").groupBy(F.coalesce("dre_group", F.lit("")).alias("dre_group")).agg(F.count("*").alias("categories"), F.coalesce(F.sum("used"), F.lit(0)).alias("entries"), codes.alias("codes"))


@query("o1_category_order", MIRROR + """, src AS (SELECT * FROM recognition WHERE period = DATE '1997-05-01') SELECT c.dre_group, c.code, sum(cents)::BIGINT AS cents, row_number() OVER (PARTITION BY c.dre_group ORDER BY min(sort_order), c.code)::INTEGER AS place
FROM src JOIN chart c USING (category_id) GROUP BY c.dre_group, c.code""")
def o1(spark, sf_dir):
    """Lines of a block by the chart's order, then by code."""
    month = recognition(spark, sf_dir).where(F.col("period") == F.lit("1997-05-01").cast("date")).groupBy("category_id").agg(F.sum("cents").alias("cents"))
    own = month.join(F.broadcast(proxy.chart(spark)), "category_id").groupBy("dre_group", "code").agg(F.sum("cents").alias("cents"), F.min("sort_order").alias("sort_order"))
    return own.select("dre_group", "code", "cents", F.row_number().over(Window.partitionBy("dre_group").orderBy("sort_order", "code")).alias("place"))


@query("o3_by_amount", SQL_LEDGER + """, r AS (SELECT entity_id, client_id, sum(cents) AS received FROM entries WHERE direction = 'in' GROUP BY ALL)
SELECT entity_id, client_id, received::BIGINT AS received, row_number() OVER (PARTITION BY entity_id ORDER BY received DESC, client_id)::INTEGER AS place FROM r""")
def o3(spark, sf_dir):
    """Clients of an entity by what they paid; of equal sums the smaller id first."""
    r = proxy.entries(spark, sf_dir).where("direction = 'in'").groupBy("entity_id", "client_id").agg(F.sum("cents").alias("received"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("received"), "client_id")))


@query("o4_by_period", CONTRACTS + " SELECT contract_id, period, row_number() OVER (PARTITION BY contract_id ORDER BY period)::INTEGER AS place FROM months")
def o4(spark, sf_dir):
    """Months of a contract in their order."""
    from ..operators.recognition import axis

    own = axis(contracts(spark, sf_dir), F.col("end_date"))
    return own.select("contract_id", "period", F.row_number().over(Window.partitionBy("contract_id").orderBy("period")).alias("place"))


@query("o6_first_failures", """WITH m AS (SELECT user_id AS account_id, CAST(ts AS DATE) AS day, sum(CAST(round(value * 100) AS BIGINT)) AS moved FROM events GROUP BY ALL), r AS (SELECT *, sum(moved) OVER (PARTITION BY account_id ORDER BY day) + day(day) AS actual FROM m),
d AS (SELECT account_id, day, (actual - lag(actual) OVER w - moved)::BIGINT AS difference FROM r WINDOW w AS (PARTITION BY account_id ORDER BY day)), f AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY day)::INTEGER AS place FROM d WHERE difference <> 0)
SELECT account_id, day, difference, place FROM f WHERE place <= 5""")
def o6(spark, sf_dir):
    """The first five days of a statement that do not add up (as many as its notice shows); each balance is off by the day's number."""
    moved = proxy.table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("day"), cents(F.col("value")).alias("signed_cents"))
    daily = moved.groupBy("account_id", "day").agg(F.sum("signed_cents").alias("moved"))
    told = daily.select("account_id", "day", (F.sum("moved").over(Window.partitionBy("account_id").orderBy("day")) + F.dayofmonth("day")).alias("balance"))
    wrong = reconcile_statement(moved, told, None, ["account_id"]).where("difference <> 0")
    return wrong.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy("day"))).where("place <= 5").select("account_id", "day", "difference", "place")


@query("f36_described", """WITH e AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN 'amount' WHEN 1 THEN 'active' WHEN 2 THEN 'client_id' WHEN 3 THEN 'amount_min' ELSE 'note' END AS field,
  CASE event_id % 5 WHEN 0 THEN '60000.25' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 2 THEN '0a1b2c3d-0000-4000-8000-000000000000' WHEN 3 THEN NULL ELSE event_type END AS value FROM events)
SELECT event_id, field, CASE event_id % 5 WHEN 0 THEN '60.000,25' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'sim' ELSE 'não' END WHEN 2 THEN '0a1b2c3d…' WHEN 3 THEN '—' ELSE event_type END AS shown FROM e""")
def f36(spark, sf_dir):
    k = F.col("event_id") % 5
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).when(k == 3, v[3]).otherwise(v[4])
    e = proxy.table(spark, sf_dir, "events").select("event_id", pick("amount", "active", "client_id", "amount_min", "note").alias("field"), pick(
        F.lit("60000.25"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("0a1b2c3d-0000-4000-8000-000000000000"), F.lit(None).cast("string"), F.col("event_type")).alias("value"))
    return e.select("event_id", "field", audit.described(F.col("field"), F.col("value")).alias("shown"))


@query("c31_rule_checks", """WITH r AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'exact' ELSE 'amount_range' END AS match_type, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS pattern,
  CASE WHEN event_id % 8 = 0 THEN '10001' END AS tax, CASE WHEN event_id % 5 > 1 THEN (event_id % 7) * 100 END AS lo, CASE WHEN event_id % 5 > 2 THEN (event_id % 6) * 100 END AS hi FROM events)
SELECT id, 'no-condition' AS violation FROM r WHERE match_type <> 'amount_range' AND pattern = '' AND tax IS NULL UNION ALL SELECT id, 'range-needs-bound' FROM r WHERE match_type = 'amount_range' AND lo IS NULL AND hi IS NULL
UNION ALL SELECT id, 'range-order' FROM r WHERE lo > hi""")
def c31(spark, sf_dir):
    """Rules that say nothing, ranges without a bound, and those upside down."""
    i = F.col("event_id")
    r = proxy.table(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 3 == 0, "contains").when(i % 3 == 1, "exact").otherwise("amount_range").alias("match_type"), F.when(i % 4 == 0, "").otherwise(F.col("event_type")).alias("pattern"),
                                                    F.when(i % 8 == 0, "10001").alias("counterparty_tax_id"), F.when(i % 5 > 1, i % 7 * 100).alias("amount_min"), F.when(i % 5 > 2, i % 6 * 100).alias("amount_max"))
    return audit.violations(r, audit.rule_checks()).select("id", "violation")


@query("c28_ai_requests", """WITH s AS (SELECT id, account_id, description, row_number() OVER (PARTITION BY account_id ORDER BY id) AS k FROM (SELECT event_id AS id, user_id AS account_id, 'Pago ' || event_type || ' ' || user_id AS description FROM events) WHERE id % 3 <> 0 AND id % 4 = 1)
SELECT account_id AS import_id, ((k - 1) // 120)::INTEGER AS batch, string_agg(id || ': ' || description, chr(10) ORDER BY id) AS prompt FROM s GROUP BY ALL""")
def c28(spark, sf_dir):
    """What a model is asked: rows that are pending (each third is settled) and have no suggestion (one in four)."""
    from ..operators import replies

    s = subjects(spark, sf_dir).select(F.col("account_id").alias("import_id"), F.col("id").alias("ref"), "description", F.when(F.col("id") % 3 != 0, "pending").otherwise("approved").alias("status"), F.when(F.col("id") % 4 != 1, F.lit(5)).alias("suggested_category_id"))
    return replies.prompt_batches(replies.open_subjects(s))


@query("f39_contract_prompts", "SELECT doc_id AS id, sha256('CONTRATO' || chr(10) || chr(10) || CASE WHEN length(trim(text)) > 60000 THEN left(trim(text), 60000) || chr(10) || chr(10) || '[...documento truncado...]' ELSE trim(text) END) AS hash FROM documents WHERE text IS NOT NULL")
def f39_contract(spark, sf_dir):
    from ..operators import replies

    d = proxy.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return replies.contract_prompts(d).select("id", F.sha2("prompt", 256).alias("hash"))


#: Replies of each kind: whole fields, a bare value, a number, a blank, a type that is none, text around, a list, no JSON.
DRAFTS = [
    """'Here: ' || '{"clientName": {"value": "' || c_name || '", "snippet": "between"}, "type": {"value": "retainer", "snippet": "s"}, "scope": null}'""",
    """'{"clientName": "' || c_name || '", "totalValue": 12500, "monthlyValue": {"value": 99.5, "snippet": " per month "}, "type": "project"}'""",
    """'{"name": {"value": " ' || c_mktsegment || ' "}, "type": {"value": "other", "snippet": "x"}, "endDate": "  ", "scope": ["a"], "billingTerms": true}'""",
    """'[{"clientName": "' || c_name || '"}]'""", "'no contract of ' || c_name", """'{"title": {"value": "' || c_name || '"}, "paymentTerms": {"snippet": "alone"}, "startDate": {"value": "01/02/2024", "snippet": 7}}'"""]
DRAFTED = "WITH told AS (SELECT c_custkey AS id, CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {d}" for k, d in enumerate(DRAFTS)) + """ END AS reply FROM customer),
f AS (SELECT id, unnest(['clientName', 'name', 'type', 'totalValue', 'monthlyValue', 'startDate', 'endDate', 'billingTerms', 'paymentTerms', 'scope']) AS field, CASE WHEN id % 6 IN (1, 2, 5) THEN reply WHEN id % 6 = 0 THEN substr(reply, 7) END::JSON AS j FROM told),
v AS (SELECT id, field, CASE WHEN json_type(j->field) = 'OBJECT' THEN j->field->'value' ELSE j->field END AS v, CASE WHEN json_type(j->field) = 'OBJECT' THEN j->field->'snippet' END AS s FROM f),
t AS (SELECT id, field, CASE WHEN json_type(v) IN ('VARCHAR', 'UBIGINT', 'DOUBLE') THEN nullif(trim(v->>'$'), '') END AS value, CASE WHEN json_type(s) IN ('VARCHAR', 'UBIGINT', 'DOUBLE') THEN nullif(trim(s->>'$'), '') END AS snippet FROM v),
k AS (SELECT *, coalesce(field = 'type' AND value NOT IN ('retainer', 'project'), false) AS strange FROM t)"""


def _told(spark, sf_dir):
    c = proxy.table(spark, sf_dir, "customer")
    reply = F.expr("CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {d}" for k, d in enumerate(DRAFTS)) + " END")
    return c.select(F.col("c_custkey").alias("id"), reply.alias("reply"))


@query("f38_contract_draft", DRAFTED + """ SELECT id, field, CASE WHEN NOT strange THEN value END AS value, CASE WHEN NOT strange AND value IS NOT NULL THEN snippet END AS snippet, value IS NULL OR strange AS missing,
  CASE WHEN strange THEN 'unknown type' WHEN value IS NOT NULL AND snippet IS NULL THEN 'no snippet' END AS warning FROM k""")
def f38(spark, sf_dir):
    """Drafts from replies of each kind."""
    from ..operators import replies

    return replies.contract_draft(_told(spark, sf_dir))


@query("f38_draft_warnings", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 3 THEN 'no object' ELSE 'no json' END AS warning FROM customer WHERE c_custkey % 6 IN (3, 4)")
def f38_warnings(spark, sf_dir):
    from ..operators import replies

    return replies.draft_warnings(_told(spark, sf_dir))
