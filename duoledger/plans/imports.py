"""Queries of imports: hashes, duplicates, statements, categorisation, subscriptions, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import audit, categorize, recurrence, staging
from ..sources import proxy
from .registry import query

LINES = """WITH lines AS (
  SELECT event_id, user_id AS account_id, CAST(ts AS DATE) AS occurred_on, CAST(round(value) AS BIGINT) * 100 AS cents, CASE WHEN event_type = 'purchase' THEN 'out' ELSE 'in' END AS direction, event_type AS description FROM events),
based AS (SELECT *, account_id || '|' || occurred_on || '|' || CAST(CAST(cents / 100.0 AS DECIMAL(14,2)) AS VARCHAR) || '|' || direction || '|' || upper(description) AS base FROM lines),
counted AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) - 1 AS occurrence FROM based),
hashed AS (SELECT *, sha256(base || CASE WHEN occurrence > 0 THEN '|#' || occurrence ELSE '' END) AS dedup_hash FROM counted)"""


def lines(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("occurred_on"), (F.round("value").cast("long") * 100).alias("cents"),
                    F.when(F.col("event_type") == "purchase", "out").otherwise("in").alias("direction"), F.col("event_type").alias("description"), F.lit(None).cast("string").alias("counterparty"))


@query("w5_occurrence", LINES + " SELECT event_id, occurrence::INTEGER AS occurrence FROM hashed")
def w5(spark, sf_dir):
    return staging.with_occurrence(lines(spark, sf_dir), ["event_id"]).select("event_id", "occurrence")


@query("c18_dedup_hash", LINES + " SELECT event_id, dedup_hash FROM hashed")
def c18(spark, sf_dir):
    return staging.with_occurrence(lines(spark, sf_dir), ["event_id"]).select("event_id", "dedup_hash")


@query("j11_dup_flag", LINES + " SELECT event_id, dedup_hash IN (SELECT dedup_hash FROM hashed WHERE account_id % 3 = 0) AS duplicate FROM hashed")
def j11(spark, sf_dir):
    """All lines staged against a ledger that has those of each third account."""
    own = lines(spark, sf_dir)
    ledger = staging.with_occurrence(own.where("account_id % 3 = 0"), ["event_id"])
    return staging.stage(own, ledger, ["event_id"]).select("event_id", "duplicate")


@query("w4_gap_days", "SELECT event_id, date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), CAST(ts AS DATE))::INTEGER AS gap FROM events")
def w4(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    day = F.col("ts").cast("date")
    return proxy.table(spark, sf_dir, "events").select("event_id", F.datediff(day, F.lag(day).over(order)).alias("gap"))


@query("w8_statement_reconcile", """WITH m AS (SELECT user_id AS account_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT)) AS moved FROM events GROUP BY ALL),
r AS (SELECT *, sum(moved) OVER (PARTITION BY account_id ORDER BY day) AS run FROM m),
d AS (SELECT account_id, day, run, CASE WHEN (account_id + day(day)) % 3 = 0 THEN run + CASE WHEN (account_id + day(day)) % 6 = 0 THEN 5 ELSE 0 END END AS actual FROM r),
a AS (SELECT *, last_value(CASE WHEN actual IS NOT NULL THEN actual - run END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM d)
SELECT account_id, day, (gap + run)::BIGINT AS expected, actual::BIGINT AS actual, (actual - gap - run)::BIGINT AS difference FROM a WHERE actual IS NOT NULL AND gap IS NOT NULL""")
def w8(spark, sf_dir):
    """Statements that declare a balance on each third day, some of them five cents off."""
    from pyspark.sql import Window

    e = proxy.table(spark, sf_dir, "events")
    moved = e.select(F.col("user_id").alias("account_id"), F.col("ts").cast("date").alias("day"), F.when(F.col("event_type") == "purchase", -cents(F.col("value"))).otherwise(cents(F.col("value"))).alias("signed_cents"))
    daily = moved.groupBy("account_id", "day").agg(F.sum("signed_cents").alias("moved"))
    run = F.sum("moved").over(Window.partitionBy("account_id").orderBy("day"))
    n = F.col("account_id") + F.dayofmonth("day")
    declared = daily.withColumn("run", run).where(n % 3 == 0).select("account_id", "day", (F.col("run") + F.when(n % 6 == 0, 5).otherwise(0)).alias("balance"))
    return staging.reconcile_statement(moved, declared, None, ["account_id"])


SUBJECTS = """WITH subjects AS (SELECT event_id AS id, 'Pago ' || event_type || ' ' || user_id AS description, CAST(round(value * 100) AS BIGINT) AS cents, user_id AS account_id,
  CASE WHEN event_id % 4 = 0 THEN CAST(10000 + user_id % 7 AS VARCHAR) END AS tax FROM events),
rules(rule_id, priority, match_type, pattern, tax, lo, hi, account_id, category_id) AS (VALUES
  ('r1', 10, 'contains', 'purchase', NULL, NULL, NULL, NULL, 5), ('r2', 5, 'amount_range', '', NULL, 5000, 8000, NULL, 6), ('r3', 20, 'contains', '*', '10003', NULL, NULL, NULL, 7),
  ('r4', 5, 'regex', 'view\\s+1\\d$', NULL, NULL, NULL, NULL, 8), ('r5', 1, 'exact', 'PAGO ERROR 7', NULL, NULL, NULL, NULL, 3), ('r6', 1, 'contains', 'click', NULL, NULL, NULL, 12, 9),
  ('r9', 4, 'contains', 'view', NULL, 1000, 2000, NULL, 10), ('r10', 0, 'amount_range', 'x', NULL, NULL, NULL, NULL, 1), ('r11', 30, 'exact', '*', '10.004', NULL, 9000, NULL, 2), ('r12', 0, 'contains', '', '--', NULL, NULL, NULL, 1), ('r13', 31, 'regex', ' ', '10005', NULL, NULL, NULL, 3), ('r14', 2, 'contains', 'click', '10006', NULL, NULL, NULL, 4)),
m AS (SELECT s.id AS subject_id, r.rule_id, r.category_id, r.tax IS NOT NULL AS by_tax_id, priority FROM subjects s JOIN rules r ON (r.account_id IS NULL OR r.account_id = s.account_id)
  AND (r.tax IS NULL OR (regexp_replace(r.tax, '\\D', '', 'g') <> '' AND regexp_replace(r.tax, '\\D', '', 'g') = s.tax)) AND (lo IS NULL OR abs(cents) >= lo) AND (hi IS NULL OR abs(cents) <= hi)
  AND CASE WHEN r.tax IS NOT NULL AND trim(r.pattern) IN ('', '*') THEN true WHEN match_type = 'contains' THEN r.pattern <> '' AND contains(upper(description), upper(r.pattern)) WHEN match_type = 'exact' THEN upper(description) = r.pattern
    WHEN match_type = 'regex' THEN regexp_matches(description, r.pattern, 'i') ELSE lo IS NOT NULL OR hi IS NOT NULL END),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY by_tax_id DESC, priority, rule_id) = 1)"""
RULES = [("r1", 10, "contains", "purchase", None, None, None, None, 5, True), ("r2", 5, "amount_range", "", None, 5000, 8000, None, 6, True), ("r3", 20, "contains", "*", "10003", None, None, None, 7, True),
         ("r4", 5, "regex", r"view\s+1\d$", None, None, None, None, 8, True), ("r5", 1, "exact", "PAGO ERROR 7", None, None, None, None, 3, True), ("r6", 1, "contains", "click", None, None, None, 12, 9, True),
         ("r7", 0, "regex", "([", None, None, None, None, 1, True), ("r8", 0, "contains", "Pago", None, None, None, None, 1, False),
         ("r9", 4, "contains", "view", None, 1000, 2000, None, 10, True), ("r10", 0, "amount_range", "x", None, None, None, None, 1, True), ("r11", 30, "exact", "*", "10.004", None, 9000, None, 2, True),
         ("r12", 0, "contains", "", "--", None, None, None, 1, True), ("r13", 31, "regex", " ", "10005", None, None, None, 3, True), ("r14", 2, "contains", "click", "10006", None, None, None, 4, True),
         ("r15", 0, "regex", "(?P<x>a)", None, None, None, None, 1, True)]


def subjects(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("Pago "), "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("description"), cents(F.col("value")).alias("cents"),
                    F.col("user_id").alias("account_id"), F.when(F.col("event_id") % 4 == 0, (10000 + F.col("user_id") % 7).cast("string")).alias("counterparty_tax_id"))


def rules(spark):
    return spark.createDataFrame(RULES, "id string, priority int, match_type string, pattern string, counterparty_tax_id string, amount_min long, amount_max long, account_id long, category_id long, active boolean")


def history(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events").where("event_id % 10 = 3")
    return e.select(F.concat(F.lit("Pago "), "event_type", F.lit(" "), F.col("user_id").cast("string")).alias("description"), F.when(F.col("event_id") % 20 == 3, (10000 + F.col("user_id") % 7).cast("string")).alias("counterparty_tax_id"),
                    (F.col("event_id") % 13).alias("category_id"), F.col("ts").cast("date").alias("occurred_on"))


HISTORY = """, history AS (SELECT 'PAGO ' || upper(event_type) || ' ' || user_id AS text, CASE WHEN event_id % 20 = 3 THEN CAST(10000 + user_id % 7 AS VARCHAR) END AS tax, event_id % 13 AS category_id, CAST(ts AS DATE) AS occurred_on FROM events WHERE event_id % 10 = 3),
by_tax AS (SELECT tax, max_by(category_id, (occurred_on, category_id)) AS category_id FROM history WHERE tax IS NOT NULL GROUP BY 1), by_text AS (SELECT text, max_by(category_id, (occurred_on, category_id)) AS category_id FROM history GROUP BY 1)"""


@query("w9_rule_first_match", SUBJECTS + " SELECT subject_id, rule_id, category_id::BIGINT AS category_id, by_tax_id FROM f")
def w9(spark, sf_dir):
    return categorize.first_rule(subjects(spark, sf_dir), rules(spark))


@query("j8_rule_matches", SUBJECTS + " SELECT rule_id, count(*)::BIGINT AS n FROM m GROUP BY 1")
def j8(spark, sf_dir):
    return categorize.matches(subjects(spark, sf_dir), rules(spark)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("a12_latest_history", SUBJECTS + HISTORY + " SELECT text, category_id FROM by_text")
def a12(spark, sf_dir):
    from ..functions.text import normalize

    return categorize.latest(history(spark, sf_dir).withColumn("text", normalize(F.col("description"))), "text")


SUGGESTED = SUBJECTS + HISTORY + """, people(person_id, parts) AS (VALUES ('p1', ['SIGN', '11']), ('p2', ['PAGO', 'SIGNUP']), ('p3', ['AGO', 'IGNU', 'NOBODY']), ('p4', ['PAG', 'GNUP', 'SIG'])),
named AS (SELECT person_id, [x FOR x IN parts IF length(x) >= 3] AS parts FROM people),
scored AS (SELECT id AS subject_id, person_id, len([x FOR x IN parts IF contains(upper(description), x)]) AS n, len(parts) AS of FROM subjects, named WHERE len(parts) >= 2),
p AS (SELECT subject_id, person_id FROM scored WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY n + n / of DESC, person_id) = 1),
j AS (SELECT s.id AS subject_id, f.rule_id, f.by_tax_id, f.category_id AS rc, t.category_id AS tc, x.category_id AS xc, p.person_id AS pp FROM subjects s LEFT JOIN f ON f.subject_id = s.id LEFT JOIN by_tax t ON t.tax = s.tax LEFT JOIN by_text x ON x.text = upper(s.description) LEFT JOIN p ON p.subject_id = s.id),
k AS (SELECT *, CASE WHEN rule_id IS NOT NULL THEN CASE WHEN by_tax_id THEN 'rule_tax_id' ELSE 'rule_text' END WHEN tc IS NOT NULL THEN 'history_tax_id' WHEN xc IS NOT NULL THEN 'history_description' WHEN pp IS NOT NULL THEN 'person' ELSE 'none' END AS source FROM j)
SELECT subject_id, (CASE WHEN source LIKE 'rule%' THEN rc WHEN source = 'history_tax_id' THEN tc WHEN source = 'history_description' THEN xc WHEN source = 'person' THEN 4 END)::BIGINT AS category_id, CASE WHEN source = 'person' THEN pp END AS person_id, source,
  (CASE source WHEN 'rule_tax_id' THEN 1.0 WHEN 'rule_text' THEN 0.95 WHEN 'history_tax_id' THEN 0.9 WHEN 'history_description' THEN 0.85 WHEN 'person' THEN 0.7 ELSE 0.0 END)::DOUBLE AS confidence, rule_id FROM k"""


@query("c15_suggest", SUGGESTED)
def c15(spark, sf_dir):
    people = spark.createDataFrame([("p1", "Sign 11"), ("p2", "Pago Signup"), ("p3", "ago ignu Nobody"), ("p4", "Pag gnup Sig")], "id string, name string")
    return categorize.suggest(subjects(spark, sf_dir), rules(spark), history(spark, sf_dir), people, 4)


@query("c16_sure_categories", f"SELECT subject_id AS id, category_id, source, confidence FROM ({SUGGESTED}) WHERE subject_id % 2 = 1 AND category_id IS NOT NULL AND confidence >= 0.8")
def c16(spark, sf_dir):
    """Each second subject has a category already."""
    own = subjects(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.lit(8)).alias("category_id"))
    return categorize.sure(own, c15(spark, sf_dir))


@query("c33_import_decisions", f"""SELECT subject_id % 5 AS import_id, count(*)::BIGINT AS pending, (count(*) - count(category_id))::BIGINT AS undecided, count(category_id)::BIGINT AS chosen
FROM ({SUGGESTED}) WHERE subject_id % 3 <> 0 GROUP BY 1""")
def c33(spark, sf_dir):
    """Subjects as rows of five imports, each third one settled already."""
    staged = subjects(spark, sf_dir).select("id", (F.col("id") % 5).alias("import_id"), F.when(F.col("id") % 3 != 0, "pending").otherwise("approved").alias("status"))
    return categorize.import_decisions(staged, c15(spark, sf_dir))


@query("a20_suggestions_by_source", f"SELECT source, count(*)::BIGINT AS n FROM ({SUGGESTED}) GROUP BY 1")
def a20(spark, sf_dir):
    return c15(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


CHARGES = """WITH charges AS (SELECT l_suppkey % 40 * 1000 + l_partkey % 997 AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST(l_suppkey % 20 AS INTEGER) AS occurred_on, 300000 + (l_partkey % 997) * 10 + l_linenumber % 2 * 100 AS cents FROM lineitem)"""
RECURRING = CHARGES + """, o AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY cents) AS k, count(*) OVER (PARTITION BY supplier) AS n FROM charges),
t AS (SELECT supplier, min(cents) FILTER (k = (n + 1) // 2) AS typical FROM o GROUP BY 1 HAVING max(n) >= 3),
near AS (SELECT c.*, typical, date_diff('day', lag(occurred_on) OVER (PARTITION BY c.supplier ORDER BY occurred_on, cents), occurred_on) AS gap FROM charges c JOIN t ON c.supplier = t.supplier WHERE abs(cents - typical) <= (2 * typical * 25 + 100) // 200),
g AS (SELECT supplier, count(*) AS charges, max(typical) AS typical, min(occurred_on) AS first_on, max(occurred_on) AS last_on, floor(quantile_cont(gap, 0.5) + 0.5)::INTEGER AS gap_days, list(gap) FILTER (gap IS NOT NULL) AS gaps FROM near GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT *, CASE WHEN abs(gap_days - 30) <= 8 THEN 'monthly' WHEN abs(gap_days - 365) <= 20 THEN 'annual' END AS cadence FROM g WHERE len([x FOR x IN gaps IF abs(x - gap_days) <= 5]) * 2 >= len(gaps))
SELECT supplier, charges::BIGINT AS charges, typical::BIGINT AS typical, gap_days, cadence, first_on, last_on, date_diff('day', last_on, DATE '2001-09-01') <= 2 * gap_days + 5 AS active,
  (CASE WHEN cadence = 'annual' THEN (2 * typical + 12) // 24 ELSE typical END)::BIGINT AS monthly_cost FROM h WHERE cadence IS NOT NULL"""


def charges(spark, sf_dir):
    l = proxy.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_suppkey") % 40 * 1000 + F.col("l_partkey") % 997).alias("supplier"), F.date_add(F.trunc(F.col("l_shipdate").cast("date"), "MM"), (F.col("l_suppkey") % 20).cast("int")).alias("occurred_on"),
                    (300000 + (F.col("l_partkey") % 997) * 10 + F.col("l_linenumber") % 2 * 100).alias("cents"))


@query("c17_recurring", RECURRING)
def c17(spark, sf_dir):
    return recurrence.detect(charges(spark, sf_dir), "supplier", "2001-09-01")


@query("a16_lower_median", CHARGES + " SELECT supplier, quantile_disc(cents, 0.5)::BIGINT AS typical FROM charges GROUP BY 1")
def a16(spark, sf_dir):
    return recurrence.lower_median(charges(spark, sf_dir), "supplier", "cents").select("supplier", "typical")


@query("a17_subscription_total", f"SELECT count(*)::BIGINT AS subscriptions, coalesce(sum(monthly_cost), 0)::BIGINT AS monthly_total, (12 * coalesce(sum(monthly_cost), 0))::BIGINT AS yearly_total FROM ({RECURRING}) WHERE active")
def a17(spark, sf_dir):
    return recurrence.total(recurrence.detect(charges(spark, sf_dir), "supplier", "2001-09-01"))


@query("a25_parse_bounds", LINES + " SELECT account_id, min(occurred_on) AS first_on, max(occurred_on) AS last_on, count(*)::BIGINT AS n, sum(CASE WHEN direction = 'in' THEN cents ELSE -cents END)::BIGINT AS net FROM lines GROUP BY 1")
def a25(spark, sf_dir):
    """What a file spans, and its signed sum."""
    return lines(spark, sf_dir).groupBy("account_id").agg(F.min("occurred_on").alias("first_on"), F.max("occurred_on").alias("last_on"), F.count("*").alias("n"), F.sum(F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents"))).alias("net"))


@query("a27_actors", "SELECT DISTINCT user_id AS actor FROM events WHERE user_id IS NOT NULL")
def a27(spark, sf_dir):
    return proxy.table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("actor")).distinct()


CHANGES = """WITH b AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0)"""


def _snapshots(spark, sf_dir):
    c = proxy.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    after = c.where("c_custkey % 13 <> 0").withColumns({"c_name": F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))})
    return c.where("c_custkey % 11 <> 0"), after


@query("k17_audit_diff", CHANGES + """ SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN a.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS action FROM b FULL JOIN a ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name <> b.c_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def k17(spark, sf_dir):
    return audit.snapshot_diff(*_snapshots(spark, sf_dir), ["c_custkey"]).select("c_custkey", "action")


@query("f35_changed_fields", CHANGES + """ SELECT a.c_custkey, 'c_name' AS field, b.c_name AS "from", a.c_name AS "to" FROM a JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_name <> b.c_name
UNION ALL SELECT a.c_custkey, 'c_mktsegment', b.c_mktsegment, a.c_mktsegment FROM a JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def f35(spark, sf_dir):
    return audit.field_changes(audit.snapshot_diff(*_snapshots(spark, sf_dir), ["c_custkey"]).where("action = 'update'"), ["c_custkey"])
