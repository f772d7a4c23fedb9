"""Queries of what stands on paper: bills against their printed totals, laid-out pages, statements verified, contract texts, report files; and days by the local clock."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.money import cents
from ..operators import mirror, verify
from ..sources import proxy, sinks, statements
from ..sources.files import contract_text
from ..sources.proxy import SQL_LEDGER
from ..sources.store import parts_for, shared_folder
from .registry import query

BILLS = """WITH charges AS (SELECT user_id AS path, event_id, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_type = 'error' THEN 'in' ELSE 'out' END AS direction, CASE event_type WHEN 'signup' THEN 'payments' WHEN 'view' THEN NULL ELSE 'charges' END AS section FROM events),
summed AS (SELECT path, coalesce(sum(CASE direction WHEN 'out' THEN cents ELSE -cents END) FILTER (section IS DISTINCT FROM 'payments'), 0) AS total FROM charges GROUP BY 1)"""


def _charges(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "payments").when(F.col("event_type") != "view", "charges")
    return e.select(F.col("user_id").alias("path"), cents(F.col("value")).alias("cents"), F.when(F.col("event_type") == "error", "in").otherwise("out").alias("direction"), kind.alias("section"))


@query("c23_reconciled_cards", BILLS + """ SELECT c_custkey AS path, coalesce(total, 0)::BIGINT AS total, (coalesce(total, 0) + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS printed, c_custkey % 3 <> 0 AS exact FROM customer LEFT JOIN summed ON path = c_custkey""")
def c23(spark, sf_dir):
    """A bill for each customer, those without charges printed as zero; each third is a cent off and refused."""
    own = _charges(spark, sf_dir)
    total = own.where("section is null or section <> 'payments'").groupBy("path").agg(F.sum(F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents"))).alias("t"))
    printed = proxy.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")).join(total, "path", "left").select("path", (F.coalesce("t", F.lit(0)) + F.when(F.col("path") % 3 == 0, 1).otherwise(0)).alias("printed"))
    return statements.reconcile_card(own, printed)


@query("a29_bill_totals", BILLS + " SELECT path, coalesce(section, 'none') AS section, direction, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM charges GROUP BY ALL")
def a29(spark, sf_dir):
    """What the sections of each bill add up to."""
    return _charges(spark, sf_dir).groupBy("path", F.coalesce("section", F.lit("none")).alias("section"), "direction").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


PAGES = """WITH k AS (SELECT user_id AS path, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
placed AS (SELECT path, (k // 40 + 1)::INTEGER AS page, k % 40 AS k, k % 40 % 2 AS c, k % 40 // 2 AS row, event_type || ' ' || event_id AS text FROM k),
whole AS (SELECT *, count(*) OVER (PARTITION BY path, page) AS n FROM placed),
lines AS (SELECT path, page, c, row, (row + CASE WHEN c = 1 THEN (n + 1) // 2 ELSE 0 END)::INTEGER AS line_at, text FROM whole WHERE n >= 6)"""


@query("c24_layout", PAGES + """ SELECT path::VARCHAR AS path, page, line_at, c::INTEGER AS column_at, text || ' R$ ' || row AS line FROM lines""")
def c24(spark, sf_dir):
    """Pages of two columns, twenty lines each, of two items a line whose heights differ by two points."""
    e = proxy.table(spark, sf_dir, "events")
    parts = parts_for(e, 200_000)
    rows = e.select(F.col("user_id").cast("string").alias("path"), "event_id", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text")).repartition(parts, "path")
    k = (F.row_number().over(Window.partitionBy("path").orderBy("event_id")) - 1).alias("k")
    rows = rows.select("path", k, "text").select("path", F.expr("cast(k div 40 + 1 as int)").alias("page"), (F.col("k") % 40 % 2).alias("c"), F.expr("k % 40 div 2").alias("row"), "text").repartition(parts, "path", "page")  # a path of many pages is many tasks
    x, y = F.col("c") * 300.0 + 40.0, 700.0 - 12.0 * F.col("row")
    item = lambda x, y, t: F.struct(x.alias("x"), y.alias("y"), F.lit(50.0).alias("width"), t.alias("text"))
    items = rows.select("path", "page", F.inline(F.array(item(x, y, F.col("text")), item(x + 100.0, y - 2.0, F.concat(F.lit("R$ "), F.col("row").cast("string"))))))
    full = statements.listed(items).where(F.size("text") >= 12)
    return statements.page_lines(full).select("path", "page", "line_at", "column_at", "line")


@query("w12_lines_of_pages", PAGES + " SELECT path::VARCHAR AS path, page, count(*)::BIGINT AS lines, count(DISTINCT c)::BIGINT AS columns FROM lines GROUP BY ALL")
def w12(spark, sf_dir):
    return c24(spark, sf_dir).groupBy("path", "page").agg(F.count("*").alias("lines"), F.countDistinct("column_at").alias("columns"))


@query("c32_verified_statements", """WITH rows AS (SELECT user_id AS path, event_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS cents FROM events),
daily AS (SELECT path, day, sum(cents) AS moved, count(*) AS n FROM rows GROUP BY ALL), run AS (SELECT *, sum(moved) OVER (PARTITION BY path ORDER BY day) AS run FROM daily),
told AS (SELECT path, day, run + CASE WHEN path % 5 = 0 AND day(day) % 10 = 0 THEN 1 ELSE 0 END AS balance, run FROM run WHERE day(day) % 2 = 0),
gaps AS (SELECT path, balance - run - lag(balance - run) OVER (PARTITION BY path ORDER BY day) AS off FROM told)
SELECT path, 'statement' AS kind, sum(n)::BIGINT AS n, path NOT IN (SELECT path FROM gaps WHERE off <> 0) AS ok FROM daily GROUP BY 1""")
def c32_statements(spark, sf_dir):
    """A statement for each user, with a balance on even days; those of each fifth are a cent off now and then."""
    e = proxy.table(spark, sf_dir, "events")
    signed = F.when(F.col("event_type") == "purchase", -cents(F.col("value"))).otherwise(cents(F.col("value")))
    moved = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("row"), F.lit("movement").alias("kind"), F.col("ts").cast("date").alias("occurred_on"), F.abs(signed).alias("cents"), F.when(signed >= 0, "in").otherwise("out").alias("direction"), F.lit(None).cast("long").alias("balance_cents"))
    daily = moved.groupBy("path", "occurred_on").agg(F.sum(F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents"))).alias("moved"))
    run = F.sum("moved").over(Window.partitionBy("path").orderBy("occurred_on"))
    day = F.dayofmonth("occurred_on")
    told = daily.withColumn("run", run).where(day % 2 == 0).select("path", F.lit(0).cast("long").alias("row"), F.lit("balance").alias("kind"), "occurred_on", F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("direction"),
                                                                 (F.col("run") + F.when((F.col("path") % 5 == 0) & (day % 10 == 0), 1).otherwise(0)).alias("balance_cents"))
    return verify.statements(moved.unionByName(told))


@query("p8_overrides", SQL_LEDGER + """ SELECT coalesce(competence_period <> CAST(date_trunc('month', occurred_on) AS DATE), false) AS overridden, coalesce(competence_period, CAST(date_trunc('month', occurred_on) AS DATE)) AS period, count(*)::BIGINT AS n FROM entries GROUP BY ALL""")
def p8(spark, sf_dir):
    """Entries by the month that they count in, and whether somebody chose it."""
    e = proxy.entries(spark, sf_dir)
    pair = F.col("competence_period"), F.col("occurred_on")
    return e.groupBy(mirror.has_override(*pair).alias("overridden"), mirror.competence(*pair).alias("period")).agg(F.count("*").alias("n"))


@query("f20_local_day", "SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day, date_diff('day', CAST(ts - INTERVAL 3 HOUR AS DATE), DATE '2024-02-15')::INTEGER AS age FROM events")
def f20(spark, sf_dir):
    """The local day of each event (three hours behind), and its age on a report's day."""
    day = calendar.local_day(F.col("ts"))
    return proxy.table(spark, sf_dir, "events").select("event_id", day.alias("day"), F.datediff(calendar.today("2024-02-15"), day).alias("age"))


@query("s26_contract_texts", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS path, sha256(array_to_string(l, chr(10))) AS hash, length(array_to_string(l, chr(10))) >= 200 AS enough FROM l WHERE len(l) > 0""")
def s26(spark, sf_dir):
    """Documents as contracts, by the lines that hold something."""
    d = proxy.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    lines = d.select("path", "line", F.trim("raw").alias("text")).where("text <> ''")
    return contract_text(lines).select("path", F.sha2("text", 256).alias("hash"), "enough")


@query("k2_report_file", """WITH rows AS (SELECT o_orderkey, 'note; "' || o_orderpriority || '"' AS note, CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '' END || translate(format('{:,.2f}', CAST(round(o_totalprice * 100) AS BIGINT) / 100.0), ',.', '.,') AS cents FROM orders)
SELECT o_orderkey || ';"' || replace(note, '"', '""') || '";' || cents AS line FROM rows""")
def k2(spark, sf_dir):
    """Lines of the files that a report is written to, but for their headers."""
    c = cents(F.col("o_totalprice"))
    report = proxy.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('note; "'), "o_orderpriority", F.lit('"')).alias("note"), F.when(F.col("o_orderkey") % 2 == 1, -c).otherwise(c).alias("cents"))
    path = f"{shared_folder(spark)}/duoledger/report-{uuid.uuid4().hex}"
    sinks.export_csv(report, path, ["cents"])
    return spark.read.text(path).where(~F.col("value").endswith("o_orderkey;note;cents")).select(F.col("value").alias("line"))
