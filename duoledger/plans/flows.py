"""Queries of imports that enter the ledger, of the seven reports, and of files that are verified."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..functions.money import cents, format_money
from ..operators import approval, categorize, exports, maintenance, recurrence, verify
from ..sources import proxy, statements
from ..sources.proxy import SQL_CHART
from .accrual import MIRROR, PAY, _categories, _pay, _subtotals, recognition
from .cash import CLASSIFIED, END, START
from .cash import rows as cash_rows
from .contracts import CONTRACTS, RECOGNISED, contracts, dealt, recognised
from .imports import CHARGES, RECURRING, SUGGESTED, c15, charges
from .registry import query

STAGED = """WITH staged AS (SELECT event_id AS id, (user_id % 5)::INTEGER AS entity_id, user_id || event_type || CAST(ts AS DATE) AS hash, event_id % 3 <> 0 AS chosen, CASE WHEN event_id % 2 = 0 THEN event_id % 14 END AS given, event_id % 7 AS suggested FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY chosen, entity_id, hash ORDER BY id) AS k FROM staged)"""
KNOWN = "(entity_id, hash) IN (SELECT entity_id, hash FROM staged WHERE id % 17 = 0)"


def staged(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("int").alias("entity_id"), F.concat(F.col("user_id").cast("string"), "event_type", F.col("ts").cast("date").cast("string")).alias("dedup_hash"),
                    F.lit("pending").alias("status"), (F.col("event_id") % 7).alias("suggested_category_id"))


@query("k4_admitted", STAGED.replace("PARTITION BY chosen, ", "PARTITION BY ") + f" SELECT id, k = 1 AND NOT {KNOWN} AS admitted FROM k")
def k4(spark, sf_dir):
    """Entries written to a ledger that has the hashes of each seventeenth."""
    own = staged(spark, sf_dir)
    return approval.admitted(own, own.where("id % 17 = 0"), ["id"]).select("id", "admitted")


@query("k13_approve", STAGED + f" SELECT id, CASE WHEN NOT chosen THEN 'pending' WHEN k = 1 AND NOT {KNOWN} THEN 'approved' ELSE 'duplicate' END AS status, CASE WHEN chosen THEN coalesce(given, suggested) END::BIGINT AS category_id FROM k")
def k13(spark, sf_dir):
    """Two thirds of the rows are chosen, half of them with a category of their own."""
    own = staged(spark, sf_dir)
    chosen = own.where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 14).alias("category_id"))
    return approval.approve(own, chosen, own.where("id % 17 = 0"), ["id"]).select("id", "status", "category_id")


MIRRORED = f"""WITH {SQL_CHART}, e AS (SELECT o_orderkey AS entry_id, o_custkey % 14 AS category_id, CASE WHEN o_orderkey % 5 = 0 THEN 'in' ELSE 'out' END AS direction, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders), plan AS (SELECT entry_id, period, category_id, CASE direction WHEN 'out' THEN cents ELSE -cents END AS cents FROM e JOIN chart USING (category_id) WHERE kind IN ('cost', 'expense', 'tax') AND cents <> 0),
old AS (SELECT entry_id, period, category_id, CASE direction WHEN 'out' THEN cents ELSE -cents END + CASE WHEN entry_id % 7 = 0 THEN 1 ELSE 0 END AS cents, entry_id % 11 = 0 AS edited FROM e WHERE entry_id % 3 <> 0),
acts AS (SELECT coalesce(p.entry_id, o.entry_id) AS entry_id, CASE WHEN edited THEN 'edited' WHEN p.entry_id IS NULL THEN 'delete' WHEN o.entry_id IS NULL THEN 'insert' WHEN p.cents = o.cents THEN 'same' ELSE 'update' END AS action,
  p.period, p.category_id::BIGINT AS category_id, p.cents::BIGINT AS cents FROM plan p FULL JOIN old o ON p.entry_id = o.entry_id)"""


def _saved(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("entry_id"), (F.col("o_custkey") % 14).alias("category_id"), F.when(F.col("o_orderkey") % 5 == 0, "in").otherwise("out").alias("direction"), cents(F.col("o_totalprice")).alias("cents"),
                 F.col("o_orderdate").cast("date").alias("occurred_on"), F.lit(None).cast("date").alias("competence_period"), F.lit(0).alias("entity_id"))
    signed = F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents"))
    old = e.where("entry_id % 3 <> 0").select("entry_id", period_of(F.col("occurred_on")).alias("period"), "category_id", (signed + F.when(F.col("entry_id") % 7 == 0, 1).otherwise(0)).alias("cents"), (F.col("entry_id") % 11 == 0).alias("manually_edited"))
    return e, old


@query("k7_mirror_actions", MIRRORED + " SELECT * FROM acts")
def k7(spark, sf_dir):
    e, old = _saved(spark, sf_dir)
    return approval.mirror_actions(e, proxy.chart(spark), old)


@query("k5_updated_entries", MIRRORED + " SELECT action, count(*)::BIGINT AS n, sum(cents)::BIGINT AS cents FROM acts WHERE entry_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1) GROUP BY 1")
def k5(spark, sf_dir):
    """Each fourth entry is saved anew; rows of the others are not looked at."""
    e, old = _saved(spark, sf_dir)
    return approval.mirror_actions(e.where("entry_id % 4 = 1"), proxy.chart(spark), old).groupBy("action").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("s5_recognition_of_entry", MIRRORED + " SELECT entry_id, period, cents FROM old WHERE entry_id IN (7, 77, 770)")
def s5(spark, sf_dir):
    return _saved(spark, sf_dir)[1].where(F.col("entry_id").isin(7, 77, 770)).select("entry_id", "period", "cents")


@query("k18_touched", """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 4 = 0 THEN TIMESTAMP '2026-01-02 03:04:05' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS updated_at FROM customer""")
def k18(spark, sf_dir):
    """Each sixth row is new, each fourth changed."""
    c = proxy.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("2025-01-01").cast("timestamp").alias("updated_at"))
    after = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return maintenance.touch(c.where("c_custkey % 6 <> 0"), after, ["c_custkey"], "2026-01-02 03:04:05").select("c_custkey", "updated_at")


@query("k19_seeded", "SELECT s_suppkey AS account_id, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN 5 ELSE CAST(round(s_acctbal * 100) AS BIGINT) END::BIGINT AS opening_cents FROM supplier")
def k19(spark, sf_dir):
    """Two thirds of the accounts are there, half of them with an opening of their own."""
    wanted = proxy.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"), cents(F.col("s_acctbal")).alias("opening_cents"))
    there = wanted.where("account_id % 3 <> 0").withColumn("opening_cents", F.when(F.col("account_id") % 2 == 0, F.lit(5)).otherwise(0).cast("long"))
    return maintenance.seeded(there, wanted, ["account_id"])


@query("p16_preselected", f"""WITH s AS ({SUGGESTED}), a AS (SELECT subject_id, category_id, CASE WHEN subject_id % 3 = 0 THEN 'ai' ELSE source END AS source, CASE WHEN subject_id % 6 = 0 THEN 0.75 ELSE confidence END AS confidence FROM s)
SELECT subject_id, category_id IS NOT NULL AND (source <> 'ai' OR confidence >= 0.8) AS chosen FROM a""")
def p16(spark, sf_dir):
    """Suggestions of which each third came from a model, half of them unsure."""
    i = F.col("subject_id")
    s = c15(spark, sf_dir).withColumns({"source": F.when(i % 3 == 0, "ai").otherwise(F.col("source")), "confidence": F.when(i % 6 == 0, 0.75).otherwise(F.col("confidence"))})
    return s.select("subject_id", categorize.starts_chosen(F.col("category_id"), F.col("source"), F.col("confidence")).alias("chosen"))


@query("p18_mismatches", """SELECT s_suppkey AS import_id, s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 AS not_card, s_suppkey % 3 = 0 AND s_suppkey % 7 = 0 AND s_suppkey % 10 <> 0 AS other_digits, s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0 AS other_number FROM supplier""")
def p18(spark, sf_dir):
    """Bills and statements, some of which name another account than the one that was chosen."""
    a = proxy.accounts(spark, sf_dir)
    k = F.col("account_id")
    text = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(4)), "0")  # noqa: E731  lpad cuts what is longer
    own = a.withColumns({"number": F.concat(text(k), F.lit("-1")), "last_digits": F.when(k % 10 != 0, text(k))})
    told = own.select(k.alias("import_id"), "account_id", F.when(k % 3 == 0, "card_invoice").otherwise("statement").alias("kind"), F.when(k % 7 == 0, text(k + 1)).otherwise(text(k)).alias("said_digits"),
                      F.when(k % 5 == 0, F.concat(text(k), F.lit("-2"))).otherwise(F.concat(text(k), F.lit("1"))).alias("said_number"))
    return approval.mismatches(told, own).select("import_id", "not_card", "other_digits", "other_number")


@query("c29_cash_flow", CLASSIFIED + f""", months AS (SELECT CAST(month AS DATE) AS period FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 MONTH) g(month)),
cells AS (SELECT section, unnest([coalesce(code, 'none'), 'total']) AS line, period, CASE WHEN section = 'transfer' THEN signed_cents ELSE cents END AS cents FROM own WHERE period BETWEEN DATE '{START}' AND DATE '{END}'),
shells AS (SELECT section, line, months.period FROM (SELECT DISTINCT section, line FROM cells), months), grid AS (SELECT s.section, s.line, s.period, coalesce(sum(cents), 0) AS cents FROM shells s LEFT JOIN cells c ON s.section = c.section AND s.line = c.line AND s.period = c.period GROUP BY ALL),
first AS (SELECT (SELECT coalesce(sum(opening_cents), 0) FROM accounts WHERE type <> 'credit_card') + (SELECT coalesce(sum(signed_cents), 0) FROM own WHERE occurred_on < DATE '{START}') AS first),
nets AS (SELECT m.period, coalesce(sum(signed_cents), 0) AS net FROM months m LEFT JOIN own ON own.period = m.period GROUP BY 1), run AS (SELECT period, net, first + sum(net) OVER (ORDER BY period) AS closing FROM nets, first),
shown AS (SELECT CASE section WHEN 'in' THEN 'Entradas' WHEN 'out' THEN 'Saídas' ELSE 'Transferências' END AS section, line, period, cents FROM (SELECT * FROM grid UNION ALL SELECT section, line, NULL, sum(cents) FROM grid GROUP BY ALL))
SELECT section, CASE line WHEN 'total' THEN 'Total de ' || lower(section) WHEN 'none' THEN 'Sem categoria' ELSE line || ' ' || name END AS line, period, cents::BIGINT AS cents FROM shown LEFT JOIN chart ON code = line
UNION ALL SELECT '', 'Saldo inicial', period, (closing - net)::BIGINT FROM run UNION ALL SELECT '', 'Movimento líquido', period, net::BIGINT FROM run UNION ALL SELECT '', 'Saldo final', period, closing::BIGINT FROM run
UNION ALL SELECT '', 'Saldo inicial', NULL, first::BIGINT FROM first UNION ALL SELECT '', 'Saldo final', NULL, arg_max(closing, period)::BIGINT FROM run""")
def c29_cash(spark, sf_dir):
    return exports.cash_flow(cash_rows(spark, sf_dir), proxy.accounts(spark, sf_dir), proxy.chart(spark), START, END)


LABELS = "CASE line " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in exports.LINES.items()) + " END"


@query("c29_pl", MIRROR + f""", src AS (SELECT * FROM recognition), blocks AS ({_subtotals('period')}), cats AS ({_categories('period')}), ords AS (SELECT DISTINCT line, ord FROM blocks),
every AS (SELECT ord, {LABELS} AS line, '' AS sub, period, cents FROM blocks UNION ALL SELECT o.ord, '  ' || c.code || ' · ' || name, c.code, period, cents FROM cats c JOIN ords o ON o.line = c.line JOIN chart USING (code))
SELECT ord, line, sub, period, cents::BIGINT AS cents FROM every UNION ALL SELECT ord, line, sub, NULL, sum(cents)::BIGINT FROM every GROUP BY ALL""")
def c29_pl(spark, sf_dir):
    return exports.profit_and_loss(recognition(spark, sf_dir), proxy.chart(spark))


MONTH = "['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month({0})] || '/' || strftime({0}, '%y')"
WHO = MIRROR + """, who AS (SELECT entity_id, category_id, code, dre_group, CAST(date_trunc('month', occurred_on) AS DATE) AS period, client_id, cents FROM entries JOIN chart USING (category_id) WHERE direction = 'in')"""


def _recognised(spark, sf_dir):
    """The recognition ledger with client, source and whether a row was edited."""
    e, chart = proxy.entries(spark, sf_dir), proxy.chart(spark)
    earned = e.where("direction = 'in'").select("category_id", "client_id", period_of(F.col("occurred_on")).alias("period"), "cents", F.lit("revenue").alias("entry_kind"), F.lit("engine").alias("source"), (F.col("client_id") % 9 == 0).alias("manually_edited"))
    from ..operators.mirror import mirror

    cost = mirror(e, chart).select("category_id", F.lit(None).cast("long").alias("client_id"), "period", "cents", "entry_kind", F.lit("cash_mirror").alias("source"), F.lit(False).alias("manually_edited"))
    return earned.unionByName(cost)


def _clients(spark, sf_dir):
    """One client in seven has been removed."""
    return proxy.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name"))


CLIENTS = ", clients AS (SELECT c_custkey AS client_id, c_name AS client FROM customer WHERE c_custkey % 7 <> 0)"


@query("c29_recognition", WHO + CLIENTS + f""", r AS (SELECT category_id, client_id, period, cents, 'revenue' AS kind, 'engine' AS source, client_id % 9 = 0 AS edited FROM who UNION ALL SELECT category_id, NULL, period, cents, 'cost', 'cash_mirror', false FROM mirrored)
SELECT {MONTH.format('period')} AS month, c.code, c.name AS category, CASE r.kind WHEN 'revenue' THEN 'receita' ELSE 'custo' END AS kind, coalesce(client, '') AS client, source, CASE WHEN edited THEN 'sim' ELSE 'não' END AS edited, CASE r.kind WHEN 'revenue' THEN cents ELSE -cents END AS cents
FROM r JOIN chart c USING (category_id) LEFT JOIN clients USING (client_id)""")
def c29_recognition(spark, sf_dir):
    return exports.recognition_list(_recognised(spark, sf_dir), proxy.chart(spark), _clients(spark, sf_dir))


@query("c29_entries", MIRROR + CLIENTS + f""" SELECT strftime(occurred_on, '%d/%m/%Y') AS day, {MONTH.format("coalesce(competence_period, occurred_on)")} AS month, coalesce(s_name, '') AS account, coalesce(code, '') AS code,
  CASE WHEN category_id IS NULL THEN 'Sem categoria' ELSE c.name END AS category, coalesce(client, '') AS client, CASE direction WHEN 'in' THEN cents ELSE -cents END AS cents
FROM entries LEFT JOIN chart c USING (category_id) LEFT JOIN clients USING (client_id) LEFT JOIN supplier ON s_suppkey = account_id""")
def c29_entries(spark, sf_dir):
    names = proxy.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("name"))
    return exports.entry_list(proxy.entries(spark, sf_dir), names, proxy.chart(spark), _clients(spark, sf_dir))


@query("c29_revenue", WHO + CLIENTS + """ SELECT client_id, CASE WHEN client_id IS NULL THEN 'Sem cliente' ELSE coalesce(client, 'Cliente removido') END AS client, period, sum(cents)::BIGINT AS cents FROM
  (SELECT CASE WHEN client_id % 13 <> 0 THEN client_id END AS client_id, period, cents FROM who) LEFT JOIN clients USING (client_id) WHERE period BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' GROUP BY ALL""")
def c29_revenue(spark, sf_dir):
    """Each thirteenth client is unknown."""
    r = _recognised(spark, sf_dir).withColumn("client_id", F.when(F.col("client_id") % 13 != 0, F.col("client_id")))
    return exports.revenue(r, _clients(spark, sf_dir), START, END)


@query("c29_backlog", RECOGNISED + CLIENTS + """, done AS (SELECT contract_id, sum(cents) AS recognised FROM recognised GROUP BY 1)
SELECT c.contract_id, coalesce(client, '') AS client, total_cents AS contracted, coalesce(recognised, 0)::BIGINT AS recognised, nullif(greatest(total_cents - coalesce(recognised, 0), 0), 0)::BIGINT AS to_recognise, nullif(greatest(coalesce(recognised, 0) - total_cents, 0), 0)::BIGINT AS to_invoice
FROM contracts c LEFT JOIN done d ON c.contract_id = d.contract_id LEFT JOIN clients USING (client_id) WHERE status <> 'draft'""")
def c29_backlog(spark, sf_dir):
    from ..operators.recognition import deferred

    own = dealt(spark, sf_dir, contracts(spark, sf_dir))
    return exports.backlog(deferred(own, recognised(spark, sf_dir)), own, _clients(spark, sf_dir))


@query("c29_payroll", PAY + """ SELECT person_id, coalesce(s_name, 'Pessoa removida') AS person, CASE WHEN s_name IS NULL THEN '' ELSE 'role ' || s_nationkey END AS role, CAST(date_trunc('month', occurred_on) AS DATE) AS period, sum(cents)::BIGINT AS cents
FROM pay LEFT JOIN supplier ON s_suppkey = person_id AND s_suppkey % 6 <> 0 WHERE person_id IS NOT NULL AND occurred_on BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ALL""")
def c29_payroll(spark, sf_dir):
    """People are suppliers here; each sixth has been removed."""
    people = proxy.table(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.concat(F.lit("role "), F.col("s_nationkey").cast("string")).alias("role"))
    paid = _pay(spark, sf_dir).withColumns({"entry_kind": F.lit("cost"), "period": period_of(F.col("occurred_on"))})
    return exports.payroll(paid, people, START, END)


@query("c29_subscriptions", f"SELECT supplier::VARCHAR AS supplier, cadence, charges, strftime(last_on, '%d/%m/%Y') AS last, CASE WHEN active THEN 'sim' ELSE 'não' END AS active, monthly_cost AS monthly, 12 * monthly_cost AS yearly FROM ({RECURRING})")
def c29_subscriptions(spark, sf_dir):
    return exports.subscriptions(recurrence.detect(charges(spark, sf_dir), "supplier", "2001-09-01"), "supplier")


BILLS = """WITH heads AS (SELECT o_custkey AS path, (o_custkey % 50)::VARCHAR AS digits, o_custkey // 100 AS due, CASE WHEN o_custkey % 7 <> 3 THEN sum(CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 1 END) + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END END AS printed,
  count(*) AS n FROM orders GROUP BY o_custkey), bills AS (SELECT *, coalesce(printed IS NOT NULL AND path % 5 <> 0, false) AS ok, row_number() OVER (PARTITION BY digits, due ORDER BY path) > 1 AS duplicate FROM heads)"""


def _bills(spark, sf_dir):
    """Bills of a customer each, cents off on each fifth, without a printed total on some, many of one account and day."""
    o = proxy.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), cents(F.col("o_totalprice")).alias("cents"), F.when(F.col("o_orderkey") % 10 == 0, "in").otherwise("out").alias("direction"))
    printed = F.sum(F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents"))) + F.when(F.col("path") % 5 == 0, 1).otherwise(0)
    heads = o.groupBy("path").agg(F.when(F.col("path") % 7 != 3, printed).alias("printed")).select("path", (F.col("path") % 50).cast("string").alias("account_digits"), F.date_add(F.lit("2026-01-01").cast("date"), F.expr("cast(path div 100 as int)")).alias("due_on"), "printed")
    return heads, o


@query("x7_same_bills", BILLS + " SELECT path, duplicate FROM bills")
def x7(spark, sf_dir):
    return verify.bills(*_bills(spark, sf_dir)).select("path", "duplicate")


@query("c32_verified_bills", BILLS + " SELECT count(*)::BIGINT AS checked, count(*) FILTER (ok)::BIGINT AS \"right\", count(*) FILTER (NOT ok)::BIGINT AS wrong, count(*) FILTER (duplicate)::BIGINT AS duplicates FROM bills")
def c32(spark, sf_dir):
    return verify.summary(verify.bills(*_bills(spark, sf_dir)))


@query("c32_trusted_charges", BILLS + " SELECT path, count(*)::BIGINT AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders JOIN bills ON path = o_custkey WHERE o_orderkey % 10 <> 0 AND ok AND NOT duplicate GROUP BY 1")
def c32_trusted(spark, sf_dir):
    """What subscriptions may be found in: outflows of bills that are right, each bill once."""
    heads, o = _bills(spark, sf_dir)
    return verify.trusted(o, verify.bills(heads, o)).groupBy("path").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


CELLS = """WITH lines AS (SELECT user_id % 20 AS path, event_id AS row, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS signed, event_id % 9 AS k, event_type FROM events)"""


def _cells(spark, sf_dir):
    """Statements of cells: headers, movements, balances, rows without date, amounts of zero, sweeps."""
    e = proxy.table(spark, sf_dir, "events").withColumns({"path": F.col("user_id") % 20, "k": F.col("event_id") % 9})
    amount = format_money(F.when(F.col("event_id") % 2 == 0, cents(F.col("value"))).otherwise(-cents(F.col("value"))))
    cell = lambda col, text: F.struct(F.lit(col).alias("col"), text.alias("text"))
    k = F.col("k")
    body = e.select("path", F.col("event_id").alias("row"), F.inline(F.array(
        cell(0, F.when(k == 1, "total").otherwise(F.date_format("ts", "dd/MM/yyyy"))), cell(1, F.when(k == 2, "APLICACAO RES APLIC AUT MAIS").otherwise(F.col("event_type"))),
        cell(2, F.when(k == 3, "0,00").when(k != 4, amount)), cell(3, F.when(k == 4, amount)))))
    heads = e.select("path").distinct().select("path", F.lit(-1).cast("long").alias("row"), F.inline(F.array(cell(0, F.lit("Data")), cell(1, F.lit("Lançamento")), cell(2, F.lit("Valor (R$)")), cell(3, F.lit("Saldo (R$)")))))
    return body.unionByName(heads).where("text is not null")


@query("c20_parse_statement", CELLS + """ SELECT path, row, CASE WHEN k <> 1 THEN day END AS occurred_on, (CASE WHEN k = 3 THEN 0 WHEN k <> 4 THEN abs(signed) END)::BIGINT AS cents, CASE WHEN k = 4 THEN signed END::BIGINT AS balance_cents,
  CASE k WHEN 1 THEN 'discarded' WHEN 2 THEN 'discarded' WHEN 3 THEN 'discarded' WHEN 4 THEN 'balance' ELSE CASE WHEN signed = 0 THEN 'discarded' ELSE 'movement' END END AS kind,
  CASE WHEN k = 1 THEN 'no date' WHEN k = 3 OR (k <> 4 AND signed = 0) THEN 'zero' WHEN k = 2 THEN 'sweep' END AS reason FROM lines""")
def c20(spark, sf_dir):
    return statements.parse_statement(_cells(spark, sf_dir)).select("path", "row", "occurred_on", "cents", "balance_cents", "kind", "reason")


@query("c22_card_bill", """SELECT o_custkey AS path, o_orderkey AS at, CASE WHEN k = 1 THEN 'total' WHEN k = 2 THEN 'charge' WHEN k IN (3, 4) THEN 'discarded' ELSE 'charge' END AS kind, CASE WHEN k = 2 THEN 'Repasse de IOF' WHEN k IN (0, 5, 6, 7) THEN 'LOJA ' || o_orderkey END AS shown,
  CASE WHEN k = 3 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, CASE WHEN k IN (0, 5, 6, 7) THEN 'SAO PAULO' END AS detail,
  CASE WHEN k = 2 THEN DATE '1999-06-30' WHEN k <> 1 THEN make_date(CASE WHEN (month(o_orderdate), day(o_orderdate)) <= (6, 30) THEN 1999 ELSE 1998 END, month(o_orderdate), least(day(o_orderdate), 28)) END AS occurred_on
FROM (SELECT *, o_orderkey % 8 AS k FROM orders)""")
def c22(spark, sf_dir):
    """Bills of a customer each: every order is a heading, a dated line with an amount that bleeds in from beside it, and a line below; some are the total, foreign tax, lines without amount, or charges to come."""
    o = proxy.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 8).alias("k"), format_money(cents(F.col("o_totalprice"))).alias("amount"),
                                                    F.make_date(F.lit(2000), F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28))).alias("day"))
    k = F.col("k")
    item = lambda line, x, text: F.struct(F.lit(line).alias("sub"), F.lit(float(x)).alias("x"), text.alias("text"))
    t = F.lit
    opener = F.when(k == 4, "Compras parceladas - próximas faturas").otherwise("Lançamentos: compras e saques")
    parts = (F.when(k == 1, F.array(item(0, 10, t("Total dos lançamentos atuais")), item(0, 300, F.col("amount"))))
             .when(k == 2, F.array(item(0, 10, t("Repasse de IOF em R$")), item(0, 300, F.col("amount"))))
             .otherwise(F.array(item(0, 10, opener), item(1, 10, t("DATA")), item(1, 60, t("ESTABELECIMENTO")), item(1, 300, t("VALOR EM R$")), item(2, 10, F.date_format("day", "dd/MM")), item(2, 60, F.concat(t("LOJA "), F.col("at").cast("string"))),
                                item(2, 310, F.when(k != 3, F.col("amount"))), item(2, 480, t("7.220,00")), item(3, 60, t("SAO PAULO")))))
    rows = o.select("path", "at", F.inline(parts)).where("text is not null")
    lines = rows.groupBy("path", "at", "sub").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("_items"))
    items = lines.select("path", "at", "sub", F.array_join("_items.text", " ").alias("line"), F.inline("_items")).select("path", F.lit(1).alias("page"), (F.col("at") * 4 + F.col("sub")).alias("line_at"), "line", F.lit(0).alias("column_at"), "x", (F.lit(700.0) - 12 * (F.col("at") * 4 + F.col("sub"))).alias("y"), "text")
    got = statements.parse_invoice(items, "1999-06-30")
    shown = F.when(F.col("kind") == "charge", F.col("description"))
    return got.select("path", F.expr("line_at div 4").alias("at"), "kind", shown.alias("shown"), "cents", "detail", "occurred_on")
