"""Queries of scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, money, text
from ..functions.text import ACCENTED, PLAIN
from ..sources import proxy
from .registry import query

NORM = f"trim(regexp_replace(upper(replace(translate(text, '{ACCENTED}', '{PLAIN}'), 'ß', 'ss')), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query("f1_mul_ratio", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey, l_tax, l_discount, CAST(l_shipdate AS DATE) AS day,
  (CASE WHEN l_partkey % 2 = 1 THEN -1 ELSE 1 END * ((2 * CAST(round(l_extendedprice * 100) AS BIGINT)::HUGEINT * CAST(l_quantity AS BIGINT) + 365) // 730))::BIGINT AS share FROM lineitem""")
def f1(spark, sf_dir):
    amount = money.cents(F.col("l_extendedprice"))
    share = money.mul_ratio(F.when(F.col("l_partkey") % 2 == 1, -amount).otherwise(amount), F.col("l_quantity").cast("long"), F.lit(365))
    return proxy.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey", "l_tax", "l_discount", F.col("l_shipdate").cast("date").alias("day"), share.alias("share"))


@query("f5_parse_money", """SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 4 IN (1, 2) THEN -1 ELSE 1 END AS cents FROM orders""")
def f5(spark, sf_dir):
    """Amounts written in four ways, and read back."""
    shown = money.format_money(money.cents(F.col("o_totalprice")))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.concat(F.lit("R$ "), shown)).when(k == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 2, F.concat(shown, F.lit(" D"))).otherwise(F.concat(F.lit("+"), F.translate(shown, ".,", ",.")))
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", money.parse_money(written).alias("cents"))


@query("f6_format_money", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '' END || translate(format('{:,.2f}', CAST(round(o_totalprice * 100) AS BIGINT) / 100.0), ',.', '.,') AS shown FROM orders""")
def f6(spark, sf_dir):
    c = money.cents(F.col("o_totalprice"))
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", money.format_money(F.when(F.col("o_orderkey") % 2 == 1, -c).otherwise(c)).alias("shown"))


@query("f18_covered_days", """SELECT o_orderkey, greatest(0, date_diff('day', greatest(CAST(o_orderdate AS DATE), DATE '1998-02-01'), least(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER), DATE '1998-02-28')) + 1)::INTEGER AS days,
  day(last_day(o_orderdate))::INTEGER AS month_days, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders""")
def f18(spark, sf_dir):
    start = F.col("o_orderdate").cast("date")
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", calendar.covered_days(F.lit("1998-02-01").cast("date"), start, F.date_add(start, (F.col("o_orderkey") % 400).cast("int"))).alias("days"),
                                                       calendar.days_in_month(start).alias("month_days"), calendar.period_of(start).alias("period"))


@query("f13_month_label", """SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)] || '/' || strftime(o_orderdate, '%y') AS label FROM orders""")
def f13(spark, sf_dir):
    p = calendar.period_of(F.col("o_orderdate").cast("date"))
    return proxy.table(spark, sf_dir, "orders").select(p.alias("period"), calendar.month_label(p).alias("label")).distinct()


@query("f23_normalize", f"SELECT doc_id, sha256({NORM}) AS hash FROM documents")
def f23(spark, sf_dir):
    return proxy.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("hash"))


TAX = "WITH t AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 12345) % 1000000000 AS VARCHAR), 9, '0') AS nine FROM customer), "
DIGIT = lambda s, n: "(11 - (" + " + ".join(f"CAST(substr({s}, {i + 1}, 1) AS INTEGER) * {n + 1 - i}" for i in range(n)) + ") % 11)"


@query("f25_tax_id", TAX + f"""a AS (SELECT *, CASE WHEN {DIGIT('nine', 9)} >= 10 THEN 0 ELSE {DIGIT('nine', 9)} END AS d1 FROM t), b AS (SELECT *, nine || d1 AS ten FROM a),
c AS (SELECT *, CASE WHEN {DIGIT('ten', 10)} >= 10 THEN 0 ELSE {DIGIT('ten', 10)} END AS d2 FROM b)
SELECT c_custkey, (d1 = c_custkey % 10 AND d2 = c_custkey // 10 % 10) AND NOT regexp_matches(nine || (c_custkey % 10) || (c_custkey // 10 % 10), '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid FROM c""")
def f25(spark, sf_dir):
    """Eleven digits made from the key; few have the right check digits."""
    nine = F.lpad(((F.col("c_custkey") * 7919 + 12345) % 1_000_000_000).cast("string"), 9, "0")
    written = F.concat(nine, (F.col("c_custkey") % 10).cast("string"), (F.floor(F.col("c_custkey") / 10) % 10).cast("string"))
    shown = F.regexp_replace(written, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
    return proxy.table(spark, sf_dir, "customer").select("c_custkey", text.valid_tax_id(shown).alias("valid"))


@query("f26_supplier_key", """WITH d AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name || ' *' || p_partkey || ' ' || p_type), '[0-9*#]+', ' ', 'g'), ' +', ' ', 'g')) AS bare FROM part)
SELECT p_partkey, CASE WHEN len(w) > 0 THEN array_to_string(w[1:2], ' ') ELSE bare END AS key FROM (SELECT *, [x FOR x IN string_split(bare, ' ') IF length(x) >= 2] AS w FROM d)""")
def f26(spark, sf_dir):
    description = F.concat("p_name", F.lit(" *"), F.col("p_partkey").cast("string"), F.lit(" "), "p_type")
    return proxy.table(spark, sf_dir, "part").select("p_partkey", text.supplier_key(description).alias("key"))


@query("f28_instalment", """SELECT o_orderkey, CASE WHEN m BETWEEN 2 AND 36 AND n BETWEEN 1 AND m THEN n END AS current, CASE WHEN m BETWEEN 2 AND 36 AND n BETWEEN 1 AND m THEN m END AS total
FROM (SELECT o_orderkey, (o_orderkey % 15)::INTEGER AS n, (o_orderkey % 41)::INTEGER AS m FROM orders)""")
def f28(spark, sf_dir):
    description = F.concat(F.lit("LOJA "), (F.col("o_orderkey") % 15).cast("string"), F.lit(" / "), (F.col("o_orderkey") % 41).cast("string"), F.lit(" x"))
    found = text.instalment(description)
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", found["current"].alias("current"), found["total"].alias("total"))


@query("f22_excel_serial", "SELECT o_orderkey, CAST(DATE '1899-12-30' + CAST(40000 + o_orderkey % 9000 AS INTEGER) AS DATE) AS day FROM orders")
def f22(spark, sf_dir):
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", calendar.excel_serial(40000 + F.col("o_orderkey") % 9000).alias("day"))


@query("f7_numeric", "SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS DECIMAL(14,2))::VARCHAR AS amount, CAST(round(o_totalprice * 100) AS BIGINT) AS back FROM orders")
def f7(spark, sf_dir):
    """Cents to a stored amount and back."""
    amount = money.to_numeric(money.cents(F.col("o_totalprice")))
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", amount.cast("string").alias("amount"), money.cents(amount).alias("back"))


@query("f9_percent", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE (o_orderkey % 100) * 1000 + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 123 ELSE 50 END END::BIGINT AS thousandths FROM orders""")
def f9(spark, sf_dir):
    """Percents written with a comma, a point, further digits, and not at all."""
    n, k = (F.col("o_orderkey") % 100).cast("string"), F.col("o_orderkey") % 4
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(",1239 %"))).when(k == 2, F.concat(n, F.lit(".05%"))).otherwise(F.concat(n, F.lit(" per cent")))
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", money.parse_percent(text).alias("thousandths"))


DAYS = """WITH d AS (SELECT o_orderkey, (1990 + o_orderkey % 30)::INTEGER AS y, (1 + o_orderkey % 13)::INTEGER AS m, (1 + o_orderkey % 31)::INTEGER AS d FROM orders), r AS (SELECT *, try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day FROM d)"""


def _days(spark, sf_dir):
    k = F.col("o_orderkey")
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", (1990 + k % 30).cast("int").alias("y"), (1 + k % 13).cast("int").alias("m"), (1 + k % 31).cast("int").alias("d"))


@query("f10_iso_day", DAYS + " SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN day END AS day FROM r")
def f10(spark, sf_dir):
    """Days of which many don't exist; each seventh is written with a slash."""
    t = F.format_string("%04d-%02d-%02d", "y", "m", "d")
    t = F.when(F.col("o_orderkey") % 7 == 0, F.translate(t, "-", "/")).otherwise(t)
    return _days(spark, sf_dir).select("o_orderkey", calendar.parse_iso(t).alias("day"))


@query("f11_br_day", DAYS + " SELECT o_orderkey, day, strftime(day, '%d/%m/%Y') AS shown FROM r")
def f11(spark, sf_dir):
    """The same days as written here, some without leading zeros: one that doesn't exist is none, and never the next month's."""
    t = F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%02d/%02d/%04d", "d", "m", "y")).otherwise(F.format_string(" %d/%d/%04d ", "d", "m", "y"))
    return _days(spark, sf_dir).select("o_orderkey", calendar.parse_br(t).alias("day")).select("o_orderkey", "day", calendar.format_br(F.col("day")).alias("shown"))


@query("f15_add_months", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 25 - 12 AS INTEGER)) AS DATE) AS day, ((year(DATE '2000-05-31') * 12 + 5) - (year(o_orderdate) * 12 + month(o_orderdate)))::INTEGER AS months FROM orders")
def f15(spark, sf_dir):
    """Months later or earlier, cut at the month's last day; whole calendar months to a day."""
    d = F.col("o_orderdate").cast("date")
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", calendar.add_months(d, (F.col("o_orderkey") % 25 - 12).cast("int")).alias("day"), calendar.months_between(d, F.lit("2000-05-31").cast("date")).alias("months"))


@query("f21_card_day", DAYS + ", t AS (SELECT *, try_cast(printf('1998-%02d-%02d', m, d) AS DATE) AS this, try_cast(printf('1997-%02d-%02d', m, d) AS DATE) AS before FROM d) SELECT o_orderkey, CASE WHEN this <= DATE '1998-02-20' THEN this ELSE before END AS day FROM t")
def f21(spark, sf_dir):
    """Days of a bill that closed on 20 February: those after it are of the year before."""
    return _days(spark, sf_dir).select("o_orderkey", calendar.card_date(F.format_string("%02d/%02d", "d", "m"), F.lit("1998-02-20").cast("date")).alias("day"))


@query("f24_header", f"SELECT p_partkey, trim(regexp_replace(lower(translate('Nº. ' || p_name || ' / ' || p_type || ' (R$)', '{ACCENTED}', '{PLAIN}')), '[^a-z0-9]+', ' ', 'g')) AS header FROM part")
def f24(spark, sf_dir):
    return proxy.table(spark, sf_dir, "part").select("p_partkey", text.normalize_header(F.concat(F.lit("Nº. "), "p_name", F.lit(" / "), "p_type", F.lit(" (R$)"))).alias("header"))


@query("f27_proposed_pattern", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'PIX ' || upper(o_orderpriority) ELSE 'PIX ' || upper(o_orderpriority) || ' 12' END AS pattern FROM orders""")
def f27(spark, sf_dir):
    """Descriptions with dates, long numbers and trailing dashes; a third with a known counterparty."""
    k = F.col("o_orderkey") % 3
    d = F.concat(F.lit("Pix  "), "o_orderpriority", F.when(k == 1, F.lit(" 12/03/2024 000123456 --*")).otherwise(F.lit(" 12 05/11 ")))
    return proxy.table(spark, sf_dir, "orders").select("o_orderkey", text.propose_pattern(d, F.when(k == 0, "12.345")).alias("pattern"))


@query("f29_sweep", "SELECT event_id, event_id % 4 IN (0, 1) AS sweep FROM events")
def f29(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 0, "RES APLIC AUT MAIS").when(k == 1, "Apl. Aplic. Aut. Mais").when(k == 2, "REND PAGO APLIC AUT MAIS").otherwise(F.col("event_type"))
    return proxy.table(spark, sf_dir, "events").select("event_id", text.automatic_sweep(t).alias("sweep"))


HEADS = ["Data", "Lançamento", "Valor (R$)", "Saldo (R$)", "Razão Social", "CPF/CNPJ", "Débito (R$)", "Agência"]
ROLES = ["'date'", "'description'", "'amount'", "'balance'", "'counterparty'", "'tax_id'", "'debit'", "NULL"]


@query("f30_header_roles", "SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {r}" for k, r in enumerate(ROLES)) + " END AS role FROM events")
def f30(spark, sf_dir):
    """A heading for each event, some in capitals, some with spaces around."""
    from ..sources.statements import role_of

    e = proxy.table(spark, sf_dir, "events")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("event_id") % 8 + 1).cast("int"))
    shown = F.when(F.col("user_id") % 3 == 0, F.upper(head)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("  "), head, F.lit(" "))).otherwise(head)
    return e.select("event_id", role_of(shown).alias("role"))


@query("f32_slug", f"SELECT p_partkey, trim(regexp_replace(lower(translate('Relatório: ' || p_name || '!', '{ACCENTED}', '{PLAIN}')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def f32(spark, sf_dir):
    return proxy.table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat(F.lit("Relatório: "), "p_name", F.lit("!"))).alias("slug"))


@query("p15_month_param", DAYS + " SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN try_cast(printf('%04d-%02d-01', y, m) AS DATE) END, DATE '2024-01-01') AS period FROM r")
def p15(spark, sf_dir):
    """Months of a request: the thirteenth, and what is no month, take the year's first."""
    t = F.when(F.col("o_orderkey") % 5 == 0, F.format_string("%04d/%02d", "y", "m")).otherwise(F.format_string("%04d-%02d", "y", "m"))
    return _days(spark, sf_dir).select("o_orderkey", calendar.period_param(t, F.lit("2024-01-01").cast("date")).alias("period"))


@query("p20_form_fields", """SELECT event_id, event_id % 4 <> 0 AS named, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(date_trunc('month', ts) AS DATE) END AS month, event_id % 3 <> 2 OR day(ts) = 1 AS month_ok,
  CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 <> 1 THEN CAST(round(value * 100) AS BIGINT) END AS cents, event_type IN ('view', 'click') AS chosen, CASE WHEN event_id % 6 = 0 THEN 9 ELSE event_id END::BIGINT AS n, event_id % 2 = 0 AS ticked FROM events""".replace(
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(date_trunc('month', ts) AS DATE) END", "CASE WHEN event_id % 3 = 1 OR (event_id % 3 = 2 AND day(ts) = 1) THEN CAST(date_trunc('month', ts) AS DATE) END"))
def p20(spark, sf_dir):
    """Fields as people fill them in, some empty, some wrong."""
    from ..functions import forms

    i, e = F.col("event_id"), proxy.table(spark, sf_dir, "events")
    month = forms.optional_month(F.when(i % 3 == 0, " ").when(i % 3 == 1, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    amount = forms.money(F.when(i % 5 == 0, "").when(i % 5 == 1, "a lot").otherwise(money.format_money(money.cents(F.col("value")))), optional=True)
    return e.select("event_id", forms.required_text(F.when(i % 4 == 0, "  ").otherwise(F.col("event_type")))["ok"].alias("named"), month["value"].alias("month"), month["ok"].alias("month_ok"), amount["value"].alias("cents"),
                    forms.choice(F.col("event_type"), ["view", "click"])["ok"].alias("chosen"), forms.integer(F.when(i % 6 == 0, "none").otherwise(F.concat(i.cast("string"), F.lit(" rows"))), 9).alias("n"), forms.ticked(F.when(i % 2 == 0, "on").otherwise("off")).alias("ticked"))
