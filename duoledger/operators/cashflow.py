"""Cash ledger: sections, monthly flow with a running balance, balances of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_axis, period_of

#: Where money sits. A card is a debt: no cash moves until its bill is paid.
CASH_TYPES = ["bank", "cash", "investment"]


def signed(direction: Column, c: Column) -> Column:
    return F.when(direction == "in", c).otherwise(-c)


def section(kind: Column, direction: Column) -> Column:
    """A transfer is one whatever its direction; kind may be null."""
    return F.when(F.coalesce(kind, F.lit("")) == "transfer", "transfer").otherwise(direction)


def cash_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.col("type").isin(CASH_TYPES))


def classified(entries: DataFrame, accounts: DataFrame, chart: DataFrame) -> DataFrame:
    """Entries of cash accounts with section, code, period and signed cents; those without a category stay."""
    own = entries.join(cash_accounts(accounts).select("account_id"), "account_id", "left_semi")
    own = own.join(F.broadcast(chart.select("category_id", "code", "kind")), "category_id", "left")
    return own.withColumns({"section": section(F.col("kind"), F.col("direction")), "period": period_of(F.col("occurred_on")), "signed_cents": signed(F.col("direction"), F.col("cents"))})


def sections(rows: DataFrame) -> DataFrame:
    """(section, code, period, cents): magnitudes of in and out, signed transfers."""
    c = F.when(F.col("section") == "transfer", F.col("signed_cents")).otherwise(F.col("cents"))
    return rows.groupBy("section", "code", "period").agg(F.sum(c).alias("cents"))


def matrix(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(section, line, period, cents) of each month of the range: a line for each code that the section has in it, 'none' without category, and 'total'.

    Months in which a line has nothing stand with zero. Only the aggregate by line and
    month, bounded by chart and range, meets the axis.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    own = sections(rows.where((F.col("period") >= a) & (F.col("period") <= b)))
    both = F.explode(F.array(F.coalesce("code", F.lit("none")), F.lit("total"))).alias("line")
    own = own.select("section", both, "period", "cents").groupBy("section", "line", "period").agg(F.sum("cents").alias("cents"))
    axis = F.explode(F.sequence(a, b, F.expr("interval 1 month"))).alias("period")
    return own.select("section", "line").distinct().select("section", "line", axis).join(own, ["section", "line", "period"], "left").na.fill(0, ["cents"])


def drilled(rows: DataFrame, chart: DataFrame, code: str | None, period: str) -> DataFrame:
    """The rows behind a cell of the matrix: those of all categories of a code, or without category where code is None."""
    own = rows.where(F.col("period") == F.lit(period).cast("date"))
    if code is None:
        return own.where("category_id is null")
    return own.join(F.broadcast(chart.where(F.col("code") == code).select("category_id")), "category_id", "left_semi")


def monthly(rows: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """(period, opening, inflow, outflow, operating, transfers, net, closing) of each month of the range, also of those without entries.

    The first opening is that of the accounts and of all that moved before. Months are few,
    so the running sum stands on their aggregate.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = rows.where(F.col("occurred_on") < a).agg(F.coalesce(F.sum("signed_cents"), F.lit(0)).alias("moved"))
    opened = cash_accounts(accounts).agg(F.coalesce(F.sum("opening_cents"), F.lit(0)).alias("opened"))
    part = lambda name, c: F.coalesce(F.sum(F.when(F.col("section") == name, F.col(c))), F.lit(0))
    months = rows.where((F.col("period") >= a) & (F.col("period") <= b)).groupBy("period").agg(
        part("in", "cents").alias("inflow"), part("out", "cents").alias("outflow"), part("transfer", "signed_cents").alias("transfers"))
    months = period_axis(rows.sparkSession, start, end).join(months, "period", "left").na.fill(0, ["inflow", "outflow", "transfers"])
    months = months.withColumn("operating", F.col("inflow") - F.col("outflow")).withColumn("net", F.col("operating") + F.col("transfers"))
    first = before.join(opened, F.lit(True)).select((F.col("moved") + F.col("opened")).alias("first"))
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = months.join(F.broadcast(first), F.lit(True)).withColumn("closing", F.col("first") + F.sum("net").over(upto))
    return rows.select("period", (F.col("closing") - F.col("net")).alias("opening"), "inflow", "outflow", "operating", "transfers", "net", "closing")


def balances(entries: DataFrame, accounts: DataFrame, until: str) -> DataFrame:
    """(account_id, type, balance) of every account, opening included whatever its date."""
    moved = entries.where(F.col("occurred_on") <= F.lit(until).cast("date")).groupBy("account_id").agg(F.sum(signed(F.col("direction"), F.col("cents"))).alias("moved"))
    return accounts.join(moved, "account_id", "left").select("account_id", "type", (F.col("opening_cents") + F.coalesce("moved", F.lit(0))).alias("balance"))


def merged_chart(charts: DataFrame) -> DataFrame:
    """(category_id, entity_id, code, name, kind) of the charts of several entities (category_id, entity_id, code, name, kind, sort_order): what shares a code is one category, named by the first chart in order that has it."""
    first = charts.groupBy("code").agg(F.min_by(F.struct("name", "kind"), F.struct("sort_order", "entity_id", "category_id")).alias("_first"))
    return charts.select("category_id", "entity_id", "code").join(first, "code").select("category_id", "entity_id", "code", "_first.name", "_first.kind")


def consolidated(entries: DataFrame, accounts: DataFrame, charts: DataFrame, start: str, end: str) -> DataFrame:
    """(section, line, name, period, cents) of all entities together: the matrix by code, and the section balance with lines opening, net and closing.

    Categories are merged by code (merged_chart); entries without one, or of a category that
    their entity's chart hasn't, are the line none. Charts are small next to the entries:
    the join's strategy is left to Spark.
    """
    merged = merged_chart(charts)
    own = entries.join(cash_accounts(accounts).select("account_id"), "account_id", "left_semi").join(merged.select("category_id", "entity_id", "code", "kind"), ["category_id", "entity_id"], "left")
    own = own.withColumns({"section": section(F.col("kind"), F.col("direction")), "period": period_of(F.col("occurred_on")), "signed_cents": signed(F.col("direction"), F.col("cents"))})
    names = merged.groupBy("code").agg(F.first("name").alias("name")).withColumnRenamed("code", "line")
    cells = matrix(own, start, end).join(names, "line", "left").select("section", "line", "name", "period", "cents")
    months = monthly(own, accounts, start, end)
    frame = F.array(*[F.struct(F.lit(n).alias("line"), F.col(n).alias("cents")) for n in ("opening", "net", "closing")])
    balance = months.select("period", F.inline(frame)).select(F.lit("balance").alias("section"), "line", F.lit(None).cast("string").alias("name"), "period", "cents")
    return cells.unionByName(balance)


def warnings(entries: DataFrame, accounts: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """(code, subject, n): what a reader of the cash flow should know.

    empty-month: a month of the range without an entry in a cash account (n 0).
    dropped-account: an account that isn't cash, or isn't known, with entries in the range,
    which the flow leaves out; subject is the account, n its entries. late-opening: a cash
    account whose opening is dated after the range's start, yet counted (where accounts
    have opened_on). uncategorised: n entries of cash accounts in the range without a category.
    """
    a, b = F.lit(start).cast("date"), F.last_day(F.lit(end).cast("date"))
    inside = entries.where(F.col("occurred_on").between(a, b))
    cash = cash_accounts(accounts).select("account_id", F.lit(True).alias("_cash"))
    judged = inside.join(cash, "account_id", "left")
    own = judged.where("_cash").groupBy(period_of(F.col("occurred_on")).alias("period")).agg(F.count("*").alias("n"), F.count(F.when(F.col("category_id").isNull(), 1)).alias("bare"))
    row = lambda code, subject, n: [F.lit(code).alias("code"), subject.cast("string").alias("subject"), n.cast("long").alias("n")]
    empty = period_axis(entries.sparkSession, start, end).join(own, "period", "left").where("n is null").select(*row("empty-month", F.col("period"), F.lit(0)))
    dropped = judged.where("_cash is null").groupBy("account_id").agg(F.count("*").alias("n")).select(*row("dropped-account", F.col("account_id"), F.col("n")))
    bare = own.agg(F.sum("bare").alias("n")).where("n > 0").select(*row("uncategorised", F.lit(None), F.col("n")))
    out = empty.unionByName(dropped).unionByName(bare)
    if "opened_on" in accounts.columns:
        out = out.unionByName(cash_accounts(accounts).where(F.col("opened_on") > a).select(*row("late-opening", F.col("account_id"), F.lit(1))))
    return out
