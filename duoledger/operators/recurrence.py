"""Subscriptions: charges of one supplier at even intervals and like amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import mul_ratio

#: Charges needed; how far amounts may differ (percent); intervals in days and their slack; drift of a single interval.
LEAST, SPREAD, MONTH, MONTH_SLACK, YEAR, YEAR_SLACK, DRIFT = 3, 25, 30, 8, 365, 20, 5


def lower_median(rows: DataFrame, key: str, c: str) -> DataFrame:
    """(key, n, typical) of the values that are not null: of an even number of them, the lower one of the middle two.

    Equal values are counted before they move, and a running count over them finds the
    middle, so no key's values are ever held at once.
    """
    counts = rows.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("m"))
    upto = Window.partitionBy(key).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"upto": F.sum("m").over(upto), "n": F.sum("m").over(Window.partitionBy(key))})
    return counts.where(2 * F.col("upto") >= F.col("n")).groupBy(key).agg(F.max("n").alias("n"), F.min(c).alias("typical"))


def detect(charges: DataFrame, key: str, as_of: str) -> DataFrame:
    """(key, charges, typical, gap_days, cadence, first_on, last_on, active, monthly_cost) from outflows (key, occurred_on, cents).

    Charges far from the supplier's lower median are left out; the rest, three at least,
    must have a median gap of a month or a year, and half of the gaps must be within five
    days of it. It is active while the silence is at most two gaps and five days. Rows
    without amount or date are no charges.

    Charges of one day are counted first: gaps then stand between the different days of a
    supplier, and what a group holds is bounded by the calendar and not by its charges.
    """
    charges = charges.where("cents is not null and occurred_on is not null")
    typical = lower_median(charges, key, "cents").where(F.col("n") >= LEAST).select(key, "typical")
    near = charges.join(typical, key).where(F.abs(F.col("cents") - F.col("typical")) <= mul_ratio(F.col("typical"), F.lit(SPREAD), F.lit(100)))
    days = near.groupBy(key, "occurred_on").agg(F.count("*").alias("m"), F.max("typical").alias("typical"))
    since = F.datediff("occurred_on", F.lag("occurred_on").over(Window.partitionBy(key).orderBy("occurred_on")))
    days = days.withColumn("since", since)
    gaps = F.array(F.struct(F.col("since").alias("gap"), F.col("since").isNotNull().cast("long").alias("times")), F.struct(F.lit(0).alias("gap"), (F.col("m") - 1).alias("times")))
    found = days.select(key, "occurred_on", "typical", F.posexplode(gaps).alias("k", "g"), "m").select(
        key, "occurred_on", "typical", F.when(F.col("k") == 0, F.col("m")).otherwise(0).alias("m"), "g.gap", "g.times")
    found = found.groupBy(key).agg(F.sum("m").alias("charges"), F.max("typical").alias("typical"), F.min("occurred_on").alias("first_on"), F.max("occurred_on").alias("last_on"),
                                   F.round(F.percentile("gap", 0.5, F.col("times"))).cast("int").alias("gap_days"), F.sum("times").alias("gaps"),
                                   F.collect_list(F.when(F.col("times") > 0, F.struct("gap", "times"))).alias("each")).where(F.col("charges") >= LEAST)
    cadence = F.when(F.abs(F.col("gap_days") - MONTH) <= MONTH_SLACK, "monthly").when(F.abs(F.col("gap_days") - YEAR) <= YEAR_SLACK, "annual")
    even = F.expr(f"aggregate(each, 0L, (n, g) -> n + if(abs(g.gap - gap_days) <= {DRIFT}, g.times, 0L))") * 2 >= F.col("gaps")
    found = found.withColumn("cadence", cadence).where(F.col("cadence").isNotNull() & even)
    active = F.datediff(F.lit(as_of).cast("date"), "last_on") <= 2 * F.col("gap_days") + DRIFT
    monthly = F.when(F.col("cadence") == "annual", mul_ratio(F.col("typical"), F.lit(1), F.lit(12))).otherwise(F.col("typical"))
    return found.select(key, "charges", "typical", "gap_days", "cadence", "first_on", "last_on", active.alias("active"), monthly.alias("monthly_cost"))


def last_charge(charges: DataFrame, found: DataFrame, key: str, shown: list[str]) -> DataFrame:
    """found (of detect) with `shown` columns (label, category, account) of each supplier's last charge that counts: not far from the typical amount; of one day, the greatest amount, then the greatest values."""
    own = charges.join(found.select(key, "typical"), key).where(F.abs(F.col("cents") - F.col("typical")) <= mul_ratio(F.col("typical"), F.lit(SPREAD), F.lit(100)))
    last = own.groupBy(key).agg(F.max(F.struct("occurred_on", "cents", *shown)).alias("_last"))
    return found.join(last, key).select(*found.columns, *[F.col(f"_last.{c}").alias(c) for c in shown])


def total(found: DataFrame) -> DataFrame:
    """One row (subscriptions, monthly_total, yearly_total) of those that are active."""
    of = F.coalesce(F.sum("monthly_cost"), F.lit(0))
    return found.where("active").agg(F.count("*").alias("subscriptions"), of.alias("monthly_total"), (12 * of).alias("yearly_total"))
