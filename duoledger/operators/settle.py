"""Payments and the bills that they settle: equal amounts, one to one, within a window of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import blocked, last_before, running


def pair_payments(payments: DataFrame, bills: DataFrame, window_days: int = 45, blocks: int | None = None) -> DataFrame:
    """(payment_id, bill_id, account_id, cents, paid_on, billed_on, days, outcome) from payments and bills (id, account_id, cents, day).

    A payment takes the bill of its account and exact cents whose day is the nearest before
    it (or its own day), a bill the payment that is the nearest after it; who chose each
    other are a pair, and the others choose again among those left, until none is left that
    can. In the order of days (bills first on a day, then by id) that is how brackets close:
    a bill opens a level, a payment closes it. So a running sum gives every row its
    level, and a payment's bill is the row before it on its level; two scans, whatever
    the number of rounds, and an (account, cents) that holds most rows is many tasks.
    What lies more than window_days apart is no pair: nothing nearer was left for either.

    outcome: paired, payment only, bill only; rows without account, cents or day are
    only themselves. Ids tell rows of a side apart.
    """
    keys = ["account_id", "cents"]
    both = bills.select(F.lit(1).cast("long").alias("step"), "id", *keys, "day").unionByName(payments.select(F.lit(-1).cast("long").alias("step"), "id", *keys, "day"))
    whole = F.col("account_id").isNotNull() & F.col("cents").isNotNull() & F.col("day").isNotNull()
    rows = both.where(whole).withColumns({"side": F.when(F.col("step") == 1, 0).otherwise(1)})
    order = ["day", "side", "id"]
    depth = running(blocked(rows, keys, order, blocks), keys, order, {"depth": "step"}).drop("block")
    level = depth.withColumn("level", F.col("depth") + F.when(F.col("side") == 1, 1).otherwise(0)).withColumn("opened", F.when(F.col("side") == 0, F.struct("id", "day")))
    found = last_before(blocked(level, [*keys, "level"], order, blocks), [*keys, "level"], order, {"bill": "opened"}).where("side = 1")
    days = F.datediff("day", F.col("bill.day"))
    taken = found.withColumn("days", F.when(days <= window_days, days)).select(
        F.col("id").alias("payment_id"), F.when(F.col("days").isNotNull(), F.col("bill.id")).alias("bill_id"), *keys, F.col("day").alias("paid_on"), F.when(F.col("days").isNotNull(), F.col("bill.day")).alias("billed_on"), "days")
    paid = taken.withColumn("outcome", F.when(F.col("days").isNotNull(), "paired").otherwise("payment only"))
    one = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), *keys, F.col("day").alias("paid_on" if side == "payment" else "billed_on"), F.lit(f"{side} only").alias("outcome"))
    left = bills.join(taken.where("bill_id is not null").select(F.col("bill_id").alias("id")), "id", "left_anti")
    return paid.unionByName(one(left, "bill"), allowMissingColumns=True).unionByName(one(payments.where(~whole), "payment"), allowMissingColumns=True)
