"""What clients bring and cost: received and recognised side by side, margin after the people who work for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import basis_points
from ..sources.store import written


def revenue(received: DataFrame, recognised: DataFrame, parts: int | None = None) -> DataFrame:
    """(level, client_id, period, received, recognised) from cash receipts and recognised revenue (client_id, period, cents).

    level: cell (client and month), client (all months), month (all clients), all. Rows
    without a client are a client of their own, the null one. Lines where both are
    zero don't stand. Cells are summed in so many parts, or as many as shuffle partitions, and
    written; the other levels are sums of them.
    """
    one = lambda df, what: df.select("client_id", "period", F.lit(what).alias("what"), "cents")
    rows = one(received, "received").unionByName(one(recognised, "recognised"))
    part = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("cents"))), F.lit(0)).alias(what)
    rows = rows.repartition(parts, "client_id", "period") if parts else rows
    cells = written(rows.groupBy("client_id", "period").agg(part("received"), part("recognised")), "cells")
    more = cells.groupingSets([["client_id"], ["period"], []], "client_id", "period").agg(F.grouping_id("client_id", "period").alias("_id"), F.sum("received").alias("received"), F.sum("recognised").alias("recognised"))
    out = more.unionByName(cells.withColumn("_id", F.lit(0).cast("long")))
    level = F.element_at(F.array(*map(F.lit, ("cell", "client", "month", "all"))), (F.col("_id") + 1).cast("int"))
    return out.where("received <> 0 or recognised <> 0").select(level.alias("level"), "client_id", "period", "received", "recognised")


def margin(gained: DataFrame, paid: DataFrame, people: DataFrame) -> DataFrame:
    """(kind, client_id, revenue, cost, people, margin, margin_bp) from revenue (client_id, cents), payroll (person_id, cents) and people (person_id, client_id).

    What a person is paid is a cost of their client. kind: client; unallocated, one row for
    payroll without a person, of unknown people, or of people without a client; total.
    Revenue without a client is in the total alone. margin_bp is null without revenue.
    """
    known = people.where(F.col("client_id").isNotNull()).select("person_id", "client_id").dropDuplicates(["person_id"])
    cost = paid.join(known, "person_id", "left").select("client_id", F.lit(0).cast("long").alias("revenue"), F.col("cents").alias("cost"), F.when(F.col("client_id").isNotNull(), F.col("person_id")).alias("person_id"))
    rows = gained.select("client_id", F.col("cents").alias("revenue"), F.lit(0).cast("long").alias("cost"), F.lit(None).alias("person_id")).unionByName(cost)
    own = rows.groupBy("client_id").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.countDistinct("person_id").alias("people"))
    total = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("revenue", "cost", "people")]).select(F.lit("total").alias("kind"), F.lit(None).cast("long").alias("client_id"), "revenue", "cost", "people")
    each = own.where("client_id is not null").select(F.lit("client").alias("kind"), "client_id", "revenue", "cost", "people")
    rest = own.where("client_id is null and cost <> 0").select(F.lit("unallocated").alias("kind"), "client_id", F.lit(0).cast("long").alias("revenue"), "cost", "people")
    out = each.unionByName(rest).unionByName(total).withColumn("margin", F.col("revenue") - F.col("cost"))
    return out.withColumn("margin_bp", basis_points(F.col("margin"), F.col("revenue")))
