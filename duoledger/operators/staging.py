"""Imports: occurrence of equal lines, duplicates against the ledger, statements against their own balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_hash
from .scans import blocked, last_before, running


def with_occurrence(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines with occurrence (0, 1, ...) among those of equal content, in the order given, and the hash of both."""
    content = [F.col(c) for c in ("account_id", "occurred_on", "cents", "direction", "description", "counterparty")]
    rows = lines.withColumn("_base", dedup_hash(*content, F.lit(0)))
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("_base").orderBy(*order)) - 1)
    return rows.withColumn("dedup_hash", dedup_hash(*content, F.col("occurrence"))).drop("_base")


def stage(lines: DataFrame, ledger_hashes: DataFrame, order: list[str]) -> DataFrame:
    """lines with dedup_hash and duplicate: whether the ledger has the hash already."""
    known = ledger_hashes.select("dedup_hash").distinct().withColumn("_known", F.lit(True))
    return with_occurrence(lines, order).join(known, "dedup_hash", "left").withColumn("duplicate", F.coalesce("_known", F.lit(False))).drop("_known")


def reconcile_statement(movements: DataFrame, declared: DataFrame, opening_cents: int | None, key: list[str]) -> DataFrame:
    """(key, day, expected, actual, difference) of each declared day.

    A day's expected balance is the balance declared last before it (or the opening) plus
    what moved since. Without an opening the first declared day anchors and is not judged.
    Running sums and anchors pass from block to block, so one account may hold most days.
    """
    days = movements.groupBy(*key, "day").agg(F.sum("signed_cents").alias("moved")).withColumn("actual", F.lit(None).cast("long")).unionByName(
        declared.select(*key, "day", F.lit(0).cast("long").alias("moved"), F.col("balance").alias("actual")))
    days = days.groupBy(*key, "day").agg(F.sum("moved").alias("moved"), F.max("actual").alias("actual"))
    days = running(blocked(days, key, ["day"]), key, ["day"], {"run": "moved"})
    days = last_before(days.withColumn("_anchor", F.when(F.col("actual").isNotNull(), F.struct("actual", "run"))), key, ["day"], {"anchor": "_anchor"})
    expected = F.when(F.col("anchor").isNotNull(), F.col("anchor.actual") + F.col("run") - F.col("anchor.run"))
    if opening_cents is not None:
        expected = F.coalesce(expected, F.lit(opening_cents) + F.col("run"))
    return days.withColumn("expected", expected).where("actual is not null and expected is not null").select(
        *key, "day", "expected", "actual", (F.col("actual") - F.col("expected")).alias("difference"))
