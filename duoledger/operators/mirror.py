"""Costs of the recognition ledger, derived from cash entries and never stored twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_of

#: Kinds of categories that a payment mirrors as cost.
MIRRORED = ["cost", "expense", "tax"]


def competence(override: Column, day: Column) -> Column:
    return F.coalesce(override, period_of(day))


def has_override(override: Column, day: Column) -> Column:
    return F.coalesce(override != period_of(day), F.lit(False))


def mirror(entries: DataFrame, chart: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Cost rows: out counts up, in (a refund) down; entries of no amount have none. keep: further columns of the entries."""
    own = entries.where("cents <> 0").join(F.broadcast(chart.where(F.col("kind").isin(MIRRORED))), "category_id")
    return own.select(*keep, "entity_id", "category_id", "code", "dre_group", competence(F.col("competence_period"), F.col("occurred_on")).alias("period"),
                      F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents")).alias("cents"), F.lit("cost").alias("entry_kind"))
