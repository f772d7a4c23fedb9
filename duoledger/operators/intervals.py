"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written


#: Keys that are broadcast.
FEW = 100_000


def _block(at: Column, level: Column) -> Column:
    """Number of the block of 2^level that a whole number lies in (downward)."""
    return F.call_function("shiftright", at, level)


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points (without end) joined with the intervals of their keys that hold them: start <= at <= end, in whole numbers (days, cents).

    An interval has the level of its length's power of two and stands for at most two blocks of
    that width; a point has one block for each level that occurs (64 at most, and a hot key is
    as many tasks as blocks). So an equi-join on (keys, level, block) finds every pair
    and a comparison settles it; no side is compared with all of the other.

    Null keys, points and bounds match nothing; an interval that ends before it starts holds
    nothing. Points of keys that no interval has are left out before they are spread. Repeated rows match as often as they stand. Columns of the two sides, keys
    apart, need different names.
    """
    own = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    length = F.col(end).cast("decimal(20,0)") - F.col(start).cast("decimal(20,0)") + 1
    level = F.least(F.ceil(F.log2(length.cast("double"))), F.lit(62)).cast("int")
    own = own.withColumn("_level", level).withColumn("_first", _block(F.col(start), F.col("_level"))).withColumn("_last", _block(F.col(end), F.col("_level")))
    own = written(own.withColumn("_block", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last"), "intervals")
    levels = sorted(r["_level"] for r in own.select("_level").distinct().collect())  # 64 at most
    met = own.select(*keys).distinct()
    points = points.join(F.broadcast(met) if met.count() <= FEW else met, keys, "left_semi") if keys else points
    spread = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    spread = spread.withColumn("_block", _block(F.col(at), F.col("_level")))
    return spread.join(own, [*keys, "_level", "_block"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_level", "_block")


def day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date")).cast("long")
