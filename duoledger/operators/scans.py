"""Running sums, last values and ranks of keys that no single task can hold.

Rows are dealt into blocks, ranges of (key, order), so a hot key is many blocks and a block
many small keys. Windows run within a block; what a block hands on to later ones of its key
is one row, and only a block's first key takes anything over: as many rows as blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def blocked(rows: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """rows as a table with block: a number of ranges of (keys, order), as many as shuffle partitions unless given. Rows of equal keys and order are in one block."""
    n = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    return written(rows.repartitionByRange(n, *by).withColumn("block", F.spark_partition_id()), "blocks")


def _meets(a: str, b: str, keys: list[str]) -> Column:
    """Equal block and keys, null being a key."""
    on = F.col(f"{a}.block") == F.col(f"{b}.block")
    for k in keys:
        on &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _with_state(rows: DataFrame, keys: list[str], state: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with carry, computed from the state (aggregates) of the blocks of their key before theirs; null in a key's first block."""
    blocks = rows.groupBy("block", *keys).agg(*[c.alias(n) for n, c in state.items()])
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("block")
    blocks = blocks.withColumns({n: c.over(before.rowsBetween(Window.unboundedPreceding, -1)) for n, c in carry.items()})
    later = blocks.withColumn("_k", F.row_number().over(before)).where("_k > 1")
    few = F.broadcast(later.select("block", *keys, *carry))  # a later block of a key has that key first: one row a block
    return rows.alias("r").join(few.alias("s"), _meets("r", "s", keys), "left").select("r.*", *[f"s.{n}" for n in carry])


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Blocked rows with the sum of a column from the key's first row up to each row, in the order given, which must tell rows of a key apart."""
    upto = Window.partitionBy("block", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({out: F.sum(c).over(upto) for out, c in sums.items()})
    own = _with_state(own, keys, {f"_t_{out}": F.sum(c) for out, c in sums.items()}, {f"_c_{out}": F.sum(f"_t_{out}") for out in sums})
    return own.withColumns({out: F.coalesce(F.col(out), F.lit(0)) + F.coalesce(f"_c_{out}", F.lit(0)) for out in sums}).drop(*[f"_c_{out}" for out in sums])


def last_before(rows: DataFrame, keys: list[str], order: list[str], lasts: dict[str, str]) -> DataFrame:
    """Blocked rows with the last value of a column that isn't null in the key's rows before each row."""
    ordered = Window.partitionBy("block", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({out: F.last(c, ignorenulls=True).over(before) for out, c in lasts.items()})
    at = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    own = _with_state(own, keys, {f"_t_{out}": F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)) for out, c in lasts.items()}, {f"_c_{out}": F.last(f"_t_{out}", ignorenulls=True) for out in lasts})
    return own.withColumns({out: F.coalesce(out, f"_c_{out}") for out in lasts}).drop(*[f"_c_{out}" for out in lasts])


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False, forward: bool = False, within: str | None = None, blocks: int | None = None) -> DataFrame:
    """left with the values of the right row of its keys that is the last at or before it.

    strict: before it. forward: the first at or after it. within: an interval (such as
    '30 days') beyond which a match doesn't count. Both sides go through one scan, so a hot key
    is many tasks; nothing is compared in pairs. Null keys are keys; left rows of a null time
    match nothing, right ones are never matched. Of right rows of one time, the one of the
    greatest values counts. left may repeat rows and have any columns.
    """
    sign = -1 if forward else 1
    took = F.struct(F.col(right_at).alias("_at"), *[F.col(v) for v in values])
    r = right.where(F.col(right_at).isNotNull()).select(*keys, (sign * _micros(F.col(right_at))).alias("_time"), F.lit(int(strict)).alias("_side"), took.alias("_value"))
    r = r.groupBy(*keys, "_time", "_side").agg(F.max("_value").alias("_value"))
    own = left.select(*keys, (sign * _micros(F.col(left_at))).alias("_time"), F.lit(1 - int(strict)).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = blocked(own.unionByName(r, allowMissingColumns=True), keys, ["_time"], blocks)
    found = last_before(both, keys, ["_time", "_side"], {"_found": "_value"}).where("_row is not null")
    holds = F.col("_time").isNotNull()
    if within:
        limit = F.expr(f"interval {within}")
        gone = (F.col("_found._at").cast("timestamp") - limit > F.col(f"_row.{left_at}").cast("timestamp")) if forward else (F.col("_found._at").cast("timestamp") + limit < F.col(f"_row.{left_at}").cast("timestamp"))
        holds &= ~F.coalesce(gone, F.lit(False))
    return found.select("_row.*", *[F.when(holds, F.col(f"_found.{v}")).alias(v) for v in values])


def ranked(rows: DataFrame, keys: list[str], order: list[str], ties: list[str], tiles: int = 4, blocks: int | None = None) -> DataFrame:
    """rows with number, rank, percent_rank, cume_dist and tile (ntile) by key; `ties` order rows of equal order for number and tile.

    Equal (keys, order) are one block, so ranks of ties are known there; blocks add the
    counts of those before. Without keys, all rows are one key, and still many tasks.
    """
    own = blocked(rows, keys, order, blocks)
    by = Window.partitionBy("block", *keys)
    first = [F.col(c).asc_nulls_first() for c in order]
    own = own.withColumns({"number": F.row_number().over(by.orderBy(*first, *ties)), "rank": F.rank().over(by.orderBy(*first)), "_upto": F.count("*").over(by.orderBy(*first).rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    own = _with_state(own, keys, {"_n": F.count("*")}, {"_before": F.sum("_n")})
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    spread = own.groupBy("block", *keys).agg(F.lit(1).alias("_one")).drop("_one")
    sized = spread.alias("b").join(totals.alias("t"), _all(keys, "b", "t")).select("b.*", "t._total")
    own = own.alias("r").join(sized.alias("s"), _meets("r", "s", keys)).select("r.*", "s._total")
    n, before = F.col("_total"), F.coalesce("_before", F.lit(0))
    number, rank = F.col("number") + before, F.col("rank") + before
    small, more = F.expr(f"_total div {tiles}"), n % tiles
    cut = more * (small + 1)  # the first tiles have one row more
    tile = F.when(number <= cut, F.floor((number - 1) / (small + 1)) + 1).otherwise(more + F.floor((number - 1 - cut) / small) + 1)
    return own.select(*rows.columns, number.alias("number"), rank.alias("rank"), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
                      ((F.col("_upto") + before) / n).alias("cume_dist"), tile.cast("int").alias("tile"))


def _all(keys: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def range_sum(rows: DataFrame, keys: list[str], day: str, value: str, days: int, blocks: int | None = None) -> DataFrame:
    """(keys, day, total, window_total) of each day with rows: its sum, and that of it and the `days` calendar days before (a RANGE frame).

    A window's sum is the difference of two running sums, and the second is found by an
    as-of join, so a hot key is many tasks.
    """
    daily = rows.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.sum(value).alias("total"))
    run = running(blocked(daily, keys, [day], blocks), keys, [day], {"_run": "total"}).drop("block")
    run = written(run.withColumn("_from", F.date_sub(day, days)), "running")
    found = as_of(run, run.select(*keys, F.col(day).alias("_day"), F.col("_run").alias("_was")), keys, "_from", "_day", ["_was"], strict=True, blocks=blocks)
    return found.select(*keys, day, "total", (F.col("_run") - F.coalesce("_was", F.lit(0))).alias("window_total"))
