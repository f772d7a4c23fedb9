"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, read, stored

#: Rows of one source that one flight moves at a time; a parameter of speed, not of results' size.
BLOCK = 2000
#: Units, besides the two that a flight leaves, whose landing is solved by trying all ways.
LANDING = 10
EPS = 1e-9


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, take the weights in turn. The targets sum to
    share * total where the ceilings allow: sources whose ceiling, most * size, is low for
    their weight are filled first, and the level of the others follows from what is left.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1))
    rows = rows.withColumn("ceiling", F.lit(most) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
                           / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    rows = rows.withColumn("full", F.col("level") * F.col("w") >= F.col("ceiling"))
    level = F.min(F.when(~F.col("full"), F.struct("ceiling_by_w", "source_order", "level")))
    rows = rows.withColumn("ceiling_by_w", F.col("ceiling") / F.col("w")).withColumn("source_order", F.row_number().over(by_fill))
    rows = rows.withColumn("common", level.over(all_rows)["level"])
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("common") * F.col("w")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move the probabilities p through the null space of (sizes, counts) until at most two are fractional.

    Three fractional units at a time move along the vector that keeps both totals; each
    move settles one at least. Large units come first, so that those left are small.
    land: LANDING units of all sizes stay out of the flight and are rounded, with what it
    leaves, to the sum of sizes nearest.
    """
    p = p.copy()
    s = size.astype(float).tolist()
    active: list[int] = []
    kept_back = sorted({*np.linspace(0, len(p) - 1, LANDING).astype(int).tolist()}) if land and len(p) else []
    for unit in [i for i in range(len(p)) if i not in kept_back]:
        if not EPS < p[unit] < 1 - EPS:
            p[unit] = round(p[unit])
            continue
        active.append(unit)
        while len(active) == 3:
            a, b, c = active
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u, strict=True) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            for i, x in zip(active, u, strict=True):
                p[i] += step * x
                if p[i] <= EPS:
                    p[i] = 0.0
                elif p[i] >= 1 - EPS:
                    p[i] = 1.0
            active = [i for i in active if 0 < p[i] < 1]
    active += [i for i in kept_back if 0 < p[i] < 1]
    if land and active:
        own = np.array([s[i] for i in active])
        ways = (np.arange(1 << len(active))[:, None] >> np.arange(len(active))) & 1
        off = np.abs(ways @ own - own @ p[active])
        count = np.abs(ways.sum(1) - p[active].sum())
        p[active] = ways[np.lexsort((count, off))[0]]
    return p


def _fly(land: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:  # sorted by block; a block may span batches
            held.append(part)
            rows = pd.concat(held) if len(held) > 1 else part
            last = rows["place"].iloc[-1] if len(rows) else None
            open_ = (rows["place"] == last).to_numpy()
            held = [rows[open_]]
            yield from blocks(rows[~open_])
        if held:
            yield from blocks(held[0])

    def blocks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        cut = np.flatnonzero(np.r_[True, rows["place"].to_numpy()[1:] != rows["place"].to_numpy()[:-1]])
        p, sizes, probs, places = [], rows["size"].to_numpy(), rows["p"].to_numpy(), rows["place"].to_numpy()
        for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
            p.append(flight(sizes[a:b], probs[a:b], np.random.default_rng(zlib.crc32(places[a].encode())), land))
        yield rows.assign(p=np.concatenate(p))

    return run


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """How often each row is taken: (id, source, size, source_size, target, copies, taken).

    Every row of a source has the inclusion target / source size: its whole part is taken
    outright, its fraction by the cube method, which keeps each source's words and
    documents. Blocks of BLOCK rows of a source fly on their own and leave two rows at
    most; what they leave flies again in blocks, until each source has one block, whose
    last rows land. A hot source is many blocks, so no task holds a source.

    Null and empty texts have size 0 and are taken 0 times. The null source is a source.
    Ties and repeated rows are units of their own. Reruns give the same rows. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = stored(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes.select("source", "source_size"), share, weights, most)
    goal = goal.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    goal = stored(goal.withColumns({"whole": F.floor(ratio).cast("long"), "p": ratio - F.floor(ratio)}), "targets")
    goal = goal.withColumnRenamed("source", "s")
    rows = rows.join(F.broadcast(goal) if goal.limit(100_001).count() <= 100_000 else goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("n") / BLOCK)))
    rows = rows.withColumn("place", F.concat_ws("/", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")), F.col("block")))
    blocks = goal.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    settled = []
    open_ = rows.where((F.col("size") > 0) & (F.col("p") > 0))
    rest = rows.where(~((F.col("size") > 0) & (F.col("p") > 0))).withColumn("p", F.lit(0.0))
    while blocks:
        flown = open_.repartition("place").sortWithinPartitions("place", F.desc("size"), F.xxhash64("id", "size"), "id")
        flown = stored(flown.mapInPandas(_fly(blocks == 1), flown.schema), "flown")
        settled.append(flown.where("p = 0 or p = 1"))
        open_ = flown.where("p > 0 and p < 1")
        if blocks == 1:
            break
        blocks = -(-blocks // (BLOCK // 2))
        open_ = open_.withColumn("block", F.floor(F.col("block") / (BLOCK // 2))).withColumn(
            "place", F.concat_ws("/", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")), F.col("block")))
    for part in settled:
        rest = rest.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(0)
    return rest.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), "doc_id", "text", "source").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")
