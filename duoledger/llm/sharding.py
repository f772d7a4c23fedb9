"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

RING = 1 << 32


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """One row: vpos, the sorted places of all virtual nodes, and after, for each of them the shards in clockwise order.

    A node's place rests on its shard and number alone, so another shard leaves all others' in
    place. The size is shards * vnodes, whatever the data.
    """
    nodes = spark.range(shards * vnodes).select(F.expr(f"cast(id div {vnodes} as int)").alias("shard"), (F.col("id") % vnodes).alias("replica"))
    nodes = nodes.select(F.pmod(F.xxhash64(F.lit("vnode"), "shard", "replica"), F.lit(RING)).alias("pos"), "shard")
    row = nodes.agg(F.array_sort(F.collect_list(F.struct("pos", "shard"))).alias("n"))
    row = row.select(F.expr("transform(n, x -> x.pos)").alias("vpos"), F.expr("transform(n, x -> x.shard)").alias("s"))
    twice = row.select("vpos", F.concat("s", "s").alias("s"))
    return twice.select("vpos", F.expr(f"transform(vpos, (p, i) -> array_distinct(slice(s, i + 1, {shards * vnodes})))").alias("after"))


def shard(docs: DataFrame, id_col: str, text_col: str, shards: int = 16, vnodes: int = 64, cells: int = 16384, slack: float = 0.001) -> DataFrame:
    """Place every row in a shard: (id, size, text_crc32, shard, slot). Law: bytes.

    Each row's key is hashed to one of `cells` places on the ring. Cells, the largest
    first, go to the first shard clockwise whose load stays within (1 + slack) of the mean;
    a cell that finds every shard full goes to the least loaded one. A cell holds about
    total / cells bytes, so the walk over cells is bounded by a parameter, not by the
    data, and shards differ by about a cell. A further shard takes about a tenth of the
    bytes of 16, a seventeenth being the least: what others give up goes to it, and cells that
    had overflowed move back. Rows of equal texts are no group: their ids deal them out. Slots are offsets of cells plus places in a
    cell, so no task holds a shard.

    Null texts have size 1 and the checksum of nothing (0), and count like empty ones. Null
    ids are rows like others (the text is hashed too). Repeated rows get slots of their
    own. Very long texts are rows of a large size; they are measured and never moved. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit("key"), "id", "text_crc32"), F.lit(cells)))
    loads = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    one = ring(spark, shards, vnodes).withColumn("ring", F.lit(1))  # one row, of a size that the parameters set
    places = loads.withColumn("ring", F.lit(1)).join(F.broadcast(one), "ring").select(
        "cell", "bytes", "n",
        F.expr(f"element_at(after, size(filter(vpos, p -> p < cell * {RING // cells})) % size(vpos) + 1)").alias("after"))
    walk = places.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "cell", "n", "after"))).alias("c"),
        F.sum("bytes").alias("total"))
    walk = walk.withColumn("most", F.col("total") / shards * (1 + slack))
    placed = walk.select(F.expr(f"""
        aggregate(c,
          named_struct('load', array_repeat(0L, {shards}), 'at', cast(array() as array<int>), 'most', most),
          (acc, x) -> named_struct(
            'load', transform(acc.load, (l, i) -> l + if(i = coalesce(
                get(filter(x.after, s -> acc.load[s] - x.neg <= acc.most), 0), array_position(acc.load, array_min(acc.load)) - 1), -x.neg, 0L)),
            'at', concat(acc.at, array(cast(coalesce(
                get(filter(x.after, s -> acc.load[s] - x.neg <= acc.most), 0), array_position(acc.load, array_min(acc.load)) - 1) as int))),
            'most', acc.most),
          acc -> zip_with(c, acc.at, (x, s) -> named_struct('cell', x.cell, 'n', x.n, 'shard', s)))""").alias("p"))
    placed = placed.select(F.inline("p"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("cell").orderBy("id", "text_crc32", "size")
    rows = rows.withColumn("k", F.row_number().over(within) - 1)
    return rows.join(F.broadcast(placed), "cell").select(
        "id", "size", "text_crc32", "shard", (F.col("first") + F.col("k")).alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
