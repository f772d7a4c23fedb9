"""Shared pieces: word patterns, tables in the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased; none for null."""
    return WORD.findall(lower_az(text)) if text else []


def byte_words(text: str | None) -> list[bytes]:
    """The same words in UTF-8: bytes know no other white space and no other letters than these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_az(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def n_words(col: Column) -> Column:
    return F.when(col.isNull(), F.lit(0)).otherwise(F.regexp_count(col, F.lit(WORD_PATTERN))).cast("long")


#: Rows and bytes of a batch that a Python task holds at once.
BATCH_ROWS, BATCH_BYTES = 2500, 2 << 20


def bounded(spark: SparkSession) -> None:
    """From now on, batches of texts that reach Python are small, so that a task's memory does not rest on the rows' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(rows: DataFrame, run, schema: str, *kept: str) -> DataFrame:
    """rows.mapInPandas(run, schema) with the columns kept as text on the way: where one is null, pandas would make floats of whole numbers, and large ones would change."""
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{c} string" for c in kept)
    out = rows.withColumns({c: F.col(c).cast("string") for c in kept}).mapInPandas(run, f"{fields}, {schema}")
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in kept})


def release() -> None:
    """Give memory that a Python task no longer uses back to the machine, now and whenever a large array goes: workers live on for the tasks of later stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # only glibc has these
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: arrays of 2 MB and more are the system's own pages
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where driver and executors are one process may it be unset: a folder of our own then."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="duoledger-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark).rstrip('/')}/duoledger/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like stored, as a table bucketed by key: grouping by key then needs no shuffle of it."""
    spark = df.sparkSession
    bounded(spark)
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/duoledger/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it is counted), else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key from which the key is hot, at least; rows of a table up to which it is broadcast.
HOT, FEW = 10_000, 1_000_000


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the one row of table (key, copies, ...) of their key, which every row has; copies is dropped.

    A small table is broadcast. Of a large one, the hot keys are: those of at least n / FEW
    of n rows, so FEW at most. No other key fills a task, and they are joined by shuffle.
    """
    table = stored(table, "lookup")
    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(table.drop("copies")), key)
    least = max(HOT, -(-table.agg(F.sum("copies")).first()[0] // FEW))
    hot = F.broadcast(table.where(F.col("copies") >= least).drop("copies"))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("copies") < least).drop("copies"), key)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node reachable, of every node that has an edge.

    Each round takes the least label among the neighbours and then that label's own
    label, so paths halve; rounds end when no label moves. Labels and links stay in
    tables; only the number of changes reaches the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        step = step.join(jump, "c", "left").select("u", "was", F.least("c", F.coalesce("cc", "c")).alias("c"))
        step = stored(step, "labels")
        labels = step.select("u", "c")
        if step.where("c <> was").limit(1).count() == 0:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
