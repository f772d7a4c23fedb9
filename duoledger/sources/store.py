"""Tables that a job writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a temporary folder if driver and executors are one process."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="duoledger-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def parts_for(table: DataFrame, rows: int = 30_000) -> int:
    """Partitions for a shuffle of a stored table: as many as shuffle partitions, and more where these would hold more than so many of its rows each, so that a task's memory doesn't grow with the table."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: later steps read it, lost executors don't bring its making back, and what was drawn or numbered in it stays."""
    path = f"{shared_folder(df.sparkSession)}/duoledger/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
