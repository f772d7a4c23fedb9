"""Extension: staged lines as they land, each once; the batch operators do the work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import dedup_hash
from ..operators.cashflow import signed
from ..operators.staging import stage

LINES = "line_no long, account_id long, occurred_on date, cents long, direction string, description string, counterparty string, landed_at timestamp"


def landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LINES).parquet(path)


def unique_lines(lines: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Lines whose content has not landed within the watermark; equal lines of one file are told apart by number."""
    rows = lines.withColumn("dedup_hash", dedup_hash(*[F.col(c) for c in ("account_id", "occurred_on", "cents", "direction", "description", "counterparty")], F.lit(0)))
    return rows.withWatermark("landed_at", lateness).dropDuplicatesWithinWatermark(["dedup_hash", "line_no"])


def daily_flow(lines: DataFrame, lateness: str = "7 days") -> DataFrame:
    """(day, direction, cents) in windows of a day of landing, late lines counted within the watermark."""
    return lines.withWatermark("landed_at", lateness).groupBy(F.window("landed_at", "1 day").alias("w"), "direction").agg(F.sum(signed(F.col("direction"), F.col("cents"))).alias("cents")).select(
        F.col("w.start").cast("date").alias("day"), "direction", "cents")


CONTENT = ["account_id", "occurred_on", "cents", "direction", "description", "counterparty"]


def _unseen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of lines of one content, those that stand more often in their file than in any file before; the state is how often that was."""
    rows = pd.concat(list(parts)).sort_values(["landed_at", "file", "line_no"], kind="stable")
    seen = state.get[0] if state.exists else 0
    rows["occurrence"] = rows.groupby("file", sort=False).cumcount()
    times = rows.groupby("file", sort=False)["occurrence"].max() + 1
    before = times.cummax().shift(fill_value=0).clip(lower=seen)
    state.update((max(seen, int(times.max())),))
    new = rows[rows["occurrence"] >= rows["file"].map(before)]
    yield pd.DataFrame({"content": key[0], "file": new["file"], "line_no": new["line_no"], "landed_at": new["landed_at"], "occurrence": new["occurrence"].astype("int32")})


def staged_once(lines: DataFrame) -> DataFrame:
    """New lines (file, line_no, landed_at, occurrence, dedup_hash, and their content) of a stream of files, each once.

    Equal lines of one file are told apart by their occurrence, as in the batch
    operator; a file that lands again, or later than others, adds only what no file had so
    often. State is a number for each different content, so a batch meets its own keys and not the whole ledger.
    """
    content = F.to_json(F.struct(*CONTENT))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), "line_no", "landed_at", content.alias("content"))
    new = rows.groupBy("content").applyInPandasWithState(_unseen, "content string, file string, line_no long, landed_at timestamp, occurrence int", "times long", "append", GroupStateTimeout.NoTimeout)
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    held = F.from_json("content", ", ".join(f"{c} {types[c]}" for c in CONTENT))
    out = new.withColumn("c", held).select("file", "line_no", "landed_at", "occurrence", "c.*")
    return out.withColumn("dedup_hash", dedup_hash(*[F.col(c) for c in CONTENT], F.col("occurrence")))


def write_once(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what staged_once lets through to a table; after a restart it goes on where it stopped."""
    return staged_once(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def stage_stream(lines: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's new lines to the ledger table: occurrence and hashes are those of the batch operator, so a file that lands twice adds nothing."""
    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        try:
            known = spark.read.parquet(ledger).select("dedup_hash")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "dedup_hash string")
        stage(rows, known, ["line_no"]).where("not duplicate").drop("duplicate").write.mode("append").parquet(ledger)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
