"""A stored ledger that changes by batches of actions, each once, whatever dies in between."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.approval import admitted
from .store import parts_for, written


#: Rows of a part of a batch, so that a task's memory doesn't grow with the ledger.
ROWS = 400_000


class Clash(ValueError):
    """A batch that doesn't fit the ledger; nothing of it was applied."""


class Ledger:
    """Rows under a path, as Parquet by `parts` (such as entity and period), one of each key.

    A batch goes in three steps: its outcome, the whole new contents of the partitions that
    it touches, is written beside the ledger and logged as staged; those partitions
    are overwritten from it; the batch is logged as done. Whatever dies in between, the same
    call goes on where it stopped, from the outcome as it was staged; a batch that is done is
    not applied again, and a batch that was left open by another call is finished first. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], parts: list[str]):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _stored(self) -> DataFrame:
        """Rows, and markers of partitions that have none left (a partition without rows could not be overwritten)."""
        kept = [f for f in self.schema if f.name not in self.parts] + [f for f in self.schema if f.name in self.parts]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return self._read("rows", f"{fields}, _none boolean")

    def rows(self) -> DataFrame:
        return self._stored().where("_none is null").select(*self.columns)

    def log(self) -> DataFrame:
        """(batch, state): staged, then done."""
        return self._read("log", "batch string, state string").distinct()

    def _logged(self, batch: str, state: str) -> None:
        self.spark.createDataFrame([(batch, state)], "batch string, state string").write.mode("append").parquet(f"{self.path}/log")

    def _finish(self, batch: str) -> None:
        rows = self._read(f"outcomes/{batch}", self._stored().schema)
        rows.repartitionByRange(parts_for(rows, ROWS), *self.parts, *self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(f"{self.path}/rows")
        self._logged(batch, "done")

    def _same(self, names: list[str]) -> Column:
        on = F.lit(True)
        for n in names:
            on &= F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        return on

    def apply(self, batch: str, actions: DataFrame) -> bool:
        """Applies actions (action, key, and for insert and update all columns); False if the batch was done before.

        insert, update (which may move a row to another partition) and delete count, all
        other actions are none. Clash, and nothing is written, if a key is inserted that stands,
        updated or deleted that doesn't, or acted on twice.
        """
        states = {(r["batch"], r["state"]) for r in self.log().collect()}  # a line or two for each batch
        open_ = sorted({b for b, s in states if s == "staged"} - {b for b, s in states if s == "done"})
        for b in open_:
            self._finish(b)
        if batch in open_ or (batch, "done") in states:
            return batch in open_
        own = written(actions.where(F.col("action").isin("insert", "update", "delete")).select("action", *self.columns), "actions")
        now = self.rows()
        row = F.struct(*self.columns)
        both = own.select(*self.key, "action", row.alias("_row")).unionByName(now.select(*self.key, F.lit(None).cast("string").alias("action"), row.alias("_row")))
        stood, acted, inserts = F.col("action").isNull(), F.count("action"), F.count(F.when(F.col("action") == "insert", 1))
        met = both.repartition(max(parts_for(own, ROWS), parts_for(now, ROWS)), *self.key).groupBy(*self.key).agg(
            acted.alias("_acted"), inserts.alias("_inserts"), (F.count(F.when(stood, 1)) > 0).alias("_known"), F.first(F.when(stood, F.col("_row")), True).alias("_old"), F.first(F.when(F.col("action") != "delete", F.col("_row")), True).alias("_new"))
        met = written(met.drop(*self.key), "met")
        known = F.col("_known")
        sums = met.agg(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name) for name, c, n in (
            ("inserted twice", known, F.col("_inserts")), ("not there", ~known, F.col("_acted") - F.col("_inserts")), ("acted on twice", F.col("_acted") > 1, F.lit(1)))]).first().asDict()
        if wrong := {k: n for k, n in sums.items() if n}:
            raise Clash(f"{batch}: {wrong}")
        acted_on = met.where("_acted > 0")
        touched = acted_on.where(known).select(*[f"_old.{p}" for p in self.parts]).unionByName(acted_on.where("_new is not null").select(*[f"_new.{p}" for p in self.parts])).distinct()
        stay = met.where("_acted = 0").select("_old.*").alias("a").join(F.broadcast(touched).alias("b"), self._same(self.parts), "left_semi")  # as many as folders of the ledger
        rows = stay.select(*self.columns).unionByName(acted_on.where("_new is not null").select("_new.*")).withColumn("_none", F.lit(None).cast("boolean"))
        filled = rows.select(*self.parts).distinct()
        empty = touched.alias("a").join(filled.alias("b"), self._same(self.parts), "left_anti").withColumn("_none", F.lit(True))
        rows.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/outcomes/{batch}")
        self._logged(batch, "staged")
        self._finish(batch)
        return True

    def merge(self, batch: str, plan: DataFrame) -> bool:
        """Applies a merge plan (action, contract_id or another key, planned as cents): its removals delete, rows edited by hand and right ones stay."""
        verb = F.when(F.col("action") == "remove", "delete").otherwise(F.col("action"))
        return self.apply(batch, plan.withColumn("action", verb))

    def admit(self, batch: str, entries: DataFrame, order: list[str]) -> bool:
        """Inserts the entries (entity_id, dedup_hash, ...) whose hash the ledger hasn't, the first of equal ones; run again, it adds nothing."""
        new = admitted(entries, self.rows(), order).where("admitted").withColumn("action", F.lit("insert"))
        return self.apply(batch, new)
