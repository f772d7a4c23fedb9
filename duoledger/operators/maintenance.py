"""Changes of stored tables as frames: upserts, versions, deletions with what hangs on them, status and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new rows, of each key the new one where there is one (of several new ones the last by `at`)."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("at"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


def current_versions(contracts: DataFrame) -> DataFrame:
    return contracts.where("superseded_at is null")


def amend(contracts: DataFrame, amendments: DataFrame, key: str = "contract_no") -> DataFrame:
    """Versioned contracts after amendments (key, amended_at, changed columns): the version in force is superseded, a new one follows."""
    changed = [c for c in amendments.columns if c not in (key, "amended_at")]
    new = amendments.select(key, "amended_at", *[F.col(c).alias(f"_{c}") for c in changed])
    both = contracts.join(new, key, "left")
    hit = F.col("amended_at").isNotNull() & F.col("superseded_at").isNull()
    old = both.withColumn("superseded_at", F.when(hit, F.col("amended_at")).otherwise(F.col("superseded_at"))).select(*contracts.columns)
    fresh = both.where(hit).withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in changed} | {"version": F.col("version") + 1}).select(*contracts.columns)
    return old.unionByName(fresh)


def delete_with_pairs(entries: DataFrame, pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """entries without those deleted and the counterparts of transfers from them."""
    legs = pairs.join(gone.select(F.col("entry_id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("entry_id"))
    return entries.join(gone.select("entry_id").unionByName(legs).distinct(), "entry_id", "left_anti")


def counterparts(transfers: DataFrame) -> DataFrame:
    """The other leg of each transfer (entry_id, account_id, target_account_id, occurred_on, cents, direction, code): opposite direction, in the target account; none within one account."""
    own = transfers.where("target_account_id is not null and target_account_id <> account_id")
    kind = F.when(F.col("code") == "99.02", "card_payment").when(F.col("code") == "99.03", "investment").otherwise("internal")
    return own.select(F.col("entry_id").alias("from_id"), F.col("target_account_id").alias("account_id"), "occurred_on", "cents", F.when(F.col("direction") == "in", "out").otherwise("in").alias("direction"), kind.alias("pair_kind"))


def import_status(staged: DataFrame) -> DataFrame:
    """(import_id, pending, approved, rejected, signed, status): approved once nothing is pending."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return staged.groupBy("import_id").agg(n("pending"), n("approved"), n("rejected"), F.sum("signed_cents").alias("signed")).withColumn("status", F.when(F.col("pending") > 0, "review").otherwise("approved"))


def rule_hits(rules: DataFrame, decided: DataFrame) -> DataFrame:
    """rules with hits raised by the decisions of each."""
    n = decided.where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("_n"))
    return rules.join(n, "rule_id", "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")


def touch(before: DataFrame, after: DataFrame, key: list[str], at: str) -> DataFrame:
    """after with updated_at: `at` where a row is new or any other column has changed, else as it was."""
    values = [c for c in after.columns if c not in (*key, "updated_at")]
    old = before.select(*key, F.struct(*values).alias("_old"), F.col("updated_at").alias("_was"), F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull() & F.struct(*values).eqNullSafe(F.col("_old"))
    return after.drop("updated_at").join(old, key, "left").withColumn("updated_at", F.when(same, F.col("_was")).otherwise(F.lit(at).cast("timestamp"))).drop("_old", "_was", "_known")


def seeded(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Accounts after a seed that may run again: new ones are added, an opening of zero is filled, any other opening stays."""
    w = wanted.select(*key, F.col("opening_cents").alias("_opening"))
    old = existing.join(w, key, "left").withColumn("opening_cents", F.when(F.col("opening_cents") == 0, F.coalesce("_opening", F.lit(0))).otherwise(F.col("opening_cents"))).select(*existing.columns)
    return old.unionByName(wanted.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)
