"""Lines on their way into the ledger: what is new, what an approval makes of staged rows, what the recognition ledger takes from entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits
from .cashflow import CASH_TYPES
from .mirror import mirror

#: One hash stands once in an entity's ledger.
KEY = ["entity_id", "dedup_hash"]


def admitted(entries: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """entries with admitted: false where the ledger has the entity's hash already, or an earlier entry of the batch has it.

    Entries without a hash are always admitted, and meet no shuffle.
    """
    hashed = entries.where("dedup_hash is not null")
    known = ledger.where("dedup_hash is not null").select(*KEY).distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) == 1
    judged = hashed.withColumn("_first", first).join(known, KEY, "left").withColumn("admitted", F.col("_first") & F.col("_known").isNull())
    return judged.select(*entries.columns, "admitted").unionByName(entries.where("dedup_hash is null").withColumn("admitted", F.lit(True)))


def approve(staged: DataFrame, chosen: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """staged (id, entity_id, dedup_hash, status, suggested_category_id, ...) with status and category_id after chosen rows (id, category_id) are approved.

    A chosen row takes the category that its reader gave it, or else the suggested one. It
    is approved, or a duplicate where the ledger has its hash. The others stay as they are.
    """
    rows = staged.join(chosen.select("id", F.col("category_id").alias("_given"), F.lit(True).alias("_chosen")), "id", "left")
    picked = F.coalesce("_chosen", F.lit(False))
    taken = admitted(rows.where(picked), ledger, order).withColumn("status", F.when(F.col("admitted"), "approved").otherwise("duplicate")).withColumn("category_id", F.coalesce("_given", "suggested_category_id"))
    return taken.select(*staged.columns, "category_id").unionByName(rows.where(~picked).select(*staged.columns, F.lit(None).cast("long").alias("category_id")))


def mirror_actions(entries: DataFrame, chart: DataFrame, existing: DataFrame) -> DataFrame:
    """(entry_id, action, period, category_id, cents): what saved entries do to their rows (entry_id, period, category_id, cents, manually_edited) of the recognition ledger.

    A row edited by hand is never touched. An entry that no longer mirrors loses its row;
    a row that is right already stays ('same').
    """
    plan = mirror(entries, chart, ["entry_id"]).select("entry_id", "period", "category_id", "cents")
    old = existing.join(entries.select("entry_id"), "entry_id", "left_semi").select(
        "entry_id", F.col("period").alias("_period"), F.col("category_id").alias("_category"), F.col("cents").alias("_cents"), F.coalesce("manually_edited", F.lit(False)).alias("_edited"))
    both = plan.join(old, "entry_id", "full_outer")
    same = F.col("period").eqNullSafe(F.col("_period")) & F.col("category_id").eqNullSafe(F.col("_category")) & F.col("cents").eqNullSafe(F.col("_cents"))
    action = F.when(F.col("_edited"), "edited").when(F.col("period").isNull(), "delete").when(F.col("_edited").isNull(), "insert").when(same, "same").otherwise("update")
    return both.select("entry_id", action.alias("action"), "period", "category_id", "cents")


def mismatches(imports: DataFrame, accounts: DataFrame) -> DataFrame:
    """imports (import_id, kind, account_id, said_number, said_digits) with not_card, other_digits and other_number.

    A bill belongs to a card, of the digits that it prints; a statement to the account whose
    number it prints. What either side doesn't say is no mismatch.
    """
    a = accounts.select("account_id", F.col("type").alias("_type"), F.col("number").alias("_number"), F.col("last_digits").alias("_digits"))
    bill = F.col("kind") == "card_invoice"
    differ = lambda x, y: F.coalesce((x != "") & (y != "") & (x != y), F.lit(False))
    return imports.join(a, "account_id", "left").withColumns({
        "not_card": bill & F.coalesce(F.col("_type").isin(CASH_TYPES), F.lit(False)), "other_digits": bill & differ(F.col("said_digits"), F.col("_digits")),
        "other_number": ~bill & differ(digits(F.col("said_number")), digits(F.col("_number")))}).drop("_type", "_number", "_digits")
