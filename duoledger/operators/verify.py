"""Verification of many files at once: each statement against its own balances, each card bill against its printed total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import reconcile_statement


def statements(rows: DataFrame, file: str = "path") -> DataFrame:
    """(file, kind, n, ok) of parsed statement rows: ok where every declared balance is what moved since the one before. Files without a movement are no statements and have no row."""
    moved = rows.where("kind = 'movement'").select(file, F.col("occurred_on").alias("day"), F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents")).alias("signed_cents"))
    last = rows.where("balance_cents is not null and occurred_on is not null").groupBy(file, F.col("occurred_on").alias("day")).agg(F.max_by("balance_cents", "row").alias("balance"))
    wrong = reconcile_statement(moved, last, None, [file]).groupBy(file).agg(F.count(F.when(F.col("difference") != 0, 1)).alias("wrong"))
    return moved.groupBy(file).agg(F.count("*").alias("n")).join(wrong, file, "left").select(file, F.lit("statement").alias("kind"), "n", (F.coalesce("wrong", F.lit(0)) == 0).alias("ok"))


def bills(heads: DataFrame, charges: DataFrame, file: str = "path") -> DataFrame:
    """(file, kind, n, ok, duplicate) of card bills (file, account_digits, due_on, printed) and their charges (file, cents, direction).

    A file's name says nothing: a bill is the account and the day it is due, and of several
    files of one bill the first by name counts. Files with neither charges nor a printed
    total are no bills. A bill without a printed total can't be verified.
    """
    total = charges.groupBy(file).agg(F.count("*").alias("n"), F.sum(F.when(F.col("direction") == "out", F.col("cents")).otherwise(-F.col("cents"))).alias("total"))
    own = heads.join(total, file, "left").where("n is not null or printed is not null")
    identity = [F.coalesce("account_digits", F.lit("????")), F.coalesce(F.col("due_on").cast("string"), F.lit("?"))]
    again = F.row_number().over(Window.partitionBy(*identity).orderBy(file)) > 1
    return own.select(file, F.lit("card_invoice").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.coalesce("total", F.lit(0)) == F.col("printed"), F.lit(False)).alias("ok"), again.alias("duplicate"))


def trusted(charges: DataFrame, verified: DataFrame, file: str = "path") -> DataFrame:
    """Outflows of bills that are right and no duplicates: a misread file would invent subscriptions."""
    return charges.where("direction = 'out'").join(verified.where("ok and not duplicate").select(file), file, "left_semi")


def summary(verified: DataFrame) -> DataFrame:
    """One row (checked, right, wrong, duplicates)."""
    return verified.agg(F.count("*").alias("checked"), F.count(F.when(F.col("ok"), 1)).alias("right"), F.count(F.when(~F.col("ok"), 1)).alias("wrong"), F.count(F.when(F.col("duplicate"), 1)).alias("duplicates"))
