"""Audit: what changed between two snapshots; constraint violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import changed_fields
from ..functions.money import format_money, parse_money

#: Fields that hold money.
MONEY = ["amount", "opening_balance", "total_value", "monthly_value", "gross_amount", "net_amount", "amount_min", "amount_max"]


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, action, before_json, after_json) of rows inserted, updated and deleted between two snapshots."""
    pack = lambda df, name: df.select(*key, F.to_json(F.struct(*df.columns)).alias(name))
    both = pack(before, "before_json").join(pack(after, "after_json"), key, "full_outer")
    action = F.when(F.col("before_json").isNull(), "insert").when(F.col("after_json").isNull(), "delete").when(F.col("before_json") != F.col("after_json"), "update")
    return both.withColumn("action", action).where("action is not null").select(*key, "action", "before_json", "after_json")


def field_changes(diff: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, from, to) of updated rows."""
    return diff.select(*key, F.inline(changed_fields(F.col("before_json"), F.col("after_json"))))


def described(field: Column, value: Column) -> Column:
    """A field's stored value (text) as a reader sees it: money as money, yes and no, ids by their first eight signs, a dash for nothing."""
    money = format_money(parse_money(value, "."))
    return (F.when(value.isNull() | (value == ""), "—").when(field.isin(MONEY), F.coalesce(money, value)).when(value == "true", "sim").when(value == "false", "não")
            .when(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"), F.concat(value.substr(1, 8), F.lit("…"))).otherwise(value))


def log(events: DataFrame, entity_ids: list[int], table_name: str | None = None, actor: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Audit rows of entities, cut to a table, an actor and days; the last day counts to its last whole second."""
    rows = events.where(F.col("entity_id").isin(entity_ids))
    for column, value in (("table_name", table_name), ("actor", actor)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if first is None else rows.where(F.col("created_at") >= F.lit(f"{first} 00:00:00").cast("timestamp"))
    return rows if last is None else rows.where(F.col("created_at") <= F.lit(f"{last} 23:59:59").cast("timestamp"))


def trail(events: DataFrame, key: list[str], most: int = 50) -> DataFrame:
    """The last `most` rows of each key, the newest first by place; of one moment the greatest id first."""
    order = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("id"))
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows that break a check, once for each, with its name."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.withColumn("violation", F.explode(broken))


#: Fixed rules of the ledgers.
def entry_checks() -> dict[str, Column]:
    month = lambda c: F.col(c) == F.trunc(c, "MM")
    return {"amount-sign": F.col("cents") >= 0, "direction": F.col("direction").isin("in", "out"), "competence-month": month("competence_period")}


def contract_checks() -> dict[str, Column]:
    return {
        "end-before-start": F.col("end_date") >= F.col("start_date"),
        "poc-needs-total": (F.col("method") != "poc") | F.col("total_cents").isNotNull(),
        "straight-needs-amount": (F.col("method") != "straight_line") | F.col("monthly_cents").isNotNull() | (F.col("total_cents").isNotNull() & F.col("end_date").isNotNull())}


def rule_checks() -> dict[str, Column]:
    ranged = F.col("match_type") == "amount_range"
    return {
        "no-condition": (F.coalesce("pattern", F.lit("")) != "") | (F.coalesce("counterparty_tax_id", F.lit("")) != "") | ranged,
        "range-needs-bound": ~ranged | F.col("amount_min").isNotNull() | F.col("amount_max").isNotNull(),
        "range-order": F.col("amount_min") <= F.col("amount_max")}
