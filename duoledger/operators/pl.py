"""Management profit and loss: blocks, subtotals, entities with eliminations, comparison of the two ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_label

#: Blocks of the statement. Transfers are in none.
REVENUE, DEDUCTIONS, DIRECT, OWNERS, IGNORED = "receita_bruta", "deducoes", "custos_diretos", "socios", "transferencias"
OPERATING = ["pessoal", "ferramentas", "servicos", "viagem", "outras", "financeiras"]
GROUPS = [REVENUE, DEDUCTIONS, DIRECT, *OPERATING, OWNERS]
#: Subtotals: what each adds and subtracts of the blocks. Interest and the like come after the operating result, and so are in EBITDA's remainder.
SUBTOTALS = {
    "net-revenue": ([REVENUE], [DEDUCTIONS]),
    "gross-margin": ([REVENUE], [DEDUCTIONS, DIRECT]),
    "operating": (OPERATING, []),
    "ebitda": ([REVENUE], [DEDUCTIONS, DIRECT, *OPERATING]),
    "result": ([REVENUE], [DEDUCTIONS, DIRECT, *OPERATING, OWNERS]),
}
#: Lines in the order of the statement.
LINES = [REVENUE, DEDUCTIONS, "net-revenue", DIRECT, "gross-margin", *OPERATING, "operating", "ebitda", OWNERS, "no-group", "result"]


def _block() -> Column:
    return F.when(F.col("dre_group").isin(GROUPS), F.col("dre_group")).otherwise("no-group")


def category_lines(rows: DataFrame, column: str) -> DataFrame:
    """(line, code, column, cents) from (dre_group, code, column, cents): what each category adds to its block. A null code is a category that the chart doesn't name; lines of zero stay."""
    own = rows.where(F.coalesce(F.col("dre_group"), F.lit("")) != IGNORED)
    return own.groupBy(_block().alias("line"), "code", column).agg(F.sum("cents").alias("cents"))


def lines(rows: DataFrame, column: str) -> DataFrame:
    """(line, ord, column, cents) from (dre_group, column, cents): blocks, the unknown groups' line, subtotals.

    One aggregation by group; subtotals are sums of its few rows. The line of unknown groups
    is in no subtotal and stands only where it isn't zero.
    """
    group = _block()
    own = rows.where(F.coalesce(F.col("dre_group"), F.lit("")) != IGNORED).groupBy(group.alias("line"), F.col(column)).agg(F.sum("cents").alias("cents"))
    terms = [F.struct(F.col("line").alias("line"), F.col("cents").alias("cents"))]
    for name, (plus, minus) in SUBTOTALS.items():
        c = F.when(F.col("line").isin(plus), F.col("cents"))
        c = c.when(F.col("line").isin(minus), -F.col("cents")) if minus else c
        terms.append(F.struct(F.lit(name).alias("line"), c.otherwise(0).alias("cents")))
    out = own.select(column, F.inline(F.array(*terms))).groupBy("line", column).agg(F.sum("cents").alias("cents"))
    out = out.where("line <> 'no-group' or cents <> 0")
    place = F.array_position(F.array(*map(F.lit, LINES)), F.col("line")).cast("int")
    return out.select("line", place.alias("ord"), column, "cents")


def fanned(rows: DataFrame) -> DataFrame:
    """(dre_group, code, col, cents) by column: each entity, eliminations, total. Intercompany rows also count negated in the last two."""
    c, mutual = F.col("cents"), F.col("is_intercompany")
    column = lambda name, value: F.struct(name.alias("col"), value.alias("cents"))
    own = F.array(column(F.concat(F.lit("entity-"), F.col("entity_id").cast("string")), c), column(F.lit("total"), c))
    both = F.array(column(F.lit("eliminations"), -c), column(F.lit("total"), -c))
    code = F.col("code") if "code" in rows.columns else F.lit(None).cast("string").alias("code")
    return rows.select("dre_group", code, F.explode(F.when(mutual, F.concat(own, both)).otherwise(own)).alias("r")).select("dre_group", "code", "r.col", "r.cents")


def consolidated(rows: DataFrame) -> DataFrame:
    """lines by column of fanned rows."""
    return lines(fanned(rows), "col")


def compare(cash: DataFrame, recognition: DataFrame) -> DataFrame:
    """(period, cash_in, cash_out, recognised_revenue, recognised_cost) by month, and in all with a null period. Cash includes transfers."""
    rows = cash.select("period", F.concat(F.lit("cash_"), F.col("direction")).alias("what"), "cents").unionByName(
        recognition.select("period", F.concat(F.lit("recognised_"), F.col("entry_kind")).alias("what"), "cents"))
    part = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("cents"))), F.lit(0)).alias(what)
    return rows.rollup("period").agg(*map(part, ("cash_in", "cash_out", "recognised_revenue", "recognised_cost")))


def columns(periods: DataFrame | None, entities: DataFrame | None = None) -> DataFrame:
    """(key, label) of a report's columns: its periods, or the entities (entity_id, name), eliminations and the consolidated total."""
    if entities is None:
        return periods.select(F.col("period").cast("string").alias("key"), month_label(F.col("period")).alias("label"))
    fixed = entities.sparkSession.createDataFrame([("eliminations", "Eliminações"), ("total", "Consolidado")], "key string, label string")
    return entities.select(F.concat(F.lit("entity-"), F.col("entity_id").cast("string")).alias("key"), F.col("name").alias("label")).unionByName(fixed)
