"""The seven reports as frames that a reader may take away: labels in place of ids, cents signed as the report shows them.

Each is in long form, one row for a line and a column; `sinks.matrix` turns it to one
row a line. A null period is the total of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import format_br, month_label, period_of
from . import cashflow, pl

#: Labels of the reports.
REPORTS = {"fluxo-de-caixa": "Fluxo de caixa", "dre": "DRE gerencial", "competencia": "Competência", "lancamentos": "Lançamentos", "receita": "Receita", "folha": "Folha por pessoa", "assinaturas": "Assinaturas"}
SECTIONS = {"in": "Entradas", "out": "Saídas", "transfer": "Transferências"}
LINES = {
    "receita_bruta": "Receita bruta", "deducoes": "Deduções", "custos_diretos": "Custos diretos", "pessoal": "Pessoal", "ferramentas": "Ferramentas e assinaturas", "servicos": "Serviços de terceiros",
    "viagem": "Viagem e representação", "outras": "Outras despesas", "financeiras": "Financeiras", "socios": "Sócios", "net-revenue": "Receita líquida", "gross-margin": "Margem bruta",
    "operating": "Total de despesas operacionais", "ebitda": "EBITDA", "result": "Resultado do período", "no-group": "Sem grupo de DRE"}
UNSORTED = "Sem categoria"


def named(values: dict[str, str], key: Column) -> Column:
    """The label of a key, or the key itself."""
    out = key
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def labels(rows: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """rows with out, the name that names (key, name) give its key; null without one. The join's strategy is left to Spark, as clients may be many."""
    return rows.join(names.select(key, F.col("name").alias(out)), key, "left")


def cash_flow(rows: DataFrame, accounts: DataFrame, chart: DataFrame, start: str, end: str) -> DataFrame:
    """(section, line, period, cents): opening, the categories of each section and its total, net movement, closing. Net has no total; opening's is the first, closing's the last."""
    cells = cashflow.matrix(rows, start, end)
    every = cells.unionByName(cells.groupBy("section", "line").agg(F.sum("cents").alias("cents")).withColumn("period", F.lit(None).cast("date")))
    codes = F.broadcast(chart.select(F.col("code").alias("line"), F.concat_ws(" ", "code", "name").alias("label")))
    title = named(SECTIONS, F.col("section"))
    label = F.when(F.col("line") == "total", F.concat(F.lit("Total de "), F.lower(title))).when(F.col("line") == "none", UNSORTED).otherwise(F.coalesce("label", "line"))
    body = every.join(codes, "line", "left").select(title.alias("section"), label.alias("line"), "period", "cents")
    months = cashflow.monthly(rows, accounts, start, end)
    frame = F.array(*[F.struct(F.lit(name).alias("line"), F.col(c).alias("cents")) for name, c in (("Saldo inicial", "opening"), ("Movimento líquido", "net"), ("Saldo final", "closing"))])
    frame = months.select("period", F.inline(frame))
    ends = frame.where("line <> 'Movimento líquido'").groupBy("line").agg(F.when(F.first("line") == "Saldo inicial", F.min_by("cents", "period")).otherwise(F.max_by("cents", "period")).alias("cents"))
    frame = frame.unionByName(ends.withColumn("period", F.lit(None).cast("date")))
    return body.unionByName(frame.withColumn("section", F.lit("")))


def profit_and_loss(recognition: DataFrame, chart: DataFrame) -> DataFrame:
    """(ord, line, period, cents): blocks, below each its categories indented, subtotals; the total of a line has a null period."""
    lines = pl.lines(recognition, "period").withColumns({"label": named(LINES, F.col("line")), "sub": F.lit("")})
    names = F.broadcast(chart.select("code", F.concat(F.lit("  "), "code", F.lit(" · "), "name").alias("label")))
    place = F.array_position(F.array(*map(F.lit, pl.LINES)), F.col("line")).cast("int")
    own = pl.category_lines(recognition, "period").join(names, "code", "left").select(place.alias("ord"), F.coalesce("label", F.lit("  Categoria removida")).alias("line"), F.coalesce("code", F.lit("~")).alias("sub"), "period", "cents")
    every = lines.select("ord", F.col("label").alias("line"), "sub", "period", "cents").unionByName(own)
    return with_total(every, ["ord", "line", "sub"])


def with_total(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, period, cents) and, with a null period, the sum of each key."""
    return rows.unionByName(rows.groupBy(*key).agg(F.sum("cents").alias("cents")).withColumn("period", F.lit(None).cast("date")))


def recognition_list(recognition: DataFrame, chart: DataFrame, clients: DataFrame) -> DataFrame:
    """(month, code, category, kind, client, source, edited, cents): rows of the recognition ledger, costs negative."""
    rows = recognition.join(F.broadcast(chart.select("category_id", F.col("name").alias("category"), F.col("code").alias("_code"))), "category_id", "left")
    rows = labels(rows, clients, "client_id", "client")
    revenue = F.col("entry_kind") == "revenue"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(month_label(F.col("period")).alias("month"), F.coalesce("_code", F.lit("")).alias("code"), blank("category"), F.when(revenue, "receita").otherwise("custo").alias("kind"), blank("client"), "source",
                       F.when(F.col("manually_edited"), "sim").otherwise("não").alias("edited"), F.when(revenue, F.col("cents")).otherwise(-F.col("cents")).alias("cents"))


def entry_list(entries: DataFrame, accounts: DataFrame, chart: DataFrame, clients: DataFrame) -> DataFrame:
    """(day, month, account, code, category, client, cents) of cash entries, outflows negative; no row cap."""
    rows = entries.join(F.broadcast(chart.select("category_id", F.col("name").alias("category"), "code")), "category_id", "left")
    rows = labels(labels(rows, accounts, "account_id", "account"), clients, "client_id", "client")
    return rows.select(format_br(F.col("occurred_on")).alias("day"), month_label(F.coalesce("competence_period", period_of(F.col("occurred_on")))).alias("month"), F.coalesce("account", F.lit("")).alias("account"),
                       F.coalesce("code", F.lit("")).alias("code"), F.when(F.col("category_id").isNull(), UNSORTED).otherwise(F.coalesce("category", F.lit(""))).alias("category"), F.coalesce("client", F.lit("")).alias("client"),
                       F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents")).alias("cents"))


def revenue(recognition: DataFrame, clients: DataFrame, start: str, end: str) -> DataFrame:
    """(client, period, cents) of recognised revenue in the range; clients without a name are gone, a null client is none. Clients of one name stay apart by id."""
    own = recognition.where((F.col("entry_kind") == "revenue") & F.col("period").between(start, end)).groupBy("client_id", "period").agg(F.sum("cents").alias("cents"))
    return labels(own, clients, "client_id", "client").select("client_id", F.when(F.col("client_id").isNull(), "Sem cliente").otherwise(F.coalesce("client", F.lit("Cliente removido"))).alias("client"), "period", "cents")


def backlog(deferred: DataFrame, contracts: DataFrame, clients: DataFrame) -> DataFrame:
    """(contract_id, client, contracted, recognised, to_recognise, to_invoice) of contracts active or completed; sums of zero are left blank."""
    own = labels(contracts.where(F.col("status").isin("active", "completed")).select("contract_id", "client_id"), clients, "client_id", "client")
    return own.join(deferred, "contract_id").select("contract_id", F.coalesce("client", F.lit("")).alias("client"), "contracted", "recognised", F.expr("nullif(to_recognise, 0)").alias("to_recognise"), F.expr("nullif(to_invoice, 0)").alias("to_invoice"))


def payroll(recognition: DataFrame, people: DataFrame, start: str, end: str) -> DataFrame:
    """(person_id, person, role, period, cents) of costs with a person."""
    own = recognition.where((F.col("entry_kind") == "cost") & F.col("person_id").isNotNull() & F.col("period").between(start, end)).groupBy("person_id", "period").agg(F.sum("cents").alias("cents"))
    return own.join(people.select("person_id", F.col("name").alias("person"), "role"), "person_id", "left").select("person_id", F.coalesce("person", F.lit("Pessoa removida")).alias("person"), F.coalesce("role", F.lit("")).alias("role"), "period", "cents")


def subscriptions(found: DataFrame, key: str) -> DataFrame:
    """(supplier, cadence, charges, last, active, monthly, yearly) of detected subscriptions."""
    return found.select(F.col(key).cast("string").alias("supplier"), "cadence", "charges", format_br(F.col("last_on")).alias("last"), F.when(F.col("active"), "sim").otherwise("não").alias("active"),
                        F.col("monthly_cost").alias("monthly"), (F.col("monthly_cost") * 12).alias("yearly"))


def file_name(entity: str, report: str, start: str, end: str, sheets: list[str], fmt: str) -> str:
    """Name of a report's file; a text file holds the first sheet alone and says which, where there are more."""
    from ..sources.sinks import slug

    base = f"{entity}_{report}_{start[:7]}_{end[:7]}"
    return f"{base}_{slug(sheets[0])}.csv" if fmt == "csv" and len(sheets) > 1 else f"{base}.{fmt}"
