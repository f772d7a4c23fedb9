"""Prompts for a language model, and its replies as rows that are checked before anything is believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import extract_json

REPLY = "array<struct<ref:string,category_code:string,client_id:string,person_id:string,confidence:double,reasoning:string>>"
#: Fields of a contract draft, as replies name them; kinds of contract; signs of a snippet that are kept.
DRAFT = ["clientName", "name", "type", "totalValue", "monthlyValue", "startDate", "endDate", "billingTerms", "paymentTerms", "scope"]
KINDS, SNIPPET = ["retainer", "project"], 400


def prompt_batches(subjects: DataFrame, size: int = 120) -> DataFrame:
    """(batch, prompt): lines of undecided subjects (import_id, ref, description), `size` at a time. Amounts are never told."""
    order = Window.partitionBy("import_id").orderBy("ref")
    rows = subjects.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    line = F.concat(F.col("ref").cast("string"), F.lit(": "), F.col("description"))
    lines = F.array_sort(F.collect_list(F.struct("ref", line.alias("line"))))
    return rows.groupBy("import_id", "batch").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


#: Signs of a contract that a model reads at most, and the note that there are more. The limit is the model's.
CONTRACT_SIGNS, CUT = 60_000, "[...documento truncado...]"


def contract_rules() -> str:
    """What a model is told before a contract."""
    return f"""Extract the main terms of a service contract. Reply with one JSON object and nothing else.
Each field found is {{"value": ..., "snippet": ...}}: the value as the contract writes it, neither converted nor computed, and the words it stands in, 200 signs at most.
Leave out what the contract does not say. Dates stay as written. type is one of: {", ".join(KINDS)}.
Fields: {", ".join(DRAFT)}."""


def contract_prompts(contracts: DataFrame) -> DataFrame:
    """(id, prompt) of contract texts (id, text); contract_rules() goes before each as the system's part."""
    t = F.trim("text")
    cut = F.when(F.length(t) > CONTRACT_SIGNS, F.concat(t.substr(1, CONTRACT_SIGNS), F.lit(f"\n\n{CUT}"))).otherwise(t)
    return contracts.select("id", F.concat(F.lit("CONTRATO\n\n"), F.coalesce(cut, F.lit(""))).alias("prompt"))


def open_subjects(staged: DataFrame) -> DataFrame:
    """Staged rows (status, suggested_category_id, ...) that a model may be asked about: pending, and without a suggestion."""
    return staged.where("status = 'pending' and suggested_category_id is null")


def checked_replies(replies: DataFrame, subjects: DataFrame, chart: DataFrame) -> DataFrame:
    """(import_id, ref, category_code, confidence, reason) of each suggestion in (import_id, reply); reason is null where it may be used.

    Unknown references and codes, repeated references and confidences outside 0 to 1 are
    refused, each with its reason; a reply without JSON is one refused row.
    """
    found = F.from_json(extract_json(F.col("reply")), REPLY)
    rows = replies.select("import_id", F.posexplode_outer(found).alias("at", "s")).select("import_id", "at", "s.*")
    rows = rows.join(subjects.select("import_id", F.col("ref").cast("string").alias("ref"), F.lit(True).alias("known")), ["import_id", "ref"], "left")
    rows = rows.join(F.broadcast(chart.select(F.col("code").alias("category_code"), F.lit(True).alias("coded")).distinct()), "category_code", "left")
    again = F.row_number().over(Window.partitionBy("import_id", "ref").orderBy("at")) > 1
    reason = (F.when(F.col("at").isNull(), "no json").when(F.col("known").isNull(), "unknown ref").when(again, "repeated ref").when(F.col("coded").isNull(), "unknown code")
              .when(F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)), "bad confidence"))
    return rows.select("import_id", "ref", "category_code", "confidence", reason.alias("reason"))


def _text(v: Column) -> Column:
    """A JSON value as text: of a string what is left without the spaces around it, of a number its shortest form; null for anything else, and for nothing."""
    kind, said = F.schema_of_variant(v), F.trim(F.try_variant_get(v, "$", "string"))
    number = F.try_variant_get(v, "$", "double")
    short = F.when(number == F.floor(number), F.try_variant_get(v, "$", "decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    return F.when((kind == "STRING") & (said != ""), said).when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.coalesce(short, number.cast("string")))


def contract_draft(replies: DataFrame) -> DataFrame:
    """(id, field, value, snippet, missing, warning) of the ten fields of each draft reply (id, reply).

    A field is an object of value and snippet, or a bare value, which has no snippet. Null,
    blank and other values are missing, and so is a type that is neither of KINDS. Without a
    JSON object, all are missing.

    warning: no snippet (the value can't be checked against the contract), unknown type, or null.
    """
    whole = F.try_parse_json(extract_json(F.col("reply")))
    rows = replies.select("id", whole.alias("d")).select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.try_variant_get("d", f"$.{n}", "variant").alias("v")) for n in DRAFT])).alias("r")).select("id", "r.*")
    held = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    value = F.when(held, _text(F.try_variant_get("v", "$.value", "variant"))).otherwise(_text(F.col("v")))
    rows = rows.select("id", "field", value.alias("value"), F.substring(F.when(held, _text(F.try_variant_get("v", "$.snippet", "variant"))), 1, SNIPPET).alias("snippet"))
    strange = (F.col("field") == "type") & ~F.col("value").isin(KINDS)
    warning = F.when(strange, "unknown type").when(F.col("value").isNotNull() & F.col("snippet").isNull(), "no snippet")
    return rows.select("id", "field", F.when(~F.coalesce(strange, F.lit(False)), F.col("value")).alias("value"), F.when(F.col("value").isNotNull() & ~F.coalesce(strange, F.lit(False)), F.col("snippet")).alias("snippet"), warning.alias("warning")).select(
        "id", "field", "value", "snippet", F.col("value").isNull().alias("missing"), "warning")


def draft_warnings(replies: DataFrame) -> DataFrame:
    """(id, warning) of replies as wholes: no json, no object, no fields; those that are neither have no row."""
    own = replies.select("id", F.schema_of_variant(F.try_parse_json(extract_json(F.col("reply")))).alias("kind"))
    found = contract_draft(replies).groupBy("id").agg(F.max(~F.col("missing")).alias("any"))
    warning = F.when(F.col("kind").isNull(), "no json").when(~F.col("kind").startswith("OBJECT"), "no object").when(~F.col("any"), "no fields")
    return own.join(found, "id").select("id", warning.alias("warning")).where("warning is not null")
