"""JSON documents: replies of models, and what changed between two versions of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bookkeeping fields that are no change.
IGNORED = ["updated_at", "updated_by", "created_at", "created_by", "dedup_hash"]


def extract_json(text: Column) -> Column:
    """The JSON of a reply: of its fenced block, or from its first bracket to its last; null where that does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(bare).isNotNull() & (bare != ""), bare)


def changed_fields(before: Column, after: Column) -> Column:
    """Array of (field, from, to), by field, of two JSON objects; empty where one is missing."""
    a, b = (F.from_json(x, "map<string,string>") for x in (before, after))
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("from"), y.alias("to")))
    kept = F.map_filter(both, lambda k, v: ~v["from"].eqNullSafe(v["to"]) & ~k.isin(IGNORED))
    rows = F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("field"), e["value"]["from"].alias("from"), e["value"]["to"].alias("to")))
    return F.coalesce(F.array_sort(rows), F.array().cast("array<struct<field:string,from:string,to:string>>"))
