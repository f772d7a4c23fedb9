"""What people type into fields, read as columns: a value, and whether it was one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import parse_iso
from .money import parse_money


def _typed(text: Column) -> Column:
    """Trimmed; null where nothing was typed."""
    t = F.trim(text)
    return F.when(t != "", t)


def _read(value: Column, ok: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def required_text(text: Column) -> Column:
    return _read(_typed(text), _typed(text).isNotNull())


def day(text: Column) -> Column:
    d = parse_iso(_typed(text))
    return _read(d, d.isNotNull())


def optional_month(text: Column) -> Column:
    """YYYY-MM, or the first day of a month; nothing typed is a null that is fine."""
    t = _typed(text)
    d = parse_iso(F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).otherwise(t))
    d = F.when(F.dayofmonth(d) == 1, d)
    return _read(d, t.isNull() | d.isNotNull())


def money(text: Column, optional: bool = False) -> Column:
    """Cents; nothing typed is zero where money is optional."""
    c = parse_money(_typed(text))
    c = F.when(_typed(text).isNull(), F.lit(0).cast("long")).otherwise(c) if optional else c
    return _read(c, c.isNotNull())


def choice(text: Column, allowed: list[str]) -> Column:
    t = F.coalesce(F.trim(text), F.lit(""))
    return _read(t, t.isin(allowed))


def integer(text: Column, fallback: int) -> Column:
    """The whole number that the text begins with, or the fallback: never an error."""
    n = F.regexp_extract(F.coalesce(F.trim(text), F.lit("")), r"^([+-]?\d+)", 1).try_cast("long")
    return F.coalesce(n, F.lit(fallback).cast("long"))


def ticked(text: Column) -> Column:
    return F.coalesce(text.isin("on", "true", "1"), F.lit(False))
