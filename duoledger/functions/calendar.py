"""Calendar periods: a period is the first day of a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short month names of reports.
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
LONG_MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def period_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def add_months(day: Column, n: Column | int) -> Column:
    return F.add_months(day, n)


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months from a's month to b's."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def each_period(start: Column, end: Column) -> Column:
    """All periods from start's to end's; none where start is later."""
    a, b = period_of(start), period_of(end)
    return F.when(a <= b, F.sequence(a, F.greatest(a, b), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def covered_days(period: Column, start: Column, end: Column) -> Column:
    """Days of the period's month in the term from start to end (open where null)."""
    last = F.last_day(period)
    return F.greatest(F.lit(0), F.datediff(F.least(F.coalesce(end, last), last), F.greatest(start, period)) + 1)


def month_label(period: Column, long: bool = False) -> Column:
    """abr/26, or abril de 2026."""
    name = F.element_at(F.array(*map(F.lit, LONG_MONTHS if long else MONTHS)), F.month(period))
    return F.concat(name, F.lit(" de "), F.year(period).cast("string")) if long else F.concat(name, F.lit("/"), F.lpad((F.year(period) % 100).cast("string"), 2, "0"))


def parse_iso(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_br(text: Column) -> Column:
    """d/m/yyyy; null where there is no such day."""
    return F.when(F.trim(text).rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(F.trim(text), "d/M/yyyy"))


def format_br(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def excel_serial(n: Column) -> Column:
    """The day of a spreadsheet's serial number, whose calendar has a 29 February 1900."""
    return F.date_add(F.lit("1899-12-31").cast("date"), (n - F.when(n > 59, 1).otherwise(0)).cast("int"))


def card_date(day_month: Column, reference: Column) -> Column:
    """dd/mm of a card bill: in the reference's year, or the one before where that is later than the reference."""
    day, month = (F.regexp_extract(day_month, r"^(\d{2})/(\d{2})$", k).try_cast("int") for k in (1, 2))
    this = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(reference), month, day), "yyyy-MM-dd")
    before = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(reference) - 1, month, day), "yyyy-MM-dd")
    return F.when(this <= reference, this).otherwise(before)


def local_day(at: Column) -> Column:
    """The day in São Paulo of a moment (a timestamp in UTC)."""
    return F.from_utc_timestamp(at, "America/Sao_Paulo").cast("date")


def today(as_of: str | None = None) -> Column:
    """The day of a report: given, or that of the clock in São Paulo."""
    return F.lit(as_of).cast("date") if as_of else local_day(F.current_timestamp())


def period_axis(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(each_period(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("period"))


def period_param(text: Column, default: Column) -> Column:
    """The month of YYYY-MM, or the default where the text is none."""
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")), default)
