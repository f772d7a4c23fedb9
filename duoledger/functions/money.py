"""Exact money on integer cents: half-up division, ratios, allocation, parsing, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a whole in thousandths of a percent.
FULL = 100_000


def cents(amount: Column) -> Column:
    """Cents of a double or decimal amount."""
    return F.round(amount * 100).cast("long")


def to_numeric(c: Column) -> Column:
    return (c.cast("decimal(38,0)") / 100).cast("decimal(14,2)")


def div_half_up(n: Column, d: Column) -> Column:
    """n / d, halves away from zero; a zero divisor is an error."""
    return mul_ratio(n, F.lit(1), d)


def mul_ratio(v: Column, n: Column, d: Column) -> Column:
    """v * n / d, rounded once."""
    v, n, d = (x.cast("long") for x in (v, n, d))
    product = v.cast("decimal(38,0)") * n.cast("decimal(19,0)")
    negative = (product < 0) != (d < 0)
    twice = F.abs(product).cast("decimal(37,0)") * 2 + F.abs(d).cast("decimal(19,0)")
    whole = (twice - F.pmod(twice, F.abs(d).cast("decimal(19,0)") * 2)) / (F.abs(d).cast("decimal(19,0)") * 2)
    return F.when(negative, -whole).otherwise(whole).cast("long")


def basis_points(part: Column, whole: Column) -> Column:
    """part / whole in hundredths of a percent; null of nothing."""
    return F.when(whole != 0, mul_ratio(part, F.lit(10_000), F.when(whole != 0, whole)))


def allocate(rows: DataFrame, key: list[str], order: str, total: str, weight: str, out: str = "share") -> DataFrame:
    """Split each key's total over its rows by weight: truncated parts, then one cent each by largest remainder, ties in order.

    The parts of a key sum to its total. Keys whose weights sum to zero get nulls.
    """
    w = Window.partitionBy(*key)
    amount, own = F.abs(F.col(total)).cast("decimal(38,0)"), F.col(weight).cast("decimal(18,0)")
    rows = rows.withColumn("_sum", F.sum(F.col(weight)).over(w).cast("decimal(18,0)"))
    product = (amount.cast("decimal(19,0)") * own).cast("decimal(38,0)")
    rows = rows.withColumn("_rest", F.when(F.col("_sum") != 0, F.pmod(product, F.col("_sum"))))
    rows = rows.withColumn("_part", F.when(F.col("_sum") != 0, ((product - F.col("_rest")) / F.col("_sum")).cast("long")))
    left = (F.abs(F.col(total)) - F.sum("_part").over(w)).cast("long")
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), F.col(order)))
    part = F.col("_part") + F.when(rank <= left, 1).otherwise(0)
    return rows.withColumn(out, F.when(F.col(total) < 0, -part).otherwise(part).cast("long")).drop("_sum", "_rest", "_part")


def allocate_listed(rows: DataFrame, total: str, weights: str, out: str = "shares") -> DataFrame:
    """As allocate, of rows that list their weights: an array of shares, of earlier weights first where remainders tie. Nothing is shuffled; weights sum to less than 3e9."""
    rows = rows.withColumn("_s", F.expr(f"nullif(aggregate({weights}, 0L, (a, w) -> a + w), 0L)"))
    rows = rows.withColumns({"_q": F.expr(f"abs({total}) div _s"), "_r": F.expr(f"abs({total}) % _s")})
    rows = rows.withColumn("_rests", F.expr(f"transform({weights}, (w, i) -> named_struct('less', -((_r * w) % _s), 'i', i))"))
    rows = rows.withColumn("_up", F.expr("transform(slice(array_sort(_rests), 1, cast(aggregate(_rests, 0L, (a, x) -> a - x.less) div _s as int)), x -> x.i)"))
    part = F.expr(f"transform({weights}, (w, i) -> sign({total}) * (_q * w + (_r * w) div _s + if(array_contains(_up, i), 1, 0)))").cast("array<long>")
    return rows.withColumn(out, part).drop("_s", "_q", "_r", "_rests", "_up")


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse_money(text: Column, separator: str | None = None) -> Column:
    """Cents of a money string: R$, parentheses, a trailing D or C, signs, and a declared or inferred decimal sign; null where it is none."""

    def signs(t: Column) -> Column:
        inside = F.regexp_replace(t, r"^\((.*)\)$", "$1")
        return let(F.struct(t.rlike(r"^\(.*\)$").alias("parens"), F.trim(inside).alias("t")), bare)

    def bare(x: Column) -> Column:
        debit = x["t"].rlike(r"\s[Dd]$")
        t = F.regexp_replace(F.regexp_replace(x["t"], r"\s[DCdc]$", ""), r"(?i)R\$|[\s\x{00A0}]", "")
        return let(F.struct((x["parens"] | debit).alias("negative"), t.startswith("-").alias("minus"), F.regexp_replace(t, r"^[+-]", "").alias("t")), number)

    def number(x: Column) -> Column:
        t = x["t"]
        last = lambda sign: F.length(t) - F.instr(F.reverse(t), sign)  # noqa: E731  signs before the last of its kind
        if separator is None:
            commas, dots = (F.length(t) - F.length(F.translate(t, c, "")) for c in (",", "."))
            place = (F.when((commas > 0) & (dots > 0), F.greatest(last(","), last("."))).when(commas == 1, last(","))
                     .when((commas == 0) & (dots == 1) & (F.instr(F.reverse(t), ".") != 4), last(".")))
        else:
            place = F.when(F.instr(t, separator) > 0, last(separator))
        own = let(F.coalesce(place, F.length(t)), lambda at: F.struct(F.translate(t.substr(F.lit(1), at), ".,", "").alias("whole"), F.translate(t.substr(at + 2, F.lit(60)), ".,", "").alias("rest")))
        value = let(own, amount)
        return F.when(t.rlike(r"^[0-9.,]+$"), F.when(x["negative"] != x["minus"], -value).otherwise(value))

    def amount(x: Column) -> Column:
        padded = F.rpad(x["rest"], 3, "0")
        up = (F.length(x["rest"]) > 2) & (padded.substr(3, 1).try_cast("int") >= 5)
        return F.coalesce(x["whole"].try_cast("long"), F.lit(0)) * 100 + padded.substr(1, 2).try_cast("int") + F.when(up, 1).otherwise(0)

    return let(F.trim(text), signs).cast("long")


def format_money(c: Column) -> Column:
    """-1.234,56: sign before the digits, points between thousands."""
    shown = F.translate(F.call_function("format_number", F.abs(c).cast("decimal(20,0)") / 100, F.lit("#,##0.00")), ",.", ".,")
    return F.concat(F.when(c < 0, "-").otherwise(""), shown)


def format_brl(c: Column) -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("R$ "), format_money(F.abs(c)))


def parse_percent(text: Column) -> Column:
    """Thousandths of a percent; further digits are cut; null where it is no percent."""
    t = F.translate(F.regexp_replace(F.trim(text), r"\s*%$", ""), ",", ".")
    n = F.regexp_extract(t, r"^(-?)(\d+)(?:\.(\d*))?$", 2)
    part = F.rpad(F.regexp_extract(t, r"^(-?)(\d+)(?:\.(\d*))?$", 3).substr(1, 3), 3, "0")
    value = n.try_cast("long") * 1000 + part.try_cast("long")
    return F.when(t.rlike(r"^-?\d+(\.\d*)?$"), F.when(t.startswith("-"), -value).otherwise(value))
