"""Which texts contain which patterns, by an index of three-letter grams in place of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; rows of an index up to which it is broadcast.
Q, FEW = 3, 1_000_000


def grams(text: Column, q: int) -> Column:
    """Different grams of q letters."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, F.lit(q)))
    return F.when(F.length(text) >= q, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _own(pattern: Column) -> Column:
    """Grams of a pattern; one of fewer letters is its own."""
    return F.when(F.length(pattern) < Q, F.array(pattern)).otherwise(grams(pattern, Q))


def _sizes(patterns: DataFrame, pattern: str) -> list[int]:
    """Lengths of grams that the patterns need: Q numbers at most."""
    return sorted(r[0] for r in patterns.where(F.length(pattern) > 0).select(F.least(F.length(pattern), F.lit(Q))).distinct().collect())


def _exploded(texts: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    return texts.withColumn("_gram", F.explode(F.concat(*[grams(F.col(text), q) for q in sizes])))


def hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def rarest(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, _gram, _texts): of each different pattern that isn't empty, the gram that the fewest texts have, and how many; patterns with a gram that no text has are left out, as none contains them."""
    sizes = _sizes(patterns, pattern)
    own = patterns.where(F.length(pattern) > 0).select(pattern).distinct().withColumn("_grams", _own(F.col(pattern)))
    each = own.select(pattern, F.size("_grams").alias("_of"), F.explode("_grams").alias("_gram"))
    if not sizes:
        return each.select(pattern, "_gram", F.lit(0).cast("long").alias("_texts"))
    wanted = hinted(each.select("_gram").distinct())
    counts = _exploded(texts.select(text), text, sizes).join(wanted, "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_texts"))
    found = each.join(counts, "_gram").groupBy(pattern).agg(F.max("_of").alias("_of"), F.count("*").alias("_found"), F.min(F.struct("_texts", "_gram")).alias("_least"))
    return found.where(F.col("_of") == F.col("_found")).select(pattern, "_least._gram", "_least._texts")


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, index: DataFrame | None = None) -> DataFrame:
    """(text, pattern): each different pattern that isn't empty with the texts (a column of different texts) that contain it.

    A pattern is looked up by one gram alone, the rarest among the texts; so a text meets the
    patterns that share a rare gram with it, and an exact test settles the rest. The
    index is one row a pattern: it is broadcast if that is few, and shuffled beyond.
    """
    sizes = _sizes(patterns, pattern)
    if not sizes:
        return texts.select(text).join(patterns.select(pattern).where("false"), F.lit(True))
    index = (index or rarest(texts, text, patterns, pattern)).select(pattern, "_gram")
    size = patterns.where(F.length(pattern) > 0).select(pattern).distinct().limit(FEW + 1).count()
    met = _exploded(texts.select(text), text, sizes).join(F.broadcast(index) if size <= FEW else index, "_gram")
    return met.where(F.col(text).contains(F.col(pattern))).select(text, pattern)


def beside(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every text with every pattern, for patterns that nothing tells apart (such as .*): patterns go to each of as many parts as there are shuffle partitions, texts to one."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = patterns.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return texts.withColumn("_part", F.pmod(F.xxhash64(*texts.columns), F.lit(parts)).cast("int")).join(each, "_part").drop("_part")


def required_literal(pattern: Column) -> Column:
    """Letters, digits and spaces (three or more, in upper case) that whatever a regular expression matches must have one after the other; null where it isn't plain to see.

    Escapes, classes, groups and signs break a run; what a quantifier may leave out goes, and
    alternatives, inline flags, quotes and numbered or named signs make it null.
    """
    cut = "\x01"
    plain = F.regexp_replace(pattern, r"\\.", cut)
    plain = F.regexp_replace(plain, r"\[[^\[\]]*\]", cut)
    for _ in range(4):
        plain = F.regexp_replace(plain, r"\([^()]*\)", cut)
    plain = F.regexp_replace(plain, r"[\s\S]?(\?|\*|\{[^}]*\})[?+]?", cut)
    runs = F.split(plain, "[^A-Za-z0-9 ]+")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
    clear = ~pattern.rlike(r"\||\(\?|\\[QEGxucpPkN0-9]") & ~plain.rlike(r"[\[\]()]")
    return F.when(clear & (longest["n"] >= Q), F.upper(longest["r"]))


def folded(text: Column) -> Column:
    """A text in which a required literal of a regular expression that ignores case is found as it stands."""
    return F.upper(F.lower(text))
