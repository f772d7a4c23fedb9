"""Grouping sets against plain sums; merged sketches against exact figures, with their error bounds."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from duoledger.operators import levels


def test_levels_are_one_shuffle_and_nulls_are_values(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), rng.choice(["pessoal", None, "transferencias"]), rng.choice(["6.02", None]), rng.randrange(2), rng.randrange(100)) for _ in range(400)]
    df = spark.createDataFrame(data, "entity_id int, dre_group string, code string, period int, cents long")
    out = levels.statement_levels(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.level, r.entity_id, r.dre_group, r.code, r.period): (r.cents, r.n) for r in out.collect()}
    want = collections.defaultdict(lambda: (0, 0))
    for e, g, c, p, v in data:
        if g != "transferencias":
            for key in [("all", None, None, None, p), ("entity", e, None, None, p), ("block", e, g, None, p), ("category", e, g, c, p)]:
                want[key] = (want[key][0] + v, want[key][1] + 1)
    assert got == dict(want)
    assert levels.statement_levels(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="differ"):
        levels.grouped(df, {"a": ["code"], "b": ["code"]}, {"n": F.count("*")})


def test_merged_sketches_are_near(spark, tmp_path):
    """A hot key of 120,000 rows beside small ones: months are stored as sketches, merged, and compared with their rows."""
    rows = spark.range(130_000).select(F.when(F.col("id") < 120_000, 1).otherwise(F.col("id") % 9 + 2).alias("entity"), (F.col("id") % 12).alias("month"), (F.col("id") * 7919 % 50_021).alias("who"),
                                       (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("cents"), F.when(F.col("id") % 3 == 0, "often").otherwise((F.col("id") % 40_000).cast("string")).alias("what"))
    levels.sketched(rows, ["entity", "month"], "who", "cents", "what").write.parquet(str(tmp_path / "sketches"))
    found = {r.entity: r for r in levels.merged(spark.read.parquet(str(tmp_path / "sketches")), ["entity"]).collect()}
    exact = {r.entity: r for r in rows.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("who").alias("who"), F.sort_array(F.collect_list("cents")).alias("cents"), F.count(F.when(F.col("what") == "often", 1)).alias("often")).collect()}
    assert set(found) == set(exact)
    for k, e in exact.items():
        assert found[k].n == e.n and abs(found[k].distinct - e.who) <= max(1, 5 * 1.04 / 2 ** (levels.HLL / 2) * e.who)
        for share, value in zip((0.1, 0.5, 0.9), found[k].quantiles, strict=True):
            below, upto = sum(c < value for c in e.cents) / e.n, sum(c <= value for c in e.cents) / e.n
            assert below - 0.02 <= share <= upto + 0.02
        top = found[k].frequent[0]
        assert (top["item"] == "often") == (e.often > 0)
        assert not e.often or abs(top["count"] - e.often) <= e.n / (0.75 * levels.TRACKED)
    none = rows.where("false")
    assert levels.merged(levels.sketched(none, ["entity", "month"], "who", "cents", "what"), ["entity"]).count() == 0
    odd = spark.createDataFrame([(1, 1, None, None, None)], "entity int, month int, who long, cents long, what string")
    assert levels.merged(levels.sketched(odd, ["entity", "month"], "who", "cents", "what"), ["entity"]).select("n", "distinct").collect() == [(1, 0)]
