"""Queries of several levels at once, and of merged sketches beside their exact twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..operators import levels
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from ..sources.store import written
from .accrual import MIRROR, recognition
from .registry import query


@query("a33_statement_levels", MIRROR + """ SELECT CASE grouping_id(entity_id, dre_group, code) WHEN 7 THEN 'all' WHEN 3 THEN 'entity' WHEN 1 THEN 'block' ELSE 'category' END AS level, entity_id, dre_group, code, period, sum(cents)::BIGINT AS cents, count(*)::BIGINT AS n
FROM recognition WHERE coalesce(dre_group, '') <> 'transferencias' GROUP BY GROUPING SETS ((period), (entity_id, period), (entity_id, dre_group, period), (entity_id, dre_group, code, period))""")
def a33_levels(spark, sf_dir):
    return levels.statement_levels(recognition(spark, sf_dir))


@query("a33_cube", SQL_LEDGER + """ SELECT CASE grouping_id(entity_id, direction, kind) WHEN 0 THEN 'each' WHEN 1 THEN 'entity, direction' WHEN 2 THEN 'entity, kind' WHEN 4 THEN 'direction, kind' WHEN 3 THEN 'entity' WHEN 5 THEN 'direction' WHEN 6 THEN 'kind' ELSE 'all' END AS level,
  entity_id, direction, kind, sum(cents)::BIGINT AS cents FROM entries LEFT JOIN chart USING (category_id) GROUP BY CUBE (entity_id, direction, kind)""")
def a33_cube(spark, sf_dir):
    """All eight sums by entity, direction and kind; entries without a category have a null kind, which is not the null of a sum."""
    e = proxy.entries(spark, sf_dir).join(F.broadcast(proxy.chart(spark).select("category_id", "kind")), "category_id", "left")
    a, b, c = "entity_id", "direction", "kind"
    sets = {"each": [a, b, c], "entity, direction": [a, b], "entity, kind": [a, c], "direction, kind": [b, c], "entity": [a], "direction": [b], "kind": [c], "all": []}
    return levels.grouped(e, sets, {"cents": F.sum("cents")})


@query("a33_rollup", SQL_LEDGER + """, own AS (SELECT entity_id, year(occurred_on) AS year, CAST(date_trunc('month', occurred_on) AS DATE) AS period, CASE WHEN direction = 'in' THEN cents ELSE -cents END AS cents FROM entries)
SELECT CASE grouping_id(entity_id, year, period) WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 3 THEN 'entity' ELSE 'all' END AS level, entity_id, year::INTEGER AS year, period, sum(cents)::BIGINT AS net FROM own GROUP BY ROLLUP (entity_id, year, period)""")
def a33_rollup(spark, sf_dir):
    """Net cash of each month, year and entity, and of all."""
    e = proxy.entries(spark, sf_dir).select("entity_id", F.year("occurred_on").alias("year"), period_of(F.col("occurred_on")).alias("period"), F.when(F.col("direction") == "in", F.col("cents")).otherwise(-F.col("cents")).alias("cents"))
    return levels.grouped(e, {"month": ["entity_id", "year", "period"], "year": ["entity_id", "year"], "entity": ["entity_id"], "all": []}, {"net": F.sum("cents")})


def _entity_years(spark, sf_dir):
    """Monthly sketches, stored, and merged by entity and year; beside them, the exact figures."""
    e = proxy.entries(spark, sf_dir).select("entity_id", period_of(F.col("occurred_on")).alias("period"), "account_id", "cents", "category_id")
    monthly = written(levels.sketched(e, ["entity_id", "period"], "account_id", "cents", "category_id"), "sketches")
    return e.withColumn("year", F.year("period")), levels.merged(monthly.withColumn("year", F.year("period")), ["entity_id", "year"])


YEARS = SQL_LEDGER + ", own AS (SELECT entity_id, year(occurred_on)::INTEGER AS year, account_id, cents, category_id FROM entries) "


@query("a33_distinct_accounts", YEARS + "SELECT entity_id, year, count(*)::BIGINT AS n, count(DISTINCT account_id)::BIGINT AS accounts, true AS near FROM own GROUP BY ALL")
def a33_distinct(spark, sf_dir):
    """Accounts that moved in a year, exactly, and whether the estimate of merged monthly sketches is within five standard errors (8 %) or one."""
    own, found = _entity_years(spark, sf_dir)
    exact = own.groupBy("entity_id", "year").agg(F.countDistinct("account_id").alias("accounts"))
    return exact.join(found, ["entity_id", "year"]).select("entity_id", "year", "n", "accounts", (F.abs(F.col("distinct") - F.col("accounts")) <= F.greatest(F.lit(1), 0.08 * F.col("accounts"))).alias("near"))


@query("a33_quantiles", YEARS + "SELECT entity_id, year, quantile_disc(cents, 0.5)::BIGINT AS median, true AS near FROM own GROUP BY ALL")
def a33_quantiles(spark, sf_dir):
    """A year's median amount (the lower one), and whether the merged sketch's median, tenth and nine tenths have ranks within 4 % of all."""
    own, found = _entity_years(spark, sf_dir)
    beside = own.join(F.broadcast(found.select("entity_id", "year", "quantiles")), ["entity_id", "year"])  # a row for each entity and year
    below = [F.avg((F.col("cents") < F.col("quantiles")[k]).cast("double")) for k in range(3)]
    upto = [F.avg((F.col("cents") <= F.col("quantiles")[k]).cast("double")) for k in range(3)]
    near = F.lit(True)
    for k, share in enumerate((0.1, 0.5, 0.9)):
        near = near & (below[k] <= share + 0.04) & (upto[k] >= share - 0.04)
    return beside.groupBy("entity_id", "year").agg(F.expr("percentile_disc(0.5) within group (order by cents)").cast("long").alias("median"), near.alias("near"))


@query("a33_frequent_categories", YEARS + """, c AS (SELECT entity_id, year, category_id, count(*) AS n FROM own WHERE category_id IS NOT NULL GROUP BY ALL)
SELECT entity_id, year, max(n)::BIGINT AS most, true AS exact FROM c GROUP BY ALL""")
def a33_frequent(spark, sf_dir):
    """How often the commonest category of a year stands, and whether the merged sketch says the same (categories are fewer than it tracks, so it must)."""
    own, found = _entity_years(spark, sf_dir)
    counts = own.where("category_id is not null").groupBy("entity_id", "year", "category_id").count().groupBy("entity_id", "year").agg(F.max("count").alias("most"))
    return counts.join(found, ["entity_id", "year"]).select("entity_id", "year", "most", (F.col("frequent")[0]["count"] == F.col("most")).alias("exact"))
