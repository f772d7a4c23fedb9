"""Queries in the order of time: as-of and interval joins, payments and bills, scans of hot keys, ranks, RANGE frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import cents
from ..operators import intervals, scans, settle, staging
from ..sources import proxy
from ..sources.proxy import SQL_LEDGER
from .registry import query

#: Daily balances that some accounts declare; all accounts of an even number share account 0, which so has most rows.
DECLARED = """WITH moved AS (SELECT event_id, user_id % 2 * user_id AS account_id, ts, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS cents FROM events),
daily AS (SELECT account_id, day, sum(cents)::BIGINT AS moved FROM moved GROUP BY ALL)"""


def moved(spark, sf_dir):
    e = proxy.table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", -cents(F.col("value"))).otherwise(cents(F.col("value")))
    return e.select("event_id", (F.col("user_id") % 2 * F.col("user_id")).alias("account_id"), "ts", F.col("ts").cast("date").alias("day"), amount.alias("cents"))


@query("j18_as_of", DECLARED + """, rates AS (SELECT account_id, ts AS rated_at, cents AS rate FROM moved WHERE event_id % 7 = 0)
SELECT event_id, rated_at, rate FROM moved m ASOF LEFT JOIN rates r ON m.account_id = r.account_id AND m.ts >= r.rated_at""")
def j18_as_of(spark, sf_dir):
    """Every movement with the last rated one of its account at or before it."""
    m = moved(spark, sf_dir)
    rates = m.where("event_id % 7 = 0").select("account_id", F.col("ts").alias("rated_at"), F.col("cents").alias("rate"))
    return scans.as_of(m.select("event_id", "account_id", "ts"), rates, ["account_id"], "ts", "rated_at", ["rated_at", "rate"]).select("event_id", "rated_at", "rate")


@query("j18_as_of_next", DECLARED + """, rates AS (SELECT account_id, ts AS rated_at, cents AS rate FROM moved WHERE event_id % 7 = 0),
found AS (SELECT event_id, ts, rated_at, rate FROM moved m ASOF LEFT JOIN rates r ON m.account_id = r.account_id AND m.ts < r.rated_at)
SELECT event_id, CASE WHEN rated_at <= ts + INTERVAL 6 HOUR THEN rated_at END AS rated_at, CASE WHEN rated_at <= ts + INTERVAL 6 HOUR THEN rate END AS rate FROM found""")
def j18_as_of_next(spark, sf_dir):
    """Every movement with the first rated one of its account after it, six hours later at most."""
    m = moved(spark, sf_dir)
    rates = m.where("event_id % 7 = 0").select("account_id", F.col("ts").alias("rated_at"), F.col("cents").alias("rate"))
    return scans.as_of(m.select("event_id", "account_id", "ts"), rates, ["account_id"], "ts", "rated_at", ["rated_at", "rate"], strict=True, forward=True, within="6 hours").select("event_id", "rated_at", "rate")


@query("j18_interval", SQL_LEDGER + """, terms AS (SELECT o_orderkey AS contract_id, o_custkey % 10 AS account_id, CAST(o_orderdate AS DATE) AS starts_on, CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 - 1 AS INTEGER) AS ends_on FROM orders WHERE o_custkey % 3 = 0)
SELECT t.contract_id, count(*)::BIGINT AS n, sum(e.cents)::BIGINT AS cents FROM terms t JOIN entries e ON e.account_id = t.account_id AND e.occurred_on BETWEEN t.starts_on AND t.ends_on WHERE e.direction = 'out' GROUP BY 1""")
def j18_interval(spark, sf_dir):
    """What left the account of each contract during its term."""
    o = proxy.table(spark, sf_dir, "orders").where("o_custkey % 3 = 0")
    starts = intervals.day_number(F.col("o_orderdate"))
    terms = o.select(F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 10).alias("account_id"), starts.alias("starts_on"), (starts + F.col("o_custkey") % 120 - 1).alias("ends_on"))
    e = proxy.entries(spark, sf_dir).where("direction = 'out'").select("account_id", "cents", intervals.day_number(F.col("occurred_on")).alias("day"))
    return intervals.in_interval(e, terms, ["account_id"], "day", "starts_on", "ends_on").groupBy("contract_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


PAIRS = """WITH RECURSIVE bills AS (SELECT event_id AS id, user_id % 2 * user_id AS account_id, CAST(round(value) AS BIGINT) * 100 AS cents, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'click')),
payments AS (SELECT event_id AS id, user_id % 2 * user_id AS account_id, CAST(round(value) AS BIGINT) * 100 AS cents, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'error')),
pool AS (SELECT id, account_id, cents, day, 0 AS side FROM bills UNION ALL SELECT id, account_id, cents, day, 1 FROM payments),
rounds AS (
  SELECT id, account_id, cents, day, side, 0 AS round, CAST(NULL AS BIGINT) AS mate, CAST(NULL AS DATE) AS mate_day FROM pool
  UNION ALL
  SELECT id, account_id, cents, day, side, round + 1, CASE WHEN side = 1 AND before.side = 0 THEN before.id WHEN side = 0 AND after.side = 1 THEN after.id END, CASE WHEN side = 1 AND before.side = 0 THEN before.day WHEN side = 0 AND after.side = 1 THEN after.day END
  FROM (SELECT id, account_id, cents, day, side, round, lag(struct_pack(side := side, id := id, day := day)) OVER w AS before, lead(struct_pack(side := side, id := id, day := day)) OVER w AS after,
          bool_or(side = 0) OVER u AS opened FROM rounds WHERE mate IS NULL WINDOW w AS (PARTITION BY account_id, cents ORDER BY day, side, id), u AS (PARTITION BY account_id, cents)) WHERE round < 300 AND opened),
final AS (SELECT id, side, max_by(mate, round) AS mate, max_by(mate_day, round) AS mate_day, any_value(account_id) AS account_id, any_value(cents) AS cents, any_value(day) AS day FROM rounds GROUP BY id, side),
judged AS (SELECT *, mate IS NOT NULL AND abs(date_diff('day', day, mate_day)) <= 10 AS pair FROM final)
SELECT id AS payment_id, CASE WHEN pair THEN mate END AS bill_id, account_id, cents, day AS paid_on, CASE WHEN pair THEN mate_day END AS billed_on, CASE WHEN pair THEN date_diff('day', mate_day, day) END::INTEGER AS days, CASE WHEN pair THEN 'paired' ELSE 'payment only' END AS outcome FROM judged WHERE side = 1
UNION ALL SELECT NULL, id, account_id, cents, NULL, day, NULL, 'bill only' FROM judged WHERE side = 0 AND NOT pair"""


@query("j17_payment_to_bill", PAIRS)
def j17(spark, sf_dir):
    """Views and clicks as bills, purchases and errors as payments of equal whole amounts, ten days apart at most; the SQL goes round by round."""
    e = proxy.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 2 * F.col("user_id")).alias("account_id"), (F.round("value").cast("long") * 100).alias("cents"), F.col("ts").cast("date").alias("day"), "event_type")
    return settle.pair_payments(rows.where("event_type in ('purchase', 'error')").drop("event_type"), rows.where("event_type in ('view', 'click')").drop("event_type"), 10)


@query("w8_hot_statement", DECLARED + """, run AS (SELECT *, sum(moved) OVER (PARTITION BY account_id ORDER BY day) AS run FROM daily),
d AS (SELECT *, CASE WHEN day(day) % 3 = 0 THEN run + CASE WHEN day(day) % 6 = 0 THEN 5 ELSE 0 END END AS actual FROM run),
a AS (SELECT *, last_value(CASE WHEN actual IS NOT NULL THEN actual - run END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM d)
SELECT account_id, day, (gap + run)::BIGINT AS expected, actual::BIGINT AS actual, (actual - gap - run)::BIGINT AS difference FROM a WHERE actual IS NOT NULL AND gap IS NOT NULL""")
def w8_hot(spark, sf_dir):
    """Statements of which one account has most rows, by blocks."""
    m = moved(spark, sf_dir).select("account_id", "day", F.col("cents").alias("signed_cents"))
    daily = m.groupBy("account_id", "day").agg(F.sum("signed_cents").alias("moved"))
    run = scans.running(scans.blocked(daily, ["account_id"], ["day"]), ["account_id"], ["day"], {"run": "moved"})
    n = F.dayofmonth("day")
    declared = run.where(n % 3 == 0).select("account_id", "day", (F.col("run") + F.when(n % 6 == 0, 5).otherwise(0)).alias("balance"))
    return staging.reconcile_statement(m, declared, None, ["account_id"])


@query("w1_account_balance_by_day", DECLARED + " SELECT account_id, day, moved, (sum(moved) OVER (PARTITION BY account_id ORDER BY day))::BIGINT AS balance FROM daily")
def w1_daily(spark, sf_dir):
    """The running balance of each account by day, by blocks."""
    daily = moved(spark, sf_dir).groupBy("account_id", "day").agg(F.sum("cents").alias("moved"))
    return scans.running(scans.blocked(daily, ["account_id"], ["day"]), ["account_id"], ["day"], {"balance": "moved"}).select("account_id", "day", "moved", "balance")


@query("w14_ranks", DECLARED + """ SELECT event_id, row_number() OVER (ORDER BY cents, event_id) AS number, rank() OVER (ORDER BY cents) AS rank, percent_rank() OVER (ORDER BY cents) AS percent_rank, cume_dist() OVER (ORDER BY cents) AS cume_dist,
  ntile(7) OVER (ORDER BY cents, event_id)::INTEGER AS tile FROM moved""")
def w14_ranks(spark, sf_dir):
    """Ranks of all movements by amount, without a window over all rows."""
    return scans.ranked(moved(spark, sf_dir).select("event_id", "cents"), [], ["cents"], ["event_id"], 7).drop("cents")


@query("w14_ranks_by_account", DECLARED + """ SELECT event_id, row_number() OVER w AS number, rank() OVER (PARTITION BY account_id ORDER BY day) AS rank, percent_rank() OVER (PARTITION BY account_id ORDER BY day) AS percent_rank,
  cume_dist() OVER (PARTITION BY account_id ORDER BY day) AS cume_dist, ntile(4) OVER w::INTEGER AS tile FROM moved WINDOW w AS (PARTITION BY account_id ORDER BY day, event_id)""")
def w14_by_account(spark, sf_dir):
    return scans.ranked(moved(spark, sf_dir).select("event_id", "account_id", "day"), ["account_id"], ["day"], ["event_id"]).drop("account_id", "day")


@query("w14_range_frame", DECLARED + " SELECT account_id, day, moved AS total, (sum(moved) OVER (PARTITION BY account_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))::BIGINT AS window_total FROM daily")
def w14_range(spark, sf_dir):
    """A week's movements up to each day."""
    return scans.range_sum(moved(spark, sf_dir), ["account_id"], "day", "cents", 6)


@query("w14_quartiles", DECLARED + """, t AS (SELECT cents, ntile(4) OVER (ORDER BY cents, event_id) AS tile FROM moved)
SELECT tile::INTEGER AS tile, count(*)::BIGINT AS n, min(cents)::BIGINT AS low, max(cents)::BIGINT AS high, sum(cents)::BIGINT AS total FROM t GROUP BY 1""")
def w14_quartiles(spark, sf_dir):
    return scans.ranked(moved(spark, sf_dir).select("event_id", "cents"), [], ["cents"], ["event_id"], 4).groupBy("tile").agg(
        F.count("*").alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.sum("cents").alias("total"))
