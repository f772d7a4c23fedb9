"""Scans, as-of and interval joins, ranks and settlement against plain Python, with one key that holds most rows and blocks that cut it."""

import random

import pytest
from pyspark.sql import functions as F

from duoledger.operators import intervals, scans, settle, staging


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randrange(400), rng.choice([None, rng.randrange(-50, 50)])) for i in range(1500)]
    return data, spark.createDataFrame(data, "id long, k string, t long, v long").repartition(5)


def test_running_sums_and_last_values_cross_blocks(rows):
    data, df = rows
    own = scans.blocked(df, ["k"], ["t", "id"], 13)
    assert own.where("k = 'hot'").select("block").distinct().count() >= 6  # the hot key is many tasks
    got = {r.id: r for r in scans.last_before(scans.running(own, ["k"], ["t", "id"], {"run": "v"}), ["k"], ["t", "id"], {"last": "v"}).collect()}
    for key in {d[1] for d in data}:
        total, last = 0, None
        for i, _, _, v in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0])):
            total += v or 0
            assert (got[i].run, got[i].last) == (total, last)
            last = v if v is not None else last


def test_no_rows(rows):
    none = rows[1].where("false")
    assert scans.running(scans.blocked(none, ["k"], ["t"], 4), ["k"], ["t"], {"run": "v"}).count() == 0
    assert scans.ranked(none, [], ["t"], ["id"]).count() == 0 and scans.range_sum(none.withColumn("day", F.current_date()), ["k"], "day", "v", 3).count() == 0


@pytest.mark.parametrize(("strict", "forward", "within"), [(False, False, None), (True, False, None), (False, True, None), (True, True, 9), (False, False, 9)])
def test_as_of(spark, rows, strict, forward, within):
    data, df = rows
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int"))
    left = df.select("id", "k", F.when(F.col("id") != 7, day).alias("at"), F.lit(1).alias("_time"))
    right = df.where("id % 9 = 0").select("k", F.when(F.col("id") != 9, day).alias("seen"), F.col("id").alias("other"))
    got = {r.id: r.other for r in scans.as_of(left, right, ["k"], "at", "seen", ["other"], strict, forward, f"{within} days" if within else None, 11).collect()}
    for i, k, t, _ in data:
        later = lambda s: (s - t) * (1 if forward else -1)
        found = [(s, j) for j, q, s, _ in data if j % 9 == 0 and j != 9 and q == k and (later(s) > 0 or (later(s) == 0 and not strict))]
        want = max((j for s, j in found if abs(s - t) == min(abs(x - t) for x, _ in found)), default=None)
        if want is not None and within and min(abs(s - t) for s, _ in found) > within:
            want = None
        assert got[i] == (None if i == 7 else want)


def test_intervals(spark):
    rng = random.Random(5)
    points = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(-300, 300)])) for i in range(300)]
    spans = [(i, rng.choice(["x", "x", "y", None]), s, s + rng.choice([-3, 0, 1, 7, 64, 500, 10**12])) for i, s in ((i, rng.randrange(-400, 300)) for i in range(200))] + [(900, "x", None, 5), (901, "x", 5, None), (902, "x", -(2**62), 2**62)]
    p, s = spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(spans, "s long, k string, a long, b long")
    joined = intervals.in_interval(p, s, ["k"], "at", "a", "b")
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
    want = sorted((i, j) for i, k, at in points for j, q, a, b in spans if k is not None and k == q and None not in (at, a, b) and a <= at <= b)
    assert sorted((r.p, r.s) for r in joined.collect()) == want
    assert intervals.in_interval(p, s.where("false"), ["k"], "at", "a", "b").count() == 0


def test_ranks(rows):
    data, df = rows
    for keys in ([], ["k"]):
        got = {r.id: r for r in scans.ranked(df, keys, ["t"], ["id"], 7, 11).collect()}
        assert len(got) == len(data)
        for key in {d[1] for d in data} if keys else {None}:
            own = sorted((d for d in data if not keys or d[1] == key), key=lambda d: (d[2], d[0]))
            n = len(own)
            for at, (i, _, t, _) in enumerate(own):
                below, upto = sum(d[2] < t for d in own), sum(d[2] <= t for d in own)
                big = n % 7 * (n // 7 + 1)
                tile = at // (n // 7 + 1) + 1 if at < big else n % 7 + (at - big) // (n // 7) + 1
                assert (got[i].number, got[i]["rank"], got[i].tile) == (at + 1, below + 1, tile)
                assert got[i].percent_rank == pytest.approx(below / (n - 1)) and got[i].cume_dist == pytest.approx(upto / n)


def test_range_sum(rows):
    data, df = rows
    got = {(r.k, r.day.toordinal()): (r.total, r.window_total) for r in scans.range_sum(df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int"))), ["k"], "day", "v", 5, 9).collect()}
    import datetime

    zero = datetime.date(2024, 1, 1).toordinal()
    daily = {}
    for _, k, t, v in data:
        daily[k, t] = daily.get((k, t), 0) + (v or 0) if v is not None or (k, t) in daily else daily.get((k, t), 0)
    for (k, t), total in daily.items():
        assert (got[k, zero + t][0] or 0, got[k, zero + t][1]) == (total, sum(daily.get((k, u), 0) for u in range(t - 5, t + 1)))
    assert len(got) == len(daily)


def settled(payments, bills, window):
    """Rounds of mutual choice, in plain words."""
    out, keys = {}, {p[1:3] for p in payments if None not in p[1:]}
    for key in keys:
        pool = sorted([(d, 0, i) for i, *k, d in bills if tuple(k) == key and d is not None] + [(d, 1, i) for i, *k, d in payments if tuple(k) == key and d is not None])
        while True:
            pairs = [(a, b) for a, b in zip(pool, pool[1:]) if a[1] == 0 and b[1] == 1]
            if not pairs:
                break
            for a, b in pairs:
                pool.remove(a)
                pool.remove(b)
                if b[0] - a[0] <= window:
                    out[b[2]] = a[2]
    return out


def test_payments_find_their_bills(spark):
    rng = random.Random(9)
    draw = lambda i: (i, "hot" if rng.random() < 0.7 else rng.choice(["a", None]), 100 * rng.randrange(1, 3), rng.choice([None] + [rng.randrange(200)] * 30))
    bills, payments = [draw(i) for i in range(700)], [draw(5000 + i) for i in range(500)]
    frame = lambda data: spark.createDataFrame(data, "id long, account_id string, cents long, n int").select("id", "account_id", "cents", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day"))
    rows = settle.pair_payments(frame(payments), frame(bills), 20, 9).collect()
    assert {r.payment_id: r.bill_id for r in rows if r.outcome == "paired"} == settled(payments, bills, 20)
    assert sorted(r.payment_id for r in rows if r.payment_id is not None) == [p[0] for p in payments] and sorted(r.bill_id for r in rows if r.bill_id is not None) == [b[0] for b in bills]
    deep = [(i, "x", 1, i) for i in range(300)]  # as many rounds as bills, if rounds were run
    got = settle.pair_payments(frame([(900 + i, "x", 1, 300 + i) for i in range(310)]), frame(deep), 1000, 5).where("outcome = 'paired'").collect()
    assert {r.payment_id: r.bill_id for r in got} == {900 + i: 299 - i for i in range(300)}
    assert settle.pair_payments(frame([]), frame([]), 20).count() == 0


def test_statement_of_one_account_is_many_blocks(spark):
    days = [(1, i, (i * 37) % 101 - 50) for i in range(600)]
    day = lambda df: df.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n").cast("int"))).drop("n")
    moved = day(spark.createDataFrame(days, "account_id long, n long, signed_cents long"))
    run, told, want, base = 1000, [], {}, 1000
    for _, n, c in days:
        run += c
        base += c
        if n % 11 == 0:
            told.append((1, n, base + n % 4))
            want[n] = (run, base + n % 4)
            run = base + n % 4
    got = staging.reconcile_statement(moved, day(spark.createDataFrame(told, "account_id long, n long, balance long")), 1000, ["account_id"]).collect()
    import datetime

    assert {(r.day - datetime.date(2024, 1, 1)).days: (r.expected, r.actual) for r in got} == want
