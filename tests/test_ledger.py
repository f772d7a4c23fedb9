"""Batches of actions on a stored ledger: killed between any two steps and run again, they come to the same rows; clashes change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from duoledger.sources.ledger import Clash, Ledger

SCHEMA = "entity_id int, period date, entry_id long, cents long"


class Killed(Exception):
    pass


def make(spark, path):
    return Ledger(spark, str(path), SCHEMA, ["entry_id"], ["entity_id", "period"])


def frame(spark, data):
    rows = [(a, e, p, i, c) for a, (i, (e, p, c)) in data]
    return spark.createDataFrame(rows, "action string, entity_id int, p string, entry_id long, cents long").withColumn("period", F.col("p").cast("date")).drop("p")


def now(ledger):
    return {r.entry_id: (r.entity_id, str(r.period) if r.period else None, r.cents) for r in ledger.rows().collect()}


def batches():
    """Three batches and what stands after each: inserts, then moves, deletions of whole partitions, no-ops."""
    rng = random.Random(1)
    state = {i: (rng.randrange(3), rng.choice(["2024-01-01", "2024-02-01", None]), i) for i in range(60)}
    yield [("insert", kv) for kv in state.items()], dict(state)
    acts = []
    for i in list(state):
        if state[i][0] == 2 or i % 7 == 0:
            acts.append(("delete", (i, (None, None, None))))
            del state[i]
        elif i % 5 == 0:
            state[i] = (1 - state[i][0], "2024-03-01", 1000 + i)
            acts.append(("update", (i, state[i])))
        else:
            acts.append((("same", "edited")[i % 2], (i, (9, None, -1))))
    yield acts, dict(state)
    new = {100 + i: (2, "2024-01-01", i) for i in range(5)}
    yield [("insert", kv) for kv in new.items()], state | new


@pytest.mark.parametrize("step", [None, "_logged", "_finish", "late"])
def test_batches_survive_being_killed(spark, tmp_path, monkeypatch, step):
    ledger = make(spark, tmp_path)
    assert ledger.rows().count() == 0
    for k, (acts, want) in enumerate(batches()):
        if step:
            real = getattr(Ledger, "_logged" if step == "late" else step)

            def dies(self, *args, real=real):
                if step != "late" or args[1] == "done":  # late: all is written, but not logged as done
                    raise Killed
                return real(self, *args)

            with monkeypatch.context() as m:
                m.setattr(Ledger, "_logged" if step == "late" else step, dies)
                with pytest.raises(Killed):
                    ledger.apply(f"b{k}", frame(spark, acts))
        again = make(spark, tmp_path)  # another process
        assert again.apply(f"b{k}", frame(spark, acts))
        assert now(again) == want
        assert not again.apply(f"b{k}", frame(spark, acts)) and now(again) == want
    assert {tuple(r) for r in ledger.log().collect()} == {(f"b{k}", s) for k in range(3) for s in ("staged", "done")}


def test_a_batch_left_open_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    ledger = make(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_finish", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            ledger.apply("one", frame(spark, [("insert", (1, (0, "2024-01-01", 5)))]))
    assert ledger.apply("two", frame(spark, [("update", (1, (0, "2024-01-01", 6))), ("insert", (2, (0, "2024-01-01", 7)))]))
    assert now(ledger) == {1: (0, "2024-01-01", 6), 2: (0, "2024-01-01", 7)}


def test_clashes_change_nothing(spark, tmp_path):
    ledger = make(spark, tmp_path)
    one = (1, (0, "2024-01-01", 5))
    ledger.apply("first", frame(spark, [("insert", one)]))
    for acts in ([("insert", one)], [("delete", (2, (0, None, 0)))], [("update", (3, (0, None, 0)))], [("update", one), ("delete", one)], [("insert", (4, (0, None, 1))), ("insert", (4, (0, None, 1)))]):
        with pytest.raises(Clash):
            ledger.apply("bad", frame(spark, acts))
        assert now(ledger) == {1: (0, "2024-01-01", 5)} and ledger.log().count() == 2
    assert ledger.apply("bad", frame(spark, [])) and now(ledger) == {1: (0, "2024-01-01", 5)}
