"""State machines: range by range equal to a plain fold, whatever the ranges, and composition of functions."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.machines import ClampedSum, Lockout, states
from scriptorium.streaming.events import chunk_delta, locked_out


def made(n=700):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, int(r.random() < 0.6), None if r.random() < 0.05 else r.randrange(-400, 600), "x") for i in range(n)]
    return [*rows, (None, 3, 1, 1, "x"), ("k1", None, 1, 1, "x"), ("tie", 5, 0, 90, "x"), ("tie", 5, 1, 90, "x"), ("tie", 5, 1, 90, "x"), ("tie", 6, 1, -9, "x")]


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_states_equal_the_fold(spark, ranges):
    rows = made()
    df = spark.createDataFrame(rows, "key string, at bigint, drift int, amount bigint, _range string")
    got = states(df, "key", "at", {"lock": (Lockout(), F.col("drift")), "total": (ClampedSum(), F.col("amount"))}, ranges)
    want, now = [], {}
    for k, at, drift, amount, _ in sorted((x for x in rows if x[0] and x[1] is not None), key=lambda x: (x[0], x[1], x[2])):
        drifts, left, total = now.get(k, (0, 0, 0.0))
        drifts, left = locked_out(bool(drift), drifts, left)
        total = chunk_delta(total, 0.0 if amount is None else amount / 100, amount is None)
        now[k] = drifts, left, total
        want.append((k, at, drifts if not left else 2 + left, round(total * 100)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == ["key", "at", "lock", "total"] and states(df.limit(0), "key", "at", {"lock": (Lockout(), F.col("drift"))}).count() == 0


@pytest.mark.parametrize("machine", [Lockout(), Lockout(1, 1), Lockout(2, 9), ClampedSum(), ClampedSum(5, 7)])
def test_functions_compose(machine):
    r = random.Random(1)
    events = [0, 1] if isinstance(machine, Lockout) else [None, 3, -4, 900, -900, 0]
    for _ in range(200):
        fs = [machine.event(r.choice(events)) for _ in range(r.randrange(1, 9))]
        whole = fs[0]
        for f in fs[1:]:
            whole = machine.after(whole, f)
        for state in range(2):
            step = state
            for f in fs:
                step = machine.at(f, step)
            assert machine.at(whole, state) == step
