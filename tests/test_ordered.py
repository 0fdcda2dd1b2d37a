"""Range-wise ordered analytics against brute force, with a key that holds most rows, ties and nulls."""

import random

import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import ordered


def test_order_statistics_and_percentiles(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.choice([r.randint(0, 20), r.randint(0, 10_000)]) / 4) for _ in range(3000)] + [("one", 5.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    got = ordered.order_statistics(df, "k", "v", {"low": F.floor(F.col("n") / 4), "mid": F.floor(F.col("n") / 2)}, ranges=7).collect()
    assert {(x.k, x.n, x.low, x.mid) for x in got} == {(k, len(v), sorted(v)[len(v) // 4], sorted(v)[len(v) // 2]) for k, v in values.items()}
    for x in ordered.percentiles(df, "k", "v", {"p50": 0.5, "p99": 0.99}).collect():
        assert np.allclose([x.p50, x.p99], np.percentile(values[x.k], [50, 99]))


def test_following(spark):
    r = random.Random(4)
    ids = r.sample(range(10_000), 700)
    rows = [("hot" if i % 10 else str(i % 7), i) for i in ids]
    by = {}
    for k, i in sorted(rows, key=lambda x: x[1]):
        by.setdefault(k, []).append(i)
    want = {(k, i, b) for k, v in by.items() for i, b in zip(v, [*v[1:], None], strict=True)}
    df = spark.createDataFrame(rows, "k string, i bigint")
    assert {tuple(x) for x in ordered.following(df, "k", "i").collect()} == want
    assert ordered.following(df.limit(0), "k", "i").count() == 0
