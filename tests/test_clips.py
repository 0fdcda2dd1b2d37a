"""Intervals and clips by brute force: overlaps, hot keys, nulls, empty tables, short and silent clips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import audio as A
from scriptorium.functions.spectrum import centroids, mean_centroid
from scriptorium.operators.intervals import merged, subtracted


def unions(rows):
    out = []
    for a, z in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def made(seed, n, hot=0.6):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a = r.randrange(0, 3000)
        rows.append(("hot" if r.random() < hot else f"k{r.randrange(6)}", a, a + r.choice([0, 1, 5, 30, 400]), "x"))
    return [*rows, (None, 1, 5, "x"), ("k1", None, 9, "x"), ("k1", 9, None, "x"), ("only", 5, 9, "x"), ("only", 5, 9, "x")]


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_merged(spark, ranges):
    rows = made(1, 160)
    got = sorted(map(tuple, merged(spark.createDataFrame(rows, "key string, start bigint, end bigint, _range string"), "key", ranges=ranges).collect()))
    want = {}
    for k, a, z, _ in rows:
        if k is not None and a is not None and z is not None and a < z:
            want.setdefault(k, []).append((a, z))
    assert got == sorted((k, a, z) for k, v in want.items() for a, z in unions(v))


def test_subtracted(spark):
    clips, holes = made(2, 120), made(3, 50, 0.3)
    schema = "key string, start bigint, end bigint, name string"
    c, h = spark.createDataFrame(clips, schema), spark.createDataFrame([x for x in holes if x[0] != "k3"], schema)
    want = []
    for k, a, z, n in clips:
        if k is None or a is None or z is None or a >= z:
            continue
        at = a
        for x, y in unions([(x, y) for m, x, y, _ in holes if m == k and m != "k3" and x is not None and y is not None and x < y]):
            if x > at and at < z:
                want.append((k, a, z, n, at, min(x, z)))
            at = max(at, y)
        if at < z:
            want.append((k, a, z, n, at, z))
    for width in (10, 100, 100_000):
        assert sorted(map(tuple, subtracted(c, h, "key", width).collect())) == sorted(want)
    assert subtracted(c.limit(0), h, "key", 10).count() == 0
    assert sorted(map(tuple, subtracted(c, h.limit(0), "key", 50).collect())) == sorted((k, a, z, n, a, z) for k, a, z, n in clips if k is not None and a is not None and z is not None and a < z)


def gate(a, level, less, size, hop):
    env = np.zeros(len(a))
    for i in range(0, len(a) - size, hop):
        env[i : i + hop] = np.sqrt(np.mean(a[i : i + size] ** 2))
    return np.where(env < 10 ** (level / 20), a * 10 ** (less / 20), a)


def test_gated(spark):
    r = np.random.default_rng(1)
    clips = [list(r.normal(size=n) * np.repeat(r.random(n // 7 + 1) ** 3, 7)[:n]) for n in (0, 1, 15, 16, 17, 40, 64, 101)]
    df = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(clips)] + [(99, None)], "i int, a array<double>")
    got = {x.i: x.g for x in df.select("i", A.gated(F.col("a"), -10.0, -20.0, 16, 8).alias("g")).collect()}
    assert got.pop(99) is None
    for i, c in enumerate(clips):
        assert got[i] == pytest.approx(list(gate(np.array(c), -10.0, -20.0, 16, 8)))


def overlap(chunks, fade, guard, seam):
    out, warned = None, 0
    for c in chunks:
        if c is None or not len(c):
            continue
        c = np.array(c, float)
        if out is None:
            out = c.copy()
            continue
        loud = np.flatnonzero(np.abs(c) > 1e-4)
        lead = loud[0] if len(loud) else len(c)
        f = 0 if lead >= guard else fade
        if f < 4 or len(out) < f or len(c) < f:
            out = np.concatenate([out, c])
            continue
        if len(out) >= seam and len(c) >= seam:
            x, y = np.sqrt(np.mean(out[-seam:] ** 2)), np.sqrt(np.mean(c[:seam] ** 2))
            warned += not (x < 1e-6 and y < 1e-6) and abs(x - y) / max(x, y, 1e-3) > 0.2
        out[-f:] = out[-f:] * np.linspace(1, 0, f) + c[:f] * np.linspace(0, 1, f)
        out = np.concatenate([out, c[f:]])
    return ([] if out is None else list(out)), int(warned)


@pytest.mark.parametrize(("fade", "guard", "seam"), [(6, 5, 4), (6, 5, 20), (3, 5, 4), (4, 100, 10), (10, 1, 3)])
def test_joined(spark, fade, guard, seam):
    r = np.random.default_rng(fade)
    files = []
    for _ in range(25):
        chunks = [[float(x) for x in r.normal(size=r.choice([0, 1, 3, 6, 7, 12, 40])) * r.choice([0.0, 0.1, 1.0])] for _ in range(r.integers(0, 7))]
        files.append([([0.0] * 6 + c if r.random() < 0.3 else c) for c in chunks])
    files.append([None, [1.0] * 9, None])
    df = spark.createDataFrame(list(enumerate(files)), "i int, c array<array<double>>")
    for x in df.select("i", A.joined(F.col("c"), fade, guard, seam).alias("j")).collect():
        samples, warned = overlap(files[x.i], fade, guard, seam)
        assert x.j.samples == pytest.approx(samples) and x.j.warnings == warned


def test_centroids(spark):
    t = np.arange(256) / 8_000
    assert centroids(np.sin(2 * np.pi * 1_000 * t), 8_000, 64, 16)[4:-4] == pytest.approx(1_000, rel=0.02)
    df = spark.createDataFrame([(0, None), (1, []), (2, [0.0] * 64), (3, [None, 1.0]), (4, [float(x) for x in np.sin(2 * np.pi * 1_000 * t)])], "i int, a array<double>")
    got = {r.i: r.c for r in df.select("i", mean_centroid(F.col("a"), 8_000, 64, 16).alias("c")).collect()}
    assert got[0] is None and got[1] == got[2] == 0.0 and got[3] > 0 and 900 < got[4] < 1_300
