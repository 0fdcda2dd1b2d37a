"""Chunkers: the cases that the rules come with, brute force for the clause split, and the whole composition."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import chunks, quality
from scriptorium.operators import chunker
from scriptorium.plans.chunks import formed

DATA = "/root/testdata/sf0.001"


def test_completeness_is_one_rule(spark):
    """The chunker's rule is the column's, on sentences of the documents and on endings of every kind."""
    texts = ["He said,", "The end of the", "Fine.", "", ' "odd', "a b c which runs far", "a b c which is far", "it ends;", "one, "]
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect():
        texts += [r.text[:k] for k in (20, 77, 150) if r.text]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (quality.completeness(F.col("t")) == "complete").alias("c")).collect()
    assert [r.c for r in got] == [chunker.is_complete(t) for t in texts]


def test_three_tiers():
    four = ["This is the first sentence of the text.", "Here comes the second one, a bit longer.", "A third sentence follows right after it.", "And this is the fourth and the last one."]
    got = chunker.three_tiers(four, 50, 150, 200)
    assert len(got) == 2 and all(len(c) <= 200 for c in got) and " ".join(got) == " ".join(four)
    over = chunker.three_tiers(["Short sentence.", "A" * 700, "Short sentence."])
    assert len(over) >= 1 and "A" * 700 in " ".join(over)
    eight = [f"Sentence number {k} is here for the test now." for k in range(8)]
    found = chunker.three_tiers(eight, 100, 150, 200, 400)
    assert all(sum(s in c for c in found) == 1 for s in eight)
    twelve = [f"This is sentence number {k} of the twelve." for k in range(12)]
    joined = " ".join(chunker.three_tiers(twelve, 100, 200, 250, 400))
    assert all(s in joined for s in twelve) and chunker.three_tiers(twelve) == chunker.three_tiers(twelve)
    r = random.Random(3)
    for _ in range(200):
        s = [" ".join(r.choice(["the", "which", "cat", "and", "ran", "far,", "said", "home;"]) for _ in range(r.randint(1, 30))) + r.choice([".", "", ",", ' "']) for _ in range(r.randint(0, 12))]
        found, every = ("".join("".join(x).split()) for x in (chunker.three_tiers(s, 50, 120, 160, 240), s))
        assert every.startswith(found) and len(every) - len(found) < 50


def test_incomplete_chunks_merge_backwards():
    got = ["The first chunk is complete here."]
    chunker.merge_back(got, "and it goes on with the", 400, 24.0)
    assert got == ["The first chunk is complete here. and it goes on with the"]
    got = ["One; two three"]
    chunker.merge_back(got, "four; five", 12, 24.0)
    assert got == ["One;", "two three", "four;", "five"]


def clauses(t, most):
    """The rule as it is told: recursion over the first pattern with a cut."""
    import re

    if len(t) <= most:
        return [t]
    parts = [p.strip() for p in re.split("(?<=;)", t) if p.strip()]
    if len(parts) > 1:
        return [x for p in parts for x in clauses(p, most)]
    for pattern, least, stays in chunker.CLAUSES:
        best, far = None, float("inf")
        for m in re.finditer(pattern, t, re.IGNORECASE):
            at = m.end() if stays else m.start()
            a, b = t[:at].strip(), t[at:].strip()
            if len(a.split()) < least or len(a) > most:
                continue
            d = abs(len(a) - most // 2) if len(b) <= most else abs(len(a) - most)
            if d < far:
                best, far = (a, b), d
        if best:
            return [best[0], *clauses(best[1], most)]
    return chunker.word_pieces(t, most)


def test_clause_split(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["river", "which", "and", "because", "stone,", "--", "light;", "who", "plain", "for"]) for _ in range(r.randint(1, 120))) for _ in range(120)] + ["x" * 700, ""]
    for t in texts:
        assert chunker.clause_pieces(t.strip(), 90) == clauses(t.strip(), 90)
    df = spark.createDataFrame([(["Short one.", " ", texts[0]],), (None,), ([],)], "s array<string>")
    assert [x.c for x in df.select(chunker.clause_split(F.col("s"), 90).alias("c")).collect()] == [["Short one.", *([texts[0]] if len(texts[0]) <= 90 else clauses(texts[0], 90))], None, []]


def test_short_chunks_and_bounds(spark):
    df = spark.createDataFrame([(["ab.", "cd.", "x" * 40 + ".", "y" * 60 + " the"],)], "c array<string>")
    merged = df.select(chunks.merge_short(F.col("c"), 10, 30, 80).alias("m"), chunks.duration_bounds(F.col("c"), 0.1).alias("d"), chunks.repaired(F.col("c"), 400).alias("r"), chunks.word_split(F.lit("aa bb cc dd"), 6).alias("w")).first()
    assert merged.m == ["ab.\n\ncd.\n\n" + "x" * 40 + ".", "y" * 60 + " the"] and merged.d == ["ab. cd.", "x" * 40 + ".", "y" * 60 + " the"]
    assert merged.r == ["ab.", "cd.", "x" * 40 + ". " + "y" * 60 + " the"] and merged.w == ["aa bb", "cc dd"]


def test_formed_chunks_hold_every_word(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", formed(F.col("text"), strict=250).alias("c"))
    for r in docs.collect():
        assert all(len(c) <= 250 or " " not in c for c in r.c)
        assert len(" ".join(r.c).split()) <= len(r.text.split())
