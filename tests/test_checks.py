"""Issues, breaks and chains against Python's regular expressions, plain walks and NumPy."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import mastering as M
from scriptorium.plans import checks as K
from scriptorium.plans.sentences import ABBREVIATIONS

TEXTS = [
    None, "", "The NASA and US met OK at 5% of $3,000.50M on 1/2/2024 or 2024-01-02 in Q3 and FY2024 — really... “no” 'yes' \"so\" it's 'ok'", "the the cat sat sat. 1,234,567.8 and 3.5k",
    "one two three four " * 4, "a b c d e f g " * 3 + "Mr. Smith and Dr. Who vs. etc. i.e. Prof. X", "x" * 230 + "! " + "word, " * 40, "DIE ÄÖÜ ABC ÉTÉ straße straße", "H2 h2 Q5 FY1", "ABCDEFG ABCDEF A1B2", "-- -- -- -- -- -- -- -- -- -- -- -- NASA",
]


def issues(t):
    out = [("acronym", "high" if len(x) >= 3 else "medium") for x in re.findall(K.ACRONYM, t) if x not in K.SAFE]
    for kind, p, grave in K.ISSUES:
        out += [(kind, grave)] * len(list(re.finditer(p, t)))
    w = t.lower().split()
    for n in K.PHRASES_OF:
        if len(w) >= 10 and len(w) >= 2 * n and max(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).values()) >= 3:
            out.append(("phrase_repeat", "high"))
    for p, _ in ABBREVIATIONS:
        out += [("abbreviation", "low")] * len(re.findall(p, t, re.IGNORECASE))
    return out[:10]


def test_speech_issues_equal_python(spark):
    texts = TEXTS + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.where("t is not null").select("i", K.speech_issues(F.col("t")).alias("x")).collect():
        assert [tuple(x) for x in r.x] == issues(texts[r.i]), texts[r.i][:200]


def plain_breaks(text, most, least):
    paragraphs, ends = [m.end() for m in re.finditer(r"\n\n+", text)], [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    every, last, out = sorted(set(paragraphs + ends)), 0, []
    for at in every:
        if least <= at - last <= most:
            out.append((at, "paragraph" if at in paragraphs else "sentence", False))
            last = at
        elif at - last > most:
            near = [b for b in every if last < b <= last + most]
            if near:
                out.append((max(near), "paragraph" if max(near) in paragraphs else "sentence", True))
                last = max(near)
    return out


@pytest.mark.parametrize(("most", "least"), [(1000, 200), (60, 20), (30, 29), (5, 1)])
def test_break_points_equal_the_walk(spark, most, least):
    r = np.random.default_rng(most)
    texts = ["", "no end", *("".join(r.choice(["word ", "end. ", "x" * 40, "\n\n", "! ", "?\n\n\n"]) for _ in range(r.integers(1, 120))) for _ in range(200))]
    for t in texts:
        assert K.break_points(t, most, least) == plain_breaks(t, most, least)


def test_closest_key_equals_the_library():
    import difflib

    r = np.random.default_rng(7)
    made = lambda: "".join(r.choice(list("abc_1")) for _ in range(r.integers(0, 12)))
    for _ in range(500):
        keys, asked = [made() for _ in range(r.integers(0, 6))], made()
        want = difflib.get_close_matches(asked, [k for k in keys if k], n=1, cutoff=0.6)
        assert K.closest(asked, keys) == (want[0] if want else None)
    assert K.closest(None, ["a"]) is None


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (None, "One. Two.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r)[:3] for r in K.text_break_points(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(None, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert [r.doc_id for r in K.speech_report(spark, str(tmp_path)).collect()] == [None]
    assert K.text_speech_issues(spark, str(tmp_path)).count() == 2


def test_chain(spark):
    clips = [[], [0.0] * 5, [0.5, -0.9, 0.01, -0.002, 0.2]]
    df = spark.createDataFrame(list(enumerate(clips)) + [(9, None)], "i int, a array<double>")
    got = {r.i: r.m for r in df.select("i", M.chain(F.col("a"), K.CHAIN).alias("m")).collect()}
    assert got[9] is None and got[0] == [] and got[1] == [0.0] * 5
    x = np.array(clips[2])
    x = x * (np.abs(x) > 10 ** (-32 / 20))
    t, over = 10 ** (-16 / 20), np.abs(x) > 10 ** (-16 / 20)
    x[over] *= 1 - (1 - 1 / 3) * ((np.abs(x[over]) - t) / np.abs(x[over]))
    x = x * 0.8 + np.tanh(x * 1.4) * 0.2
    x = np.clip(x, -(10 ** (-12 / 20)), 10 ** (-12 / 20))
    x = x * 10 ** ((-20 - 20 * np.log10(np.sqrt(np.mean(x * x)))) / 20)
    top = 10 ** (-9 / 20)
    x = x * (top / np.abs(x).max() if np.abs(x).max() > top else 1)
    assert got[2] == pytest.approx(list(x))
    assert [r.m for r in df.where("i = 2").select(M.chain(F.col("a"), [{"type": "limiter", "ceiling_db": 0.0}, {}]).alias("m")).collect()] == [clips[2]]
