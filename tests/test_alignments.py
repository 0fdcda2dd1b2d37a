"""Alignments against textbook tables, the standard library's matcher and literal cases."""

import difflib
import random

import pytest

from scriptorium.operators import alignment as A
from scriptorium.plans import alignments as P


def least_edit(a, b):
    """Replaced places by the whole table and the stated order of ties."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    d = [[i + j if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
    i, j, out = len(x), len(y), []
    while i and j:
        if d[i - 1][j] + 1 == d[i][j]:
            i -= 1
        elif d[i][j - 1] + 1 == d[i][j] and d[i][j - 1] < d[i - 1][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append((head + i, head + j))
    return out[::-1]


def test_replaced_words_by_the_whole_table():
    r = random.Random(1)
    for _ in range(600):
        a = [r.choice("abcd") for _ in range(r.randrange(0, 60))]
        b = [r.choice("abcdz") for _ in range(r.randrange(0, 60))] if r.random() < 0.5 else [x if r.random() < 0.9 else "z" for x in a]
        assert A.replaced(*A.codes(a, b)) == least_edit(a, b)
    assert A.replaced(*A.codes([], ["a"])) == [] and A.replaced(*A.codes(["a"], ["b"])) == [(0, 0)]


def test_long_sequences_keep_few_rows():
    a = [str(k % 977) for k in range(4_000)]
    b = [x if k % 50 else "new" for k, x in enumerate(a)]
    assert A.replaced(*A.codes(a, b)) == [(k, k) for k in range(0, 4_000, 50)]
    band = A._Band(*A.codes(a, b), 200)
    assert band.edits == 80 and len(band.kept) < 70


@pytest.mark.parametrize("kinds", ["ab", "abcdefghijklmnopqrstuvwxyz ", "".join(map(chr, range(97, 397)))])
def test_differences_equal_the_matcher(kinds):
    r = random.Random(len(kinds))
    for _ in range(300):
        a = "".join(r.choice(kinds) for _ in range(r.choice([0, 1, 10, 60, 199, 200, 260])))
        b = "".join(r.choice(kinds) for _ in range(r.choice([0, 1, 10, 60, 199, 200, 260]))) if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.9) + r.choice(["", "xyz"])
        m = difflib.SequenceMatcher(None, a, b)
        assert A.differences(a, b) == [o for o in m.get_opcodes() if o[0] != "equal"]
        assert A.ratio(a, b) == pytest.approx(m.ratio(), abs=1e-12)


def test_turns_meet_the_next_one(spark):
    rows = [(1, 0, "The Quick Brown fox jumps", "x"), (1, 2, "the quack Brawn fox jumped", "x"), (1, 2, "twice", "x"), (1, 5, None, "x"), (2, 0, "alone", "x"), (None, 1, "no id", "x"), (3, None, "no turn", "x"), (4, 0, "", "x"), (4, 1, "", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string, next string")
    got = sorted(map(tuple, P.turn_pairs(turns).collect()))
    assert got == [(1, 0, rows[0][2], rows[1][2]), (1, 0, rows[0][2], "twice"), (1, 2, rows[1][2], ""), (1, 2, "twice", ""), (4, 0, "", "")]
    said = {(r.conv_id, r.turn, r.n_replaced): r.words for r in P.mispronounced(P.turn_pairs(turns), ["conv_id", "turn"]).collect()}
    assert said[1, 0, 3] == ["Brown", "Quick"] and said[4, 0, 0] == []
    changed = P.text_changes(P.turn_pairs(turns), ["conv_id", "turn"]).collect()
    assert {(r.conv_id, r.n_differences, r.similarity) for r in changed if r.conv_id == 4} == {(4, 0, 1.0)}
    for r in changed:
        if r.conv_id == 1 and r.turn == 0 and r.similarity > 0.5:
            a, b = rows[0][2], rows[1][2]
            ops = [o for o in difflib.SequenceMatcher(None, a, b).get_opcodes() if o[0] != "equal"]
            assert r.n_differences == len(ops) and r.shown == [f"{k} {i}-{j} {m}-{n}\n{a[max(0, i - 30) : j + 30]}\n{b[max(0, m - 30) : n + 30]}" for k, i, j, m, n in ops[:5]]
    none = turns.limit(0)
    assert P.turn_pairs(none).count() == 0


def test_consensus(spark):
    good = "the cat and the dog of the house went to a shop and " * 3
    rows = [(1, good, good, None, "x"), (2, good, "1234567890 " * 40, None, "x"), (3, "", None, "", "x"), (4, None, good, "", "x"), (5, "12345 67890 12345", good[:40] + "zz", good, "x"), (6, good, good[::-1], good, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, one string, two string, three string, score string")
    got = {r.page_id: r for r in P.consensus(pages, ["one", "two", "three"]).collect()}
    assert (got[1].method, got[1].confidence, got[1].status) == ("one", 1.0, "ok")
    assert got[2].method == "one" and got[2].confidence == pytest.approx(round(difflib.SequenceMatcher(None, good[:500], ("1234567890 " * 40)[:500]).ratio(), 6)) and got[2].status == "failed"
    assert (got[3].method, got[3].score, got[3].confidence, got[3].status) == ("none", 0.0, 0.0, "failed")
    assert (got[4].method, got[4].confidence) == ("two", got[4].score)
    assert got[5].method == "two" or got[5].method == "three"
    assert got[6].method == "one" and got[6].confidence == pytest.approx(round(got[6].score * difflib.SequenceMatcher(None, good[:500], good[::-1][:500]).ratio(), 6))
    assert P.consensus(pages.limit(0), ["one", "two"]).count() == 0
