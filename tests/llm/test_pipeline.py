"""The pipeline's five stages over a small table, by brute force."""

import math
import random
import re

import pytest


def test_run_matches_brute_force(spark, tmp_path):
    """One source, so the mix draws each row once, and no labels, so the base rules alone decide on quality."""
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    import corpus_pipeline
    from scriptorium.llm import byte_bpe

    r = random.Random(8)
    fresh = lambda n: " ".join(f"w{r.randint(0, 9999)}" for _ in range(n))
    texts = [fresh(r.choice([10, 49, 50, 51, 90])) for _ in range(25)] + ["the same words " * 40, fresh(60) + " a b c d e" * 11, ""]
    base = fresh(120)
    texts += [base, base + " end", "start " + base, base.replace(" ", "\n"), base + "  ", texts[24] + fresh(90), fresh(70)]
    texts.append(texts[-1])
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def good(t):
        w = t.split()
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        under = {j + d for j, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}
        return len(w) >= 50 and 100 * len(under) <= 50 * len(w)

    left = [(i, t) for i, t in docs if good(t)]
    first = {}
    for i, t in sorted(left, key=lambda x: (-len(x[1]), x[0])):
        first.setdefault(re.sub(r"\s", "", t), (i, t))
    once = sorted(first.values())
    sets = {i: {tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(len(w) - 4)} for i, t in once}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    kept = [(i, t) for i, t in once if group[i] == i]
    assert len(docs) > len(left) > len(once) > len(kept) > 5
    ranks = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == [(i, len(enc.encode_ordinary(t))) for i, t in kept]


def test_run_with_sources_labels_and_other_columns(spark, tmp_path):
    """Two sources and labels, so that the mix repeats one source and the likelihood ratio rejects texts; columns of any name."""
    P, tiktoken, xxhash = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken"), pytest.importorskip("xxhash")
    import corpus_pipeline
    from scriptorium.llm import byte_bpe, mixing

    r = random.Random(3)
    say = lambda stem, n, k=400: " ".join(f"{stem}{r.randint(0, k)}" for _ in range(n))
    docs = [(i, say("w", 80), "a" if i % 4 else "b") for i in range(60)] + [(100 + i, say("junk", 80), "a") for i in range(30)] + [(200 + i, say("w", 20) + " " + say("junk", 60), "b") for i in range(10)]
    docs += [(300, docs[0][1], "b"), (301, docs[1][1] + " more", "b"), (302, None, "a"), (None, say("w", 70), "b"), (303, "short text", None)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(110, 0, 0), (58, 1, 1), (None, 1, 0)]
    own = "target string, copies int, source_size string, _id string, _t string, _h string, kept string"
    spark.createDataFrame([(i, t, "en", s, 1, "x", 1, "y", "z", "t", "h", "k") for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + own).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def grams(t):
        w, m = (t or "").split(), (1 << 16) - 1
        h = lambda x, seed=42: xxhash.xxh64(x.encode(), seed=seed).intdigest()
        return [h(x) & m for x in w] + [h(y, h(x)) & m for x, y in zip(w, w[1:], strict=False)]

    trusted = {i for i, q, bad in labels if q and not bad and i is not None}
    raw, target = {}, {}
    for i, t, _ in docs:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in trusted)
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda t: sum(math.log((target[g] + 8.0) / (raw[g] * m / n + 8.0)) for g in grams(t)) / (2 * len(t.split()) - 1)
    left = [(i, t, s) for i, t, s in docs if len((t or "").split()) >= 50 and ratio(t) >= -0.15]
    assert {i for i, *_ in docs if i is not None and 100 <= i < 130} - {i for i, *_ in left} and {i for i, *_ in left} >= set(range(60))
    kept = [x for x in left if x[0] not in (300, 301)]
    size = {i: len(t.split()) for i, t, _ in kept}
    sums = {s: sum(size[i] for i, _, x in kept if x == s) for s in ("a", "b")}
    goal = dict(zip(("a", "b"), mixing.targets(list(sums.values())), strict=True))
    ranks = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens, where = {i: len(enc.encode_ordinary(t)) for i, t, _ in kept}, {i: s for i, _, s in kept}
    got = [(x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert {i for i, _ in got} <= set(tokens) and all(tokens[i] == k for i, k in got)
    for s in ("a", "b"):
        assert abs(sum(size[i] for i, _ in got if where[i] == s) - goal[s]) <= 80
    assert max(sum(i == j for i, _ in got) for j in tokens) <= 3 and len({i for i, _ in got if where[i] == "a"}) == sum(s == "a" for s in where.values())


def test_run_over_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, target string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
