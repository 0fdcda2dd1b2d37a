"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import byte_bpe, chat_format, exact_dedup, mixing, ngram_join, quality, sharding, shingles, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, source string, kept boolean, size string, key string"


def table(spark, rows):
    """Columns of documents, and some whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, None, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "OF", "é"]
    out = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 30, 120]))), r.choice(["a", "b", None])) for i in range(60)]
    base = out[7][1] + " " + " ".join(r.choice(words) for _ in range(150))
    cut = base.split(" ")
    out += [(100 + k, " ".join([*cut[:k], "new", *cut[k + 1 :]]), "a") for k in range(0, 150, 15)] + [(200, base, "a"), (201, base.upper(), "a"), (202, base + " \n", "b")]
    return [*out, (300, None, "a"), (301, "", None), (302, " \n\t", "a"), (303, base, "b"), (303, base, "b"), (None, base, "b"), (None, None, None), (304, "long " * 30_000, "c")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(spark, rows):
    for prime in (exact_dedup.PRIME, 7):  # with 7, fingerprints collide all the time
        got = exact_dedup.exact_groups(table(spark, rows), prime=prime, chunk=64).collect()
        assert len(got) == len(rows)
        sizes = Counter(norm(t) for _, t, _ in rows)
        by = {hashlib.sha256(k.encode()).hexdigest(): (k, n) for k, n in sizes.items()}
        assert all(by[r.text_sha256][1] == r.group_size for r in got)
        for key, (k, _) in by.items():
            first = min(((-len(t or ""), i is None, i or 0) for i, t, _ in rows if norm(t) == k))
            mine = [r for r in got if r.text_sha256 == key]
            assert sum(r.kept for r in mine) == 1 and {r.keep_id for r in mine} == {None if first[1] else first[2]}
    left = exact_dedup.exact_dedup(table(spark, rows))
    assert left.columns == table(spark, rows).columns and Counter(norm(r.text) for r in left.collect()) == Counter(set(map(norm, (t for _, t, _ in rows))))


def test_components(spark, rows):
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    sets = {}
    for k, (i, t, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = (i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    group = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    want = []
    for k, (i, s) in sets.items():
        ids = [sets[j][0] for j in sets if group[j] == group[k] and sets[j][0] is not None]
        want.append((i, len(s), (min(ids) if ids else None) if s else i))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got)


def test_links(spark, rows):
    """All links by brute force, also those that the components don't need, with a component in one block and in many."""
    docs = [*rows, *((400 + k, rows[60][1] + f" tail{k}", "a") for k in range(40))]
    sets = []
    for _, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    like = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted(repr((d[0], len(x), sum(like(x, y) for j, y in enumerate(sets) if j != i))) for i, (d, x) in enumerate(zip(docs, sets, strict=True)))
    found = list(set(sets))
    n_links = sum(like(x, y) for i, x in enumerate(found) for y in found[:i])
    assert n_links > 780
    for block, volume in ((1024, 500_000), (8, 500_000), (1024, 1500)):
        got = ngram_join.ngram_components(table(spark, docs), count_links=True, block=block, volume=volume).collect()
        assert sorted(repr((r.doc_id, r.n_shingles, r.n_links)) for r in got) == want
    links = ngram_join.ngram_links(table(spark, docs), block=8).collect()
    assert len(links) == len({(r.x, r.y) for r in links}) == n_links and all(r.x < r.y for r in links)


def test_the_list_of_common_shingles_changes_no_result(spark, rows, monkeypatch):
    """Drawn from a part of the texts, from all of them, empty, or any other: components and numbers of links are those of brute force."""
    docs = [*rows, *((400 + k, rows[60][1] + f" tail{k}", "a") for k in range(20)), *((500 + k, f"{rows[60][1]} own{k} " + " ".join(f"x{k}y{j}" for j in range(40 + 10 * k)), "a") for k in range(8))]
    docs = [(k, t, s) for k, (_, t, s) in enumerate(docs)]
    sets = []
    for _, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    like = [[j for j, y in enumerate(sets) if x and y and 100 * len(x & y) >= 75 * len(x | y)] for x in sets]
    least = list(range(len(sets)))
    while (new := [min((least[j] for j in near), default=i) for i, near in enumerate(like)]) != least:
        least = new
    want = [(i, least[i], len(near) - bool(near)) for i, near in enumerate(like)]
    values = np.sort(shingles.shingle_sets([(t or "").encode() for _, t, _ in docs])[1])
    drawn, found = ngram_join.common_shingles, []
    monkeypatch.setattr(ngram_join, "common_shingles", lambda *of: found.append(drawn(*of)) or found[-1])
    monkeypatch.setattr(ngram_join, "COMMON", 1)
    for sample in (8, 8192):
        monkeypatch.setattr(ngram_join, "SAMPLE", sample)
        assert sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_components(table(spark, docs), count_links=True).collect()) == want
    assert 0 < len(found[0]) < len(found[1])  # the first one is drawn from a part
    for given in (values[:0], np.unique(values[::3])):
        monkeypatch.setattr(ngram_join, "common_shingles", lambda *_: given)  # noqa: B023
        assert sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_components(table(spark, docs), count_links=True).collect()) == want


def test_one_of_each_with_repeated_ids(spark):
    """Two near copies under one id, and a near copy of 3 under an id that leads another component."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    docs = [(1, text("a"), "s"), (1, text("a") + " end", "s"), (3, text("b"), "s"), (5, text("b") + " end", "s"), (5, text("c"), "s"), (6, text("c") + " end", "s"), (7, "", "s"), (7, None, "s"), (None, text("a") + " more", "s")]
    got = sorted((r.doc_id, (r.text or "")[:1]) for r in ngram_join.one_of_each(table(spark, docs)).collect())
    assert got == [(1, "a"), (3, "b"), (5, "c"), (7, ""), (7, "")]


def test_suffix_dedup(spark, rows):
    for length, hot in ((8, 1024), (30, 2)):
        data = [(i, t) for i, t, _ in rows[:80] if len(t or "") < 3000]
        count = Counter(b[k : k + length] for _, t in data for b in [(t or "").encode()] for k in range(len(b) - length + 1))
        want = []
        for i, t in data:
            b = (t or "").encode()
            m = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - length + 1):
                if count[b[k : k + length]] > 1:
                    m[k : k + length] = True
            kept = bytes(c for c, x in zip(b, m, strict=False) if not x)
            want.append((i, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        got = suffix_dedup.suffix_dedup(table(spark, [(i, t, "a") for i, t in data]), length, hot).drop("kept").collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_shards(spark, rows):
    got = sharding.shard_documents(table(spark, rows), 4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    even = table(spark, [(i, "x" * (i % 7), "a") for i in range(400)])
    loads = Counter()
    for r in sharding.shard_documents(even, 4).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.3 * sum(loads.values())


def test_packing_heeds_every_dimension():
    """Bytes even out no further than the other loads allow; what fits nowhere goes where its worst overfill is least."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        items = np.stack([rng.integers(1, 1000, 60), rng.integers(0, 50, 60) ** 2, np.ones(60, int)], 1)
        where = sharding.pack(items, 4)
        loads = np.stack([items[where == k].sum(0) for k in range(4)])
        hi, lo = loads[:, 0].argmax(), loads[:, 0].argmin()
        gap = loads[hi, 0] - loads[lo, 0]
        # no move from the fullest to the emptiest shard is left that all dimensions allow
        for x in items[where == hi]:
            assert not (0 < x[0] < gap - 1 and gap > 1e-4 * items[:, 0].sum() / 4 and all(v == 0 or a + v < b for a, b, v in zip(loads[lo, 1:], loads[hi, 1:], x[1:], strict=True)))
    # nothing has room for the last one; by bytes alone it would join the 90 tokens
    items = np.array([[60, 10, 1], [40, 90, 1], [10, 60, 1]])
    spread = lambda w, d: abs(items[w == 0, d].sum() - items[w == 1, d].sum())
    assert spread(sharding.pack(items, 2), 1) == 20


def test_mix(spark, rows):
    assert mixing.targets([10, 10, 10], (5, 2, 1)) == [18.75, 7.5, 3.75] and mixing.targets([1, 99]) == [3.0, 97.0]
    q = mixing.split_quotas(np.array([7, 0, 12]), 5, np.random.default_rng(1))
    assert q.sum(0).tolist() == [7, 0, 12] and q.min() >= 0
    docs = table(spark, rows)
    got, again = (sorted(map(str, mixing.mix(docs).drop("copies").collect())) for _ in range(2))
    assert got == again and len(got) == len(rows)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_dealing_is_exact_and_disjoint():
    """Each draw goes to one shard; a shard gets its share of all draws, and of each source what the tree gave it."""
    rng = np.random.default_rng(2)
    draws = [[(p, b) for p in range(2) for b in rng.permutation(n).tolist()] for n in (9, 0, 30)]
    for n_shards in (1, 3, 16):
        dealt = mixing.deal(draws, n_shards, seed=5)
        assert sorted((i, p, b) for (i, b), got in dealt.items() for p, _ in got) == sorted((i, p, b) for i, d in enumerate(draws) for p, b in d)
        quotas = mixing.split_quotas(np.array([len(d) for d in draws]), n_shards, np.random.default_rng([5, 3]))
        counts = Counter((s, i) for (i, _), got in dealt.items() for _, s in got)
        assert all(counts[s, i] == quotas[s, i] for s in range(n_shards) for i in range(3))
        totals = quotas.sum(1)
        assert totals.sum() == 78 and totals.max() - totals.min() <= 1


def test_mix_meets_its_targets(spark):
    """Against brute force: words taken are within a row of each source's target, copies are told apart, and the written
    mix holds each row as often as it was taken, a shard after another."""
    r = random.Random(9)
    data = [(i, " ".join("w" for _ in range(r.randint(0, 40))) or None, s) for i, s in enumerate(["a"] * 300 + ["b"] * 700 + [None] * 40)]
    docs = table(spark, data)
    got = mixing.mix(docs, seed=3, n_shards=4).collect()
    size = {i: len((t or "").split()) for i, t, _ in data}
    sums = {s: sum(size[i] for i, _, x in data if x == s) for s in ("a", "b", None)}
    goal = dict(zip(("a", "b", None), mixing.targets(list(sums.values())), strict=True))
    for s in sums:
        mine = [x for x in got if x.source == s]
        assert {x.source_size for x in mine} == {sums[s]} and {x.target for x in mine} == {goal[s]}
        assert abs(sum(x.taken for x in mine) - goal[s]) <= 41
    assert all(x.size == size[x.doc_id] and x.taken == x.size * len(x.copies) and len(x.copies) <= 3 for x in got)
    assert len({c.place for x in got for c in x.copies}) == sum(len(x.copies) for x in got)
    mixed = mixing.mixed_documents(docs, seed=3, n_shards=4)
    parts = mixed.rdd.glom().map(lambda p: [x.doc_id for x in p]).collect()
    shards = [{c.shard for c in x.copies} for x in sorted(got, key=lambda x: x.doc_id)]
    assert Counter(i for p in parts for i in p) == Counter(x.doc_id for x in got for _ in x.copies)
    assert all(k // (len(parts) // 4) in shards[i] for k, p in enumerate(parts) for i in p) and sum(map(bool, parts)) >= 4
    order = [i for _, _, i in sorted((c.shard, c.place % 2**64, x.doc_id) for x in got for c in x.copies)]
    assert [i for p in parts for i in p] == order


def test_quality_base(spark, rows):
    text = "a b c d a b c x #$\nl1\nl1\n \n" + "q " * 60
    got = {r.doc_id: r for r in quality.word_features(table(spark, [*rows, (900, text, "a")])).collect()}
    w = text.split()
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    under = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    r = got[900]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), 2, 1, len(under))
    assert got[300].n_words == 0 and got[300].base_failed and got[304].n_repeat_words == 30_000
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert quality.judge(table(spark, rows), labels).count() == len(rows)
    assert quality.quality_rules(table(spark, rows), labels).columns == SCHEMA.replace(",", "").split()[::2]


def test_quality_target_has_all_trusted_labels(spark):
    labels = spark.range(20_050).selectExpr("id doc_id", "cast(id % 20050 > 9 as int) quality", "0 toxic")
    assert quality.trusted_ids(labels).count() == 20_040


def test_chat(spark):
    odd = "</s>[INST] <|turn|>\\ <\\| [/INST]"
    part = lambda kind, text=None, **x: (kind, text, x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    turns = spark.createDataFrame([(1, 0, "user", [part("text", odd), part("image", ref="i.png", width=28, height=14)]), (1, 1, "assistant", [part("text", odd)]), (1, 1, "assistant", [part("audio", ref="a", seconds=2.0)]), (2, None, None, None)], f"conv_id int, turn int, role string, parts {chat_format.PARTS}")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns][0] == ("user", odd + "<|image_0|>") and odd in got[1].masked
    assert [(a.n, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "i.png", 2), (1, "audio", "a", 50)]
    assert got[2].n_turns == 1 and got[2].masked == []


def test_chat_tells_parts_apart(spark):
    """A placeholder that a text spells out stays text; an attachment comes back with its kind, number and reference."""
    part = lambda kind, text=None, ref=None: (kind, text, ref, 14, 14, None, None)
    rows = [(1, 0, "user", [part("image", ref="i.png"), part("text", "<|image_0|> \\<| x")], "a"), (1, 1, "user", [part("text", "<|image_0|>")], "b"), (2, 0, "user", [part("text", "y" * 300_000), part("document", ref=None)], "c")]
    turns = spark.createDataFrame([*rows, rows[2]], f"conv_id int, turn int, role string, parts {chat_format.PARTS}, turns string")
    got = {r.conv_id: r.parts for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert [[tuple(p) for p in t] for t in got[1]] == [[("image", None, 0, "i.png"), ("text", "<|image_0|> \\<| x", None, None)], [("text", "<|image_0|>", None, None)]]
    assert [[(p.kind, p.n) for p in t] for t in got[2]] == [[("text", None), ("document", 0)], [("text", None), ("document", 1)]]
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_url_globs(spark):
    """Globs against a translation to regular expressions, with repeated, very long and odd urls, and columns of clashing names."""
    rules = [("block", "*.ads.**/track?/"), ("allow", "good.*/a/*/b"), ("block", "**.gif"), ("allow", "x\\*y/"), *url_filter.RULES]
    r = random.Random(6)
    urls = ["http://a.ads.com/x/track1/", "http://a.ads.com/track/", "http://good.org/a/q/b/c", "http://good.org/a/q/r/b", "http://z/i.gif", "http://x*y/", "http://xzy/", None, "", "http://www.example.com/en/" + "z" * 5000]
    urls += ["http://" + "".join(r.choice("ads.com/trk1*xy") for _ in range(r.randint(0, 25))) for _ in range(300)]
    pages = spark.createDataFrame([(i % 200, u, "r", "h") for i, u in enumerate(urls)], "page_id int, url string, rule string, host string")

    def regex(rule):
        if len(rule) == 3:
            return "(?:[^/]*\\.)?" + re.escape(rule[1] + rule[2])
        return "".join({"*": "[^/]*", "**": ".*", "?": "[^/]"}.get(x, re.escape(x[-1])) for x in re.findall(r"\\.|\*+|.", rule[1]))

    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        line = re.match("[^?#]*", rest)[0]
        fits = [k for k, rule in enumerate(rules) if re.match(regex(rule), line, re.S)]
        best = min(fits, key=lambda k: (-len("".join(rules[k][1:])), k)) if fits else None
        want.append((i % 200, None if best is None else "".join(rules[best][1:]), "allow" if best is None else rules[best][0]))
    got = url_filter.url_verdicts(pages, rules).collect()
    assert sorted(map(repr, want)) == sorted(repr((x.page_id, x.rule, x.verdict)) for x in got)
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://A.example.com/en/x", "http://www.example.com/en/", "https://x.net/es/1?q", "net/es/", None, "http://net", "http://n.net/fr/#a", "x://com?/", "ftp://com/"]
    got = [tuple(r)[1:] for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()]
    assert [(r, v) for _, _, r, v in got] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block"), (None, "allow"), ("com/", "allow")]
    assert got[4][:2] == ("", "") and got[7][:2] == ("com", "")


def test_bpe():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    b = byte_bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["", " ", "a" * 30_000, "ab" * 9_000, *("".join(r.choice(" \n\t\xa0\x85\x1c  ab'sé1٣!中😀") for _ in range(r.randint(0, 20))) for _ in range(3000))]
    for t in texts:
        ids = b.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and b.decode(ids).decode() == t


def test_toxicity(spark):
    r = random.Random(4)
    text = lambda bad: " ".join([*(r.choice(["sun", "moon", "tree", "road"]) for _ in range(30)), *(["grumbo", "snarfed"][: 1 + r.randint(0, 1)] if bad else [])])
    docs = table(spark, [*((i, text(i % 3 == 0), "a") for i in range(300)), (900, None, "a")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].toxic == (i % 3 == 0) for i in range(200, 300)) and not got[900].toxic


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for df in (exact_dedup.exact_groups(docs), ngram_join.ngram_components(docs), suffix_dedup.suffix_dedup(docs), sharding.shard_documents(docs), mixing.mix(docs), quality.judge(docs, labels), toxicity.score_toxicity(docs, toxicity.train(docs, labels))):
        assert df.count() == 0


def test_similar_sets_share_a_signature():
    """Of random clouds of sets around a base, any part of which may be common; LOWER and UPPER signatures meet, and the conditions on pairs of usual groups hold."""
    rng = np.random.default_rng(1)
    missed = similar = 0
    for _ in range(50):
        n = int(rng.choice([4, 8, 12, 20, 33, 60, 64, 100, 140, 300]))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate([base[rng.random(n) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, max(2, n // 3))), dtype=np.uint64)])) for _ in range(30)]
        common = np.sort(rng.choice(base, int(n * rng.choice([0, 0.5, 0.8, 1])), replace=False))
        bounds, values = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)
        owner, sig = shingles.signatures(bounds, values, common)
        rare = [len(np.setdiff1d(x, common)) for x in sets]
        plain, usual = ([{s & ~3 for s in sig[(owner == i) & ((sig & 3 == 0) == k)].tolist()} for i in range(30)] for k in (True, False))
        for i in range(30):
            for j in range(i):
                a, b, both = len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= 75 * (a + b - both):
                    similar += 1
                    allowed = 7 * rare[i] <= 4 * a - 3 * b and 7 * rare[j] <= 4 * b - 3 * a
                    missed += not (plain[i] & plain[j] or allowed and usual[i] & usual[j])
    assert similar > 1000 and not missed


def test_quality_ratio_matches_brute_force(spark, rows):
    """llr and the verdict from hashed words and pairs, the whole corpus against the trusted rows, with few buckets."""
    xxhash = pytest.importorskip("xxhash")
    r = random.Random(11)
    data = [(i, t, s) for i, t, s in rows if i is not None and len(t or "") < 5000 and i != 303] + [(1000 + i, " ".join(r.choice(["sun", "moon", "junk", "tree"][: 2 + 2 * (i % 2)]) for _ in range(80)), "z") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i, _, _ in data[::2]] + [(data[0][0], 0, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    trusted = {i for i, _, _ in data[::2] if i % 3 > 0 and i % 7 != 0}
    m, smooth = 256, 8.0
    grams = {}
    for i, t, _ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        grams[i] = [h & (m - 1) for h in one] + [xxhash.xxh64_intdigest(w[j + 1].encode(), h) & (m - 1) for j, h in enumerate(one[:-1])]
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in trusted for b in grams[i])
    n, t = sum(raw.values()), sum(target.values())
    model = {b: float(np.log((target[b] + smooth) / (raw[b] * t / n + smooth))) for b in raw}
    got = {x.doc_id: x for x in quality.judge(table(spark, data), labels, buckets=m, threshold=0.0).collect()}
    assert len(got) == len(data)
    for i, g in grams.items():
        want = sum(model[b] for b in g) / len(g) if g else 0.0
        assert abs(got[i].llr - want) < 1e-9 and got[i].kept == (not got[i].base_failed and got[i].llr >= 0.0)
    assert len({x.kept for x in got.values() if not x.base_failed}) == 2


def test_shards_match_brute_force(spark, rows):
    """Sizes, checksums, whole groups, gapless slots and even bytes, with ties, repeated rows, a hot group and a long text."""
    import zlib

    data = [*rows, *((5000 + i, "one text many times", "b") for i in range(400)), *((7000 + i, "x" * (3 * i % 200), "c") for i in range(600))]
    got = sharding.shard_documents(table(spark, data), 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    loads, n = Counter(), Counter()
    for x in got:
        loads[x.shard] += x.size
        n[x.shard] += 1
    assert all(sorted(x.slot for x in got if x.shard == k) == list(range(n[k])) for k in range(4))
    texts = {}
    for i, t, _ in data:
        texts.setdefault((i, zlib.crc32((t or "").encode())), t or "")
    homes = {}
    for x in got:
        homes.setdefault(texts[x.doc_id, x.text_crc32], set()).add(x.shard)
    share = sum(loads.values()) / 4
    sizes = Counter()
    for _, t, _ in data:
        sizes[t or ""] += len((t or "").encode()) + 1
    copies = Counter(t or "" for _, t, _ in data)
    # only a group above a shard's share of bytes or rows is split
    assert all(len(s) == 1 for t, s in homes.items() if sizes[t] <= share and copies[t] <= len(data) / 4)
    big = max(len(t.encode()) + 1 for t in sizes)
    assert max(loads.values()) - min(loads.values()) <= max(big, 0.02 * share)


def test_toxicity_matches_brute_force(spark, rows):
    """Scores are sums of one shared weight vector under ordered cuts, whole texts, rows alike; ties and odd rows included."""
    r = random.Random(8)
    word = lambda bad: r.choice(["grumbo", "snarfed", "blight"]) if bad else r.choice(["sun", "moon", "tree", "road", "stone"])
    data = [(i, " ".join(word(i % 3 == 0 and r.random() < 0.1 + 0.2 * (i % 4)) for _ in range(30)), "a") for i in range(300)]
    data += [(900, None, "a"), (901, "", "a"), (902, "calm " * 60_000 + "grumbo snarfed blight", "a"), (3, data[3][1], "a"), (None, data[3][1], "b")]
    docs = table(spark, data)
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int"))
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) == 3
    want = []
    for i, t, _ in data:
        score = sum(model.word(w) for w in sorted(set(toxicity.document_words(t))))
        p = [1 / (1 + np.exp(min(40, max(-40, c - score)))) for c in model.cuts]
        assert p == sorted(p, reverse=True)
        want.append((i, round(float(sum(p)), 4), round(float(p[0]), 4)))
    got = toxicity.score_toxicity(docs, model).collect()
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, round(x.severity, 4), round(x.p_toxic, 4))) for x in got)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_encoded_documents(spark, rows):
    """Every row with its digests, nulls and repeated rows too, whatever other columns are called; an empty table is fine."""
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ByteBPE(path, P.PATTERN).ranks, special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.encode_documents(table(spark, rows), path, P.PATTERN)
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256)) for x in got.collect())
    assert byte_bpe.encode_documents(table(spark, []), path, P.PATTERN).count() == 0


CLASHING = {n: "x" for n in ("_t", "_id", "_raw", "_kept", "_rows", "_row", "_h", "_s", "_b", "_c", "_name", "_per", "_doc", "_hash", "_th", "_w", "_x", "copies", "target", "source_size", "size", "taken", "place", "n", "key", "label", "kept", "text_hash", "llr", "row_key", "group_size")}


@pytest.mark.parametrize("stage", [exact_dedup.exact_dedup, ngram_join.one_of_each, mixing.mixed_documents, lambda d: quality.quality_rules(d, d.sparkSession.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))])
def test_stages_carry_any_column(spark, stage):
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in CLASHING)
    rows = [(i, f"the words of text {i} " + " ".join(f"w{i}x{k}" for k in range(80)), "a") for i in range(12)] + [(1, None, "a"), (None, "", None)]
    docs = spark.createDataFrame([(*r, *CLASHING.values()) for r in rows], schema)
    got = stage(docs)
    assert got.columns == docs.columns
    plain = stage(docs.select("doc_id", "text", "source"))
    found = got.collect()
    assert sorted(repr(r[:3]) for r in found) == sorted(repr(tuple(r)) for r in plain.collect()) and len(found) > 5
    assert all(tuple(r[3:]) == tuple(CLASHING.values()) for r in found)
    none = stage(docs.limit(0))
    assert none.columns == docs.columns and none.count() == 0


def test_words_that_a_power_series_confuses(spark):
    """Thue-Morse words and their complements agree under every polynomial modulo 2**64."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        rows += [(2 * k, "".join("ab"[b] for b in bits)), (2 * k + 1, "".join("ba"[b] for b in bits))]
    bounds, values = shingles.shingle_sets([t.encode() for _, t in rows])
    assert len(set(values.tolist())) == len(rows) == bounds[-1]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"), count_links=True).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got)
    text = [t for _, t in rows if len(t) == 1024]
    m, k, s, e = suffix_dedup.runs_of(text[0].encode(), 1024)
    n, j, _, _ = suffix_dedup.runs_of(text[1].encode(), 1024)
    assert not {*zip(m.tolist(), k.tolist(), strict=True)} & {*zip(n.tolist(), j.tolist(), strict=True)}


def test_control_strings_split_over_parts(spark):
    r = random.Random(8)
    bits = ["<|turn|>", "<|says|>", "<|end|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<|image_0|>", "\\", "\\.", ".", "<", "[", "hi"]
    part = lambda kind, text: (kind, text, "r", 28, 28, None, None)
    want, rows = {}, []
    for c in range(120):
        turns = []
        for t in range(r.choice([1, 2, 3])):
            whole = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 5])))
            cut = sorted(r.choice(range(len(whole) + 1)) for _ in range(r.choice([0, 1, 2, 6])))
            said = [part("text", whole[a:b]) for a, b in zip([0, *cut], [*cut, len(whole)], strict=True)]
            if r.random() < 0.3:
                said.insert(r.randrange(len(said) + 1), part("image", None))
            role = r.choice(["user", "assistant"])
            rows.append((c, t, role, said))
            flat = []
            for kind, text, *_ in said:
                if kind == "text" and flat and flat[-1][0] == "text":
                    flat[-1] = ("text", flat[-1][1] + text)
                elif kind != "text" or text:
                    flat.append((kind, text))
            turns.append((role, [x for x in flat if x[1] != ""]))
        want[c] = turns
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}")
    got = chat_format.read_back(chat_format.format_conversations(frame)).collect()
    assert len(got) == len(want)
    for row in got:
        assert [t["role"] for t in row["turns"]] == [role for role, _ in want[row["conv_id"]]]
        assert [[(x["kind"], x["text"]) for x in p] for p in row["parts"]] == [parts for _, parts in want[row["conv_id"]]]
        assert not re.search(r"\[/?INST\]|</?s>|<</?SYS>>", row["formatted"])


def test_toxicity_fit_by_plain_gradient(spark):
    """The loss's gradients are its slopes, the fit comes near what plain steps along them reach, and groups count as their documents."""
    r = np.random.default_rng(5)
    groups = [(sorted(r.choice(12, size=r.integers(1, 6), replace=False).tolist()), bool(r.random() < 0.7), int(r.integers(1, 5))) for _ in range(60)] + [([], False, 40)]
    size = [len(f) for f, *_ in groups]
    rows, cols = np.repeat(np.arange(len(groups)), size), np.array([f for fs, *_ in groups for f in fs])
    hits = np.array(size) / 4 * 2
    grade = np.where([t for _, t, _ in groups], 1 + (hits > 2) + (hits > 5), 0)
    weight = np.array([n for *_, n in groups]) / sum(n for *_, n in groups)
    at = lambda x: toxicity.loss(x[:12], x[12:], rows, cols, grade, weight, 1e-4)
    x = np.concatenate([r.normal(size=12), [1.0, 0.3, 0.2]])
    _, dw, dg = at(x)
    slopes = [(at(x + 1e-6 * e)[0] - at(x - 1e-6 * e)[0]) / 2e-6 for e in np.eye(15)]
    assert np.allclose(np.concatenate([dw, dg]), slopes, atol=1e-6)
    x = np.concatenate([np.zeros(12), [2.0, 0.5, 0.5]])
    for _ in range(20_000):
        _, dw, dg = at(x)
        x = x - 0.3 * np.concatenate([dw, dg])
    model = toxicity.fit(groups)
    found = np.array([model.weights[f] for f in range(12)])
    gaps = np.array([model.cuts[0], np.log(model.cuts[1] - model.cuts[0]), np.log(model.cuts[2] - model.cuts[1])])
    assert toxicity.loss(found, gaps, rows, cols, grade, weight, 1e-4)[0] <= at(x)[0] * 1.02
    single = [(f, t, 1) for f, t, n in groups for _ in range(n)]
    assert np.allclose([toxicity.fit(single).weights[f] for f in range(12)], found)
    assert toxicity.fit([([1], True, 3)]).weights == {} and toxicity.fit([]).weights == {}


def test_toxicity_features_are_counted_by_documents(spark):
    docs = [(i, " ".join(["grumbo"] * 3 + [f"only{i}"]) if i % 2 else f"calm sea{i}") for i in range(40)] + [(50, None), (51, "")]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (50, 0), (51, 1), (77, None)]
    model = toxicity.train(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, features string, row int"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(model.weights) >= set(toxicity.word_features("grumbo")) and not set(model.weights) & set(toxicity.word_features("calm"))


def test_reducing_tasks_of_signatures_are_small(spark):
    # a reducing task's signatures of half a gigabyte of prose fit beside a JVM that fills its heap
    import tracemalloc

    import pyarrow as pa

    n_shingles, rng = 80_000_000, np.random.default_rng(5)
    docs = spark.createDataFrame([("a b c d e f",)], "text string")
    plan = ngram_join.candidates(docs, n_shingles, np.zeros(0, np.uint64))._jdf.queryExecution().analyzed().toString()
    n_parts = int(re.search(r"RepartitionByExpression .*?, (\d+)", plan)[1])
    n = n_shingles * 3 // 2 // n_parts
    sig, key = rng.integers(0, 1 << 40, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sig[-3:] = sig[:3] = np.uint64(4) * np.arange(7, 10, dtype=np.uint64)
    columns = (sig.astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint8), key)
    cuts = np.linspace(0, n, 40).astype(int)
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 39, pa.int32()), *(pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns)], names=["part", "low", "mid", "keys"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(ngram_join._meet(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = set(zip(*(found.column(c).to_numpy().view(np.uint64).tolist() for c in ("anchor", "key"))))
    assert {tuple(sorted((int(key[i]), int(key[n - 3 + i])))) for i in range(3)} <= pairs
    assert peak < 100e6, peak


def test_pairs_of_near_copies_grow_with_the_input(spark, monkeypatch):
    # each reducing task gives a pair once, so rows must not grow with the number of tasks; ranges and held pairs change nothing
    r = random.Random(11)
    texts = []
    for _ in range(30):
        base = [f"w{r.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (0, 200, 400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {n: {tuple(x) for x in ngram_join.candidates(docs, n, np.zeros(0, np.uint64)).collect()} for n in (25_000_000, 125_000_000)}
    assert len({x for p in found.values() for pair in p for x in pair}) == len(texts) and found[25_000_000] == found[125_000_000]
    monkeypatch.setattr(type(docs), "distinct", lambda self: self)
    rows = {n: ngram_join.candidates(docs, n, np.zeros(0, np.uint64)).count() for n in found}
    assert rows[125_000_000] <= 2.3 * rows[25_000_000] <= 2.3 * 16 * len(found[25_000_000]), rows

    n, rng = 20_000, np.random.default_rng(3)
    sig, key = rng.integers(0, 1 << 38, n, dtype=np.uint64) * np.uint64(4), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    sig, key = np.concatenate([sig, sig]), np.concatenate([key, (key >> np.uint64(7)) % np.uint64(5)])
    columns = (sig.astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint8), key)
    batches = [pa.RecordBatch.from_arrays([pa.array([7, 2], pa.int32()), *(pa.array([c[a : a + n // 4].tobytes(), c[a + n // 4 : a + n // 2].tobytes()], pa.binary()) for c in columns)], names=["part", "low", "mid", "keys"]) for a in range(0, 2 * n, n // 2)]
    want = Counter((x, y) if x < y else (y, x) for x, y in zip(key[:n].tolist(), key[n:].tolist()))
    for held in (ngram_join.HELD, 3000):
        monkeypatch.setattr(ngram_join, "HELD", held)
        met = pa.Table.from_batches(list(ngram_join._meet(iter(batches))))
        got = Counter(zip(*(met.column(c).to_numpy().view(np.uint64).tolist() for c in ("anchor", "key"))))
        assert set(want) <= set(got) and len(got) < 1.01 * len(want)
        assert held == 3000 or max(got.values()) <= 2


def test_batches_and_slices_of_texts_are_small(spark):
    # a worker keeps what a task's batches and arrays took, beside a JVM that fills its heap
    import tracemalloc

    import pyarrow as pa

    from scriptorium.llm.common import BATCH, BATCH_LIMIT, materialize

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get(BATCH_LIMIT)
    texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('word ', if(id = 7, 2000000, 1000)) as text").select("text").mapInArrow(sizes, "rows bigint, bytes bigint")
    got = materialize(texts, "test-batches", BATCH).collect()
    assert sum(r.rows for r in got) == 3000 and sum(r.bytes for r in got) > 3 * BATCH
    assert sum(r.bytes > 1.1 * BATCH for r in got) == 1  # that of the long text
    assert spark.conf.get(BATCH_LIMIT) == before
    with pytest.raises(Exception, match="no such"):
        materialize(spark.range(3).selectExpr("raise_error('no such') as x").selectExpr("cast(x as string) as x"), "test-batches", BATCH)
    assert spark.conf.get(BATCH_LIMIT) == before

    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 600)).encode() for _ in range(1200)]
    tracemalloc.start()
    for lo, hi in shingles.slices(texts):
        shingles.signatures(*shingles.shingle_sets(texts[lo:hi]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, peak


def test_components_take_one_query_a_step(spark):
    r = random.Random(11)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    status, root = spark._jsparkSession.sharedState().statusStore(), {}

    def top(v):
        while v in root:
            v = root[v]
        return v

    for x, y in links:
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "x bigint, y bigint")
    before = status.executionsCount()
    label = ngram_join.components(frame)
    steps = status.executionsCount() - before
    assert {(x.key, x.label) for x in label.collect()} == {(v, top(v)) for v in {v for link in links for v in link} if top(v) != v}
    assert steps <= 9, steps
    before = status.executionsCount()
    assert ngram_join.components(frame.where("x < 0")).count() == 0
    assert status.executionsCount() - before <= 3
