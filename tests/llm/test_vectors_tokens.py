"""Hard negatives, token counts and vector codes against brute force, on nulls, odd numbers, ties, repeated rows, empty tables and other columns."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import hard_negatives, queries, token_counts, vector_codes

SCHEMA = "vec_id bigint, label int, embedding array<float>, uid string, q string, code string, low int, cluster string, slot int, chunk int"
OTHER = ("u", "q", "c", 1, "k", 2, 3)


def vectors(width=12, n=420):
    """Clouds with ties, a hot vector that is a third of all rows, and every odd kind of row."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(6, width))
    rows = []
    for i in range(n):
        x = r.normal(size=width) * 0.1 + centre[i % 6] if i % 3 else centre[0]
        rows.append((i if i < 400 else i - 400, None if i % 41 == 5 else int(r.integers(0, 4)), [float(np.float32(v)) for v in x]))
    rows += [(500, 1, None), (600, 1, [math.nan] * width), (601, 1, [math.inf] + [0.0] * (width - 1)), (602, 2, [None] * width), (None, 1, rows[1][2]), (700, 1, rows[2][2]), (700, 1, rows[2][2])]
    return [*rows, (800, 2, [0.0] * width), (801, 3, rows[4][2][:5]), (900, 1, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, *OTHER) for i, lab, v in rows], SCHEMA)


def whole(v, scale, width):
    return [math.floor(scale * x) for x in v] + [0] * (width - len(v))


def good(rows):
    return [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


@pytest.mark.parametrize(("clusters", "chunk"), [(1_024, 8_192), (40, 16), (1, 50)])
def test_hard_negatives(spark, clusters, chunk):
    rows = vectors()
    kept = [(i, lab, np.array(whole(v, 256, 12))) for i, lab, v in good(rows) if lab is not None and i is not None]
    want = []
    for k, (a, lab, q) in enumerate(kept):
        if a % 50 == 0:
            s = sorted((-int(q @ x), i, j) for j, (i, _, x) in enumerate(kept) if j != k)
            for ps, p, _ in [t for t in s if kept[t[2]][1] == lab][:5]:
                fits = [t for t in s if kept[t[2]][1] != lab and -30 * ps <= -100 * t[0] <= -90 * ps][:10]
                want += [(a, p, n, i, -ps, -ns) for n, (ns, i, _) in enumerate(fits, 1)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, clusters=clusters, chunk=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_bounds_hold(spark):
    lists = hard_negatives.indexed(frame(spark, [r for r in good(vectors()) if r[1] is not None and r[0] is not None]).select(F.col("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding"), "embedding", 8, 20)
    rows = lists.rows.collect()
    assert sum(lists.sizes) == len(rows) and max(chunk_sizes(rows).values()) < 60
    q = np.stack([np.frombuffer(r.q, np.int32) for r in rows])
    chunk = np.array([r.chunk for r in rows])
    least, most = hard_negatives.bounds(lists, q[:30])
    for c in range(len(lists.sizes)):
        mine = q[(chunk >= lists.first[c]) & (chunk < lists.first[c] + lists.chunks[c])]
        if len(mine):
            s = q[:30] @ mine.T
            assert (s <= most[:, c, None]).all() and (s >= least[:, c, None]).all()


def chunk_sizes(rows):
    out = {}
    for r in rows:
        out[r.chunk] = out.get(r.chunk, 0) + 1
    return out


def lloyd(q, parts, rounds, entries):
    step = q.shape[1] // parts
    books = [q[:entries, k * step : (k + 1) * step].copy() for k in range(parts)]
    near = lambda x, b: ((x[:, None] - b[None]) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        for k, b in enumerate(books):
            x = q[:, k * step : (k + 1) * step]
            of = near(x, b)
            books[k] = np.stack([x[of == e].sum(0) // (of == e).sum() if (of == e).any() else b[e] for e in range(len(b))])
    return books, np.stack([near(q[:, k * step : (k + 1) * step], b) for k, b in enumerate(books)], 1)


@pytest.mark.parametrize(("width", "n", "scale"), [(12, 420, 1), (8, 900, 1), (10, 100, 1), (12, 420, 1e7)])
def test_vector_codes(spark, width, n, scale):
    rows = [(i, lab, None if v is None else [None if x is None else float(np.float32(scale * x)) for x in v]) for i, lab, v in vectors(width, n)]
    full = -(-width // 4) * 4
    kept = sorted(good(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    q = np.clip(np.array([whole(v, 1024, full) for _, _, v in kept], dtype=object), -(1 << 25), 1 << 25).astype(np.int64)
    books, codes = lloyd(q, 4, 4, 256)
    got, mine = vector_codes.vector_codes(frame(spark, rows))
    assert all((a == b).all() for a, b in zip(books, mine, strict=True))
    error = [int(sum(((q[i, k * full // 4 : (k + 1) * full // 4] - books[k][c]) ** 2).sum() for k, c in enumerate(codes[i]))) for i in range(len(q))]
    want = sorted(repr((i, lab, "".join(f"{c:02x}" for c in codes[k]), error[k])) for k, (i, lab, _) in enumerate(kept))
    assert sorted(repr((r.vec_id, r.label, r.code, r.error)) for r in got.collect()) == want


def test_yinyang_skips_and_keeps_ties():
    r = np.random.default_rng(1)
    x = r.integers(-6, 7, (3_000, 3))  # ties everywhere
    entries = x[:200].copy()
    group = vector_codes.grouped(entries)
    book = vector_codes.Codebook(entries, group)
    state = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), len(book.members)))
    for _ in range(6):
        state = book.assign(x, *state)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        others = np.where(np.arange(len(entries))[None] == state[0][:, None], np.inf, np.sqrt(d))
        for g, m in enumerate(book.members):
            assert (state[2][:, g] <= others[:, m].min(1) + 1e-9).all()
        moved = entries + r.integers(-1, 2, entries.shape) * (r.random(len(entries)) < 0.1)[:, None]
        book, entries = vector_codes.Codebook(moved, group, entries), moved


def test_queries_equal_their_sql(spark, tmp_path):
    rows = [(i, lab, v) for i, lab, v in vectors(64, 420) if i is not None and (v is None or len(v) == 64) and i != 700]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[1] for r in rows], pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("op11_hard_negatives", "op13_vector_codes"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = con.sql(queries.oracle_sql()[name])
        rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
        assert sorted(got.columns) == sorted(want.columns) and sorted(rows) == sorted(want.fetchall()) and rows


def test_empty_tables(spark):
    none = frame(spark, [])
    assert hard_negatives.hard_negatives(none, F.lit(True)).count() == 0
    assert vector_codes.vector_codes(none)[0].count() == 0
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 5).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    bits = [" ", "  ", "\n", " \n", "\t", "the", "The", "it's", "we'll", "word,", "naïve", "日本", "语", "١٢", "12", "!!", "…", " ", " ", "​", " ", "\x85", "\x1c", "\x1f", "é", "😀", "᠎", "ſ", "Ⅷ", "²", "ß", "﻿", "⁠", "\x00"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.choice([0, 1, 3, 30]))) for _ in range(1_500)]
    texts += [None, "", " ", "a <|endoftext|> b", "x  <|endoftext|>", "<|endoftext|>", "<|endoftext| >", "long" * 30_000, "the " * 30_000, "the cat sat on the mat " * 9, "the cat sat on the mat " * 9]
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int, n_bytes string")
    for size in (token_counts.FREQUENT, 3):
        got = {x.doc_id: x for x in token_counts.token_counts(docs, path, 20, size).collect()}
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 20), repr(t)[:200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counter_caches(name, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "CACHE", 3)
    path = public_tokenizers.path(name)
    c = token_counts.TokenCounter(path, {"the": 1})
    texts = ["the cat's hat, the bat", "The  end\n\nof it", "Éa éb éc éd éf éa"]
    assert [c.count(t) for t in texts * 2] == [c.encoded(t) for t in texts] * 2
    assert len(c.cache) <= 4


def test_digest_of_codebooks(spark, tmp_path):
    rows = [(1, 2, [0.5] * 8), (2, None, [0.25] * 8)]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(vector_codes.op13_vector_codes(spark, str(tmp_path)).collect(), key=lambda r: r.vec_id)
    digest = hashlib.sha256(",".join(["512,512,256,256"] * 4).encode()).hexdigest()
    assert [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got] == [(1, "00000000", 0, 0, digest), (2, "01010101", 0, 0, digest)]
