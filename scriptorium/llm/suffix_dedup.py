"""Suffix-array dedup: difference-cover suffix arrays over bucketed byte strings, and removal of what repeats.

A suffix array of the whole corpus would move each of its bytes as a row of 16 bytes or more, several times. Two equal
strings of ``length`` bytes have equal anchors, so suffixes need comparing only within an anchor's bucket. Each document
is cut into runs of windows that share an anchor. Runs whose anchor occurs once in the corpus are done with; runs that
equal another are repeated whole. The rest, about the ends of repeated passages, are gathered by anchor, and a task sorts
the suffixes of its buckets by the difference-cover algorithm and compares adjacent ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, materialize, table
from scriptorium.llm.shingles import _BYTE, _tables, mixed

LENGTH = 400
#: Bytes that one suffix array is built over, about. A bucket of more runs than HOT is compared window by window instead,
#: dealt by the windows' own hashes.
BATCH, HOT = 1 << 19, 1 << 10
#: Bytes of a document that are cut at once, and bits that hold a place in them.
SEGMENT, PLACE_BITS = 1 << 20, 24


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of numbers from 1 up (below 2**20, fewer than 2**20 of them) by the difference cover {1, 2} mod 3.

    Triples at the cover's places are sorted and named, the names' suffixes are sorted by recursion unless all differ,
    the other suffixes are sorted by a number and a cover suffix's rank, and both lists are merged by counting.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    x = np.concatenate([np.asarray(s, np.int64), [0, 0, 0]])
    b0, b1, b2 = (np.arange(k, n + (n % 3 == 1 and k == 1), 3) for k in range(3))
    cover = np.concatenate([b1, b2])
    triple = (x[cover] << 42) | (x[cover + 1] << 21) | x[np.minimum(cover + 2, n + 2)]
    _, name = np.unique(triple, return_inverse=True)
    name = name.astype(np.int64) + 1
    if name.max() < len(cover):
        order = suffix_array(name)
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    first = cover[order]
    first = first[first < n]
    b0 = b0[np.argsort((x[b0] << 21) | rank[b0 + 1], kind="stable")]
    one, two = first[first % 3 == 1], first[first % 3 == 2]
    before = np.searchsorted((x[one] << 21) | rank[one + 1], (x[b0] << 21) | rank[b0 + 1])
    before += np.searchsorted((x[two] << 42) | (x[two + 1] << 21) | rank[two + 2], (x[b0] << 42) | (x[b0 + 1] << 21) | rank[b0 + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(b0)) + before
    out[place] = b0
    free = np.ones(n, bool)
    free[place] = False
    out[free] = first
    return out


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(x) - w + 1
    pad = (-len(x)) % w
    block = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, run, start, end) of a text's runs of windows with one anchor.

    A window of ``length`` bytes holds its strings of half that length; the one with the least hash, the leftmost of
    equals, is its anchor. Equal windows have equal anchors at equal places. ``run`` is a BLAKE2b hash of the run's bytes: runs
    are taken as equal where anchor and hash agree, 128 bits in all, of which a power series gives only the first 64.
    """
    half = max(1, length // 2)
    w = length - half + 1
    found = []
    for lo in range(0, max(1, len(text) - length + 1), SEGMENT):
        buf = np.frombuffer(text[lo : lo + SEGMENT + length - 1], np.uint8)
        if len(buf) < length:
            continue
        up, down = _tables(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
        n = len(buf) - half + 1
        gram = mixed((total[half:] - total[:n]) * down[:n])
        low = np.uint64((1 << PLACE_BITS) - 1)
        at = (sliding_least((gram & ~low) | np.arange(n, dtype=np.uint64), w) & low).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        end = np.concatenate([begin[1:], [len(at)]]) + length - 1
        raw = buf.tobytes()
        whole = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64)
        found.append((gram[at[begin]].view(np.int64), whole, begin + lo, end + lo))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows occur in any piece, or elsewhere in itself, as well."""
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    lens = np.array([len(p) for p in pieces])
    start = np.concatenate([[0], np.cumsum(lens + 1)])
    text = flat.astype(np.int64) + 2
    text[start[1:] - 1] = 1
    order = suffix_array(text)
    has = np.zeros(len(flat), bool)  # a window begins here
    for a, n in zip(start, lens, strict=False):
        has[a : a + max(0, n - length + 1)] = True
    order = order[has[order]]
    up, down = _tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=total[1:])
    key = (total[order + length] - total[order]) * down[order] if len(order) else np.zeros(0, np.uint64)
    same = np.flatnonzero(key[1:] == key[:-1])
    step = max(1, (1 << 22) // length)
    span = np.arange(length)
    sure = np.concatenate([(flat[order[c][:, None] + span] == flat[order[c + 1][:, None] + span]).all(1) for c in (same[i : i + step] for i in range(0, len(same), step))] or [np.zeros(0, bool)])
    hit = np.zeros(len(flat), bool)
    hit[order[same[sure]]] = True
    hit[order[same[sure] + 1]] = True
    return [hit[a : a + max(0, n - length + 1)] for a, n in zip(start, lens, strict=False)]


def spans(marked: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows marked."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return [(int(a), int(b) - 1 + length) for a, b in zip(at[0::2], at[1::2], strict=True)]


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(ref, s, e): byte ranges of documents that repeated strings cover; ranges may touch and overlap. ``docs`` has ref and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for ref, text in zip(b.column("ref").to_pylist(), b.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                m, k, s, e = runs_of(raw, length)
                held.append((m, k, np.full(len(m), ref), s, e))
                size += len(m)
                if size > 100_000:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    def pack(held: list) -> pa.RecordBatch:
        m, k, r, s, e = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (m, k, r, s, e)], names=["m", "k", "ref", "s", "e"])

    runs = materialize(docs.mapInArrow(cut, "m bigint, k bigint, ref bigint, s bigint, e bigint"), "suffix-runs")
    often = materialize(runs.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "suffix-anchors")
    some = materialize(runs.join(often, "m"), "suffix-shared")
    discard(runs, often)
    kinds = materialize(some.groupBy("m", "k").agg(F.count("*").alias("c"), F.min(F.struct("ref", "s", "e")).alias("r")), "suffix-kinds")
    whole = some.join(kinds.where("c > 1").select("m", "k"), ["m", "k"]).select("ref", "s", "e")
    several = kinds.groupBy("m").agg(F.count("*").alias("d"), F.min("c").alias("least")).where("d > 1 and least = 1").select("m", "d")
    open_ = kinds.join(several, "m").select("m", "d", "c", "r.ref", "r.s", "r.e")
    asked = open_.groupBy("ref").agg(F.collect_list(F.struct("m", "d", "c", "s", "e")).alias("runs")).withColumnRenamed("ref", "_ref")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ref, text, runs_ in zip(b.column("ref").to_pylist(), _bytes(b.column("text")), b.column("runs").to_pylist(), strict=True):
                rows += [(x["m"], x["d"], x["c"], ref, x["s"], text[x["s"] : x["e"]]) for x in runs_]
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in part], pa.int64()) for j in range(5)), pa.array([r[5] for r in part], pa.binary())], names=["m", "d", "c", "ref", "s", "piece"])

    pieces = materialize(docs.join(asked, F.col("ref") == F.col("_ref")).select("ref", "text", "runs").mapInArrow(take, "m bigint, d bigint, c bigint, ref bigint, s bigint, piece binary"), "suffix-pieces")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of whole buckets, then of the one that is still coming
        size, last, begun = 0, None, 0

        def settle(part: list[tuple]) -> pa.RecordBatch:
            out = [(ref, s + a, s + z) for (_, c, ref, s, _), hit in zip(part, repeated_windows([r[4] for r in part], length), strict=True) if c == 1 for a, z in spans(hit, length)]
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], names=["ref", "s", "e"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("m", "c", "ref", "s", "piece")), strict=True):
                if r[0] != last:
                    if size >= BATCH:
                        yield settle(rows)
                        rows, size = [], 0
                    last = r[0]
                rows.append(r)
                size += len(r[4]) + 1
        if rows:
            yield settle(rows)

    few = pieces.where(F.col("d") <= hot).repartition("m").sortWithinPartitions("m").mapInArrow(sort, "ref bigint, s bigint, e bigint")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, c, ref, s, piece in zip(*(b.column(x).to_pylist() for x in ("m", "c", "ref", "s", "piece")), strict=True):
                n = len(piece) - length + 1
                at = range(s, s + n)
                key = [hashlib.blake2b(piece[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array([ref] * n, pa.int64()), pa.array(at, pa.int64()), pa.array([c] * n, pa.int64())], names=["h", "ref", "s", "c"])

    single = pieces.where(F.col("d") > hot).mapInArrow(windows, "h binary, ref bigint, s bigint, c bigint")
    twice = materialize(single.groupBy("h").agg(F.count("*").alias("n"), F.max("c").alias("c")).where("n > 1").select("h"), "suffix-windows")
    many = single.where("c = 1").join(twice, "h").select("ref", "s", (F.col("s") + length).alias("e"))
    out = materialize(whole.union(few).union(many), "suffix-spans")
    discard(some, kinds, pieces, twice)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``docs``.

    Texts are UTF-8 bytes; null counts as empty. Each byte goes that is covered by a string of ``length`` bytes which also
    starts elsewhere, in the same text or another; strings are judged on the input. Repeated rows are texts of their own
    and so remove each other. Shorter texts keep all. Other columns are not read. An empty table gives an empty result.
    """
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))
    found = repeated_spans(own.select("ref", "text"), length, hot)
    listed = found.groupBy("ref").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")).withColumnRenamed("ref", "_ref")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, text, got in zip(b.column("doc_id"), _bytes(b.column("text")), b.column("spans").to_pylist(), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                for x in got or []:
                    if x["e"] <= at and n:
                        continue
                    if not n or x["s"] > at:
                        kept.append(text[at : x["s"]])
                        n += 1
                        removed += x["e"] - x["s"]
                    else:
                        removed += x["e"] - at
                    at = x["e"]
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((ids.as_py(), len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows.clear()
            if rows:
                yield batch(rows)
                rows.clear()

    rows: list[tuple] = []
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    met = own.join(listed, F.col("ref") == F.col("_ref"), "left").select(F.col("doc_id").cast("bigint"), "text", "spans")
    return met.mapInArrow(drop, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")
