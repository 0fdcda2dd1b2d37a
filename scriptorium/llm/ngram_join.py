"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets that share a signature are candidates of the least of them, their anchor. All are compared with their anchor first,
which connects most of what is similar; then those of an anchor's candidates that are not connected yet are compared with
one another in blocks, many sets to a task, so no pair is ever a row unless it is linked or needed to connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scriptorium.llm.common import BATCH, discard, materialize, table
from scriptorium.llm.shingles import LOWER, far_apart, segment_sums, set_keys, shingle_sets, signatures, sketch, slices

#: Signatures of one reducing task, about: it holds 13 bytes of each, beside a JVM that fills its heap; texts that the list of
#: common shingles is drawn from; how many of those must have a shingle for it to count as common. The list only speeds the
#: search up; it changes no result.
TASK, SAMPLE, COMMON = 2_500_000, 8_192, 4
#: Ranges that a task sorts its signatures by, some 40 bytes of each of a range's; bits by which it marks those that occur
#: twice; pairs that it holds.
RANGES, BITMAP, HELD = 16, 1 << 20, 1 << 18
#: Columns of packed signatures: their bits 0 to 31 and 32 to 39, and the keys of their sets.
PACKED = (("low", np.uint32), ("mid", np.uint8), ("keys", np.uint64))
#: A task's memory of the sets that it has signed for; when full it starts anew.
SEEN = 500_000
#: Salts of rows that look up what is known of their set.
SALTS = 64
FLUSH = 1 << 18
#: Sets, and features of all of them, of a block whose pairs are compared at once; shared features of one matrix product.
BLOCK, VOLUME, WIDTH = 1024, 500_000, 2048


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]


def set_rows(docs: DataFrame, size: int = 5) -> DataFrame:
    """A row a document: doc_id, n (distinct shingles), key (of its set, null for none), sketch, t (hash of its text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, keys, marks = _texts(b), [], [], []
            for lo, hi in slices(texts):
                bounds, values = shingle_sets(texts[lo:hi], size)
                counts = np.diff(bounds)
                n += counts.tolist()
                keys += [int(k) if c else None for k, c in zip(set_keys(bounds, values).view(np.int64), counts, strict=True)]
                marks += [sketch(values[x:y]) if y > x else None for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary()), b.column("t")], names=["doc_id", "n", "key", "sketch", "t"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, f"doc_id {kind}, n bigint, key bigint, sketch binary, t bigint")


def common_shingles(docs: DataFrame, n_docs: int, size: int = 5) -> np.ndarray:
    """Shingles that at least COMMON of about SAMPLE hash-picked texts have, rising. Bounded by the sample, not the input."""
    every = max(1, n_docs // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts[lo:hi], size)[1].view(np.int64))], names=["s"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found = picked.mapInArrow(run, "s bigint").groupBy("s").count().where(F.col("count") >= COMMON).select("s").toArrow()
    return np.sort(found["s"].to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def _once(anchor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of two different sets once."""
    order = np.lexsort((key, anchor))
    anchor, key = anchor[order], key[order]
    new = anchor != key
    new[1:] &= (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
    return anchor[new], key[new]


def _anchored(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, key): each set with the least one of every group that shares one of these signatures."""
    # most signatures occur once; a bitmap of those that don't leaves little to sort with the keys
    whole = sig >> np.uint64(2)
    whole.sort()
    twice = np.zeros(BITMAP, bool)
    twice[whole[1:][whole[1:] == whole[:-1]] & np.uint64(BITMAP - 1)] = True
    del whole
    pick = twice[(sig >> np.uint64(2)) & np.uint64(BITMAP - 1)]
    sig, key = sig[pick], key[pick]
    kind = sig & np.uint64(3)
    # LOWER and UPPER sets of one signature meet
    sig = sig - kind + np.minimum(kind, np.uint64(LOWER))
    order = np.lexsort((key, sig))
    sig, key, kind = sig[order], key[order], kind[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key, kind = sig[new], key[new], kind[new]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    bounds = np.concatenate([at, [len(sig)]])
    count = np.diff(bounds)
    high = segment_sums((kind > LOWER).astype(np.uint64), bounds).astype(np.int64)
    some = (count > 1) & ((kind[at] < LOWER) | (high > 0) & (high < count))
    pick = np.repeat(some, count)
    return _once(np.repeat(key[at], count)[pick], key[pick])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, key) of the packed signatures of whole parts.

    A part stays packed, and a range of its signatures at a time is unpacked and sorted; what the ranges find is put
    together, so that a pair which shares many signatures is one row of the part (or a few, beyond HELD pairs)."""
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for b in batches:
        of = b.column("part").to_numpy()
        for p in np.unique(of).tolist():
            rows = np.flatnonzero(of == p).tolist()
            parts.setdefault(p, []).append(tuple(np.concatenate([np.frombuffer(b.column(c)[i].as_buffer(), t) for i in rows]) for c, t in PACKED))
        del b
    for p in sorted(parts):
        got, held = parts.pop(p), []
        for r in range(RANGES):
            picks = [mid // (256 // RANGES) == r for _, mid, _ in got]
            sig = np.concatenate([(mid[k].astype(np.uint64) << np.uint64(32)) + low[k] for (low, mid, _), k in zip(got, picks, strict=True)])
            held.append(_anchored(sig, np.concatenate([keys[k] for (_, _, keys), k in zip(got, picks, strict=True)])))
            if r + 1 < RANGES and sum(len(key) for _, key in held) < HELD:
                continue
            anchor, key = _once(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(anchor, key)]
            if len(key) and (r + 1 == RANGES or len(key) > HELD // 2):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(key.view(np.int64))], names=["anchor", "key"])
                held = []


def candidates(docs: DataFrame, n_shingles: int, common: np.ndarray, size: int = 5) -> DataFrame:
    """(anchor, key): each set with the least set of every group that shares a signature.

    Signatures travel as packed arrays dealt by their leading bits, sets by their keys, so equal sets count once. A
    reducing task sorts the arrays it gets and keeps what occurs twice; 40 bits and the task tell signatures apart. Each
    task can give a pair, so they are as few as memory allows, and pairs are at most as many as signatures.
    """
    n_parts = max(16, int(np.ceil(n_shingles * 0.7 / TASK)))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            sig, key = np.concatenate([s for s, _ in held]), np.concatenate([k for _, k in held])
            held.clear()
            part = ((sig >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
            sig, key = sig[order], key[order]
            columns = [sig.astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint8), key]
            rows = [i for i in range(n_parts) if cuts[i + 1] > cuts[i]]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([c[cuts[i] : cuts[i + 1]].tobytes() for i in rows], pa.binary()) for c in columns)], names=["part", "low", "mid", "keys"])

        for b in batches:
            texts = _texts(b)
            for lo, hi in slices(texts):
                bounds, values = shingle_sets(texts[lo:hi], size)
                keys = set_keys(bounds, values)
                owner, sig = signatures(bounds, values, shared.value)
                fresh = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        fresh[i] = True
                use = fresh[owner]
                held.append((sig[use], keys[owner[use]]))
                if sum(len(s) for s, _ in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    packed = docs.select("text").mapInArrow(sign, "part int, low binary, mid binary, keys binary")
    return packed.repartitionById(n_parts, F.col("part")).mapInArrow(_meet, "anchor bigint, key bigint").distinct()


def _told(rows: DataFrame, by: str, facts: DataFrame, spread: str) -> DataFrame:
    """``rows`` joined with ``facts``, one row a value of ``by``; a frequent value is met in up to SALTS tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(salted.select(by, "_salt").distinct().join(facts, by), [by, "_salt"]).drop("_salt")


def _pair_facts(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """``pairs`` of (x, y), x perhaps frequent, with the facts of both, named by its side."""
    side = lambda c: facts.select(F.col("key").alias(c), *(F.col(f).alias(f + c) for f in names))
    return _told(pairs.join(side("y"), "y"), "x", side("x"), "y")


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, sx, ny, sy = (b.column(c).to_pylist() for c in ("nx", "sketchx", "ny", "sketchy"))
            ok = [not far_apart([n], [s], [m], [z])[0, 0] for n, s, m, z in zip(nx, sx, ny, sy, strict=True)]
            yield b.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return _pair_facts(pairs, classes, "n", "sketch").where("4 * least(nx, ny) >= 3 * greatest(nx, ny)").mapInArrow(run, "x bigint, y bigint")


def _features(keys: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(key, features) of the sets of ``keys``, from their representatives' texts; materialized."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, want = _texts(b), b.column("key").to_pylist()
            for lo, hi in slices(texts):
                bounds, values = shingle_sets(texts[lo:hi], size)
                keys = set_keys(bounds, values).view(np.int64)
                rows = [i for i in range(hi - lo) if int(keys[i]) == want[lo + i]]
                yield pa.RecordBatch.from_arrays([pa.array([int(keys[i]) for i in rows], pa.int64()), pa.array([values[bounds[i] : bounds[i + 1]].view(np.int64) for i in rows], pa.list_(pa.int64()))], names=["key", "features"])

    need = keys.join(classes.select("key", F.col("rep").cast(kind).alias("_id")), "key")
    sets = docs.select("doc_id", "text").join(need, F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text").mapInArrow(run, "key bigint, features array<bigint>").dropDuplicates(["key"])
    return materialize(sets, "join-sets", BATCH)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are that similar, by their whole intersections."""
    both = _pair_facts(pairs, sets, "features")
    both = both.select("x", "y", F.size("featuresx").alias("_n"), F.size("featuresy").alias("_m"), F.size(F.array_intersect("featuresx", "featuresy")).alias("_i"))
    return both.where("100L * _i >= 75L * (_n + _m - _i)").select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key of each linked key's component, by alternating large-star and small-star steps.

    What tells that a step changed nothing is counted while its edges are written, so no step takes a second query."""
    edges, before = _edges(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after, sums = _edges(small)
        discard(edges)
        edges = after
        if sums == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("label"))
        before = sums


def _edges(found: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (u, v), materialized, and their number and the sum of their hashes."""
    seen = Observation()
    told = found.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    edges = materialize(told, "join-edges", BATCH)
    return edges, (seen.get["n"], seen.get["s"])


def _named(classes: DataFrame, label: DataFrame) -> DataFrame:
    return classes.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))


def similar_sets(docs: DataFrame, rows: DataFrame, size: int = 5, block: int = BLOCK, volume: int = VOLUME) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, label, sets): one row a distinct set, the components of linked sets, and the features of all that are linked.

    All candidates are compared with their anchor. Where the candidates of an anchor are then of several components, those
    outside the most frequent one are compared with all the others, in pairs of blocks, first by sketches and then by
    their features. Two similar sets share an anchor, so no link between components is lost.
    """
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("w")), "join-classes", BATCH)
    common = common_shingles(docs, docs.count(), size)
    near = materialize(candidates(docs, rows.agg(F.sum("n")).first()[0] or 0, common, size), "join-candidates", BATCH)
    good = materialize(_promising(near.select(F.col("anchor").alias("x"), F.col("key").alias("y")), classes), "join-pairs", BATCH)
    sets = _features(good.select(F.col("x").alias("key")).union(good.select("y")).distinct(), classes, docs, size)
    links = materialize(_linked(good, sets), "join-links", BATCH)
    label = components(links)
    known = _named(classes.select("key", "n"), label)
    member = _told(near.union(near.select("anchor", "anchor").distinct()), "key", known, "anchor").select("anchor", "key", "n", "label")
    member = materialize(member, "join-members", BATCH)
    shares = member.groupBy("anchor", "label").agg(F.count("*").alias("c"))
    open_ = shares.groupBy("anchor").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.sum("c").alias("m")).where("labels > 1 and m > 2").select("anchor", "most")
    open_ = _told(member, "anchor", open_, "key").select(F.col("anchor").alias("label"), "key", "n", F.col("label").alias("w"), (F.col("label") == F.col("most")).alias("main"))
    open_ = materialize(open_, "join-open", BATCH)
    discard(near, good, links, member)
    facts = classes.select("key", "n", "sketch")
    asked = _block_pairs(open_, block, volume, sketches=True).drop("n").join(facts, "key").groupBy("task").applyInArrow(_maybe, "label bigint, key bigint")
    asked = materialize(open_.join(asked.distinct(), ["label", "key"], "left_semi"), "join-asked", BATCH)
    more = _features(asked.select("key").distinct(), classes, docs, size)
    joins = components(_block_pairs(asked, block, volume).join(more, "key").groupBy("task").applyInArrow(_bridges, "x bigint, y bigint")).toDF("old", "new")
    # links between components join their labels, of which none is a key in ``label``; then each key follows its label
    labels = label.select("label").distinct().join(joins, F.col("label") == F.col("old"), "left").select("label", F.coalesce("new", "label").alias("new"))
    both = materialize(_told(label, "label", labels, "key").select("key", F.col("new").alias("label")).union(joins.select("old", "new")), "join-labels", BATCH)
    every = materialize(sets.union(more).dropDuplicates(["key"]), "join-sets", BATCH)
    discard(open_, asked, sets, more, label)
    return classes, both, every


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``."""
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    sides = []
    for sets, v in ((a, va), (b, vb)):
        at = np.searchsorted(both, v)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool)
        row, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        sides.append((len(sets), row[order], at[order]))
    out = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, len(both), WIDTH):
        hi = min(lo + WIDTH, len(both))
        dense = []
        for n, row, at in sides:
            x, y = np.searchsorted(at, [lo, hi])
            m = np.zeros((n, hi - lo), np.float32)
            m[row[x:y], at[x:y] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _units(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of one block, rows of the other one, whether they are the same) of each pair of blocks in ``table``."""
    col = {c: table.column(c).to_numpy() for c in ("label", "i", "j", "side", "key")}
    order = np.lexsort((col["key"], col["side"], col["j"], col["i"], col["label"]))
    same = np.ones(len(order), bool)
    same[1:] = np.any([np.diff(col[c][order]) != 0 for c in ("label", "i", "j")], axis=0)
    for rows in np.split(order, np.flatnonzero(same)[1:]):
        one, two = rows[col["side"][rows] == 0], rows[col["side"][rows] == 1]
        alone = bool(col["i"][rows[0]] == col["j"][rows[0]])
        yield one, one if alone else two, alone


def _linked_units(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys and w of the sets of one block, of the other one, matrix of who links) of each pair of blocks."""
    key, w = (table.column(c).to_numpy() for c in ("key", "w"))
    lists = table.column("features").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for one, two, alone in _units(table):
        a, b = ([values[ends[r] : ends[r + 1]] for r in side] for side in (one, two))
        n, m = (np.array([len(x) for x in side]) for side in (a, b))
        inter = _overlaps(a, b)
        linked = (inter > 0) & (100 * inter >= 75 * (n[:, None] + m[None, :] - inter))
        yield key[one], w[one], key[two], w[two], np.triu(linked, 1) if alone else linked


def _maybe(table: pa.Table) -> pa.Table:
    """Sets of which a sketch allows the similarity with a set of another component (``w``)."""
    label, key, w, n = (table.column(c).to_numpy() for c in ("label", "key", "w", "n"))
    marks = table.column("sketch").to_pylist()
    rows = [np.zeros(0, np.int64)]
    for one, two, _ in _units(table):
        open_ = w[one][:, None] != w[two][None, :]
        if open_.any():
            open_ &= ~far_apart(n[one], [marks[r] for r in one], n[two], [marks[r] for r in two])
            rows += [one[open_.any(1)], two[open_.any(0)]]
    rows = np.unique(np.concatenate(rows))
    return pa.table({"label": pa.array(label[rows], pa.int64()), "key": pa.array(key[rows], pa.int64())})


def _bridges(table: pa.Table) -> pa.Table:
    """Links that connect the components (``w``) of a pair of blocks, without any that close a circle."""
    out: list[tuple[int, int]] = []
    for _, wx, _, wy, linked in _linked_units(table):
        i, j = np.nonzero(linked & (wx[:, None] != wy[None, :]))
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while v in root:
                v = root[v]
            return v

        for x, y in np.unique(np.stack([wx[i], wy[j]], 1), axis=0).tolist() if len(i) else []:
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((x, y))
    return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})


def _block_pairs(members: DataFrame, block: int, volume: int, sketches: bool = False) -> DataFrame:
    """Rows of sets by the pairs of blocks (task; label, i, j) that they are compared in, side 0 or 1.

    ``members`` has label, key, n, w and main; sets of one label are compared with one another, each pair once, but for
    those that are both ``main``. Up to ``block`` sets and ``volume`` features of a label are one block, and a task has many
    such; more are cut by size and then by hash. Pairs of blocks whose sizes exclude the similarity are left out, each other
    one is a task of its own.
    """
    whole = members.groupBy("label").agg(F.count("*").alias("_m"), F.sum("n").alias("_f"))
    size_class = F.floor(F.log("n") / F.log(F.lit(1.1))) * 2 + F.col("main").cast("int")
    cut = _told(members, "label", whole, "key").withColumn("_c", F.when((F.col("_m") <= block) & (F.col("_f") <= volume), -1).otherwise(size_class).cast("long"))
    parts = cut.groupBy("label", "_c").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / volume)).alias("_s")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_s"))).alias("_parts"))
    salt = F.when(F.col("_c") < 0, 0).otherwise(F.pmod(F.xxhash64("key"), F.col("_parts")[F.col("_c")]))
    placed = materialize(_told(cut, "label", parts, "key").select("key", "label", "n", "w", "main", (F.col("_c") * F.lit(1 << 32) + salt).alias("b")), "join-placed", BATCH)
    total = placed.agg(F.sum("n")).first()[0] or 0
    blocks = materialize(placed.groupBy("label", "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"), F.min("main").alias("main")), "join-blocks", BATCH)
    side = lambda c: blocks.select("label", F.col("b").alias(c), *(F.col(x).alias(x + c) for x in ("lo", "hi", "m", "main")))
    units = side("i").join(side("j"), "label").where("i <= j and 4 * hii >= 3 * loj and 4 * hij >= 3 * loi and (i < j or mi > 1) and not (maini and mainj)").select("label", "i", "j")
    load = volume * 8 if sketches else volume
    task = F.when(F.col("i") < 0, F.pmod(F.xxhash64("label"), F.lit(max(SALTS, -(-total // load))))).otherwise(F.xxhash64("label", "i", "j"))
    sides = units.select("*", task.alias("task"), F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("b", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    return sides.join(placed, ["label", "b"]).select("task", "label", "i", "j", "side", "key", "n", "w")


def _counts(table: pa.Table) -> pa.Table:
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, wx, y, wy, linked in _linked_units(table):
        keys += [x, y]
        counts += [linked @ wy, linked.T @ wx]
    key, counts = np.concatenate(keys), np.concatenate(counts)
    return pa.table({"key": pa.array(key[counts > 0], pa.int64()), "c": pa.array(counts[counts > 0], pa.int64())})


def _pairs(table: pa.Table) -> pa.Table:
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, _, y, _, linked in _linked_units(table):
        i, j = np.nonzero(linked)
        xs.append(np.minimum(x[i], y[j]))
        ys.append(np.maximum(x[i], y[j]))
    return pa.table({"x": pa.array(np.concatenate(xs), pa.int64()), "y": pa.array(np.concatenate(ys), pa.int64())})


def _classified(docs: DataFrame, size: int, block: int = BLOCK, volume: int = VOLUME) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, classes, label, sets): a row a document, one a distinct set, and the components and features of linked sets."""
    rows = materialize(set_rows(docs, size), "join-rows", BATCH)
    return rows, *similar_sets(docs, rows, size, block, volume)


def _compared(classes: DataFrame, label: DataFrame, sets: DataFrame, block: int, volume: int) -> DataFrame:
    """Linked sets are of one component, so all links are found by comparing each component's sets with one another."""
    inside = label.union(label.select("label", "label")).distinct().join(classes.select("key", "n", "w"), "key").withColumn("main", F.lit(False))
    return _block_pairs(inside, block, volume).join(sets, "key")


def ngram_links(docs: DataFrame, size: int = 5, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """(x, y, id_x, id_y): every link between two different sets, once; x < y are set ids, id_x and id_y the least doc_id of each."""
    _, classes, label, sets = _classified(docs, size, block, volume)
    found = _compared(classes, label, sets, block, volume).groupBy("task").applyInArrow(_pairs, "x bigint, y bigint")
    return _pair_facts(found, classes, "rep").select("x", "y", F.col("repx").alias("id_x"), F.col("repy").alias("id_y"))


def ngram_components(docs: DataFrame, size: int = 5, count_links: bool = False, block: int = BLOCK, volume: int = VOLUME) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of every row of ``docs``; with ``count_links`` also n_links.

    A document's set holds the distinct ``size``-word shingles of its whole text, A-Z lower-cased; a shorter text has its
    word sequence as one; null, empty and blank texts have none and are linked with nothing. Documents link at Jaccard
    similarity 0.75 or more; component_id is the least doc_id reachable (a null id counts only where there is no other).
    n_links is the number of other rows that a row links with, those of equal sets among them. Equal sets are one class;
    repeated rows and ids are members like others. Other columns are not read. An empty table gives an empty result.
    """
    rows, classes, label, sets = _classified(docs, size, block, volume)
    named = _named(classes.select("key", "rep", "w"), label)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    known, counted = _told(named, "label", least, "key").select("key", "w", "component_id"), []
    if count_links:
        links = _compared(classes, label, sets, block, volume).groupBy("task").applyInArrow(_counts, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))
        known = known.join(links, "key", "left").withColumn("n_links", F.col("w") - 1 + F.coalesce("c", F.lit(0)))
        counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    known = known.drop("w", "c")
    # salted, as one class may hold a third of all rows
    salted = rows.select("doc_id", "n", "key").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    asked = salted.where("key is not null").groupBy("key", "_salt").agg(F.lit(1).alias("_one")).join(known, "key").drop("_one")
    out = salted.join(asked, ["key", "_salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("key").alias("set_id"), *counted)


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` without the rows of a component other than its first one's: that of the least doc_id, nulls last, and of
    several texts under it the one of the least hash. Rows of no set stay, and repetitions of a row that stays. Other columns,
    whatever their names, stay as they are; an empty table gives an empty result."""
    rows, classes, label, sets = _classified(docs, size)
    discard(sets)
    first = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "t")
    least = rows.where("key is not null").groupBy("key").agg(F.min(first).alias("_first"))
    stay = least.join(label, "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("_first").alias("_first")).select("_first.doc_id", "_first.t")
    stay = stay.union(rows.where("key is null").select("doc_id", "t")).distinct().toDF("_id", "_t")
    carried = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    return carried.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_t")), "left_semi").select("_row.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")
