"""Hard-negative mining over inverted lists of k-means clusters with stored radii."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import discard, materialize, table
from scriptorium.llm.vectors import pack, products, unpack, usable, whole

#: What components are scaled by; the window of a negative's score, in hundredths of the positive's; positives an anchor, negatives a positive.
SCALE, WINDOW, POSITIVES, NEGATIVES = 256, (30, 90), 5, 10
#: The clusters are fitted on so many rows, chosen by a hash, or fewer where vectors are long; every row is in the lists.
SAMPLE, SAMPLE_VALUES, ROUNDS = 16_384, 1 << 22, 6
#: Clusters at most; a cluster's list is cut into chunks of about CHUNK rows.
CLUSTERS, CHUNK = 1_024, 8_192
#: Clusters that an anchor visits before the others are judged by what it found there.
FIRST = 4
#: Anchors that are scored against a chunk at once.
BLOCK = 256
_ROW = "chunk int, anchor boolean, uid bigint, vec_id bigint, label bigint, q binary, low array<bigint>, high array<bigint>"
_FAR = 1 << 62


@dataclass(frozen=True)
class Lists:
    """The index: rows in chunks of inverted lists, and for each cluster its centroid, radius, rows, first chunk and chunks."""

    rows: DataFrame
    width: int
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    chunks: np.ndarray


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """Centroids of a few Lloyd rounds from evenly spaced rows of the sample."""
    x = sample.astype(np.float64)
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        of = nearest(x, centre)
        n = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1))
        centre = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None] - 2 * (x @ centre.T)).argmin(1)


def indexed(rows: DataFrame, vector: str, most: int = CLUSTERS, chunk: int = CHUNK) -> Lists | None:
    """Inverted lists of all rows of (vec_id, label, ``vector``), or None if there are none.

    The radius of a cluster is the largest distance of its rows from its centroid. A hot cluster, such as one of equal
    vectors, is cut into chunks by a hash, so none is one task's. The lists are a table; the clusters' figures, at most
    ``most`` rows, reach the driver."""
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    if not n:
        return None
    k = max(1, min(most, int(n**0.5) // 4))
    m = max(k, min(SAMPLE, SAMPLE_VALUES // max(1, width)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", vector).limit(m).select(vector).collect()
    centroids = fitted(whole(pa.array([r[0] for r in sample], pa.list_(pa.float64())), SCALE, width), k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = whole(b.column(vector), SCALE, width)
            of = nearest(q.astype(np.float64), centroids)
            away = np.sqrt(((q - centroids[of]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pack(q), pa.array(of, pa.int32()), pa.array(away, pa.float64())], names=["vec_id", "label", "q", "cluster", "away"])

    placed = rows.mapInArrow(assign, "vec_id bigint, label bigint, q binary, cluster int, away double").withColumn("uid", F.monotonically_increasing_id())
    placed = materialize(placed, "negatives-lists")  # from here on a row's uid is fixed
    radii, sizes = np.zeros(k), np.zeros(k, np.int64)
    for c, size, radius in placed.groupBy("cluster").agg(F.count("*"), F.max("away")).collect():
        radii[c], sizes[c] = radius, size
    chunks = -(-sizes // chunk)
    first = np.cumsum(chunks) - chunks
    places = rows.sparkSession.createDataFrame([(c, int(first[c]), int(chunks[c])) for c in range(k) if sizes[c]], "cluster int, first int, chunks int")
    listed = placed.join(F.broadcast(places), "cluster").select((F.col("first") + F.pmod(F.xxhash64("uid"), F.col("chunks"))).cast("int").alias("chunk"), "uid", "vec_id", "label", "q")
    return Lists(listed, width, centroids, radii, sizes, first, chunks)


def bounds(lists: Lists, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cauchy-Schwarz bounds (least, most) of each anchor's inner products with the rows of each cluster, with room for
    rounding."""
    x = q.astype(np.float64)
    at, norm = x @ lists.centroids.T, np.sqrt((x * x).sum(1))[:, None]
    reach = norm * lists.radii[None]
    reach = reach + 1e-9 * (reach + norm * np.sqrt((lists.centroids**2).sum(1))[None]) + 1e-6
    return at - reach, at + reach


def visits(lists: Lists, anchors: DataFrame, late: bool) -> DataFrame:
    """A row for each anchor and chunk that it visits.

    ``anchors``: uid, vec_id, label, q and windows of scores ``low`` to ``high``; ``floor`` is what a score must reach in
    each window, the kth score so far. Clusters whose bounds miss all windows are skipped. The FIRST by upper bound come
    first; of the others (``late``) one is visited only if its upper bound is not strictly below a window's kth score."""
    width, first, chunks, used = lists.width, lists.first, lists.chunks, lists.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = unpack(b.column("q"), np.int32, width)
            least, most = bounds(lists_, q)
            for i, (low, high, floor) in enumerate(zip(b.column("low").to_pylist(), b.column("high").to_pylist(), b.column("floor").to_pylist(), strict=True)):
                can = [(a, z, max(a, f)) for a, z, f in zip(low, high, floor, strict=True) if a <= z]
                if not can:
                    continue
                a, z, f = np.array(can).T
                within = used & ((most[i][:, None] >= a) & (least[i][:, None] <= z)).any(1)
                order = np.flatnonzero(within)
                order = order[np.argsort(-most[i][order], kind="stable")]
                if late:
                    rest = order[FIRST:]
                    order = rest[((most[i][rest][:, None] >= f) & (least[i][rest][:, None] <= z)).any(1)]
                else:
                    order = order[:FIRST]
                to = np.concatenate([first[c] + np.arange(chunks[c]) for c in order] or [np.zeros(0, np.int64)])
                one = b.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                low_ = pa.array([[max(a, f) for a, f in zip(low, floor, strict=True)]] * len(to), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(to), pa.bool_()), *(one.column(c) for c in ("uid", "vec_id", "label", "q")), low_, one.column("high")], names=[c.split()[0] for c in _ROW.split(", ")])

    lists_ = Lists(None, lists.width, lists.centroids, lists.radii, lists.sizes, lists.first, lists.chunks)
    return anchors.mapInArrow(run, _ROW)


def best(lists: Lists, visiting: DataFrame, same: bool, k: int) -> DataFrame:
    """uid, place, other, vec_id, score: of each visit the first ``k`` rows of the chunk in each window (``place``), by score,
    then vec_id; of the anchor's label (``same``) or of others, never the anchor's own row.

    Rows and visits meet sorted by chunk, the rows first: a task holds one chunk of rows and a block of visits at a time."""
    width, names = lists.width, [c.split()[0] for c in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            kind = list(zip(b.column("chunk").to_pylist(), b.column("anchor").to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(kind)) if kind[i] != kind[i - 1]), len(kind)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                chunk, anchor = kind[lo]
                if chunk != at:
                    at, held, rows = chunk, [], None
                part = t.slice(lo, hi - lo).combine_chunks()
                column = lambda c: part.column(c).combine_chunks()  # noqa: B023, E731
                if not anchor:
                    held.append((column("uid").to_numpy(), column("vec_id").to_numpy(), column("label").to_numpy(), unpack(column("q"), np.int32, width)))
                    continue
                if not held:
                    continue
                rows = rows or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                for j in range(0, hi - lo, BLOCK):
                    yield from _scored(rows, part.slice(j, BLOCK), same, k, width)

    listed = lists.rows.select("chunk", F.lit(False).alias("anchor"), "uid", "vec_id", "label", "q", F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("high"))
    met = listed.unionByName(visiting).repartition("chunk").sortWithinPartitions("chunk", "anchor", "vec_id", "uid").select(*names)
    return met.mapInArrow(run, "uid bigint, place int, other bigint, vec_id bigint, score bigint")


def _scored(rows: tuple[np.ndarray, ...], visits: pa.Table, same: bool, k: int, width: int) -> Iterator[pa.RecordBatch]:
    uid, vec_id, label, q = rows
    column = lambda c: visits.column(c).combine_chunks()
    own, mine = column("uid").to_numpy(), column("label").to_numpy()
    scores = products(unpack(column("q"), np.int32, width), q)
    allowed = (mine[:, None] == label[None]) == same
    allowed &= own[:, None] != uid[None]
    lows, highs = column("low").to_pylist(), column("high").to_pylist()
    out = []
    for place in range(max(map(len, lows))):
        low = np.array([x[place] if place < len(x) else _FAR for x in lows])
        high = np.array([x[place] if place < len(x) else -_FAR for x in highs])
        fits = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
        for i in np.flatnonzero(fits.any(1)):
            at = np.flatnonzero(fits[i])
            if len(at) > k:  # the rows are in order of vec_id, which settles ties
                s = scores[i, at]
                kth = np.partition(s, len(s) - k)[len(s) - k]
                over = at[s > kth]
                at = np.concatenate([over, at[s == kth][: k - len(over)]])
            out.append((np.full(len(at), own[i]), np.full(len(at), place), uid[at], vec_id[at], scores[i, at]))
    if out:
        a, p, o, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(o, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["uid", "place", "other", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and place, with their rank."""
    w = Window.partitionBy("uid", "place").orderBy(F.col("score").desc(), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(lists: Lists, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor in each window: some clusters first, then all that their kth scores leave."""
    early = materialize(_ranked(best(lists, visits(lists, anchors.withColumn("floor", F.transform("low", lambda _: F.lit(-_FAR))), False), same, k), k), "negatives-early")
    kth = early.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("kth"))
    floor = F.transform("low", lambda _, i: F.coalesce(F.element_at("kth", i), F.lit(-_FAR)))
    late = best(lists, visits(lists, anchors.join(kth, "uid", "left").withColumn("floor", floor).drop("kth"), True), same, k)
    return _ranked(early.drop("rank").unionByName(late), k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, clusters: int = CLUSTERS, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of ``embeddings`` (vec_id, label, embedding).

    A score is the inner product of floor(256 * x), an exact whole number; higher ones come first, ties by smaller vec_id. Of
    each row for which ``is_anchor`` holds, the first ``positives`` other rows of its label are positives; of each, the first
    ``negatives`` rows of other labels whose score is between the window's hundredths of the positive's are returned.

    Rows with a null vec_id, label or vector, or with a null, NaN or infinite component, take no part. Components that would be
    beyond 2**25 count as 2**25, so that scores fit a long; components that a shorter vector lacks count as zero. Repeated rows
    each take part, as anchors, positives and negatives; only the anchor's own row is left out. Ties of vec_id go by the row's
    place in the table. An anchor without positives, or a positive with an empty window, gives no rows; a negative positive's
    score has an empty window. Other columns are not read. An empty table gives an empty result.

    Every bound is exact, so the result is that of comparing all rows: clusters are visited in two waves by upper bound, and
    one is left out only if its bounds miss the window or its upper bound is strictly below the kth score of the first wave.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding"), "embedding")
    lists = indexed(rows, "embedding", clusters, chunk)
    if lists is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    anchors = lists.rows.where(is_anchor).select("uid", "vec_id", "label", "q", F.array(F.lit(-_FAR)).alias("low"), F.array(F.lit(_FAR)).alias("high"))
    found = materialize(_search(lists, anchors, True, positives), "negatives-positives")
    mine = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("of"))
    share = lambda w, up: F.expr(f"transform(of, x -> if(x.score < 0, {up}L, x.score div 100 * {w} + (x.score % 100 * {w} + {99 * up}) div 100))")
    asked = materialize(anchors.drop("low", "high").join(mine, "uid").withColumns({"low": share(window[0], 1), "high": share(window[1], 0)}), "negatives-anchors")
    got = materialize(_search(lists, asked.drop("of"), False, negatives).withColumnRenamed("vec_id", "negative_id"), "negatives-found")
    discard(found)
    of = F.element_at("of", F.col("place") + 1)
    joined = got.join(asked.select("uid", F.col("vec_id").alias("anchor_id"), "of"), "uid")
    return joined.select("anchor_id", of["id"].alias("positive_id"), "rank", "negative_id", of["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY score DESC, vec_id, s.other) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY score DESC, vec_id, s.other) <= 10
"""
