"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import materialize, n_words, table

#: Weights of the sources in code-point order, repeating, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
#: Blocks over all sources, and at least this many a source. Their sizes are all that the driver is sent.
BLOCKS, LEAST_BLOCKS = 1 << 14, 64
#: Words that one partition of the written mix holds, about.
PART_WORDS = 8_000_000


def targets(sizes: list[int], weights=WEIGHTS, times: float = MAX_TIMES) -> list[float]:
    """Words to take from each source: shares of all words by weight, none above ``times`` its size, the excess shared
    out again by weight among the others until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in sorted(open_) if rest * w[i] / total > times * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = float(times * sizes[i])
            open_.discard(i)
        rest -= sum(out[i] for i in over)
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """[shards, sources]: exact block quotas per shard. Each node of the tree halves its shards and draws the left
    half's quotas from a multivariate hypergeometric distribution, so sums hold exactly at every level."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    take = int(quotas.sum()) * left // n_shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if quotas.sum() else quotas * 0
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, n_shards - left, rng)])


def deal(draws: list[list[tuple[int, int]]], n_shards: int, seed: int = 42) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Output shards of each source's drawn blocks: (source, block) to a list of (pass, shard).

    ``draws`` has each source's (pass, block) in random order. The tree of :func:`split_quotas` says how many of them each
    shard gets; a shard takes that many from where the shard before it stopped, so no draw is taken twice.
    """
    quotas = split_quotas(np.array([len(x) for x in draws], np.int64), n_shards, np.random.default_rng([seed, len(draws)]))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, got in enumerate(draws):
        start = 0
        for shard in range(n_shards):
            for p, b in got[start : start + int(quotas[shard, i])]:
                out.setdefault((i, b), []).append((p, shard))
            start += int(quotas[shard, i])
    return out


def _hash(seed: int) -> F.Column:
    return F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h")


def plan_mix(rows: DataFrame, weights=WEIGHTS, times: int = MAX_TIMES, n_shards: int = 16, blocks: int = BLOCKS, seed: int = 42):
    """A function that adds source_size, target and ``copies`` (array of shard and place) to a frame of source and ``_h``.

    ``rows`` has source, size and ``_h``, a hash of the row. A source's rows fall into blocks by that hash. Its target is
    met by whole passes over its blocks and, for the rest, by those of its blocks, in a seeded random order, that still fit;
    the first that did not gives its rows in hash order, up to the row that comes nearest. :func:`deal` splits the drawn
    blocks among the output shards. What is planned, and broadcast, is a list of sources and
    at most ``blocks`` plus LEAST_BLOCKS a source blocks, whatever the input.
    """
    spark = rows.sparkSession
    by_source = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    names = sorted(s for s in by_source if s is not None) + ([None] if None in by_source else [])
    sizes, total_rows = [by_source[s]["size"] for s in names], sum(r["n"] for r in by_source.values())
    goal = targets(sizes, weights, times)
    per = [max(LEAST_BLOCKS, int(blocks * by_source[s]["n"] / total_rows)) for s in names]
    listed = spark.createDataFrame([(i, s, sizes[i], goal[i], per[i]) for i, s in enumerate(names)], "_s int, _name string, source_size bigint, target double, _per int")
    to_blocks = lambda df: df.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_b", F.pmod("_h", "_per").cast("int"))
    words = {(r["_s"], r["_b"]): r["w"] for r in to_blocks(rows).groupBy("_s", "_b").agg(F.sum("size").alias("w")).collect()}
    draws: list[list[tuple[int, int]]] = []  # of each source: (pass, block) in drawing order
    edges: list[tuple[int, int, int, int]] = []  # source, pass, block, words that it may still give
    for i in range(len(names)):
        rng = np.random.default_rng([seed, i])
        full = min(times, int(goal[i] // sizes[i])) if sizes[i] else 0
        rest, mine = goal[i] - full * sizes[i], [b for b in range(per[i]) if (i, b) in words]
        skipped = None
        got = [(p, b) for p in range(full) for b in rng.permutation(mine).tolist()]
        for b in rng.permutation(mine).tolist() if rest > 0 and full < times else []:
            if words[i, b] > rest:
                skipped = b if skipped is None else skipped
                continue
            rest -= words[i, b]
            got.append((full, b))
        if skipped is not None and rest >= 1:
            edges.append((i, full, skipped, int(rest)))
        draws.append(got)
    dealt = deal(draws, n_shards, seed)
    edge = spark.createDataFrame([(i, b, left) for i, _, b, left in edges], "_s int, _b int, _left bigint")
    so_far = to_blocks(rows).join(F.broadcast(edge), ["_s", "_b"]).withColumn("_sum", F.expr("sum(size) over (partition by _s order by _h rows unbounded preceding)"))
    cuts = {r["_s"]: r["cut"] for r in so_far.where("_sum <= _left or _sum - _left < _left - (_sum - size)").groupBy("_s").agg(F.max("_h").alias("cut")).collect()}
    on_edge = {(i, b): (p, (i + p) % n_shards, cuts[i]) for i, p, b, _ in edges if i in cuts}
    plan = [(i, b, dealt.get((i, b), []), on_edge.get((i, b))) for i, b in sorted({*dealt, *on_edge})]
    planned = spark.createDataFrame(plan, "_s int, _b int, _draws array<struct<pass:int,shard:int>>, _edge struct<pass:int,shard:int,cut:bigint>")

    def drawn(df: DataFrame) -> DataFrame:
        df = to_blocks(df).join(F.broadcast(planned), ["_s", "_b"], "left")
        got = F.expr("concat(coalesce(_draws, array()), case when _h <= _edge.cut then array(struct(_edge.pass as pass, _edge.shard as shard)) else array() end)")
        copies = F.transform(got, lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.col("_h"), x["pass"], F.lit(seed)).alias("place")))
        return df.withColumn("copies", copies).drop("_s", "_b", "_per", "_draws", "_edge")

    return drawn


def mix(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken, copies (array of shard and place).

    Size is the number of words, 0 for null. Reruns with the same rows and seed agree. A null source is the last source;
    repeated rows are drawn alike; a row without words goes with its block. Other columns are not read. An empty table
    gives an empty result. The number of sources is bounded by what the driver can list.
    """
    rows = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed)), "mix-rows")
    out = plan_mix(rows, seed=seed, **how)(rows)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = 42, n_shards: int = 16, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, whatever their names, each as often as it was drawn, a shard
    after another and shuffled within one. An empty table gives an empty result.

    Texts move once, each to the partition that holds its shard's range of places; a shard has as many partitions as its
    words need, so no task gets a whole shard of a large mix."""
    rows = materialize(docs.select("source", n_words(F.col("text")).alias("size"), _hash(seed)), "mix-rows")
    words = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-words // (n_shards * PART_WORDS)), -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    drawn = plan_mix(rows, seed=seed, n_shards=n_shards, **how)(docs.select(F.struct("*").alias("_row"), "source", _hash(seed)))
    copies = drawn.select("_row", F.explode("copies").alias("_c"))
    # a place is a uniform 64-bit hash; its upper 31 bits pick the range
    part = F.col("_c.shard") * ranges + F.shiftrightunsigned(F.shiftrightunsigned("_c.place", 33) * ranges, 31).cast("int")
    return copies.repartitionById(n_shards * ranges, part).sortWithinPartitions("_c.shard", F.shiftrightunsigned("_c.place", 1), "_c.place").select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """``copies`` has a shard and a place in it for each time that the mix takes the document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
