"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, groups of equal texts stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import materialize, n_words, table

#: Most buckets that the driver packs; 1024 for each of 16 shards. Their sizes are all that it is sent.
BUCKETS = 1 << 14
#: A bucket above this share of all bytes or rows is looked into for large groups of equal texts; 2 * SHARE**-1 exist at most.
SHARE = 1 / 256


def pack(items: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item ([items, dims]): largest first, each to the shard with room in every dimension whose
    residual capacity has the highest dot product with it; where none has room, to the one that it overfills least.

    Sizes are taken as shares of the capacity. Small items are then moved from the fullest to the emptiest shard while
    this brings the first dimension's loads closer and sets no other dimension's loads further apart.
    """
    total = items.sum(0).astype(float)
    cap = np.where(total > 0, total / n_shards, 1.0)
    x = items / cap
    load, where = np.zeros((n_shards, items.shape[1])), np.full(len(x), -1)
    for i in np.lexsort((np.arange(len(x)), -x.max(1))):
        room = 1.0 - load
        fits = (room >= x[i] - 1e-12).all(1)
        dot = room @ x[i]
        k = int(np.argmax(np.where(fits, dot, -np.inf))) if fits.any() else int(np.lexsort((-dot, (load + x[i]).max(1)))[0])
        where[i] = k
        load[k] += x[i]
    members = [list(np.flatnonzero(where == k)) for k in range(n_shards)]
    for _ in range(50 * n_shards):
        hi, lo = int(np.argmax(load[:, 0])), int(np.argmin(load[:, 0]))
        gap = load[hi, 0] - load[lo, 0]
        sizes = x[members[hi], 0] if members[hi] else np.zeros(0)
        rest = x[members[hi], 1:]
        good = (sizes > 0) & (sizes < gap) & ((rest == 0) | (load[lo, 1:] + rest <= load[hi, 1:])).all(1)
        if gap <= 1e-4 or not good.any():
            break
        j = int(np.argmin(np.where(good, np.abs(sizes - gap / 2), np.inf)))
        i = members[hi].pop(j)
        members[lo].append(i)
        load[hi] -= x[i]
        load[lo] += x[i]
        where[i] = lo
    return where


def shard_documents(docs: DataFrame, n_shards: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null), n_tokens of every row of ``docs``.

    Sizes are UTF-8 bytes of the text plus 1; a null text has no bytes, no tokens and CRC 0 and goes with empty ones. Equal texts share a hash and
    so a bucket, and a bucket goes to one shard whole. Only a group of equal texts larger than a shard's share is split,
    by a hash of its rows' ids. Rows within a bucket are ordered by doc_id, then by the row; slots run through a shard's
    buckets without gaps. Repeated rows are rows of one group. Other columns are not read. An empty table gives an empty
    result. The driver packs ``buckets`` size vectors at most, whatever the input.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), n_words(F.col("text")).alias("n_tokens"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_g"))
    rows = materialize(rows.withColumn("_b", F.pmod("_g", F.lit(buckets)).cast("int")).withColumn("_r", F.monotonically_increasing_id()), "shard-rows")
    dims = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")]
    sums = rows.groupBy("_b").agg(*dims).orderBy("_b").collect()
    size, n = sum(r["size"] for r in sums), sum(r["n"] for r in sums)
    hot = [r["_b"] for r in sums if r["size"] > SHARE * size or r["n"] > SHARE * n]
    groups = rows.where(F.col("_b").isin(hot)).groupBy("_b", "_g").agg(*dims).where((F.col("size") > SHARE * size) | (F.col("n") > SHARE * n)).orderBy("_b", "_g").collect() if hot else []
    # a large group leaves its bucket: pieces of it are numbered apart, and placed apart only if no shard can hold it whole
    pieces = {g["_g"]: max(2, int(np.ceil(2 * max(g["size"] / size, g["n"] / n) / SHARE))) for g in groups}
    whole = {g["_g"] for g in groups if max(g["size"] / size, g["n"] / n) <= 1 / n_shards}
    first, at = {}, buckets
    for g, k in pieces.items():
        first[g], at = at, at + k
    if groups:
        which = docs.sparkSession.createDataFrame([(g, first[g], pieces[g]) for g in first], "_g bigint, _first int, _pieces int")
        rows = rows.join(F.broadcast(which), "_g", "left").withColumn("_b", F.expr("case when _first is null then _b else _first + cast(pmod(xxhash64(doc_id, _r), _pieces) as int) end"))
        sums = rows.groupBy("_b").agg(*dims).orderBy("_b").collect()
    owner = {first[g] + i: first[g] for g in whole for i in range(pieces[g])}
    unit: dict[int, int] = {}
    vectors: list[list[int]] = []
    for r in sums:
        k = owner.get(r["_b"], r["_b"])
        if k not in unit:
            unit[k] = len(vectors)
            vectors.append([0, 0, 0])
        for d, c in enumerate(("size", "n_tokens", "n")):
            vectors[unit[k]][d] += r[c]
    place = pack(np.array(vectors, float).reshape(-1, 3), n_shards)
    nexts, plan = [0] * n_shards, []
    for r in sums:
        k = int(place[unit[owner.get(r["_b"], r["_b"])]])
        plan.append((r["_b"], k, nexts[k]))
        nexts[k] += r["n"]
    where = F.broadcast(docs.sparkSession.createDataFrame(plan, "_b int, shard int, _at bigint"))
    order = Window.partitionBy("_b").orderBy("doc_id", "_r")
    out = rows.withColumn("_k", F.row_number().over(order)).join(where, "_b")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") + F.col("_k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
