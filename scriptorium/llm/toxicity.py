"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, materialize, table

#: Most labelled documents that training reads, half of them toxic if there are as many.
SAMPLE = 16_000
#: Feature space, and the lengths of the word beginnings that count beside whole words.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6)
STRIP = ".,;:!?\"'()[]{}|*#%&$<>«»¿¡-"
MEMO = 400_000


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    marks = ["w" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in marks]


def document_words(text: str | None) -> set[str]:
    return {w.strip(STRIP) for w in set((text or "").lower().split())} - {""}


@dataclass(frozen=True)
class Model:
    """P(grade >= k) = sigmoid(w.x - cut[k-1]): one weight vector, as many rising cuts as grades above 0."""

    weights: dict[int, float]
    cuts: tuple[float, ...]

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def severity(self, score: float) -> tuple[float, float]:
        """Expected grade and P(grade >= 1)."""
        p = 1.0 / (1.0 + np.exp(np.clip(np.array(self.cuts) - score, -40, 40)))
        return float(p.sum()), float(p[0])


def telling(counts: DataFrame, n_toxic: int, n_clean: int, lift: float = 8.0) -> DataFrame:
    """Features of ``counts`` (f, toxic, clean: documents that have them) that at least three toxic documents, and one in 200,
    have, and whose rate there is ``lift`` times the clean rate."""
    often = F.col("toxic") >= max(3, n_toxic // 200)
    return counts.where(often & ((F.col("toxic") + 0.5) / (n_toxic + 1) >= lift * (F.col("clean") + 0.5) / (n_clean + 1))).select("f")


def fit(groups: list[tuple[list[int], bool, int]], epochs: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Fits the model on groups of documents alike: their telling features, whether they are toxic, and how many they are.

    The labels tell toxic from clean only; the grades above 0 are weak: one or two telling words (features of a word count
    once), up to five, more. Weights are shared by all cuts; cuts stay in order as sums of exponentials.
    """
    toxic, number = np.array([t for _, t, _ in groups], bool), np.array([n for *_, n in groups], float)
    if not toxic.any() or toxic.all():
        return Model({}, (6.0, 8.0, 10.0))
    told = np.unique(np.concatenate([np.asarray(f, np.int64) for f, _, _ in groups]))
    size = np.array([len(f) for f, _, _ in groups])
    rows, cols = np.repeat(np.arange(len(groups)), size), np.searchsorted(told, np.concatenate([np.asarray(f, np.int64) for f, _, _ in groups]))
    hits = size / (1 + len(PREFIXES)) * 2
    grade = np.where(toxic, 1 + (hits > 2) + (hits > 5), 0)
    w, gaps = np.zeros(len(told)), np.array([2.0, 0.5, 0.5])
    gw, gg = np.full_like(w, 1e-8), np.full(3, 1e-8)
    for _ in range(epochs):
        _, dw, dg = loss(w, gaps, rows, cols, grade, number / number.sum(), l2)
        gw += dw**2
        gg += dg**2
        w -= rate * dw / np.sqrt(gw)
        gaps -= rate * dg / np.sqrt(gg)
    return Model(dict(zip(told.tolist(), w.tolist(), strict=True)), tuple(_cuts(gaps).tolist()))


def _cuts(gaps: np.ndarray) -> np.ndarray:
    return gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])


def loss(w: np.ndarray, gaps: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted cumulative logistic loss, summed over the cuts, and its gradients by weights and gaps."""
    score = np.bincount(rows, w[cols], len(grade))
    z = np.clip(_cuts(gaps)[None, :] - score[:, None], -40, 40)
    p, above = 1 / (1 + np.exp(z)), grade[:, None] > np.arange(3)[None, :]
    value = float((weight[:, None] * np.where(above, np.logaddexp(0, z), np.logaddexp(0, -z))).sum() + l2 / 2 * (w @ w))
    err = (p - above) * weight[:, None]
    dc = -err.sum(0)
    dg = np.array([dc.sum(), np.exp(gaps[1]) * dc[1:].sum(), np.exp(gaps[2]) * dc[2]])
    return value, np.bincount(cols, err.sum(1)[rows], len(w)) + l2 * w, dg


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, picked by a hash of their ids. Ids with several labels are toxic if one
    says so; null labels and ids are left out.

    Features are counted, and the telling ones told, by Spark; what reaches the driver is groups of documents with the same
    telling features, at most ``sample``, whatever the texts' length."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    half = lambda k: one.where(F.col("_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    picked = docs.select("doc_id", "text").join(F.broadcast(half(1).unionByName(half(0))), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted({f for w in document_words(x.as_py()) for f in word_features(w)}) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("_toxic").cast(pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["toxic", "features"])

    rows = materialize(picked.mapInArrow(run, "toxic int, features array<int>").withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    each = rows.select("row", "toxic", F.explode("features").alias("f"))
    counts = each.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    told = telling(counts, n.get(1, 0), n.get(0, 0))
    sets = each.join(told, "f").groupBy("row").agg(F.sort_array(F.collect_list("f")).alias("features"))
    alike = rows.select("row", "toxic").join(sets, "row", "left").groupBy("toxic", F.coalesce("features", F.array().cast("array<int>")).alias("features")).count()
    groups = sorted((list(r.features), bool(r.toxic), r["count"]) for r in alike.collect())
    discard(rows)
    return fit(groups)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic and toxic (p_toxic >= 0.5) of every row, from its whole text.

    Null and empty texts have no features. Rows are scored alone, so repeated ones alike, and a very long text costs no more
    than its distinct words. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for b in batches:
            out = []
            for x in b.column("text"):
                score = 0.0
                for w in sorted(document_words(x.as_py())):
                    v = memo.get(w)
                    if v is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        v = memo[w] = model.word(w)
                    if v:
                        score += v
                out.append(model.severity(score))
            severity, p = [round(a, 6) for a, _ in out], [round(a, 6) for _, a in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(severity, pa.float64()), pa.array(p, pa.float64()), pa.array([v >= 0.5 for v in p], pa.bool_())], names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double, toxic boolean")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
