"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD_CLASS, table, words

#: Characters that count as symbols, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _without(col, chars: str):
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _prepared(docs: DataFrame) -> DataFrame:
    """Adds the words ``_w``, the hashes ``_h3`` of all 3-word windows and ``_dup``, the hashes found twice or more.

    ``_dup`` is dealt into about sqrt(n) buckets by its low bits, so that a lookup reads few of them however long a text is.
    """
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CLASS))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_lines", lines).withColumn("_w", words(F.col("_t")))
    df = df.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_r"),
        F.xxhash64("_t").alias("text_hash"),
        "_w",
        (F.octet_length("_t") - F.octet_length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("case when size(_w) > 3 then transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2])) else array() end").alias("_h3"),
    )
    df = df.withColumn("_s", F.expr("case when size(_h3) > size(array_distinct(_h3)) then sort_array(_h3) else cast(array() as array<bigint>) end"))
    df = df.withColumn("_d", F.expr("array_distinct(filter(_s, (x, i) -> i > 0 and _s[greatest(i - 1, 0)] = x))")).drop("_s")
    df = df.withColumn("_k", F.expr("shiftleft(1, least(12, cast(log2(greatest(size(_d), 1)) / 2 as int))) - 1"))
    return df.withColumn("_dup", F.expr("case when _k = 0 then array(_d) else transform(sequence(0, _k), b -> filter(_d, x -> (x & _k) = b)) end")).drop("_d")


def word_features(docs: DataFrame, ratio=None, buckets: int = 1 << 16) -> DataFrame:
    """A row a document: doc_id, text_hash (of the text), the base columns and, given the array column ``ratio``, ``llr``: the mean log-likelihood ratio of a
    text's words and word pairs (0 without any).

    A row a word, summed to a row a document before the only shuffle; both steps run in generated code. A word counts as
    repeated if one of the three windows over it is found twice or more in its text.
    """
    df = _prepared(docs)
    held = lambda d: f"(_j >= {d} and _j - {d} < size(_h3) and array_contains(_dup[cast(_h3[_j - {d}] & _k as int)], _h3[_j - {d}]))"
    keep = ["doc_id", "text_hash", "n_symbols", "n_dup_lines"]  # of fixed width: the sums stay in generated code
    row = df.select("_r", *keep, "_w", "_h3", "_dup", "_k", F.posexplode_outer("_w").alias("_j", "_x"))
    sums = [F.count("_x").alias("n_words"), F.coalesce(F.sum(F.length("_x")), F.lit(0)).cast("long").alias("word_chars"), F.sum(F.expr(f"case when size(_dup[0]) = 0 and _k = 0 then 0L when {held(0)} or {held(1)} or {held(2)} then 1L else 0L end")).alias("n_repeat_words")]
    if ratio is not None:
        m = buckets - 1
        one, two = F.get(ratio, F.expr(f"cast(xxhash64(_x) & {m} as int)")), F.get(ratio, F.expr(f"cast(xxhash64(_x, _w[_j + 1]) & {m} as int)"))
        none = F.lit(0.0)
        sums.append(F.sum(F.when(F.col("_x").isNull(), none).otherwise(F.coalesce(one, none) + F.when(F.expr("_j + 1 < size(_w)"), F.coalesce(two, none)).otherwise(none))).alias("_sum"))
    out = row.groupBy("_r", *keep).agg(*sums)
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    if ratio is not None:
        out = out.withColumn("llr", F.when(F.col("n_words") > 0, F.col("_sum") / (2 * F.col("n_words") - 1)).otherwise(0.0))
    return out.drop("_r", "_sum")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the trusted target: all rows of quality 1 and toxic 0."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().withColumn("_trusted", F.lit(1))


def ratio_model(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, smooth: float = 8.0) -> DataFrame:
    """One row, ``model``: an array with log(P(bucket | trusted target) / P(bucket | raw corpus)) per bucket.

    The raw multinomial counts every n-gram of every document; the target multinomial those of the trusted documents.
    Both are smoothed by ``smooth`` pseudo-counts at the raw corpus's rate, so a bucket that is hardly seen says nothing.
    Counts are summed before the last shuffle, which moves at most ``buckets`` rows a task. Documents are dealt by id to
    meet the trusted ids, whose number grows with the input, so they are not broadcast.
    """
    m = buckets - 1
    seen = docs.join(trusted.hint("shuffle_hash"), "doc_id", "left").select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), words(F.col("text")).alias("_w"))
    grams = seen.select("_trusted", "_w", F.posexplode("_w").alias("_j", "_x")).select("_trusted", F.explode(F.expr(f"array(cast(xxhash64(_x) & {m} as int), case when _j + 1 < size(_w) then cast(xxhash64(_x, _w[_j + 1]) & {m} as int) end)")).alias("b"))
    counts = grams.where("b is not null").groupBy("b").agg(F.count("*").cast("double").alias("raw"), F.sum("_trusted").cast("double").alias("target"))
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"), F.sum("raw").alias("n"), F.sum("target").alias("t"))
    value = f"case when t = 0 then 0D else ln((x.target + {smooth}) / (x.raw * t / n + {smooth})) end"
    # buckets without any n-gram are filled with 0: a step list from one seen bucket to the next
    full = f"flatten(transform(c, (x, i) -> concat(array_repeat(0D, x.b - case when i = 0 then 0 else c[greatest(i - 1, 0)].b + 1 end), array({value}))))"
    return packed.select(F.expr(full).alias("model"))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, smooth: float = 8.0, threshold: float = -0.15) -> DataFrame:
    """A row a document: doc_id, text_hash, the base columns, ``llr`` and ``kept``.

    Every document is judged by the same fixed ``threshold`` on its length-normalised ratio; nothing is sampled. Null
    texts have no words and fail the base rules. Repeated rows are judged one by one, alike. Other columns of ``docs``
    are not read, so their names cannot clash. An empty table gives an empty result; without labels the ratio is 0.
    """
    model = ratio_model(docs.select("doc_id", "text"), trusted_ids(labels), buckets, smooth)
    return word_features(docs, model.scalar(), buckets).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with their own columns. A rejected row is named by id and text, so
    ids that are null or used twice do no harm."""
    bad = judge(docs, labels, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_th"]), "left_anti")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 9).alias("llr"))
