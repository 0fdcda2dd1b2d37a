"""Queries over text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators.ordered import following
from scriptorium.functions.text import COMMON_WORDS, duration_seconds, extraction_score, normalize_spaces, phase_status, punctuation_spacing
from scriptorium.sources.tables import table

_SPACES = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9), ' '), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' +(\n|$)', '\1', 'g')"
_COMMON = " + ".join(f"CAST(contains(low, ' {w} ') AS INT)" for w in COMMON_WORDS)
_SCORE = f"""
SELECT doc_id, lang, text, CASE WHEN n < 100 THEN 0 ELSE greatest(0, 1.0
  - CASE WHEN broken > 0.01 THEN 0.3 WHEN broken > 0 THEN 0.1 ELSE 0 END
  - CASE WHEN letters / len < 0.65 THEN 0.3 WHEN letters / len < 0.75 THEN 0.1 ELSE 0 END
  - CASE WHEN common < 6 THEN 0.3 WHEN common < 8 THEN 0.1 ELSE 0 END
  - CASE WHEN digits / greatest(letters, 1) > 0.35 THEN 0.2 ELSE 0 END) END AS score
FROM (SELECT *, {_COMMON} AS common FROM (SELECT doc_id, lang, text, length(text) AS n, length(part) AS len, lower(part) AS low,
  (length(text) - length(replace(text, chr(65533), ''))) / length(text) AS broken,
  CAST(length(regexp_replace(part, '\\P{{L}}', '', 'g')) AS DOUBLE) AS letters, CAST(length(regexp_replace(part, '\\P{{Nd}}', '', 'g')) AS DOUBLE) AS digits
  FROM (SELECT *, substr(text, 1, 20000) AS part FROM documents)))
"""


def _scored(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text", extraction_score(F.col("text")).alias("score"))


@query("B1", sql=f"SELECT doc_id, round(score, 4) AS score FROM ({_SCORE})")
def text_quality_score(spark, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 4).alias("score"))


@query("B1", "B7", "C1", sql=f"""
SELECT lang, CASE WHEN score >= 0.85 THEN 'success' WHEN score >= 0.6 THEN 'partial_success' ELSE 'failed' END AS status,
  count(*) AS n, round(avg(score), 4) AS avg_score, CAST(sum(length({_SPACES})) AS BIGINT) AS chars
FROM (SELECT *, round(score, 4) AS s FROM ({_SCORE})) GROUP BY ALL
""")
def doc_quality(spark, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir).withColumn("status", phase_status(F.col("score"), F.col("score")))
    return df.groupBy("lang", "status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.sum(F.length(normalize_spaces(F.col("text")))).alias("chars"))


@query("C1", sql=f"SELECT doc_id, sha256({_SPACES}) AS digest FROM documents")
def text_normalize_spaces(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(normalize_spaces(F.col("text")), "UTF-8"), 256).alias("digest"))


@query("C4", sql=r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+([.,!?;:])', '\1', 'g'), '([.,!?;:])([^ \t\n\r\f])', '\1 \2', 'g')) AS digest FROM documents")
def text_punctuation_spacing(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(punctuation_spacing(F.col("text")), "UTF-8"), 256).alias("digest"))


@query("D2", sql="SELECT doc_id, round(length(text) / 2700.0 * 60.0, 4) AS seconds FROM documents")
def duration_predict(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(duration_seconds(F.col("text")), 4).alias("seconds"))


@query("G1", sql="""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT (length(line) >= 10 AND before IS NOT NULL AND line = before)) AS n_kept FROM p GROUP BY doc_id
""")
def dedupe_lines(spark, sf_dir: str) -> DataFrame:
    """Lines that equal the one before are dropped; shorter lines than 10 characters pass. No shuffle: a text is one row."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    kept = F.expr("size(filter(l, (x, i) -> not (length(x) >= 10 and i > 0 and x = l[greatest(i - 1, 0)])))")
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), kept.cast("long").alias("n_kept"))


@query("H1", sql="""
WITH e AS (SELECT vec_id, label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(greatest(0, least(1, list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) / sqrt(list_dot_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[])) * list_dot_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[]))))), 4) AS coherence FROM e WHERE b IS NOT NULL
""")
def coherence_adjacent(spark, sf_dir: str) -> DataFrame:
    """Similarity of each vector to its label's next one. Neighbours are found on ids alone, range by range, as one label may
    hold most rows; vectors then meet by id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    near = following(vectors, "label", "vec_id").where("next is not null").select("vec_id", "next")
    e = near.join(vectors.select("vec_id", "a"), "vec_id").join(vectors.select(F.col("vec_id").alias("next"), F.col("a").alias("b")), "next")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return e.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")))), 4).alias("coherence"))
