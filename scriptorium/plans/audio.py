"""Sample-array queries; embedding vectors stand for short clips of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import audio as A
from scriptorium.sources.tables import table

_X = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS m FROM embeddings)"
_DB = "CASE WHEN {0} < 1e-10 THEN -100 ELSE 20 * log10({0}) END"
_RMS = "sqrt(list_sum(list_transform({0}, lambda x: x * x)) / len({0}))"


def clips(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


@query("M1", "M2", "M3", "M4", "M7", "B15", sql=f"""
WITH l AS (SELECT vec_id, {_DB.format(_RMS.format("a"))} AS rms_db, {_DB.format("list_max(m)")} AS peak_db, list_filter(a, lambda x: abs(x) < 0.01) AS q FROM {_X}),
n AS (SELECT *, CASE WHEN len(q) < 100 THEN -100 ELSE {_DB.format(_RMS.format("q"))} END AS noise_db FROM l)
SELECT vec_id, round(rms_db, 4) AS rms_db, round(peak_db, 4) AS peak_db, round(noise_db, 4) AS noise_db, round(rms_db - 3, 4) AS lufs,
  concat_ws(',', CASE WHEN rms_db < -23 OR rms_db > -18 THEN 'rms' END, CASE WHEN peak_db > -3 THEN 'peak' END, CASE WHEN noise_db > -60 THEN 'noise' END) AS issues FROM n
""")
def audio_levels(spark, sf_dir: str) -> DataFrame:
    """Levels in dB and which limits of the audiobook exchange they break."""
    a = F.col("a")
    d = clips(spark, sf_dir).select("vec_id", A.decibels(A.rms(a)).alias("r"), A.decibels(A.peak(a)).alias("p"), A.noise_floor(a).alias("q"))
    issues = F.concat_ws(",", F.when((F.col("r") < -23) | (F.col("r") > -18), "rms"), F.when(F.col("p") > -3, "peak"), F.when(F.col("q") > -60, "noise"))
    return d.select("vec_id", F.round("r", 4).alias("rms_db"), F.round("p", 4).alias("peak_db"), F.round("q", 4).alias("noise_db"), F.round(F.col("r") - 3, 4).alias("lufs"), issues.alias("issues"))


@query("M5", "M6", "M13", sql=f"""
SELECT vec_id, CASE WHEN list_max(m) = 0 THEN 1 ELSE round(len(list_filter(m, lambda x: x < list_max(m) * 0.01)) / len(m), 6) END AS silence, round(len(list_filter(m, lambda x: x >= 0.99)) / len(m), 6) AS clipping,
  round(20 * log10((SELECT quantile_cont(u, 0.9) FROM (SELECT unnest(m) AS u)) / (SELECT quantile_cont(u, 0.1) FROM (SELECT unnest(m) AS u))), 4) AS dynamic_range FROM {_X}
""")
def audio_shares(spark, sf_dir: str) -> DataFrame:
    a, low = F.col("a"), A.quantile(F.col("a"), 0.1)
    top = A.peak(a)
    d = clips(spark, sf_dir).withColumn("top", top)
    return d.select(
        "vec_id", F.when(F.col("top") == 0, 1.0).otherwise(F.round(A.share_of(a, lambda x: F.abs(x) < F.col("top") * 0.01), 6)).alias("silence"), F.round(A.share_of(a, lambda x: F.abs(x) >= 0.99), 6).alias("clipping"),
        F.when(low == 0, 0.0).otherwise(F.round(20 * F.log10(A.quantile(a, 0.9) / low), 4)).alias("dynamic_range"),
    )


_SUM = "round(list_sum(list_transform(a, lambda x: abs(x * ({0})))), 4)"


@query("M9", "M10", "M15", "M16", sql=f"""
WITH l AS (SELECT *, list_max(m) AS p, {_DB.format(_RMS.format("a"))} AS r FROM {_X})
SELECT vec_id, {_SUM.format("0.95 / p")} AS normalized, {_SUM.format("0.5 / p")} AS half, {_SUM.format("CASE WHEN r < -60 THEN 1 ELSE 10 ^ ((-20 + 3 - r) / 20) END")} AS gained, {_SUM.format("CASE WHEN 20 * log10(p) > -3 THEN 10 ^ (-0.15) / p ELSE 1 END")} AS limited FROM l
""")
def audio_gains(spark, sf_dir: str) -> DataFrame:
    """Absolute sums of each clip after peak normalizing, loudness gain and limiting."""
    a = F.col("a")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)), 4)
    d = clips(spark, sf_dir).withColumn("p", A.peak(a)).withColumn("r", A.decibels(A.rms(a)))
    gain = F.when(F.col("r") < -60, 1.0).otherwise(F.pow(F.lit(10.0), (-20 + 3 - F.col("r")) / 20))
    return d.select("vec_id", total(A.scaled(a, 0.95 / F.col("p"))).alias("normalized"), total(A.scaled(a, 0.5 / F.col("p"))).alias("half"), total(A.scaled(a, gain)).alias("gained"), total(A.limited(a)).alias("limited"))


@query("W15", sql=f"""
WITH x AS (SELECT vec_id, unnest(m) < 0.05 AS quiet, generate_subscripts(m, 1) AS i FROM {_X}), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, quiet ORDER BY i) AS g FROM x),
r AS (SELECT vec_id, g, count(*) AS n FROM g WHERE quiet GROUP BY ALL)
SELECT e.vec_id, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) > 4 AS has_gap FROM embeddings AS e LEFT JOIN r ON e.vec_id = r.vec_id GROUP BY e.vec_id
""")
def audio_gaps(spark, sf_dir: str) -> DataFrame:
    run = A.longest_run(F.col("a"), lambda x: F.abs(x) < 0.05)
    return clips(spark, sf_dir).select("vec_id", run.cast("long").alias("longest"), (run > 4).alias("has_gap"))


@query("D31", "M8", "W22", sql=f"""
WITH f AS (SELECT vec_id, i, {_RMS.format("list_slice(a, i + 1, i + 8)")} AS r FROM (SELECT vec_id, a, unnest(generate_series(0, len(a) - 8, 4)) AS i FROM {_X})),
s AS (SELECT vec_id, count(*) AS n_frames, quantile_cont(r, 0.9) AS hi, quantile_cont(r, 0.1) AS lo, var_pop(r) AS v, avg(r) AS m FROM f WHERE r > 0 GROUP BY vec_id)
SELECT vec_id, n_frames, round(20 * log10(hi / lo), 4) AS snr_db, round(least(1, v / m / 10), 6) AS clarity FROM s
""")
def audio_frames(spark, sf_dir: str) -> DataFrame:
    """Signal-to-noise ratio and clarity of frames of 8 samples, 4 apart."""
    frames = F.filter(F.transform(F.sequence(F.lit(0), F.size("a") - 8, F.lit(4)), lambda i: A.rms(F.slice(F.col("a"), i + 1, F.lit(8)))), lambda r: r > 0)
    d = clips(spark, sf_dir).where(F.size("a") >= 8).select("vec_id", frames.alias("r")).where(F.size("r") > 0)
    r, n = F.col("r"), F.size("r")
    mean = F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / n
    d = d.withColumn("m", mean)
    spread = F.aggregate(r, F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / n
    return d.select("vec_id", n.cast("long").alias("n_frames"), F.round(20 * F.log10(A.quantile(r, 0.9) / A.quantile(r, 0.1)), 4).alias("snr_db"), F.round(F.least(F.lit(1.0), spread / F.col("m") / 10), 6).alias("clarity"))
