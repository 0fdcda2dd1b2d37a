"""Grouped statistics over run telemetry, each with partial aggregation before its one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.operators.ordered import order_statistics, percentiles
from scriptorium.plans.runs import _RUNS, runs
from scriptorium.plans.telemetry import _EVENTS, policy_events
from scriptorium.sources.tables import table


def _r(c, digits: int = 4):
    return F.round(c, digits)


@query("F2", "F9", sql=f"""
SELECT engine, count(*) AS n, round(avg(duration_ms), 4) AS mean, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.9), 4) AS p90, round(quantile_cont(duration_ms, 0.95), 4) AS p95,
  round(quantile_cont(duration_ms, 0.99), 4) AS p99, min(duration_ms) AS low, max(duration_ms) AS high, round(1 - count(*) FILTER (failed) / count(*), 6) AS success_rate FROM ({_EVENTS}) GROUP BY engine
""")
def number_summary(spark, sf_dir: str) -> DataFrame:
    """Percentiles come from cumulated counts of equal values, so no group of an engine is held in one buffer."""
    e = policy_events(spark, sf_dir)
    shares = {f"p{p}": p / 100 for p in (50, 90, 95, 99)}
    s = e.groupBy("engine").agg(F.count("*").alias("n"), _r(F.avg("duration_ms")).alias("mean"), F.min("duration_ms").alias("low"), F.max("duration_ms").alias("high"), _r(1 - F.count_if("failed") / F.count("*"), 6).alias("success_rate"))
    q = percentiles(e, "engine", "duration_ms", shares).select("engine", *(_r(k).alias(k) for k in shares))
    return s.join(q, "engine").select("engine", "n", "mean", *shares, "low", "high", "success_rate")


@query("F10", sql=f"SELECT coalesce(phase, 'all') AS phase, count(*) AS n, round(sum(duration_ms), 2) AS total, count(*) FILTER (failed) AS failures FROM ({_EVENTS}) GROUP BY ROLLUP (phase)")
def timing_rollup(spark, sf_dir: str) -> DataFrame:
    r = policy_events(spark, sf_dir).rollup("phase").agg(F.count("*").alias("n"), _r(F.sum("duration_ms"), 2).alias("total"), F.count_if("failed").alias("failures"))
    return r.withColumn("phase", F.coalesce("phase", F.lit("all")))


@query("F6", "E29", sql=f"""
WITH e AS (SELECT engine, count(*) FILTER (NOT failed) / count(*) AS r FROM ({_EVENTS}) GROUP BY engine)
SELECT engine, round(r, 6) AS reliability, r >= 0.55 AND r = max(r) OVER () AS advised FROM e
""")
def engine_reliability(spark, sf_dir: str) -> DataFrame:
    """Share of successes by engine; the window runs over one row an engine."""
    e = policy_events(spark, sf_dir).groupBy("engine").agg((F.count_if(~F.col("failed")) / F.count("*")).alias("r"))
    best = F.max("r").over(Window.partitionBy(F.lit(1)))
    return e.select("engine", _r("r", 6).alias("reliability"), ((F.col("r") >= 0.55) & (F.col("r") == best)).alias("advised"))


@query("F7", sql=f"""
WITH p AS (SELECT phase, avg(duration_ms) AS a, max(duration_ms) - min(duration_ms) AS s FROM ({_EVENTS}) GROUP BY phase)
SELECT arg_max(phase, a) AS slowest, arg_min(phase, a) AS fastest, (SELECT phase FROM p ORDER BY s DESC, phase LIMIT 1) AS most_variable FROM p
""")
def phase_extremes(spark, sf_dir: str) -> DataFrame:
    p = policy_events(spark, sf_dir).groupBy("phase").agg(F.avg("duration_ms").alias("a"), (F.max("duration_ms") - F.min("duration_ms")).alias("s"))
    ordered = F.struct(-F.col("s"), "phase")
    return p.agg(F.max_by("phase", "a").alias("slowest"), F.min_by("phase", "a").alias("fastest"), F.min_by("phase", ordered).alias("most_variable"))


@query("F8", sql=f"SELECT CAST(e.day AS VARCHAR) AS day, engine, count(*) AS n, count(*) FILTER (failed) AS errors, round(avg(duration_ms), 4) AS mean FROM ({_EVENTS}) AS e GROUP BY e.day, engine")
def dashboard_series(spark, sf_dir: str) -> DataFrame:
    d = policy_events(spark, sf_dir).groupBy("day", "engine").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), _r(F.avg("duration_ms")).alias("mean"))
    return d.withColumn("day", F.col("day").cast("string"))


@query("F13", "F15", "E28", "E30", sql=f"""
WITH f AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT failed) AS ok, array_to_string(list_sort(list_distinct(list(phase))), ',') AS phases, avg(duration_ms) FILTER (NOT failed) AS m, avg(duration_ms) AS a, count(*) FILTER (failed AND duration_ms > 60) AS long_failures FROM ({_EVENTS}) GROUP BY user_id)
SELECT user_id, n, ok, phases, round(m, 4) AS mean_ok, long_failures, CASE WHEN ok = n THEN 'success' WHEN ok = 0 THEN 'failed' ELSE 'partial' END AS status,
  CASE WHEN ok / n >= .95 THEN 'good' WHEN ok / n >= .8 THEN 'warning' WHEN ok / n >= .5 THEN 'poor' ELSE 'critical' END AS severity,
  CASE WHEN a > 60 THEN 'reduce' WHEN a < 40 THEN 'increase' ELSE 'none' END AS chunk_advice, CASE WHEN 1 - ok / n > .35 THEN 4 WHEN 1 - ok / n < .05 THEN 1 ELSE 0 END AS retries FROM f
""")
def file_rollup(spark, sf_dir: str) -> DataFrame:
    """Chunk results by file: counts, status, severity, and advice on chunk size and retries (0: unchanged)."""
    ok = ~F.col("failed")
    f = policy_events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"), F.avg(F.when(ok, F.col("duration_ms"))).alias("m"), F.avg("duration_ms").alias("a"),
        F.count_if(F.col("failed") & (F.col("duration_ms") > 60)).alias("long_failures"),
    )
    rate = F.col("ok") / F.col("n")
    return f.select(
        "user_id", "n", "ok", "phases", _r("m").alias("mean_ok"), "long_failures", F.when(F.col("ok") == F.col("n"), "success").when(F.col("ok") == 0, "failed").otherwise("partial").alias("status"),
        F.when(rate >= 0.95, "good").when(rate >= 0.8, "warning").when(rate >= 0.5, "poor").otherwise("critical").alias("severity"),
        F.when(F.col("a") > 60, "reduce").when(F.col("a") < 40, "increase").otherwise("none").alias("chunk_advice"), F.when(1 - rate > 0.35, 4).when(1 - rate < 0.05, 1).otherwise(0).alias("retries"),
    )


@query("F16", "F17", sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY rtf, user_id, day) AS i, count(*) OVER (PARTITION BY phase) AS total FROM ({_RUNS}))
SELECT phase, round(avg(rtf), 6) AS mean, max(rtf) FILTER (i = total // 2 + 1) AS upper_median, CASE WHEN max(rtf) FILTER (i = total // 2 + 1) > 2.5 THEN -10 WHEN max(rtf) FILTER (i = total // 2 + 1) < 1 THEN 10 ELSE 0 END AS change FROM r GROUP BY phase
""")
def benchmark_rtf(spark, sf_dir: str) -> DataFrame:
    """Mean and upper median by phase: counts of equal values are cumulated over ranges, so no phase is sorted in one task."""
    r = runs(spark, sf_dir).select("phase", "rtf")
    m = r.groupBy("phase").agg(_r(F.avg("rtf"), 6).alias("mean")).join(order_statistics(r, "phase", "rtf", {"upper_median": F.floor(F.col("n") / 2)}), "phase").drop("n")
    return m.withColumn("change", F.when(F.col("upper_median") > 2.5, -10).when(F.col("upper_median") < 1, 10).otherwise(0))


@query("F18", "F19", sql=f"""
WITH s AS (SELECT phase, engine, count(*) AS n, count(*) FILTER (NOT failed) / count(*) AS r FROM ({_EVENTS}) GROUP BY ALL)
SELECT phase, engine, round(r, 6) AS rate, round(least(.95, .3 + sum(n) OVER (PARTITION BY phase) / 100.0), 6) AS confidence FROM s WHERE TRUE QUALIFY row_number() OVER (PARTITION BY phase ORDER BY r DESC, engine) = 1
""")
def best_strategy(spark, sf_dir: str) -> DataFrame:
    s = policy_events(spark, sf_dir).groupBy("phase", "engine").agg(F.count("*").alias("n"), (F.count_if(~F.col("failed")) / F.count("*")).alias("r"))
    best = s.groupBy("phase").agg(F.min_by(F.struct("engine", "r"), F.struct(-F.col("r"), "engine")).alias("b"), F.sum("n").alias("n"))
    return best.select("phase", "b.engine", _r("b.r", 6).alias("rate"), _r(F.least(F.lit(0.95), 0.3 + F.col("n") / 100.0), 6).alias("confidence"))


@query("F21", "F22", sql=f"""
SELECT engine, CAST(floor(rtf) AS BIGINT) AS size, count(*) AS n, round(avg(score), 4) AS score, round(avg(failures / n), 6) AS failure_rate, round(count(*) / (count(*) + 5), 6) AS confidence FROM ({_RUNS}) GROUP BY ALL
""")
def stability_profile(spark, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("engine", F.floor("rtf").alias("size")).agg(F.count("*").alias("n"), _r(F.avg("score")).alias("score"), _r(F.avg(F.col("failures") / F.col("n")), 6).alias("failure_rate"), _r(F.count("*") / (F.count("*") + 5), 6).alias("confidence"))


@query("F23", sql="""
WITH u AS (SELECT lang AS genre, source, n_chars FROM documents UNION ALL SELECT role, 'chat', length(text) FROM conversations),
c AS (SELECT genre, source, count(*) AS n, sum(n_chars) AS s FROM u GROUP BY ALL)
SELECT genre, CAST(sum(n) AS BIGINT) AS n, arg_min(source, {'a': -n, 'b': source}) AS top_source, CAST(sum(s) // sum(n) AS BIGINT) AS mean_chars FROM c GROUP BY genre
""")
def genre_profile(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("genre"), "source", "n_chars")
    chat = table(spark, sf_dir, "conversations").select(F.col("role").alias("genre"), F.lit("chat").alias("source"), F.length("text").cast("long").alias("n_chars"))
    c = docs.unionByName(chat).groupBy("genre", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    return c.groupBy("genre").agg(F.sum("n").alias("n"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_source"), F.floor(F.sum("s") / F.sum("n")).cast("long").alias("mean_chars"))


@query("F24", sql="""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT user_id, event_type, count(*) AS n, count(*) FILTER (back <= 5) AS n_tail FROM l WHERE back <= 200 GROUP BY ALL
""")
def memory_summary(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id").withColumn("back", F.row_number().over(w)).where("back <= 200")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("back") <= 5).alias("n_tail"))


@query("F29", sql=f"""
WITH b AS (SELECT CAST(least(6, floor(duration_ms / 15)) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (failed) / count(*) AS r FROM ({_EVENTS}) GROUP BY 1)
SELECT bucket, n, round(r, 3) AS rate, CASE WHEN r > .4 THEN 'preemptive_split' WHEN r > .25 THEN 'use_kokoro' ELSE 'none' END AS advice FROM b WHERE n >= 5
""")
def length_buckets(spark, sf_dir: str) -> DataFrame:
    b = policy_events(spark, sf_dir).groupBy(F.least(F.lit(6).cast("long"), F.floor(F.col("duration_ms") / 15)).alias("bucket")).agg(F.count("*").alias("n"), (F.count_if("failed") / F.count("*")).alias("r")).where("n >= 5")
    return b.select("bucket", "n", _r("r", 3).alias("rate"), F.when(F.col("r") > 0.4, "preemptive_split").when(F.col("r") > 0.25, "use_kokoro").otherwise("none").alias("advice"))


@query("F30", sql=f"""
WITH r AS (SELECT phase, score, row_number() OVER (PARTITION BY phase ORDER BY score) AS i, count(*) OVER (PARTITION BY phase) AS n FROM ({_RUNS}))
SELECT phase, max(score) FILTER (i = n // 4 + 1) AS threshold FROM r GROUP BY phase
""")
def quartile_threshold(spark, sf_dir: str) -> DataFrame:
    return order_statistics(runs(spark, sf_dir).select("phase", "score"), "phase", "score", {"threshold": F.floor(F.col("n") / 4)}).drop("n")


@query("F33", sql=f"""
WITH m AS (SELECT max(e.day) AS last FROM ({_EVENTS}) AS e), c AS (SELECT user_id, phase, count(*) FILTER (e.day = last) AS now, count(*) FILTER (e.day < last) AS before FROM ({_EVENTS}) AS e, m WHERE failed GROUP BY ALL)
SELECT user_id, phase, now, now > 1 AS regressed, before = 0 AS is_new FROM c WHERE now > 0
""")
def anomaly_clusters(spark, sf_dir: str) -> DataFrame:
    """Failures of the last day by label, and those that earlier days lack."""
    e = policy_events(spark, sf_dir)
    f = e.where("failed").withColumn("last", e.agg(F.max("day")).scalar())
    c = f.groupBy("user_id", "phase").agg(F.count_if(F.col("day") == F.col("last")).alias("now"), F.count_if(F.col("day") < F.col("last")).alias("before"))
    return c.where("now > 0").select("user_id", "phase", "now", (F.col("now") > 1).alias("regressed"), (F.col("before") == 0).alias("is_new"))


@query("F39", "B20", sql=f"""
SELECT user_id, count(*) AS n, round(avg(duration_ms), 4) AS mean_s, max(duration_ms) AS longest, round(sum(duration_ms) / 3600, 6) AS coverage, sum(duration_ms) / 3600 >= 0.98 AS covered FROM ({_EVENTS}) GROUP BY user_id
""")
def segment_statistics(spark, sf_dir: str) -> DataFrame:
    d = policy_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), _r(F.avg("duration_ms")).alias("mean_s"), F.max("duration_ms").alias("longest"), F.sum("duration_ms").alias("s"))
    return d.select("user_id", "n", "mean_s", "longest", _r(F.col("s") / 3600, 6).alias("coverage"), (F.col("s") / 3600 >= 0.98).alias("covered"))
