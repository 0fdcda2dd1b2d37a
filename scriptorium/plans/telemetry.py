"""Queries over run telemetry; events stand for policy events: a run is a user's day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.operators.ordered import percentiles
from scriptorium.sources.tables import table

_EVENTS = """
SELECT event_id, ts, user_id, value AS duration_ms, CAST(ts AS DATE) AS day, 'phase' || CAST(1 + user_id % 5 AS VARCHAR) AS phase,
  CASE WHEN user_id % 2 = 0 THEN 'xtts' ELSE 'kokoro' END AS engine, event_type = 'error' AS failed, CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS fallback FROM events
"""


def policy_events(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", F.col("value").alias("duration_ms"), F.to_date("ts").alias("day"),
        F.concat(F.lit("phase"), (1 + F.col("user_id") % 5).cast("string")).alias("phase"),
        F.when(F.col("user_id") % 2 == 0, "xtts").otherwise("kokoro").alias("engine"),
        (F.col("event_type") == "error").alias("failed"), (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("fallback"),
    )


@query("F1", "F3", sql=f"""
SELECT phase, count(*) AS n, count(*) FILTER (failed) AS failures, round(avg(duration_ms), 4) AS avg_ms, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 4) AS p95_ms
FROM ({_EVENTS}) GROUP BY phase
""")
def policy_phase_summary(spark, sf_dir: str) -> DataFrame:
    e = policy_events(spark, sf_dir)
    s = e.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"))
    return s.join(percentiles(e, "phase", "duration_ms", {"p95_ms": 0.95}).select("phase", F.round("p95_ms", 4).alias("p95_ms")), "phase")


@query("W3", sql=f"""
WITH r AS (SELECT user_id, day, max(CAST(failed AS INT)) AS bad FROM ({_EVENTS}) GROUP BY ALL),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS later FROM r)
SELECT user_id, count(*) FILTER (later = 0) AS streak FROM s GROUP BY user_id
""")
def policy_streak(spark, sf_dir: str) -> DataFrame:
    runs = policy_events(spark, sf_dir).groupBy("user_id", "day").agg(F.max(F.col("failed").cast("int")).alias("bad"))
    w = Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("later", F.sum("bad").over(w)).groupBy("user_id").agg(F.count_if(F.col("later") == 0).alias("streak"))


@query(sql=f"""
SELECT user_id, CAST(day AS VARCHAR) AS day, round(1 - 1.5 * max(CAST(failed AS INT)) - 0.5 * avg(fallback), 9) AS reward FROM ({_EVENTS}) AS e GROUP BY user_id, e.day
""")
def policy_reward(spark, sf_dir: str) -> DataFrame:
    """Part of a run's reward: 1, less 1.5 if it failed and half its fallback rate."""
    return policy_events(spark, sf_dir).groupBy("user_id", "day").agg(F.round(1 - 1.5 * F.max(F.col("failed").cast("int")) - 0.5 * F.avg("fallback"), 9).alias("reward")).withColumn("day", F.col("day").cast("string"))


@query("W5", sql=f"""
WITH d AS (SELECT phase, day, avg(duration_ms) AS v FROM ({_EVENTS}) GROUP BY ALL)
SELECT phase, count(*) AS n, round(arg_max(v, day) - arg_min(v, day), 4) AS slope, least(1.0, count(*) / 10.0) AS confidence FROM d GROUP BY phase
""")
def run_trend(spark, sf_dir: str) -> DataFrame:
    days = policy_events(spark, sf_dir).groupBy("phase", "day").agg(F.avg("duration_ms").alias("v"))
    return days.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.max_by("v", "day") - F.min_by("v", "day"), 4).alias("slope"), F.least(F.lit(1.0), F.count("*") / 10.0).alias("confidence"))
