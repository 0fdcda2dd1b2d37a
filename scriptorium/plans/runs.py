"""Queries over runs, a run being a user's day of events: ordered analytics, trends, gates and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.operators.machines import ClampedSum, Lockout, states
from scriptorium.plans.telemetry import _EVENTS, policy_events
from scriptorium.sources.tables import table

#: How many of the latest events or runs count as recent.
ROLLING, RECENT_FLAGGED, LAST_RUNS = 40, 20, 10

_RUNS = f"""
SELECT user_id, day, phase, engine, min(ts) AS started, bool_or(failed) AS failed, count(*) AS n, count(*) FILTER (failed) AS failures, round(avg(fallback), 6) AS fallback,
  round(avg(duration_ms) / 50, 6) AS rtf, arg_max(duration_ms, event_id) AS last_ms,
  round(100 - least(60, 150.0 * count(*) FILTER (failed) / count(*)) - CASE WHEN avg(duration_ms) / 50 > 3 THEN 5 ELSE 0 END, 6) AS score FROM ({_EVENTS}) GROUP BY ALL
"""


def runs(spark, sf_dir: str) -> DataFrame:
    """A row a run: start, failure, event counts, rates, the last measured duration and the evaluator's score."""
    rate, slow = 150.0 * F.count_if("failed") / F.count("*"), F.avg("duration_ms") / 50
    return policy_events(spark, sf_dir).groupBy("user_id", "day", "phase", "engine").agg(
        F.min("ts").alias("started"), F.bool_or("failed").alias("failed"), F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.avg("fallback"), 6).alias("fallback"),
        F.round(slow, 6).alias("rtf"), F.max_by("duration_ms", "event_id").alias("last_ms"), F.round(100 - F.least(F.lit(60.0), rate) - F.when(slow > 3, 5).otherwise(0), 6).alias("score"),
    )


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def _by(key: str) -> Window:
    return Window.partitionBy(key)


def _latest(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last ``k`` rows of each key; Spark keeps at most ``k`` a task before it shuffles."""
    return df.withColumn("rn", F.row_number().over(_by(key).orderBy(F.desc(order)))).where(F.col("rn") <= k)


@query("W1", "F5", sql=f"""
WITH r AS (SELECT * FROM ({_EVENTS}) WHERE TRUE QUALIFY row_number() OVER (PARTITION BY engine ORDER BY event_id DESC) <= 40)
SELECT engine, count(*) AS n, round(avg(duration_ms), 4) AS recent_ms, round(avg(fallback), 6) AS recent_fallback FROM r GROUP BY engine
""")
def rolling_engine(spark, sf_dir: str) -> DataFrame:
    recent = _latest(policy_events(spark, sf_dir), "engine", "event_id", ROLLING)
    return recent.groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("recent_ms"), F.round(F.avg("fallback"), 6).alias("recent_fallback"))


@query("W1", sql=f"""
SELECT event_id, CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) OVER w AS BIGINT) / CAST(100 AS DOUBLE) / count(*) OVER w AS rolling_ms FROM ({_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)
""")
def rolling_rows(spark, sf_dir: str) -> DataFrame:
    """Averages of hundredths, summed as whole numbers, so they don't depend on the order of additions."""
    w = _by("user_id").orderBy("event_id").rowsBetween(1 - ROLLING, 0)
    cents = F.round(F.col("duration_ms") * 100).cast("long")
    return policy_events(spark, sf_dir).select("event_id", (F.sum(cents).over(w) / 100.0 / F.count("*").over(w)).alias("rolling_ms"))


@query("W2", sql=f"SELECT event_id, phase FROM ({_EVENTS}) WHERE failed QUALIFY row_number() OVER (PARTITION BY phase ORDER BY event_id DESC) <= 20")
def recent_flagged(spark, sf_dir: str) -> DataFrame:
    return _latest(policy_events(spark, sf_dir).where("failed"), "phase", "event_id", RECENT_FLAGGED).select("event_id", "phase")


@query("W4", "E4", sql=f"SELECT user_id, CAST(day AS VARCHAR) AS day, failed, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, last_ms, score FROM ({_RUNS})")
def run_fold(spark, sf_dir: str) -> DataFrame:
    """Per run: whether any event failed, the earliest time, the last measure and the evaluator's score."""
    return _day(runs(spark, sf_dir)).select("user_id", "day", "failed", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "last_ms", "score")


@query("E6", sql=f"""
SELECT user_id, CAST(day AS VARCHAR) AS day, round(score / 100 - failures / n + coalesce(score - lag(score) OVER (PARTITION BY user_id ORDER BY r.day), 0) / 50, 6) AS reward FROM ({_RUNS}) AS r
""")
def evaluator_reward(spark, sf_dir: str) -> DataFrame:
    before = F.lag("score").over(_by("user_id").orderBy("day"))
    reward = F.col("score") / 100 - F.col("failures") / F.col("n") + F.coalesce(F.col("score") - before, F.lit(0.0)) / 50
    return _day(runs(spark, sf_dir).select("user_id", "day", F.round(reward, 6).alias("reward")))


@query("W6", "W7", "F34", sql=f"""
WITH d AS (SELECT *, abs(score - lag(score) OVER (PARTITION BY user_id ORDER BY day)) AS step, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back FROM ({_RUNS}))
SELECT user_id, count(*) AS n, round(1 / (1 + coalesce(avg(step), 0)), 6) AS stability, round(stddev_pop(score), 6) AS spread, round(1 / (1 + stddev_pop(score)), 6) AS volatility_stability,
  round(arg_max(score, day) - arg_min(score, day), 6) AS drift, round(avg(score), 6) AS avg_score, round(avg(score) FILTER (back <= 5), 6) AS avg_last5, round(avg(score) FILTER (back <= 10), 6) AS avg_last10,
  min(score) FILTER (back <= 10) AS min_last10, max(score) FILTER (back <= 10) AS max_last10 FROM d GROUP BY user_id
""")
def run_history(spark, sf_dir: str) -> DataFrame:
    """Long-horizon aggregate of each user's scores; the spread is the population's deviation."""
    w = _by("user_id").orderBy("day")
    d = runs(spark, sf_dir).withColumn("step", F.abs(F.col("score") - F.lag("score").over(w))).withColumn("back", F.row_number().over(_by("user_id").orderBy(F.desc("day"))))
    last = lambda k: F.when(F.col("back") <= k, F.col("score"))
    r6 = lambda c: F.round(c, 6)
    return d.groupBy("user_id").agg(
        F.count("*").alias("n"), r6(1 / (1 + F.coalesce(F.avg("step"), F.lit(0.0)))).alias("stability"), r6(F.stddev_pop("score")).alias("spread"), r6(1 / (1 + F.stddev_pop("score"))).alias("volatility_stability"),
        r6(F.max_by("score", "day") - F.min_by("score", "day")).alias("drift"), r6(F.avg("score")).alias("avg_score"), r6(F.avg(last(5))).alias("avg_last5"), r6(F.avg(last(10))).alias("avg_last10"),
        F.min(last(10)).alias("min_last10"), F.max(last(10)).alias("max_last10"),
    )


@query("W8", "W10", sql=f"""
WITH d AS (SELECT * FROM ({_RUNS}) AS r WHERE TRUE QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r.day DESC) <= 10)
SELECT user_id, count(*) AS n, round(avg(score), 6) AS avg_score, round(arg_max(score, day) - arg_min(score, day), 6) AS trend, round(sum(failures) / count(*), 6) AS anomaly_frequency,
  arg_max(failures, day) - arg_min(failures, day) AS anomaly_slope FROM d GROUP BY user_id
""")
def last_ten_runs(spark, sf_dir: str) -> DataFrame:
    last = _latest(runs(spark, sf_dir), "user_id", "day", LAST_RUNS)
    return last.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max_by("score", "day") - F.min_by("score", "day"), 6).alias("trend"),
        F.round(F.sum("failures") / F.count("*"), 6).alias("anomaly_frequency"), (F.max_by("failures", "day") - F.min_by("failures", "day")).alias("anomaly_slope"),
    )


@query("W9", sql=f"""
WITH d AS (SELECT user_id, count(*) AS n, round(arg_max(score, day) - arg_min(score, day), 6) AS slope, sum(failures) AS anomalies FROM ({_RUNS}) GROUP BY user_id)
SELECT user_id, n >= 3 AND (slope < 0 OR anomalies > 0) AS drifting, CASE WHEN n < 3 THEN 0 ELSE round(least(1, (greatest(0, -slope) + anomalies) / 10), 6) END AS severity FROM d
""")
def run_drift(spark, sf_dir: str) -> DataFrame:
    d = runs(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max_by("score", "day") - F.min_by("score", "day"), 6).alias("slope"), F.sum("failures").alias("anomalies"))
    severity = F.round(F.least(F.lit(1.0), (F.greatest(F.lit(0.0), -F.col("slope")) + F.col("anomalies")) / 10), 6)
    return d.select("user_id", ((F.col("n") >= 3) & ((F.col("slope") < 0) | (F.col("anomalies") > 0))).alias("drifting"), F.when(F.col("n") < 3, 0.0).otherwise(severity).alias("severity"))


@query("W11", "B22", sql=f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS back, lag(failed) OVER (PARTITION BY user_id ORDER BY day) AS was FROM ({_RUNS})),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (failed) AS bad, count(*) FILTER (back <= 3 AND was <> failed) = 3 AND count(*) >= 4 AS alternating, round(avg(rtf), 6) AS usual, arg_max(rtf, day) AS latest FROM d GROUP BY user_id)
SELECT user_id, alternating, concat_ws(',', CASE WHEN n < 5 THEN 'insufficient_data' END, CASE WHEN bad / n > 0.35 THEN 'high_failure_rate' END, CASE WHEN abs(latest - usual) / usual > 0.25 THEN 'rtf_drift' END,
  CASE WHEN alternating THEN 'unstable' END) AS reasons FROM g
""")
def safety_gates(spark, sf_dir: str) -> DataFrame:
    """Reasons that block a user's next run."""
    d = runs(spark, sf_dir).withColumn("back", F.row_number().over(_by("user_id").orderBy(F.desc("day")))).withColumn("was", F.lag("failed").over(_by("user_id").orderBy("day")))
    g = d.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("bad"), ((F.count_if((F.col("back") <= 3) & (F.col("was") != F.col("failed"))) == 3) & (F.count("*") >= 4)).alias("alternating"),
        F.round(F.avg("rtf"), 6).alias("usual"), F.max_by("rtf", "day").alias("latest"),
    )
    reason = lambda test, name: F.when(test, name)
    drift = F.abs(F.col("latest") - F.col("usual")) / F.col("usual") > 0.25
    return g.select("user_id", "alternating", F.concat_ws(",", reason(F.col("n") < 5, "insufficient_data"), reason(F.col("bad") / F.col("n") > 0.35, "high_failure_rate"), reason(drift, "rtf_drift"), reason(F.col("alternating"), "unstable")).alias("reasons"))


@query("W13", sql=f"""
WITH g AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM ({_RUNS}))
SELECT user_id, CAST(g.day AS VARCHAR) AS day, count(*) FILTER (NOT failed) OVER (PARTITION BY user_id, island ORDER BY g.day ROWS UNBOUNDED PRECEDING) AS streak FROM g
""")
def voice_streak(spark, sf_dir: str) -> DataFrame:
    """Successes since the last failure, at each run."""
    upto = lambda *k: Window.partitionBy(*k).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    g = runs(spark, sf_dir).withColumn("island", F.count_if("failed").over(upto("user_id")))
    return _day(g.select("user_id", "day", F.count_if(~F.col("failed")).over(upto("user_id", "island")).alias("streak")))


@query("W24", sql=f"""
SELECT user_id, CAST(r.day AS VARCHAR) AS day, round(score - avg(score) OVER (PARTITION BY user_id ORDER BY r.day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS delta FROM ({_RUNS}) AS r
""")
def previous_runs(spark, sf_dir: str) -> DataFrame:
    w = _by("user_id").orderBy("day").rowsBetween(-LAST_RUNS, -1)
    return _day(runs(spark, sf_dir).select("user_id", "day", F.round(F.col("score") - F.avg("score").over(w), 6).alias("delta")))


@query("W16", "W17", "W21", sql=f"""
WITH s AS (SELECT event_id, epoch(ts) + 0.0 AS b, epoch(ts) + duration_ms AS e, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nb, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM ({_EVENTS}))
SELECT event_id, round(nb - e, 3) AS gap_s, coalesce(nb - e >= 0.5, FALSE) AS long_gap, coalesce(e > nb, FALSE) AS overlaps, coalesce(event_id <= was, FALSE) AS out_of_order FROM s
""")
def segment_gaps(spark, sf_dir: str) -> DataFrame:
    """Events as segments of ``duration_ms`` seconds: the gap to the user's next one, overlap, and ids that do not rise."""
    w = _by("user_id").orderBy("ts", "event_id")
    begin = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = policy_events(spark, sf_dir).select("event_id", (begin + F.col("duration_ms")).alias("e"), F.lead(begin).over(w).alias("nb"), F.lag("event_id").over(w).alias("was"))
    return s.select("event_id", F.round(F.col("nb") - F.col("e"), 3).alias("gap_s"), F.coalesce(F.col("nb") - F.col("e") >= 0.5, F.lit(False)).alias("long_gap"), F.coalesce(F.col("e") > F.col("nb"), F.lit(False)).alias("overlaps"), F.coalesce(F.col("event_id") <= F.col("was"), F.lit(False)).alias("out_of_order"))


@query("W18", sql=f"""
WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, sum(duration_ms) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stop, duration_ms FROM ({_EVENTS})),
t AS (SELECT *, max(stop) OVER (PARTITION BY user_id) AS total FROM o)
SELECT event_id, round((stop - duration_ms) * 3600 / total, 3) AS start_s, round(stop * 3600 / total, 3) AS stop_s, greatest(10, CAST(round(duration_ms * 100) AS BIGINT)) AS karaoke_cs FROM t
""")
def rescaled_segments(spark, sf_dir: str) -> DataFrame:
    """Segments laid end to end and rescaled to an hour, with their lengths in centiseconds, 10 at least."""
    o = policy_events(spark, sf_dir).withColumn("stop", F.sum("duration_ms").over(_by("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)))
    t = o.withColumn("total", F.max("stop").over(_by("user_id")))
    at = lambda c: F.round(c * 3600 / F.col("total"), 3)
    return t.select("event_id", at(F.col("stop") - F.col("duration_ms")).alias("start_s"), at(F.col("stop")).alias("stop_s"), F.greatest(F.lit(10).cast("long"), F.round(F.col("duration_ms") * 100).cast("long")).alias("karaoke_cs"))


@query("W19", sql=f"""
WITH w AS (SELECT event_id, user_id, day, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(floor(duration_ms * 1000) AS BIGINT) AS stop FROM ({_EVENTS})),
n AS (SELECT event_id, start_us, lead(start_us) OVER (PARTITION BY user_id, day ORDER BY start_us, event_id) AS next_us, max(stop) OVER (PARTITION BY user_id, day) AS line_end FROM w)
SELECT event_id, greatest(10, (coalesce(next_us, line_end) - start_us) // 10000) AS karaoke_cs FROM n
""")
def karaoke_durations(spark, sf_dir: str) -> DataFrame:
    """Centiseconds, cut off, 10 at least, from an event, a word, to the next one of its day, the line, or to the line's end."""
    day = Window.partitionBy("user_id", "day")
    w = policy_events(spark, sf_dir).select("event_id", "user_id", "day", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.floor(F.col("duration_ms") * 1000).cast("long").alias("_d"))
    until = F.coalesce(F.lead("at").over(day.orderBy("at", "event_id")), F.max(F.col("at") + F.col("_d")).over(day))
    return w.withColumn("_us", until - F.col("at")).select("event_id", F.greatest(F.lit(10).cast("long"), F.expr("_us div 10000")).alias("karaoke_cs"))


@query("E5", sql=f"""
WITH r AS (SELECT user_id, day, phase, engine, bool_or(failed) AS failed, bool_or(failed AND fallback >= .9) AS hallucination, CAST(sum(CAST(round(fallback * 100) AS BIGINT)) AS BIGINT) AS f, count(fallback) AS nf,
  CAST(sum(CAST(round(duration_ms * 100) AS BIGINT)) AS BIGINT) AS d, count(duration_ms) AS nd FROM ({_EVENTS}) GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, phase, engine, (1000000 - CASE WHEN failed THEN 1500000 ELSE 0 END - coalesce(5000 * f // nf, 0) - greatest(0, coalesce(20 * d // nd, 0) - 200000) - CASE WHEN hallucination THEN 300000 ELSE 0 END) / CAST(1000000 AS DOUBLE) AS reward FROM r
""")
def run_reward(spark, sf_dir: str) -> DataFrame:
    """Reward of a run by its failure, fallback rate, slowness beyond a factor of two, and hallucination, for which a failed
    event of a fallback rate of .9 or more stands; in whole millionths, so it doesn't depend on the order of additions."""
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    r = policy_events(spark, sf_dir).groupBy("user_id", "day", "phase", "engine").agg(
        F.bool_or("failed").alias("failed"), F.bool_or(F.col("failed") & (F.col("fallback") >= 0.9)).alias("hallucination"),
        F.sum(hundredths("fallback")).alias("f"), F.count("fallback").alias("nf"), F.sum(hundredths("duration_ms")).alias("d"), F.count("duration_ms").alias("nd"),
    )
    if_so = lambda c, n: F.when(F.col(c), n).otherwise(0)
    fallback, slow = (F.when(F.col(n) > 0, F.expr(f"{k} * {c} div {n}")).otherwise(0) for k, c, n in ((5000, "f", "nf"), (20, "d", "nd")))
    millionths = 1_000_000 - if_so("failed", 1_500_000) - fallback - F.greatest(F.lit(0), slow - 200_000) - if_so("hallucination", 300_000)
    return _day(r).select("user_id", "day", "phase", "engine", (millionths / 1e6).alias("reward"))


@query(sql=f"""
WITH d AS (SELECT *, (300 * CAST(floor(score * 10) AS BIGINT) + 250 * CAST(floor((1 - fallback) * 1000) AS BIGINT) + 250 * ((n - failures) * 1000 // n) + 200 * CAST(floor(least(1, rtf / 4) * 1000) AS BIGINT)) / CAST(1000000 AS DOUBLE) AS rating, round((score / 100 + (1 - fallback) + (1 - failures / n)) / 3, 6) AS mean FROM ({_RUNS}))
SELECT user_id, CAST(d.day AS VARCHAR) AS day, rating, CASE WHEN mean >= .8 THEN 'ok' WHEN mean >= .5 THEN 'needs_attention' ELSE 'critical' END AS verdict, CASE WHEN rating < .2 THEN 'high' WHEN rating < .4 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN mean >= .7 THEN 'healthy' WHEN mean >= .4 THEN 'caution' ELSE 'unstable' END AS health, CASE WHEN failures > 5 THEN 'structural' WHEN failures > 0 THEN 'metadata' ELSE 'unknown' END AS heal,
  CASE engine WHEN 'xtts' THEN 'enforce' ELSE 'tune' END AS mode, concat_ws(',', CASE WHEN score / 100 < .4 THEN 'low_score' END, CASE WHEN 1 - fallback < .4 THEN 'low_engine' END, CASE WHEN 1 - failures / n < .4 THEN 'low_success' END) AS issues FROM d
""")
def run_ratings(spark, sf_dir: str) -> DataFrame:
    """Weighted rating in thousandths, verdict, risk, health, healing class and the issues of each run's dimensions."""
    dims = {"score": F.col("score") / 100, "engine": 1 - F.col("fallback"), "success": 1 - F.col("failures") / F.col("n")}
    whole = lambda c: F.floor(c * 1000).cast("long")
    success = F.call_function("div", (F.col("n") - F.col("failures")) * 1000, F.col("n"))
    rating = (300 * F.floor(F.col("score") * 10).cast("long") + 250 * whole(dims["engine"]) + 250 * success + 200 * whole(F.least(F.lit(1.0), F.col("rtf") / 4))) / 1_000_000.0
    d = runs(spark, sf_dir).withColumn("rating", rating).withColumn("mean", F.round((dims["score"] + dims["engine"] + dims["success"]) / 3, 6))
    band = lambda c, *steps, last: _bands(F.col(c), steps, last)
    return _day(d.select(
        "user_id", "day", "rating", band("mean", (0.8, "ok"), (0.5, "needs_attention"), last="critical").alias("verdict"), F.when(F.col("rating") < 0.2, "high").when(F.col("rating") < 0.4, "medium").otherwise("low").alias("risk"),
        band("mean", (0.7, "healthy"), (0.4, "caution"), last="unstable").alias("health"), F.when(F.col("failures") > 5, "structural").when(F.col("failures") > 0, "metadata").otherwise("unknown").alias("heal"),
        F.when(F.col("engine") == "xtts", "enforce").otherwise("tune").alias("mode"), F.concat_ws(",", *(F.when(v < 0.4, f"low_{k}") for k, v in dims.items())).alias("issues"),
    ))


def _bands(value: Column, steps, last: str) -> Column:
    out = F.lit(last)
    for low, name in reversed(steps):
        out = F.when(value >= low, name).otherwise(out)
    return out


@query("W12", "W14", sql="""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS drift, CASE WHEN event_type <> 'signup' THEN greatest(-200, least(200, CAST(round((value - 50) * 100) AS BIGINT))) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 0 AS drifts, 0 AS locked, CAST(0 AS BIGINT) AS delta FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN f.locked > 0 OR NOT e.drift OR f.drifts = 2 THEN 0 ELSE f.drifts + 1 END, CASE WHEN f.locked > 0 THEN f.locked - 1 WHEN e.drift AND f.drifts = 2 THEN 5 ELSE 0 END,
    CASE WHEN e.d IS NULL THEN 0 ELSE greatest(-2000, least(2000, f.delta + e.d)) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, drifts, locked, delta / CAST(100 AS DOUBLE) AS delta FROM f WHERE k > 0
""")
def escalation_states(spark, sf_dir: str) -> DataFrame:
    """The stream's two machines in batch: drifts and what is left of a lockout, and the sum of steps, after each event of a
    user. A user's events are folded range by range, see ``operators/machines.py``."""
    lock, total = Lockout(), ClampedSum()
    amount = F.when(F.col("event_type") != "signup", F.round((F.col("value") - 50) * 100))
    s = states(table(spark, sf_dir, "events"), "user_id", "event_id", {"lock": (lock, (F.col("event_type") == "error").cast("int")), "total": (total, amount)})
    free = F.col("lock") < lock.drifts
    return s.select("user_id", "event_id", F.when(free, F.col("lock")).otherwise(0).cast("int").alias("drifts"), F.when(free, 0).otherwise(F.col("lock") - lock.drifts + 1).cast("int").alias("locked"), (F.col("total") / 100.0).alias("delta"))
