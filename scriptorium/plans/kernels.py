"""Ratings, gates, overrides and advice over runs: small decisions on a row each, after one aggregate of the events.

A run is a user's day with one engine. The reference's kernels read dictionaries of signals; here a signal is a whole
number of hundredths that the run's events give, missing for every fifth, so that defaults and clamps take effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.operators.ordered import percentiles
from scriptorium.sources.tables import table

_SIGNALS = """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN user_id % 2 = 0 THEN 'xtts' ELSE 'kokoro' END AS engine, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS ks, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS kmax, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS kmin,
  max(event_id) AS last_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL
"""


def signals(spark, sf_dir: str) -> DataFrame:
    """A row a run: counts and whole numbers that signals are made of."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), F.when(F.col("user_id") % 2 == 0, "xtts").otherwise("kokoro").alias("engine"), "event_type", k.alias("k"))
    return e.groupBy("user_id", "day", "engine").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("k").alias("ks"), F.max("k").alias("kmax"), F.min("k").alias("kmin"), F.max("event_id").alias("last_id"), F.countDistinct("event_type").alias("kinds"),
    )


def _signal(i: int) -> Column:
    """The i-th signal, from -0.2 to 1.19, or null."""
    return F.when((F.col("last_id") + i) % 5 != 0, ((F.col("ks") * (i + 3) + F.col("last_id") * (i + 1)) % 140 - 20) / F.lit(100.0))


def _signal_sql(i: int) -> str:
    return f"CASE WHEN (last_id + {i}) % 5 <> 0 THEN ((ks * {i + 3} + last_id * {i + 1}) % 140 - 20) / CAST(100 AS DOUBLE) END"


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def dimensions(names, default, first: int = 0) -> dict[str, Column]:
    """Clamped signals by name; ``default`` (one, or one for each) where there is none."""
    values = default if isinstance(default, tuple) else (default,) * len(names)
    return {name: clamp(F.coalesce(_signal(first + i), F.lit(v))) for i, (name, v) in enumerate(zip(names, values, strict=True))}


def _dimensions_sql(names, default, first: int = 0) -> str:
    values = default if isinstance(default, tuple) else (default,) * len(names)
    return ", ".join(f"least(1, greatest(0, coalesce({_signal_sql(first + i)}, CAST({v} AS DOUBLE)))) AS {name}" for i, (name, v) in enumerate(zip(names, values, strict=True)))


def mean(dims) -> Column:
    """Their sum, in order, over their number."""
    total, *rest = dims.values()
    for d in rest:
        total = total + d
    return total / len(dims)


def _mean_sql(names) -> str:
    return f"({' + '.join(names)}) / {len(names)}"


def listed(**tests: Column) -> Column:
    """Names of the tests that hold, joined by commas."""
    return F.concat_ws(",", *(F.when(test, name) for name, test in tests.items()))


def _listed_sql(**tests: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items()) + ")"


def _low(dims: dict[str, Column], below: float) -> Column:
    return listed(**{f"{k}_low": v < below for k, v in dims.items()})


def _low_sql(names, below: float) -> str:
    return _listed_sql(**{f"{k}_low": f"{k} < {below}" for k in names})


def _run(*cols) -> list:
    return ["user_id", "day", *cols]


INTEGRITY = ("readiness", "stability", "drift", "self_eval", "retrospection", "review", "audit")
META = ("coherence", "consistency", "stability", "quality")
REVIEW = ("stability", "coherence", "quality")
AUDIT = ("tts_quality", "chunk_flow", "reasoning_clarity", "engine_stability")
SELF = ("audio_quality", "stability", "speed", "robustness", "autonomy_safety")
#: The self-rating's dimensions with their weights and defaults.
RATED = (("coherence", 0.3, 0.75), ("alignment", 0.25, 0.75), ("stability", 0.25, 0.7), ("efficiency", 0.2, 0.7))
SELF_DEFAULTS = (0.8, 0.75, 0.7, 0.7, 0.9)


@query("E17", "E39", sql=f"""
WITH d AS (SELECT user_id, day, {_dimensions_sql(INTEGRITY, 0.5)} FROM ({_SIGNALS})), r AS (SELECT user_id, day, {_mean_sql(INTEGRITY)} AS rating, {_low_sql(INTEGRITY, 0.3)} AS issues FROM d)
SELECT user_id, day, rating, issues, array_to_string(list_filter(string_split(issues, ','), lambda i: contains(i, 'low')), ',') AS critical, CASE WHEN rating < 0.5 THEN 'integrity_below_threshold' ELSE '' END AS warnings FROM r
""")
def integrity_ratings(spark, sf_dir: str) -> DataFrame:
    dims = dimensions(INTEGRITY, 0.5)
    r = signals(spark, sf_dir).select(*_run(mean(dims).alias("rating"), _low(dims, 0.3).alias("issues")))
    critical = F.array_join(F.filter(F.split("issues", ","), lambda i: F.contains(i, F.lit("low"))), ",")
    return r.select(*_run("rating", "issues", critical.alias("critical"), F.when(F.col("rating") < 0.5, "integrity_below_threshold").otherwise("").alias("warnings")))


@query("E18", "E19", "E40", sql=f"""
WITH d AS (SELECT user_id, day, {_dimensions_sql(META, 0.5)} FROM ({_SIGNALS})),
m AS (SELECT user_id, day, {_mean_sql(META)} AS score, {_listed_sql(**{k: f"{k} < 0.4" for k in META})} AS weak, {_listed_sql(**{k: f"{k} >= 0.7" for k in META})} AS strong FROM d)
SELECT user_id, day, score, weak, strong, CASE WHEN weak = '' THEN '' ELSE string_split(weak, ',')[1] END AS top_issue, CASE WHEN strong = '' THEN '' ELSE string_split(strong, ',')[1] END AS top_strength,
  array_to_string(list_concat(list_transform(list_filter(string_split(weak, ',')[1:3], lambda x: x <> ''), lambda x: '-' || x), list_transform(list_filter(string_split(strong, ',')[1:3], lambda x: x <> ''), lambda x: '+' || x)), ',') AS ranked FROM m
""")
def meta_scores(spark, sf_dir: str) -> DataFrame:
    """The mean, weak and strong dimensions, and the first three of each, ranked by impact."""
    dims = dimensions(META, 0.5)
    m = signals(spark, sf_dir).select(*_run(mean(dims).alias("score"), listed(**{k: v < 0.4 for k, v in dims.items()}).alias("weak"), listed(**{k: v >= 0.7 for k, v in dims.items()}).alias("strong")))
    names = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    top = lambda c: F.coalesce(F.get(names(c), F.lit(0)), F.lit(""))
    ranked = F.concat(F.transform(F.slice(names("weak"), 1, 3), lambda x: F.concat(F.lit("-"), x)), F.transform(F.slice(names("strong"), 1, 3), lambda x: F.concat(F.lit("+"), x)))
    return m.select(*_run("score", "weak", "strong", top("weak").alias("top_issue"), top("strong").alias("top_strength"), F.array_join(ranked, ",").alias("ranked")))


@query("E20", sql=f"""
WITH d AS (SELECT user_id, day, {_dimensions_sql(REVIEW, 0.75)} FROM ({_SIGNALS})) SELECT user_id, day, {_low_sql(REVIEW, 0.5)} AS issues, {_mean_sql(REVIEW)} AS confidence FROM d
""")
def run_reviews(spark, sf_dir: str) -> DataFrame:
    dims = dimensions(REVIEW, 0.75)
    return signals(spark, sf_dir).select(*_run(_low(dims, 0.5).alias("issues"), mean(dims).alias("confidence")))


@query("E15", "E16", sql=f"""
WITH d AS (SELECT user_id, day, {_dimensions_sql(AUDIT, 0.75)} FROM ({_SIGNALS})), c AS (SELECT user_id, day, {_low_sql(AUDIT, 0.4)} AS issues, {_mean_sql(AUDIT)} AS confidence FROM d)
SELECT user_id, day, issues, confidence, CASE WHEN confidence < .2 THEN 'high' WHEN confidence < .4 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN confidence < .2 THEN 'risk' WHEN confidence < .4 THEN 'watch' ELSE 'ok' END AS tts,
  CASE WHEN confidence < .2 THEN 'risk' WHEN confidence < .4 THEN 'watch' ELSE 'ok' END AS llm FROM c
""")
def run_audits(spark, sf_dir: str) -> DataFrame:
    """Audit and risk; all four signals carry one label, of which two are shown."""
    dims = dimensions(AUDIT, 0.75)
    c = signals(spark, sf_dir).select(*_run(_low(dims, 0.4).alias("issues"), mean(dims).alias("confidence")))
    band = lambda high, medium, low: F.when(F.col("confidence") < 0.2, high).when(F.col("confidence") < 0.4, medium).otherwise(low)
    return c.select(*_run("issues", "confidence", band("high", "medium", "low").alias("risk"), band("risk", "watch", "ok").alias("tts"), band("risk", "watch", "ok").alias("llm")))


@query("E13", "E14", sql=f"""
WITH d AS (SELECT user_id, day, {_dimensions_sql([n for n, _, _ in RATED], tuple(v for _, _, v in RATED))}, {_dimensions_sql([f"s_{n}" for n in SELF], SELF_DEFAULTS, 4)} FROM ({_SIGNALS})),
o AS (SELECT user_id, day, ({" + ".join(f"CAST({w} AS DOUBLE) * {n}" for n, w, _ in RATED)}) / (CAST(0.3 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST(0.25 AS DOUBLE) + CAST(0.2 AS DOUBLE)) AS rating, {_mean_sql([f"s_{n}" for n in SELF])} AS overall FROM d)
SELECT user_id, day, rating, overall, CASE WHEN overall >= .8 THEN 'ok' WHEN overall >= .5 THEN 'needs_attention' ELSE 'critical' END AS verdict FROM o
""")
def self_evaluations(spark, sf_dir: str) -> DataFrame:
    """The weighted rating of four dimensions, and the mean and verdict of five others."""
    four, five = dimensions([n for n, _, _ in RATED], tuple(v for _, _, v in RATED)), dimensions(SELF, SELF_DEFAULTS, 4)
    (n0, w0, _), *rest = RATED
    total, weight = F.lit(w0) * four[n0], w0
    for n, w, _ in rest:
        total, weight = total + F.lit(w) * four[n], weight + w
    o = signals(spark, sf_dir).select(*_run((total / F.lit(weight)).alias("rating"), mean(five).alias("overall")))
    return o.select(*_run("rating", "overall", F.when(F.col("overall") >= 0.8, "ok").when(F.col("overall") >= 0.5, "needs_attention").otherwise("critical").alias("verdict")))


SOURCES = ("self_eval", "audit", "stability", "health", "schema")
_WEIGHTS_SQL = " + ".join(f"CASE (last_id + {i * 7}) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END" for i in range(5))


@query("E21", "E43", sql=f"""
WITH f AS (SELECT user_id, day, last_id, ({_WEIGHTS_SQL}) / CAST(10 AS DOUBLE) AS score, {_listed_sql(**{s: f"(last_id + {i * 7}) % 3 = 2" for i, s in enumerate(SOURCES)})} AS missing FROM ({_SIGNALS})),
c AS (SELECT *, CASE WHEN score >= .7 THEN 'healthy' WHEN score >= .4 THEN 'caution' ELSE 'unstable' END AS class, greatest(0.1, score) AS confidence FROM f)
SELECT user_id, day, score, missing, class, confidence, CASE class WHEN 'healthy' THEN 'monitoring' WHEN 'caution' THEN CASE WHEN (last_id + 14) % 3 <> 2 THEN 'guardrails,stability' ELSE 'guardrails' END ELSE 'pause,investigation' END AS actions,
  CASE class WHEN 'healthy' THEN least(1, confidence + CAST(0.1 AS DOUBLE)) WHEN 'caution' THEN greatest(0.3, confidence) ELSE greatest(0.2, confidence) END AS first_confidence FROM c
""")
def health_classes(spark, sf_dir: str) -> DataFrame:
    """A source with content counts 1, another mark of one .5, a missing one 0; the class decides on the advice."""
    state = [(F.col("last_id") + i * 7) % 3 for i in range(5)]
    points = sum((F.when(s == 0, 2).when(s == 1, 1).otherwise(0) for s in state), F.lit(0)) / F.lit(10.0)
    f = signals(spark, sf_dir).select(*_run("last_id", points.alias("score"), listed(**{name: s == 2 for name, s in zip(SOURCES, state, strict=True)}).alias("missing")))
    c = f.withColumn("class", F.when(F.col("score") >= 0.7, "healthy").when(F.col("score") >= 0.4, "caution").otherwise("unstable")).withColumn("confidence", F.greatest(F.lit(0.1), "score"))
    actions = F.when(F.col("class") == "healthy", "monitoring").when(F.col("class") == "unstable", "pause,investigation").otherwise(F.when((F.col("last_id") + 14) % 3 != 2, "guardrails,stability").otherwise("guardrails"))
    first = F.when(F.col("class") == "healthy", F.least(F.lit(1.0), F.col("confidence") + 0.1)).when(F.col("class") == "caution", F.greatest(F.lit(0.3), "confidence")).otherwise(F.greatest(F.lit(0.2), "confidence"))
    return c.select(*_run("score", "missing", "class", "confidence", actions.alias("actions"), first.alias("first_confidence")))


@query("E22", "E54", sql=f"""
WITH s AS (SELECT user_id, day, CASE WHEN failures > 5 THEN 'high' WHEN failures > 0 OR kmin = 0 THEN 'med' ELSE 'low' END AS severity FROM ({_SIGNALS}))
SELECT user_id, day, severity, CAST(CASE severity WHEN 'high' THEN 0.8 WHEN 'med' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence, CASE severity WHEN 'high' THEN 'structural' WHEN 'med' THEN 'metadata' ELSE 'unknown' END AS class FROM s
""")
def heal_classes(spark, sf_dir: str) -> DataFrame:
    """Failures or break points (a zero signal) are medium, more than five failures high."""
    severity = F.when(F.col("failures") > 5, "high").when((F.col("failures") > 0) | (F.col("kmin") == 0), "med").otherwise("low")
    by = lambda high, med, low: F.when(F.col("severity") == "high", high).when(F.col("severity") == "med", med).otherwise(low)
    return signals(spark, sf_dir).select(*_run(severity.alias("severity"))).select(*_run("severity", by(0.8, 0.6, 0.5).alias("confidence"), by("structural", "metadata", "unknown").alias("class")))


@query("E23", "E38", sql=f"""
WITH s AS (SELECT user_id, day, kmax > 90 AS engine, ks % 3 = 0 AS audio, failures > 0 AS spikes, last_id % 4 = 0 AS llm, kinds >= 3 AS boundary FROM ({_SIGNALS})),
c AS (SELECT *, CAST(engine AS INT) + CAST(audio AS INT) + CAST(spikes AS INT) + CAST(llm AS INT) + CAST(boundary AS INT) AS present FROM s)
SELECT user_id, day, present > 0 AS detected, CASE WHEN present = 0 THEN 'low' WHEN present <= 2 THEN 'medium' ELSE 'high' END AS severity,
  CASE WHEN engine THEN 'engine_behavior_change' WHEN llm THEN 'llm_reasoning_shift' WHEN spikes THEN 'pipeline_instability' ELSE 'insufficient_data' END AS cause,
  CAST(CASE WHEN engine AND boundary AND spikes THEN 0.75 WHEN engine AND spikes THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence, {_listed_sql(spikes="spikes", engine="engine", boundary="boundary")} AS evidence FROM c
""")
def root_causes(spark, sf_dir: str) -> DataFrame:
    """Regressions by how many kinds of signals are there, and their probable cause."""
    s = signals(spark, sf_dir).select(*_run((F.col("kmax") > 90).alias("engine"), (F.col("ks") % 3 == 0).alias("audio"), (F.col("failures") > 0).alias("spikes"), (F.col("last_id") % 4 == 0).alias("llm"), (F.col("kinds") >= 3).alias("boundary")))
    present = sum((F.col(c).cast("int") for c in ("engine", "audio", "spikes", "llm", "boundary")), F.lit(0))
    c = lambda *names: F.expr(" and ".join(names))
    return s.select(*_run(
        (present > 0).alias("detected"), F.when(present == 0, "low").when(present <= 2, "medium").otherwise("high").alias("severity"),
        F.when(c("engine"), "engine_behavior_change").when(c("llm"), "llm_reasoning_shift").when(c("spikes"), "pipeline_instability").otherwise("insufficient_data").alias("cause"),
        F.when(c("engine", "boundary", "spikes"), 0.75).when(c("engine", "spikes"), 0.6).otherwise(0.3).alias("confidence"), listed(spikes=c("spikes"), engine=c("engine"), boundary=c("boundary")).alias("evidence"),
    ))


@query("E24", "E25", sql=f"""
WITH t AS (SELECT user_id, (arg_max(ks, day) - arg_min(ks, day)) / CAST(100 AS DOUBLE) AS score, (arg_max(kmax, day) - arg_min(kmax, day)) / CAST(100 AS DOUBLE) AS reward, (arg_max(failures, day) - arg_min(failures, day)) / CAST(1 AS DOUBLE) AS anomaly FROM ({_SIGNALS}) GROUP BY user_id)
SELECT user_id, 0.5 + sign(score) * least(abs(score), 1) * 0.25 AS prob_improve, 1 - (0.5 + sign(score) * least(abs(score), 1) * 0.25) AS prob_regress, least(1, greatest(0, abs(score) * CAST(0.1 AS DOUBLE))) AS stability_risk,
  0.5 + sign(anomaly) * least(abs(anomaly), 1) * 0.25 AS anomaly_risk, least(1, greatest(0, 0.5 + CASE WHEN score < 0 THEN least(abs(score), 1) * 0.25 ELSE 0 END + CASE WHEN reward < 0 THEN least(abs(reward), 1) * 0.25 ELSE 0 END)) AS regression_risk FROM t
""")
def forecasts(spark, sf_dir: str) -> DataFrame:
    """Probabilities from the last value less the first one of each trend."""
    slope = lambda c: F.max_by(c, "day") - F.min_by(c, "day")
    t = signals(spark, sf_dir).groupBy("user_id").agg((slope("ks") / 100.0).alias("score"), (slope("kmax") / 100.0).alias("reward"), (slope("failures") / 1.0).alias("anomaly"))
    size = lambda c: F.least(F.abs(c), F.lit(1.0)) * 0.25
    prob = lambda c: F.lit(0.5) + F.signum(c) * size(c)
    fall = lambda c: F.when(F.col(c) < 0, size(c)).otherwise(0.0)
    return t.select("user_id", prob("score").alias("prob_improve"), (1 - prob("score")).alias("prob_regress"), clamp(F.abs("score") * 0.1).alias("stability_risk"), prob("anomaly").alias("anomaly_risk"), clamp(F.lit(0.5) + fall("score") + fall("reward")).alias("regression_risk"))


@query("E44", sql=f"""
WITH s AS (SELECT user_id, day, ks % 101 AS score, failures, kmin, kmax, last_id FROM ({_SIGNALS})),
c AS (SELECT user_id, day, CASE WHEN score >= 80 THEN 'High evaluator score (' || score || ')' ELSE '' END AS strengths, {_listed_sql(**{"failures": "failures > 0", "diag:zero": "kmin = 0"})} AS weaknesses,
  CASE WHEN kmax > 95 THEN 'regression:peak' ELSE '' END AS surprises, CASE WHEN last_id % 3 = 0 THEN 'untested changes' ELSE '' END AS missed FROM s)
SELECT *, CAST(CASE WHEN weaknesses <> '' OR surprises <> '' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM c
""")
def self_critiques(spark, sf_dir: str) -> DataFrame:
    score = F.col("ks") % 101
    c = signals(spark, sf_dir).select(*_run(
        F.when(score >= 80, F.concat(F.lit("High evaluator score ("), score.cast("string"), F.lit(")"))).otherwise("").alias("strengths"),
        listed(**{"failures": F.col("failures") > 0, "diag:zero": F.col("kmin") == 0}).alias("weaknesses"), F.when(F.col("kmax") > 95, "regression:peak").otherwise("").alias("surprises"), F.when(F.col("last_id") % 3 == 0, "untested changes").otherwise("").alias("missed"),
    ))
    return c.withColumn("confidence", F.when((F.col("weaknesses") != "") | (F.col("surprises") != ""), 0.6).otherwise(0.5))


PRESENT = ("research", "forecasting", "stability", "rewards", "planner")


@query("E41", "E42", sql=f"""
WITH s AS (SELECT user_id, day, failures = 0 AS lint, kinds > 1 AS consistent, kmin = 0 AS lint_warn, kmax > 90 AS issues, {", ".join(f"(last_id + {i}) % 3 <> 0 AS {p}" for i, p in enumerate(PRESENT))} FROM ({_SIGNALS}))
SELECT user_id, day, {" + ".join(f"CASE WHEN {p} THEN CAST(0.2 AS DOUBLE) ELSE 0 END" for p in PRESENT)} AS meta_score, {_listed_sql(**{p: f"NOT {p}" for p in PRESENT})} AS concerns,
  CASE WHEN lint THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN consistent THEN CAST(0.4 AS DOUBLE) ELSE 0 END AS global_score, lint AND consistent AS valid, {_listed_sql(schema_lint_failed="NOT lint", cross_phase_inconsistency="NOT consistent")} AS problems,
  {_listed_sql(lint_warnings_present="lint_warn", consistency_issues_present="issues")} AS warnings FROM s
""")
def signal_scores(spark, sf_dir: str) -> DataFrame:
    """A fifth for each signal present, and the weighted verdict of lint and consistency."""
    here = {p: (F.col("last_id") + i) % 3 != 0 for i, p in enumerate(PRESENT)}
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    first, *rest = here.values()
    score = part(first, 0.2)
    for test in rest:
        score = score + part(test, 0.2)
    lint, consistent = F.col("failures") == 0, F.col("kinds") > 1
    return signals(spark, sf_dir).select(*_run(
        score.alias("meta_score"), listed(**{p: ~t for p, t in here.items()}).alias("concerns"), (part(lint, 0.6) + part(consistent, 0.4)).alias("global_score"), (lint & consistent).alias("valid"),
        listed(schema_lint_failed=~lint, cross_phase_inconsistency=~consistent).alias("problems"), listed(lint_warnings_present=F.col("kmin") == 0, consistency_issues_present=F.col("kmax") > 90).alias("warnings"),
    ))


@query("E45", sql="""
WITH p AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events), d AS (SELECT DISTINCT day FROM p)
SELECT d.day, t.phase, CASE WHEN p.event_type IS NULL THEN 'missing' ELSE 'present' END AS state FROM d, (SELECT unnest(['click', 'error', 'login', 'purchase', 'view', 'refund']) AS phase) AS t LEFT JOIN p ON p.day = d.day AND p.event_type = t.phase
""")
def phase_presence(spark, sf_dir: str) -> DataFrame:
    """Which of the fixed phases, here kinds of events, each day has: one aggregate and an array of constants, no join."""
    have = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.collect_set("event_type").alias("have"))
    every = F.array(*map(F.lit, ("click", "error", "login", "purchase", "view", "refund")))
    return have.select("day", "have", F.explode(every).alias("phase")).select("day", "phase", F.when(F.array_contains("have", F.col("phase")), "present").otherwise("missing").alias("state"))


#: Flags that block autonomy where they are false or say so, and such words.
FLAGS = ("phaseK_memory_feedback", "phaseL_autonomy_core", "phaseQ_self_eval", "phaseS_consistency", "phaseT_audit", "phaseU_schema", "phaseV_harness", "phaseW_global", "phaseX_meta", "phaseY_self_heal", "phaseZ_meta")
BLOCKED = ("fail", "failed", "block", "blocked", "error")


def _flag_sql(i: int) -> str:
    return f"CASE (last_id + {i * 5}) % 37 WHEN 0 THEN 'false' WHEN 1 THEN 'Blocked' WHEN 2 THEN 'fine' WHEN 3 THEN 'error' WHEN 4 THEN NULL ELSE 'true' END"


_BLOCKED_SQL = {f: f"coalesce(lower({_flag_sql(i)}) IN ('false', 'fail', 'failed', 'block', 'blocked', 'error'), FALSE)" for i, f in enumerate(FLAGS)}
_GATES_SQL = {"readiness_failed": "failures > 1", "safety_envelope_block": "kmin = 0", "escalation_lockout": "failures > 2", "drift_detected": "kmax > 97", "stability_violations": "kinds = 1", "budget_block": "last_id % 29 = 0"}


@query("E46", "E47", sql=f"""
WITH s AS (SELECT * FROM ({_SIGNALS})), b AS (SELECT user_id, day, {_listed_sql(**_GATES_SQL, **_BLOCKED_SQL)} AS blocked, failures > 1 OR kmin = 0 OR failures > 2 OR {" OR ".join(_BLOCKED_SQL.values())} AS downgrade,
  {_listed_sql(readiness_block="failures > 1", few_kinds="kinds = 1", drift_over="kmax > 97")} AS envelope FROM s)
SELECT user_id, day, blocked = '' AS allow, blocked, downgrade, envelope = '' AS safe, envelope FROM b
""")
def global_safety(spark, sf_dir: str) -> DataFrame:
    """Six gates and eleven flags: false or a word of failure blocks, a missing flag passes; some reasons downgrade too."""
    flag = lambda i: (F.col("last_id") + i * 5) % 37
    word = lambda i: F.when(flag(i) == 0, "false").when(flag(i) == 1, "Blocked").when(flag(i) == 2, "fine").when(flag(i) == 3, "error").when(flag(i) == 4, None).otherwise("true")
    flags = {f: F.coalesce(F.lower(word(i)).isin("false", *BLOCKED), F.lit(False)) for i, f in enumerate(FLAGS)}
    gates = {"readiness_failed": F.col("failures") > 1, "safety_envelope_block": F.col("kmin") == 0, "escalation_lockout": F.col("failures") > 2, "drift_detected": F.col("kmax") > 97, "stability_violations": F.col("kinds") == 1, "budget_block": F.col("last_id") % 29 == 0}
    down = gates["readiness_failed"] | gates["safety_envelope_block"] | gates["escalation_lockout"]
    for f in flags.values():
        down = down | f
    b = signals(spark, sf_dir).select(*_run(listed(**gates, **flags).alias("blocked"), down.alias("downgrade"), listed(readiness_block=gates["readiness_failed"], few_kinds=gates["stability_violations"], drift_over=gates["drift_detected"]).alias("envelope")))
    return b.select(*_run((F.col("blocked") == "").alias("allow"), "blocked", "downgrade", (F.col("envelope") == "").alias("safe"), "envelope"))


#: Fields that an override may change, in the policy and in the budget, and the bounds of a change.
ALLOWED = ("phase3.chunk_size", "phase4.engine_preference", "rewriter.default_policy", "rewrite_policy")
BUDGETED = ("phase3.chunk_size", "chunk_size", "phase4.engine_preference", "engine_preference", "rewrite_policy")
_FIELDS = ("phase3.chunk_size", "chunk_size", "phase4.engine_preference", "engine_preference", "rewrite_policy", "rewriter.default_policy", "other")
MOST_DELTA, MOST_REWRITE, MOST_OVERRIDES = 10, 15, 2
_OVERRIDES = f"""
SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {list(_FIELDS)}[event_id % 7 + 1] AS field, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 31 - 15 END AS delta,
  ['xtts', 'kokoro', 'piper'][event_id % 3 + 1] AS engine FROM events
"""


def overrides(spark, sf_dir: str) -> DataFrame:
    """Each event as a proposed override of a field: by how much, or to which engine."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    delta = F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k").cast("long") % 31 - 15)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), pick(_FIELDS, F.col("event_id") % 7).alias("field"), delta.alias("delta"), pick(("xtts", "kokoro", "piper"), F.col("event_id") % 3).alias("engine"))


@query("B23", "B24", "B25", sql=f"""
WITH o AS (SELECT * FROM ({_OVERRIDES})),
j AS (SELECT *, CASE WHEN field IN ('chunk_size', 'phase3.chunk_size') AND abs(delta) > {MOST_DELTA} THEN 'chunk_size_delta_exceeds_bounds' WHEN field IN ('engine_preference', 'phase4.engine_preference') AND user_id % 4 = 0 THEN 'engine_switch_not_allowed'
    WHEN field IN ('rewrite_policy', 'rewriter.default_policy') AND abs(delta) > {MOST_REWRITE} - 5 THEN 'rewrite_policy_delta_exceeds_bounds' END AS violation,
  CASE field WHEN 'phase3.chunk_size' THEN coalesce(delta BETWEEN -10 AND 10, FALSE) WHEN 'phase4.engine_preference' THEN engine IN ('xtts', 'kokoro') WHEN 'rewriter.default_policy' THEN TRUE WHEN 'rewrite_policy' THEN TRUE ELSE FALSE END AS allowed, field IN {BUDGETED} AS counted FROM o)
SELECT event_id, violation, allowed, counted AND sum(CAST(counted AS INT)) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= {MOST_OVERRIDES} AS in_budget FROM j
""")
def override_rules(spark, sf_dir: str) -> DataFrame:
    """Overrides outside the bounds, those that the policy allows, and the first few of a run that the budget lets pass.
    A user whose id is divisible by four may switch no engine; rewrites change by ten at most."""
    field = F.col("field")
    violation = F.when(field.isin("chunk_size", "phase3.chunk_size") & (F.abs("delta") > MOST_DELTA), "chunk_size_delta_exceeds_bounds").when(field.isin("engine_preference", "phase4.engine_preference") & (F.col("user_id") % 4 == 0), "engine_switch_not_allowed")
    violation = violation.when(field.isin("rewrite_policy", "rewriter.default_policy") & (F.abs("delta") > MOST_REWRITE - 5), "rewrite_policy_delta_exceeds_bounds")
    allowed = F.when(field == ALLOWED[0], F.coalesce(F.col("delta").between(-10, 10), F.lit(False))).when(field == ALLOWED[1], F.col("engine").isin("xtts", "kokoro")).otherwise(field.isin(*ALLOWED[2:]))
    counted = field.isin(*BUDGETED)
    o = overrides(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("event_id"))
    passed = o.where(counted).select("event_id", first.alias("k")).where(F.col("k") <= MOST_OVERRIDES).select("event_id", F.lit(True).alias("in_budget"))
    return o.join(passed, "event_id", "left").select("event_id", violation.alias("violation"), allowed.alias("allowed"), F.coalesce("in_budget", F.lit(False)).alias("in_budget"))


@query("B21", sql="""
WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, user_id % 2 AS engine, count(*) FILTER (event_type = 'error') AS bad, count(*) AS chunks FROM events GROUP BY ALL)
SELECT day, concat_ws(',', CASE WHEN max(bad) > 1 THEN 'repeated_failures' END, CASE WHEN count(DISTINCT engine) = 1 THEN 'single_engine' END, CASE WHEN max(chunks) > min(chunks) * 5 THEN 'chunk_variance' END) AS issues FROM r GROUP BY day
""")
def quality_gate(spark, sf_dir: str) -> DataFrame:
    """Issues of a day's runs: a failure more than once, one engine only, sizes apart by more than five times."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("chunks"))
    one = F.min(F.col("user_id") % 2) == F.max(F.col("user_id") % 2)
    return e.groupBy("day").agg(listed(repeated_failures=F.max("bad") > 1, single_engine=one, chunk_variance=F.max("chunks") > F.min("chunks") * 5).alias("issues"))


@query("B27", sql=f"""
WITH u AS (SELECT user_id, max(failures) AS anomalies, count(*) FILTER (kinds > 1) AS benchmarks, avg(CAST(kmax - 50 AS DOUBLE)) AS reward FROM ({_SIGNALS}) GROUP BY user_id)
SELECT user_id, anomalies = 0 AND benchmarks > 0 AND reward >= 0 AS ready, {_listed_sql(anomalies_detected="anomalies > 0", missing_benchmarks="benchmarks = 0", low_reward="reward < 0")} AS reasons FROM u
""")
def readiness(spark, sf_dir: str) -> DataFrame:
    u = signals(spark, sf_dir).groupBy("user_id").agg(F.max("failures").alias("a"), F.count_if(F.col("kinds") > 1).alias("b"), F.avg((F.col("kmax") - 50).cast("double")).alias("r"))
    reasons = listed(anomalies_detected=F.col("a") > 0, missing_benchmarks=F.col("b") == 0, low_reward=F.col("r") < 0)
    return u.select("user_id", (reasons == "").alias("ready"), reasons.alias("reasons"))


@query("E33", "E34", "E35", "E36", "E37", sql=f"""
WITH s AS (SELECT *, ['', 'reduce_chunk_size', 'increase_chunk_size', 'Larger', 'keep'][last_id % 5 + 1] AS mode, CASE WHEN last_id % 7 = 0 THEN NULL ELSE CAST(ks % 61 - 30 AS DOUBLE) END AS delta, CASE WHEN ks % 9 = 0 THEN NULL ELSE (ks % 101) / CAST(100 AS DOUBLE) END AS confidence,
  ['supervised', 'Autonomous', 'disabled', 'recommend_only'][last_id % 4 + 1] AS autonomy, (kmax - 50) / CAST(100 AS DOUBLE) AS bias, kmin = 0 AS revert, failures > 0 AS voice_alert, n - failures AS streak FROM ({_SIGNALS}))
SELECT user_id, day, CASE WHEN contains(lower(mode), 'reduce') THEN -least(20, abs(coalesce(delta, 15))) WHEN contains(lower(mode), 'increase') OR contains(lower(mode), 'larger') THEN least(20, abs(coalesce(delta, 15))) END AS chunk_delta,
  CASE WHEN coalesce(confidence, 0) >= 0.7 THEN engine END AS engine_override, CASE WHEN streak >= 3 THEN 'voice' || (last_id % 10) END AS voice_override, CASE lower(autonomy) WHEN 'supervised' THEN 'enforce' WHEN 'autonomous' THEN 'tune' ELSE 'observe' END AS learning_mode,
  CASE WHEN revert THEN 'clear_engine' WHEN bias > 0.05 THEN 'promote_engine' ELSE 'keep_engine' END AS engine_step, CASE WHEN voice_alert THEN 'clear_voice' ELSE 'keep_voice' END AS voice_step FROM s
""")
def policy_overrides(spark, sf_dir: str) -> DataFrame:
    """Overrides of chunk size, engine and voice, the learning mode, and what self-driving does to engine and voice."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    s = signals(spark, sf_dir).withColumn("mode", F.lower(pick(("", "reduce_chunk_size", "increase_chunk_size", "Larger", "keep"), F.col("last_id") % 5)))
    delta = F.least(F.lit(20.0), F.abs(F.when(F.col("last_id") % 7 == 0, 15.0).otherwise((F.col("ks") % 61 - 30).cast("double"))))
    signed = F.when(F.contains("mode", F.lit("reduce")), -delta).when(F.contains("mode", F.lit("increase")) | F.contains("mode", F.lit("larger")), delta)
    confidence = F.when(F.col("ks") % 9 == 0, 0.0).otherwise((F.col("ks") % 101) / 100.0)
    autonomy = F.lower(pick(("supervised", "Autonomous", "disabled", "recommend_only"), F.col("last_id") % 4))
    step = F.when(F.col("kmin") == 0, "clear_engine").when((F.col("kmax") - 50) / 100.0 > 0.05, "promote_engine").otherwise("keep_engine")
    return s.select(*_run(
        signed.alias("chunk_delta"), F.when(confidence >= 0.7, F.col("engine")).alias("engine_override"), F.when(F.col("n") - F.col("failures") >= 3, F.concat(F.lit("voice"), (F.col("last_id") % 10).cast("string"))).alias("voice_override"),
        F.when(autonomy == "supervised", "enforce").when(autonomy == "autonomous", "tune").otherwise("observe").alias("learning_mode"), step.alias("engine_step"), F.when(F.col("failures") > 0, "clear_voice").otherwise("keep_voice").alias("voice_step"),
    ))


@query("E48", "E49", "E50", sql=f"""
WITH s AS (SELECT user_id, day, last_id, CASE WHEN last_id % 3 = 0 THEN NULL ELSE 500 + ks % 700 END AS pref_size, CASE WHEN last_id % 2 = 0 THEN 'kokoro' END AS pref_engine, CASE WHEN ks % 4 = 0 THEN 'minimal_fix' END AS pref_rewrite, engine AS stable_engine,
    CASE WHEN kinds > 1 THEN 800 + kmax END AS stable_size, (kmax % 101) / CAST(100 AS DOUBLE) AS engine_c, CASE WHEN kinds > 1 THEN (kmin % 101) / CAST(100 AS DOUBLE) END AS chunk_c, (ks % 101) / CAST(100 AS DOUBLE) AS genre_c, n FROM ({_SIGNALS})),
f AS (SELECT *, coalesce(pref_engine, stable_engine) AS engine, coalesce(pref_size, stable_size) AS size, (engine_c + coalesce(chunk_c, 0) + genre_c + least(1, n / CAST(10 AS DOUBLE))) / 4 AS confidence FROM s)
SELECT user_id, day, engine AS engine_preference, pref_rewrite AS rewrite_preference, confidence, coalesce(size, -1) AS chunk_size, CASE WHEN last_id % 20 = 0 AND size IS NOT NULL THEN greatest(1, size + CASE WHEN last_id % 40 = 0 THEN -1 ELSE 1 END * greatest(1, size // 20)) ELSE coalesce(size, -1) END AS explored_size,
  CASE WHEN last_id % 20 = 0 AND size IS NULL AND pref_rewrite IS NOT NULL THEN pref_rewrite || '_explore' ELSE pref_rewrite END AS explored_rewrite, CASE WHEN last_id % 20 = 0 AND size IS NULL AND pref_rewrite IS NULL THEN 'piper' ELSE engine END AS explored_engine FROM f
""")
def profile_overrides(spark, sf_dir: str) -> DataFrame:
    """Preferences of a genre over stable ones, their confidence, and one in twenty explored: a size (-1 for none) by a
    twentieth, else the policy, else the engine. The runs to explore and the sign follow from ids in place of chance."""
    c = F.col
    pref_size, pref_engine, pref_rewrite = F.when(c("last_id") % 3 != 0, 500 + c("ks") % 700), F.when(c("last_id") % 2 == 0, "kokoro"), F.when(c("ks") % 4 == 0, "minimal_fix")
    share = lambda k: (c(k) % 101) / 100.0
    confidence = (share("kmax") + F.coalesce(F.when(c("kinds") > 1, share("kmin")), F.lit(0.0)) + share("ks") + F.least(F.lit(1.0), c("n") / 10.0)) / 4
    f = signals(spark, sf_dir).select(*_run("last_id", F.coalesce(pref_engine, "engine").alias("engine_preference"), pref_rewrite.alias("rewrite_preference"), confidence.alias("confidence"), F.coalesce(pref_size, F.when(c("kinds") > 1, 800 + c("kmax"))).alias("chunk_size")))
    explore, none = c("last_id") % 20 == 0, c("chunk_size").isNull()
    step = F.greatest(F.lit(1).cast("long"), F.expr("chunk_size div 20"))
    moved = F.greatest(F.lit(1).cast("long"), c("chunk_size") + F.when(c("last_id") % 40 == 0, -step).otherwise(step))
    return f.select(*_run(
        "engine_preference", "rewrite_preference", "confidence", F.coalesce("chunk_size", F.lit(-1)).alias("chunk_size"), F.when(explore & ~none, moved).otherwise(F.coalesce("chunk_size", F.lit(-1))).alias("explored_size"),
        F.when(explore & none & c("rewrite_preference").isNotNull(), F.concat("rewrite_preference", F.lit("_explore"))).otherwise(c("rewrite_preference")).alias("explored_rewrite"),
        F.when(explore & none & c("rewrite_preference").isNull(), "piper").otherwise(c("engine_preference")).alias("explored_engine"),
    ))


@query("E51", "E52", sql=f"""
WITH s AS (SELECT user_id, day, CASE WHEN last_id % 6 = 0 THEN NULL ELSE ks % 101 END AS score, kmax - 60 AS reward FROM ({_SIGNALS}))
SELECT user_id, CASE WHEN count(score) = 0 THEN CAST(0.5 AS DOUBLE) ELSE least(1, greatest(0, CAST(0.5 AS DOUBLE) + (count(*) FILTER (score >= 70) / count(score) - CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE))) END AS confidence,
  coalesce(string_agg(day, ',' ORDER BY day) FILTER (reward > 0), '') AS stable_days FROM s GROUP BY user_id
""")
def calibrated_confidence(spark, sf_dir: str) -> DataFrame:
    """Confidence by the share of scored runs at 70 or more, and the journal of runs with a positive reward, oldest first."""
    score = F.when(F.col("last_id") % 6 != 0, F.col("ks") % 101)
    s = signals(spark, sf_dir).select(*_run(score.alias("score"), (F.col("kmax") - 60).alias("reward")))
    share = F.count_if(F.col("score") >= 70) / F.count("score")
    journal = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reward") > 0, F.col("day")))), ",")
    return s.groupBy("user_id").agg(F.when(F.count("score") == 0, 0.5).otherwise(clamp(F.lit(0.5) + (share - 0.5) * 0.2)).alias("confidence"), journal.alias("stable_days"))


@query("E31", "E32", "F4", sql=f"""
WITH e AS (SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'xtts' ELSE 'kokoro' END AS engine, event_type = 'error' AS failed, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
s AS (SELECT user_id, engine, count(*) AS n, sum(cents) / CAST(5000 AS DOUBLE) / count(*) AS avg_rtf, quantile_cont(cents / CAST(5000 AS DOUBLE), 0.9) AS p90_rtf, quantile_cont(cents / CAST(5000 AS DOUBLE), 0.99) AS p99_rtf,
  sum(cents) FILTER (back <= 40) / CAST(5000 AS DOUBLE) / count(*) FILTER (back <= 40) AS recent_rtf, sum(k) FILTER (back <= 40) / CAST(100 AS DOUBLE) / count(*) FILTER (back <= 40) AS recent_fallback, count(*) FILTER (failed AND back <= 20) AS hallucinations, count(*) FILTER (failed) AS failures FROM e GROUP BY ALL)
SELECT user_id, engine, n, round(avg_rtf, 6) AS avg_rtf, round(p90_rtf, 6) AS p90_rtf, round(p99_rtf, 6) AS p99_rtf, round(recent_rtf, 6) AS recent_rtf, {_listed_sql(rt_factor_alert="recent_rtf > 1", fallback_alert="recent_fallback > 0.25", hallucination_watch="hallucinations > 0", phase_duration_watch="recent_rtf > 1.5")} AS alerts,
  CASE WHEN failures >= 2 THEN 'switch_voice_variant' END AS voice_advice FROM s
""")
def soft_alerts(spark, sf_dir: str) -> DataFrame:
    """Real-time factors with their percentiles, the latest forty and twenty events' alerts, and advice on the voice. The
    limits of factors suit the events (1 and 1.5 in place of 4 and of 600 s). The latest events come from a limited rank, the
    percentiles range by range, so no user's events are sorted or held in one task."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("failed"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    late = e.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("back <= 40")
    recent = late.groupBy("user_id").agg((F.sum("cents") / 5000.0 / F.count("cents")).alias("recent_rtf"), (F.sum("k") / 100.0 / F.count("k")).alias("recent_fallback"), F.count_if(F.col("failed") & (F.col("back") <= 20)).alias("h"))
    p = percentiles(e.withColumn("rtf", F.col("cents") / 5000.0), "user_id", "rtf", {"p90": 0.9, "p99": 0.99})
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), (F.sum("cents") / 5000.0 / F.count("*")).alias("avg_rtf"), F.count_if("failed").alias("failures")).join(recent, "user_id").join(p, "user_id")
    alerts = listed(rt_factor_alert=F.col("recent_rtf") > 1, fallback_alert=F.col("recent_fallback") > 0.25, hallucination_watch=F.col("h") > 0, phase_duration_watch=F.col("recent_rtf") > 1.5)
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return s.select("user_id", F.when(F.col("user_id") % 2 == 0, "xtts").otherwise("kokoro").alias("engine"), "n", r6(F.col("avg_rtf"), "avg_rtf"), r6(F.col("p90"), "p90_rtf"), r6(F.col("p99"), "p99_rtf"), r6(F.col("recent_rtf"), "recent_rtf"), alerts.alias("alerts"), F.when(F.col("failures") >= 2, "switch_voice_variant").alias("voice_advice"))


#: The engine factors of the automatic choice and its pace.
RT_XTTS, RT_KOKORO, SLOWER, CHARS = 3.2, 1.3, 1.3, 1050


@query("E7", sql=f"""
WITH a AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'xtts' ELSE 'kokoro' END AS preferred, sum(length(coalesce(text, ''))) / CAST({CHARS} AS DOUBLE) * 60 AS audio FROM conversations GROUP BY conv_id)
SELECT conv_id, round(audio, 4) AS audio_s, CASE WHEN audio * CAST({RT_XTTS} AS DOUBLE) > audio * CAST({RT_KOKORO} AS DOUBLE) * CAST({SLOWER} AS DOUBLE) THEN 'kokoro' ELSE preferred END AS engine FROM a
""")
def engine_choice(spark, sf_dir: str) -> DataFrame:
    """Kokoro where the other engine's time would be much longer, which it is for any audio; turns stand for chunks."""
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length(F.coalesce("text", F.lit("")))) / float(CHARS) * 60).alias("audio"))
    slow = F.col("audio") * RT_XTTS > F.col("audio") * RT_KOKORO * SLOWER
    return a.select("conv_id", F.round("audio", 4).alias("audio_s"), F.when(slow, "kokoro").otherwise(F.when(F.col("conv_id") % 2 == 0, "xtts").otherwise("kokoro")).alias("engine"))


REASONS = ("duration_mismatch", "text_too_long", "high_wer", "silence")


@query("E10", "F12", sql=f"""
WITH c AS (SELECT user_id, CASE WHEN event_type IN ('error', 'purchase') THEN {list(REASONS)}[event_id % 4 + 1] END AS reason, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS long FROM events),
r AS (SELECT user_id, reason, count(*) AS k FROM c WHERE reason IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, string_agg(reason || ':' || k, ',' ORDER BY k DESC, reason) AS top FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, reason) <= 3) GROUP BY user_id),
s AS (SELECT user_id, count(*) AS total, count(reason) AS failed, count(*) FILTER (reason = 'duration_mismatch') AS dm, count(*) FILTER (reason = 'text_too_long') AS tl, count(*) FILTER (reason = 'high_wer') AS hw, count(*) FILTER (long AND reason IS NOT NULL) AS lf FROM c GROUP BY user_id)
SELECT s.user_id, total, failed, (total - failed) / total AS success_rate, CASE WHEN (total - failed) / total >= .95 THEN 'good' WHEN (total - failed) / total >= .8 THEN 'warning' WHEN (total - failed) / total >= .5 THEN 'poor' ELSE 'critical' END AS severity,
  {_listed_sql(duration="dm > 3", length="tl > 0", long_chunks="lf > failed * 0.5", wer="hw > 3")} AS flags, coalesce(top, '') AS top_reasons FROM s LEFT JOIN t ON s.user_id = t.user_id
""")
def batch_severity(spark, sf_dir: str) -> DataFrame:
    """Failures of a batch, here a user's events, by reason: bands, flags and the three most frequent reasons."""
    reason = F.when(F.col("event_type").isin("error", "purchase"), F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 4 + 1).cast("int")))
    c = table(spark, sf_dir, "events").select("user_id", reason.alias("reason"), (F.get_json_object("props", "$.k").cast("long") > 50).alias("long"))
    by = c.groupBy("user_id", "reason").agg(F.count("*").alias("k"), F.count_if("long").alias("long"))
    known = F.col("reason").isNotNull()
    of = lambda r: F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("k"))), F.lit(0))
    s = by.groupBy("user_id").agg(
        F.sum("k").alias("total"), F.coalesce(F.sum(F.when(known, F.col("k"))), F.lit(0)).alias("failed"), of("duration_mismatch").alias("dm"), of("text_too_long").alias("tl"), of("high_wer").alias("hw"),
        F.coalesce(F.sum(F.when(known, F.col("long"))), F.lit(0)).alias("lf"), F.slice(F.array_sort(F.collect_list(F.when(known, F.struct((-F.col("k")).alias("order"), "reason", "k")))), 1, 3).alias("top"),
    )
    rate = (F.col("total") - F.col("failed")) / F.col("total")
    flags = listed(duration=F.col("dm") > 3, length=F.col("tl") > 0, long_chunks=F.col("lf") > F.col("failed") * 0.5, wer=F.col("hw") > 3)
    top = F.array_join(F.transform("top", lambda x: F.concat(x["reason"], F.lit(":"), x["k"].cast("string"))), ",")
    return s.select("user_id", "total", "failed", rate.alias("success_rate"), F.when(rate >= 0.95, "good").when(rate >= 0.8, "warning").when(rate >= 0.5, "poor").otherwise("critical").alias("severity"), flags.alias("flags"), top.alias("top_reasons"))


#: The registry: voice, engine, profile, gender, accent and tone. A parameter of the operators; it has a fixed handful of rows.
VOICES = (
    ("amber", "xtts", "fiction", "female", "british", "warm"), ("birch", "xtts", "philosophy", "male", "american", "academic"), ("cedar", "kokoro", "fiction", "male", "british english", "dramatic"), ("dune", "kokoro", "memoir", "female", "neutral", "warm"),
    ("ember", "xtts", "technical", "female", "american", "clear"), ("flint", "kokoro", "philosophy", "male", "british", "academic"), ("grove", "xtts", "fiction", "female", "american", "dramatic"),
)
_REGISTRY = "(VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in v) + ")" for i, v in enumerate(VOICES)) + ") AS v(i, voice, vengine, profile, gender, accent, tone)"
_GENRES, _ACCENTS, _TONES = ("fiction", "philosophy", "memoir", "poetry"), ("british", "american"), ("warm", "academic", "dramatic")


def _wishes_sql() -> str:
    return f"SELECT doc_id, {list(_GENRES)}[doc_id % 4 + 1] AS genre, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ['male', 'female'][doc_id % 2 + 1] END AS g, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {list(_ACCENTS)}[doc_id % 2 + 1] END AS a, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {list(_TONES)}[doc_id % 3 + 1] END AS t, CASE WHEN doc_id % 4 = 1 THEN 'kokoro' WHEN doc_id % 4 = 2 THEN 'xtts' END AS e FROM documents"


@query("E8", sql=f"""
WITH w AS ({_wishes_sql()}), s AS (SELECT doc_id, i, voice, CASE WHEN profile = genre THEN 10 ELSE 0 END + CASE WHEN gender = g THEN 5 ELSE 0 END + CASE WHEN contains(accent, a) THEN 5 ELSE 0 END + CASE WHEN contains(tone, t) THEN 3 ELSE 0 END AS score FROM w, {_REGISTRY} WHERE e IS NULL OR e = vengine),
b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 5)
SELECT w.doc_id, coalesce(string_agg(voice || ':' || score, ',' ORDER BY score DESC, i), '') AS matches FROM w LEFT JOIN b ON w.doc_id = b.doc_id GROUP BY w.doc_id
""")
def voice_matches(spark, sf_dir: str) -> DataFrame:
    """The five best voices of the registry for each document's wishes, ties in the registry's order; scored within the row."""
    k = F.col("doc_id")
    pick = lambda names, m: F.element_at(F.array(*map(F.lit, names)), (k % m + 1).cast("int"))
    wishes = table(spark, sf_dir, "documents").select(
        "doc_id", pick(_GENRES, 4).alias("genre"), F.when(k % 3 != 0, pick(("male", "female"), 2)).alias("g"), F.when(k % 5 != 0, pick(_ACCENTS, 2)).alias("a"), F.when(k % 7 != 0, pick(_TONES, 3)).alias("t"), F.when(k % 4 == 1, "kokoro").when(k % 4 == 2, "xtts").alias("e"),
    )

    def scored(i: int, voice: str, engine: str, profile: str, gender: str, accent: str, tone: str) -> Column:
        part = lambda test, points: F.when(test, points).otherwise(0)
        score = part(F.col("genre") == profile, 10) + part(F.col("g") == gender, 5) + part(F.contains(F.lit(accent), "a"), 5) + part(F.contains(F.lit(tone), "t"), 3)
        return F.when(F.col("e").isNull() | (F.col("e") == engine), F.struct((-score).alias("order"), F.lit(i).alias("i"), F.lit(voice).alias("voice"), score.alias("score")))

    best = F.slice(F.array_sort(F.filter(F.array(*(scored(i, *v) for i, v in enumerate(VOICES))), lambda x: x["score"] > 0)), 1, 5)
    return wishes.select("doc_id", F.array_join(F.transform(best, lambda x: F.concat(x["voice"], F.lit(":"), x["score"].cast("string"))), ",").alias("matches"))


@query("E9", sql=f"""
WITH w AS (SELECT doc_id, {list(_GENRES)}[doc_id % 4 + 1] AS genre, CASE doc_id % 11 WHEN 0 THEN 'Amber' WHEN 1 THEN 'nobody' END AS cli, CASE doc_id % 7 WHEN 0 THEN 'Dune' WHEN 1 THEN 'unknown voice' END AS file, CASE WHEN doc_id % 13 = 0 THEN 'cedar' END AS global FROM documents),
k AS (SELECT doc_id, genre, replace(lower(cli), ' ', '_') AS cli, replace(lower(file), ' ', '_') AS file, replace(lower(global), ' ', '_') AS global FROM w), p AS (SELECT profile, arg_min(voice, i) AS voice FROM {_REGISTRY} GROUP BY profile)
SELECT doc_id, coalesce(CASE WHEN cli IN (SELECT voice FROM {_REGISTRY}) THEN cli END, CASE WHEN file IN (SELECT voice FROM {_REGISTRY}) THEN file END, CASE WHEN global IN (SELECT voice FROM {_REGISTRY}) THEN global END, p.voice, 'neutral_narrator') AS voice,
  CASE WHEN cli IN (SELECT voice FROM {_REGISTRY}) THEN 'cli' WHEN file IN (SELECT voice FROM {_REGISTRY}) THEN 'file' WHEN global IN (SELECT voice FROM {_REGISTRY}) THEN 'global' WHEN p.voice IS NOT NULL THEN 'profile' ELSE 'default' END AS reason FROM k LEFT JOIN p ON k.genre = p.profile
""")
def voice_cascade(spark, sf_dir: str) -> DataFrame:
    """The first of the command's, the file's and the global voice that the registry has, then the profile's first, then the default."""
    k = F.col("doc_id")
    first = {}
    for voice, _, profile, *_ in VOICES:
        first.setdefault(profile, voice)
    valid = lambda c: F.when(c.isin(*(v[0] for v in VOICES)), c)
    norm = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    genre = F.element_at(F.array(*map(F.lit, _GENRES)), (k % 4 + 1).cast("int"))
    profile = F.create_map(*(F.lit(x) for p in first.items() for x in p))[genre]
    tiers = {"cli": valid(norm(F.when(k % 11 == 0, "Amber").when(k % 11 == 1, "nobody"))), "file": valid(norm(F.when(k % 7 == 0, "Dune").when(k % 7 == 1, "unknown voice"))), "global": valid(norm(F.when(k % 13 == 0, "cedar"))), "profile": profile}
    reason = F.coalesce(*(F.when(v.isNotNull(), name) for name, v in tiers.items()), F.lit("default"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*tiers.values(), F.lit("neutral_narrator")).alias("voice"), reason.alias("reason"))
