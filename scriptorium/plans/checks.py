"""Reports on texts, breaks, records and clips: what disturbs speech, where a text may be cut, what went wrong before."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions.mastering import chain
from scriptorium.functions.text import COMMON_WORDS, SAMPLE_CHARS, bound
from scriptorium.operators.alignment import by_row, ratio
from scriptorium.operators.ordered import order_statistics
from scriptorium.plans.alignments import turn_pairs
from scriptorium.plans.audio import clips
from scriptorium.plans.kernels import _listed_sql, listed
from scriptorium.plans.runs import _RUNS, runs
from scriptorium.plans.sentences import ABBREVIATIONS, FAILURES
from scriptorium.plans.structure import repetition, repetition_sql
from scriptorium.sources.tables import table

#: Characters that speech breaks on, and the first words that are looked at for garbled ones.
BREAKING, FIRST_WORDS = "□■●◆▯\x01", 500
_WS = r"[ \t\n\r\f\x0b]+"
_SAMPLE = f"left(text, {SAMPLE_CHARS})"
_COUNT = "(length({0}) - length(regexp_replace({0}, '{1}', '', 'g')))"


@query("B5", sql=rf"""
WITH d AS (SELECT doc_id, text, {_SAMPLE} AS s FROM documents WHERE length(text) > 0), w AS (SELECT *, list_filter(regexp_split_to_array(s, '{_WS}'), lambda x: x <> '') AS w, list_filter(list_transform(regexp_split_to_array(s, '[.!?]+'), lambda x: regexp_replace(x, '{_WS}', '', 'g')), lambda x: x <> '') AS p FROM d),
m AS (SELECT doc_id, {_COUNT.format("text", chr(65533))} AS broken, {_COUNT.format("text", "[\\x{E000}-\\x{F8FF}]")} AS private, {_COUNT.format("s", "[^\\x00-\\x7F]")} AS foreign_, {_COUNT.format("s", "\\p{L}")} AS letters, length(s) AS n, {" + ".join(f"CAST(contains(lower(s), ' {x} ') AS INT)" for x in COMMON_WORDS)} AS common,
  {_COUNT.format("s", "[.,?!]")} AS marks, len(w) AS words, len(p) AS sentences, {_COUNT.format("text", "[□■●◆▯\\x01]")} AS breaking,
  list_sum(list_transform(list_transform(w[1:{FIRST_WORDS}], lambda x: lower(regexp_replace(x, '[^a-zA-Z]', '', 'g'))), lambda x: CASE WHEN length(x) >= 4 THEN CAST(regexp_matches(x, '[bcdfghjklmnpqrstvwxyz]{{5,}}') AS INT) + CAST(NOT regexp_matches(x, '[aeiou]') AS INT) ELSE 0 END)) AS garbled FROM w)
SELECT doc_id, {_listed_sql(replacement="broken > 0", private_use="private > 0", non_ascii="100 * foreign_ > 15 * n", alphabetic="100 * letters < 65 * n", common_words="common < 8", punctuation="100 * marks < 5 * words", sentences="sentences < 10", breaking="breaking > 0", garbled="coalesce(garbled, 0) > 10")} AS critical,
  {_listed_sql(non_ascii="100 * foreign_ > 5 * n AND 100 * foreign_ <= 15 * n", punctuation="100 * marks < 10 * words AND 100 * marks >= 5 * words", sentences="sentences >= 10 AND words > 50 * sentences", garbled="garbled BETWEEN 1 AND 10")} AS warnings FROM m
""")
def speech_report(spark, sf_dir: str) -> DataFrame:
    """What makes a text unfit to be spoken, and what is doubtful, by the first 20,000 characters where the rule says so; texts
    that are null or empty have no report. Shares are compared in whole numbers."""
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    s = F.substring("text", 1, SAMPLE_CHARS)
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", "text", s.alias("s"), F.filter(F.split(s, _WS), lambda x: x != "").alias("w"))
    bare = F.transform(F.slice("w", 1, F.lit(FIRST_WORDS)), lambda x: F.lower(F.regexp_replace(x, "[^a-zA-Z]", "")))
    odd = lambda x: F.when(F.length(x) >= 4, x.rlike("[bcdfghjklmnpqrstvwxyz]{5,}").cast("int") + (~x.rlike("[aeiou]")).cast("int")).otherwise(0)
    low = F.lower("s")
    m = d.select(
        "doc_id", count("text", "�").alias("broken"), count("text", "[\\x{E000}-\\x{F8FF}]").alias("private"), count("s", r"[^\x00-\x7F]").alias("foreign_"), count("s", r"\p{L}").alias("letters"), F.length("s").alias("n"),
        sum((F.contains(low, F.lit(f" {x} ")).cast("int") for x in COMMON_WORDS), F.lit(0)).alias("common"), count("s", "[.,?!]").alias("marks"), F.size("w").alias("words"),
        F.size(F.filter(F.split("s", "[.!?]+"), lambda x: F.regexp_replace(x, _WS, "") != "")).alias("sentences"), count("text", f"[{BREAKING}]").alias("breaking"), F.aggregate(F.transform(bare, odd), F.lit(0), lambda a, x: a + x).alias("garbled"),
    )
    c = F.col
    critical = listed(
        replacement=c("broken") > 0, private_use=c("private") > 0, non_ascii=100 * c("foreign_") > 15 * c("n"), alphabetic=100 * c("letters") < 65 * c("n"), common_words=c("common") < 8,
        punctuation=100 * c("marks") < 5 * c("words"), sentences=c("sentences") < 10, breaking=c("breaking") > 0, garbled=c("garbled") > 10,
    )
    warnings = listed(
        non_ascii=(100 * c("foreign_") > 5 * c("n")) & (100 * c("foreign_") <= 15 * c("n")), punctuation=(100 * c("marks") < 10 * c("words")) & (100 * c("marks") >= 5 * c("words")),
        sentences=(c("sentences") >= 10) & (c("words") > 50 * c("sentences")), garbled=c("garbled").between(1, 10),
    )
    return m.select("doc_id", critical.alias("critical"), warnings.alias("warnings"))


#: Acronyms that speech gets right; what to look for, in order, and how grave it is; issues that count.
SAFE = ("OK", "TV", "US", "UK", "EU", "UN", "AM", "PM", "AD", "BC")
ISSUES = (
    ("currency", r"[$€£¥]\s*[\d,]+(?:\.\d+)?[MBKmbk]?\b", "high"), ("percentage", r"\d+(?:\.\d+)?\s*%", "medium"), ("complex_number", r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+[MBKmbk]?", "medium"),
    ("fiscal", r"(?i)\b(?:Q[1-4]|FY\d{2,4}|H[12])\b", "high"), ("date_format", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", "medium"),
    ("em_dash", "—|--", "medium"), ("ellipsis", r"\.{3,}|…", "medium"), ("nested_quotes", r"[\"'][^\"']*[\"'][^\"']*[\"']", "medium"), ("long_sentence", "[^.!?]{200,}", "high"), ("word_repeat", r"(?i)\b(\w+)\s+\1\b", "low"),
)
ACRONYM, MOST_ISSUES, PHRASES_OF, LONG_RUN = r"\b[A-Z]{2,6}\b", 10, (4, 5, 6, 7), 200
NUMBERS = ("currency", "percentage", "complex_number", "fiscal", "date_format")


def _letters(pattern: str) -> str:
    """The characters that an abbreviation's pattern asks for."""
    return re.sub(r"\\b|\\\.\?$", "", pattern).replace("\\", "").lower()


def speech_issues(text) -> Column:
    """The first ten issues of a text, as kind and gravity: acronyms, numbers, marks, long sentences, repeated words and
    phrases, abbreviations. Words and digits are Unicode's."""
    entry = lambda kind, grave: F.struct(F.lit(kind).alias("kind"), (grave if isinstance(grave, Column) else F.lit(grave)).alias("grave"))
    found = lambda p: F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0))
    acronyms = F.transform(F.filter(found(ACRONYM), lambda x: ~x.isin(*SAFE)), lambda x: entry("acronym", F.when(F.length(x) >= 3, "high").otherwise("medium")))
    each = lambda p, kind, grave: F.transform(found(p), lambda _: entry(kind, grave))
    none = F.array().cast("array<struct<kind:string,grave:string>>")
    digits, low = text.rlike(r"(?U)\d"), F.lower(text)
    # what the patterns must hold is looked for first; a run without marks is as well a piece between marks
    long = F.transform(F.filter(F.split(text, "[.!?]"), lambda x: F.length(x) >= LONG_RUN), lambda _: entry("long_sentence", "high"))
    if_there = lambda test, found_: F.when(test, found_).otherwise(none)
    lists = [acronyms, *(long if kind == "long_sentence" else if_there(digits, each(p, kind, grave)) if kind in NUMBERS else each(p, kind, grave) for kind, p, grave in ISSUES)]
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")

    def phrases(w: Column) -> Column:
        often = lambda h: F.exists(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.get(h, i) == F.get(h, i + 2))
        hashes = lambda n: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)))))
        return F.array_compact(F.array(*(F.when((F.size(w) >= 10) & (F.size(w) >= 2 * n) & (F.size(w) >= n + 2), F.when(bound(hashes(n), often), entry("phrase_repeat", "high"))) for n in PHRASES_OF)))

    folded = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("K"))  # equal s and k, case aside
    lists += [bound(words, phrases), *(if_there(folded | F.contains(low, F.lit(_letters(p))), each("(?i)" + p, "abbreviation", "low")) for p, _ in ABBREVIATIONS)]
    return F.slice(F.concat(*lists), 1, F.lit(MOST_ISSUES))


@query("B19")
def text_speech_issues(spark, sf_dir: str) -> DataFrame:
    """No SQL: RE2 knows no reference back to a group. Tests compare it with Python's regular expressions."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", speech_issues(F.col("text")).alias("i"))
    n = lambda g: F.size(F.filter("i", lambda x: x["grave"] == g))
    rewrite = (n("high") >= 2) | ((n("high") >= 1) & (n("medium") >= 2))
    return d.select("doc_id", F.size("i").cast("long").alias("n"), rewrite.alias("needs_rewrite"), F.array_join("i.kind", ",").alias("kinds"))


#: The sizes between which a text is cut.
MOST_CHARS, LEAST_CHARS = 1000, 200
_PARAGRAPH, _SENTENCE = re.compile(r"\n\n+"), re.compile(r"[.!?]\s+")


def break_points(text: str, most: int = MOST_CHARS, least: int = LEAST_CHARS) -> list[tuple[int, str, bool]]:
    """(place, paragraph or sentence, forced): breaks at ends of paragraphs and sentences whose distance from the one before is
    within bounds; where the next end is too far, the last one that is near enough is taken, however near, and marked forced."""
    paragraphs = {m.end() for m in _PARAGRAPH.finditer(text)}
    ends = sorted(paragraphs | {m.end() for m in _SENTENCE.finditer(text)})
    out, last = [], 0
    for at in ends:
        size, forced = at - last, False
        if size > most:
            k = bisect_right(ends, last + most)
            if k <= bisect_left(ends, last + 1):
                continue
            at, forced = ends[k - 1], True
        elif size < least:
            continue
        out.append((at, "paragraph" if at in paragraphs else "sentence", forced))
        last = at
    return out


@query("D21")
def text_break_points(spark, sf_dir: str) -> DataFrame:
    """No SQL, as each break depends on the last: tests compare it with a plain walk."""

    def found(text: str | None) -> tuple[int, int, str]:
        b = break_points(text or "")
        return len(b), sum(f for _, _, f in b), hashlib.sha256(",".join(f"{at}:{kind}" for at, kind, _ in b).encode()).hexdigest()

    return by_row(table(spark, sf_dir, "documents"), ["text"], ["doc_id"], "n bigint, n_forced bigint, digest string", found)


@query("J13", sql=f"""
WITH p AS (SELECT conv_id * 1000000 + turn AS doc_id, conv_id, turn, coalesce(text, '') AS text, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
r AS ({repetition_sql("p")}), k AS (SELECT doc_id, list_position(['none', 'low', 'medium', 'high'], severity) AS k FROM r)
SELECT p.conv_id, p.turn, a.k > 1 AS in_source, b.k > 1 AS in_heard, b.k > a.k AS introduced, CAST(CASE WHEN b.k > a.k THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM p JOIN k a ON p.doc_id = a.doc_id JOIN k b ON b.doc_id = p.conv_id * 1000000 + p.next
""")
def introduced_repetition(spark, sf_dir: str) -> DataFrame:
    """Whether what was heard, here the next turn, repeats itself worse than the text it comes from."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ("none", "low", "medium", "high"))), repetition(F.col(c))["severity"])
    k = turn_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", rank("a").alias("a"), rank("b").alias("b"))
    worse = F.col("b") > F.col("a")
    return k.select("conv_id", "turn", (F.col("a") > 1).alias("in_source"), (F.col("b") > 1).alias("in_heard"), worse.alias("introduced"), F.when(worse, 0.8).otherwise(0.0).alias("confidence"))


@query("F31", sql="""
WITH n AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20), e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS type FROM events WHERE event_type = 'error')
SELECT 'runs_analyzed' AS kind, '' AS name, (SELECT count(*) FROM n) AS n UNION ALL SELECT 'failures_over_time', CAST(user_id AS VARCHAR), count(*) FROM e WHERE user_id IN (SELECT user_id FROM n) GROUP BY user_id
UNION ALL SELECT 'failures_over_time', 'error_registry_total', count(*) FROM e UNION ALL SELECT 'chunk_quality_trends', 'phase' || (1 + user_id % 5), count(*) FROM e GROUP BY 2
UNION ALL SELECT 'common_error_types', coalesce('type' || type, 'unknown'), count(*) FROM (SELECT type FROM e UNION ALL SELECT type FROM e WHERE user_id IN (SELECT user_id FROM n)) GROUP BY 2
""")
def retro_history(spark, sf_dir: str) -> DataFrame:
    """Failures of the twenty newest logs and of the registry, here users' and all errors: by log, type and phase."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "props")
    newest = events.groupBy("user_id").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), "user_id").limit(20).select("user_id")
    e = events.where("event_type = 'error'").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("type"))
    late = e.join(F.broadcast(newest), "user_id")
    rows = lambda df, kind, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda df, kind, name: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
    kind = F.coalesce(F.concat(F.lit("type"), F.col("type").cast("string")), F.lit("unknown"))
    out = total(newest, "runs_analyzed", "").union(rows(late, "failures_over_time", F.col("user_id").cast("string"))).union(total(e, "failures_over_time", "error_registry_total"))
    return out.union(rows(e, "chunk_quality_trends", F.concat(F.lit("phase"), (1 + F.col("user_id") % 5).cast("string")))).union(rows(e.select("type").union(late.select("type")), "common_error_types", kind))


#: The least mean coherence and readability of a good record.
COHERENCE, FLESCH = 0.87, 60.0


@query("F35", sql=f"""
WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS f, CAST(json_extract_string(props, '$.k') AS BIGINT) AS c FROM events)
SELECT user_id, count(*) AS num_chunks, coalesce(sum(c) / CAST(100 AS DOUBLE) / count(c), 0) AS avg_coherence, coalesce(sum(f) / CAST(100 AS DOUBLE) / count(f), 0) AS avg_flesch, coalesce(sum(c) * 100 >= {round(COHERENCE * 100)} * 100 * count(c), FALSE) AS high_coherence, coalesce(sum(f) >= {round(FLESCH * 100)} * count(f), FALSE) AS high_readability FROM e GROUP BY user_id
""")
def record_metrics(spark, sf_dir: str) -> DataFrame:
    """Mean scores of a record's chunks, here a user's events, and whether they pass; scores are whole hundredths."""
    e = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("f"), F.get_json_object("props", "$.k").cast("long").alias("c"))
    g = e.groupBy("user_id").agg(F.count("*").alias("num_chunks"), F.sum("c").alias("c"), F.count("c").alias("nc"), F.sum("f").alias("f"), F.count("f").alias("nf"))
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / 100.0 / F.col(n)).otherwise(0.0)
    passes = lambda s, n, least: F.coalesce(F.col(s) >= round(least * 100) * F.col(n), F.lit(False))
    return g.select("user_id", "num_chunks", mean("c", "nc").alias("avg_coherence"), mean("f", "nf").alias("avg_flesch"), passes("c", "nc", COHERENCE).alias("high_coherence"), passes("f", "nf", FLESCH).alias("high_readability"))


#: A chain that does something to clips of these levels; one step is unknown and one has a parameter too many.
CHAIN = [
    {"type": "noise_gate", "threshold_db": -32.0}, {"type": "reverb"}, {"type": "compressor", "threshold_db": -16.0, "ratio": 3.0}, {"type": "limiter", "knee": 2},
    {"type": "harmonic_exciter", "amount": 0.2}, {"type": "stereo_widener", "width_percent": 20.0}, {"type": "limiter", "ceiling_db": -12.0}, {"type": "loudness", "target_db": -20.0, "max_peak_db": -9.0},
]
_G, _T, _L = ("10 ^ (-32 / 20.0)", "10 ^ (-16 / 20.0)", "10 ^ (-12 / 20.0)")


@query("M12", sql=f"""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), g AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN abs(x) > {_G} THEN x ELSE 0 END) AS a FROM a),
c AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN abs(x) > {_T} THEN x * (1 - (1 - 1 / 3.0) * ((abs(x) - {_T}) / abs(x))) ELSE x END) AS a FROM g), h AS (SELECT vec_id, list_transform(a, lambda x: x * 0.8 + (exp(2.8 * x) - 1) / (exp(2.8 * x) + 1) * 0.2) AS a FROM c),
l AS (SELECT vec_id, list_transform(a, lambda x: greatest(-({_L}), least({_L}, x))) AS a FROM h), r AS (SELECT vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS r FROM l),
n AS (SELECT vec_id, list_transform(a, lambda x: x * CASE WHEN r < 1e-3 THEN 1 ELSE 0.1 / r END) AS a FROM r), p AS (SELECT vec_id, a, list_max(list_transform(a, lambda x: abs(x))) AS p FROM n),
f AS (SELECT vec_id, list_transform(a, lambda x: x * CASE WHEN p > 10 ^ (-9 / 20.0) THEN 10 ^ (-9 / 20.0) / p ELSE 1 END) AS a FROM p)
SELECT vec_id, round(list_max(list_transform(a, lambda x: abs(x))), 4) AS peak, round(list_sum(list_transform(a, lambda x, k: x * (k % 7))), 4) AS checksum FROM f
""")
def mastered_clips(spark, sf_dir: str) -> DataFrame:
    """Peak and weighted sum of each clip after a chain of effects."""
    m = clips(spark, sf_dir).select("vec_id", chain(F.col("a"), CHAIN).alias("m"))
    weighted = F.aggregate(F.transform("m", lambda x, k: x * ((k + 1) % 7)), F.lit(0.0), lambda s, x: s + x)
    return m.select("vec_id", F.round(F.array_max(F.transform("m", F.abs)), 4).alias("peak"), F.round(weighted, 4).alias("checksum"))


#: How grave a failure of each category is, and the confidence in one that nothing points to.
GRAVE, UNSURE = {"oom": "high", "schema": "high", "io": "high"}, 0.3
_CATEGORY = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, _, words in FAILURES)


@query("E11", sql=f"""
WITH c AS (SELECT conv_id, turn, CASE {_CATEGORY} ELSE 'unknown' END AS category FROM conversations)
SELECT conv_id, turn, category, CAST(CASE category {" ".join(f"WHEN '{name}' THEN {sure}" for name, sure, _ in FAILURES)} ELSE {UNSURE} END AS DOUBLE) AS confidence, CASE WHEN category IN ('oom', 'schema', 'io') THEN 'high' ELSE 'medium' END AS severity FROM c
""")
def failure_analysis(spark, sf_dir: str) -> DataFrame:
    """Each message's failure category, how sure its words make of it, and how grave it is."""
    low = F.lower("text")
    category, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for name, confidence, words in FAILURES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        category, sure = category.when(hit, name), sure.when(hit, confidence)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", category.otherwise("unknown").alias("category"), sure.otherwise(UNSURE).alias("confidence"))
    return c.withColumn("severity", F.when(F.col("category").isin(*GRAVE), "high").otherwise("medium"))


@query("F17", sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY phase, engine ORDER BY rtf) AS i, count(*) OVER (PARTITION BY phase, engine) AS total FROM ({_RUNS}) WHERE rtf IS NOT NULL), m AS (SELECT phase, engine, max(rtf) FILTER (i = total // 2 + 1) AS median_rtf FROM r GROUP BY ALL)
SELECT phase, engine AS preferred, median_rtf, CASE WHEN median_rtf > 2.5 THEN 'reduce' WHEN median_rtf < 1 THEN 'increase' ELSE 'maintain' END AS action, CASE WHEN median_rtf > 2.5 THEN -10 WHEN median_rtf < 1 THEN 10 ELSE 0 END AS delta_percent FROM m QUALIFY row_number() OVER (PARTITION BY phase ORDER BY median_rtf, engine) = 1
""")
def benchmark_recommendations(spark, sf_dir: str) -> DataFrame:
    """By benchmark, here a phase, the engine of the least upper median, the first by name of several, and the change of chunk sizes that it allows."""
    r = runs(spark, sf_dir).where("rtf is not null").select("phase", "engine", F.concat_ws("|", "phase", "engine").alias("both"), "rtf")
    medians = order_statistics(r, "both", "rtf", {"median_rtf": F.floor(F.col("n") / 2)}).select("both", "median_rtf")
    m = medians.select(F.split("both", r"\|")[0].alias("phase"), F.split("both", r"\|")[1].alias("engine"), "median_rtf")
    best = m.groupBy("phase").agg(F.min(F.struct("median_rtf", "engine")).alias("b")).select("phase", F.col("b.engine").alias("preferred"), "b.median_rtf")
    slow, fast = F.col("median_rtf") > 2.5, F.col("median_rtf") < 1
    return best.withColumns({"action": F.when(slow, "reduce").when(fast, "increase").otherwise("maintain"), "delta_percent": F.when(slow, -10).when(fast, 10).otherwise(0)})


@query("F15", sql="""
WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type NOT IN ('purchase', 'view', 'click')) AS failed FROM events GROUP BY user_id), r AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c.user_id, total, greatest(failed, coalesce(n, 0)) AS failed, round(greatest(failed, coalesce(n, 0)) / total, 6) AS rate FROM c LEFT JOIN r ON c.user_id = r.user_id
""")
def chunk_failure_rates(spark, sf_dir: str) -> DataFrame:
    """Failed chunks of a file, or the registry's entries where they are more, over all; a user's events stand for chunks and
    orders for entries."""
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~F.col("event_type").isin("purchase", "view", "click")).alias("failed"))
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    failed = F.greatest("failed", F.coalesce("n", F.lit(0)))
    return c.join(r, "user_id", "left").select("user_id", "total", failed.alias("failed"), F.round(failed / F.col("total"), 6).alias("rate"))


def closest(asked: str | None, keys: list[str], least: float = 0.6) -> str | None:
    """The key that is most like ``asked``, the greatest of several; None where none is alike enough. Empty keys are out."""
    like = [(ratio(k, asked or ""), k) for k in keys if k]
    best = max((x for x in like if x[0] >= least), default=None)
    return best[1] if best else None


@query("J1")
def close_keys(spark, sf_dir: str) -> DataFrame:
    """The last tier of a key's resolution: the slug most like the asked one by their shared blocks. Names are brands and types of
    parts with a letter more or less; distinct ones alone are compared. No SQL: tests compare it with the standard library."""
    keys = sorted(set(CLOSE_KEYS))
    p = table(spark, sf_dir, "part").select(F.regexp_replace(F.lower(F.concat_ws("_", "p_brand", F.substring_index("p_type", " ", 1))), "[^a-z0-9]+", "_").alias("asked")).distinct()
    return by_row(p, ["asked"], ["asked"], "key string", lambda a: (closest(a, keys),))


#: Slugs that the asked ones may mean, in place of a state's files.
CLOSE_KEYS = ("brand_1_economy", "brand_2_standard", "brand_33_promo", "branded_small", "medium")
