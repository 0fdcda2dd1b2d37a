"""Chunkers and what describes chunks; a text, a conversation or a document is one row throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import chunks as C
from scriptorium.operators import chunker
from scriptorium.plans.sentences import _SENTENCES, sentences
from scriptorium.sources.tables import table

#: Seconds that a chunk lasts at least, in the query of that rule.
LEAST_S = 2.0
#: The profiles' words and characters, least and most, and durations where a profile has its own.
PROFILES = (
    ("philosophy", 280, 450, 1400, 2250, 12, 18, 28), ("fiction", 200, 350, 1000, 1750, 10, 15, 22), ("academic", 150, 300, 750, 1500, None, None, None),
    ("memoir", 220, 360, 1100, 1800, None, None, None), ("technical", 150, 300, 750, 1500, 8, 12, 18), ("auto", 200, 400, 1000, 2000, None, None, None),
)


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _described(df: DataFrame, key: str, pieces: Column) -> DataFrame:
    """Number, lengths and digest of pieces."""
    d = df.select(key, pieces.alias("p"))
    n = F.transform("p", lambda x: F.length(x))
    return d.select(key, F.size("p").cast("long").alias("n"), F.coalesce(F.array_min(n), F.lit(0)).cast("long").alias("shortest"), F.coalesce(F.array_max(n), F.lit(0)).cast("long").alias("longest"), F.sha2(F.encode(F.array_join("p", "\n"), "UTF-8"), 256).alias("digest"))


def _described_sql(pieces: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"WITH p AS (SELECT {key}, {pieces} AS p FROM {source}) SELECT {key}, len(p) AS n, coalesce(list_min(list_transform(p, lambda x: length(x))), 0) AS shortest, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS longest, sha256(array_to_string(p, chr(10))) AS digest FROM p"


@query("D6", sql=_described_sql(C.word_split_sql("text")))
def word_pieces(spark, sf_dir: str) -> DataFrame:
    return _described(_docs(spark, sf_dir), "doc_id", C.word_split(F.col("text")))


@query("D8", sql=_described_sql(C.merge_short_sql(_SENTENCES)))
def merged_short_chunks(spark, sf_dir: str) -> DataFrame:
    return _described(_docs(spark, sf_dir), "doc_id", C.merge_short(sentences(F.col("text"))))


@query("D9", sql=_described_sql(C.duration_bounds_sql(_SENTENCES, LEAST_S)))
def bounded_chunks(spark, sf_dir: str) -> DataFrame:
    return _described(_docs(spark, sf_dir), "doc_id", C.duration_bounds(sentences(F.col("text")), LEAST_S))


@query("D14", sql=_described_sql(C.repaired_sql(_SENTENCES)))
def repaired_chunks(spark, sf_dir: str) -> DataFrame:
    return _described(_docs(spark, sf_dir), "doc_id", C.repaired(sentences(F.col("text"))))


_PARTS = "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query("D13", sql=_described_sql(f"flatten(list_transform({_PARTS}, lambda k: {C.strict_repack_sql('k', _SENTENCES.replace('text', 'k'))}))"))
def strict_chunks(spark, sf_dir: str) -> DataFrame:
    """Paragraphs as packs of at most 250 characters."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _described(_docs(spark, sf_dir), "doc_id", F.flatten(F.transform(parts, lambda k: C.strict_repack(k, sentences))))


@query("D4", "D5")
def clause_chunks(spark, sf_dir: str) -> DataFrame:
    """Sentences, those above 250 characters split at clauses. No SQL for the recursion; tests compare it with brute force."""
    return _described(_docs(spark, sf_dir), "doc_id", chunker.clause_split(sentences(F.col("text"))))


@query("D7", "D10")
def tiered_chunks(spark, sf_dir: str) -> DataFrame:
    """The three-tier chunker, which joins backwards what cannot be completed. No SQL: it looks ahead; tests have its cases."""
    return _described(_docs(spark, sf_dir), "doc_id", chunker.tiered(sentences(F.col("text"))))


def formed(text: Column, limits: dict | None = None, least_s: float | None = None, strict: int | None = None) -> Column:
    """Sentences of three characters or more to chunks: three tiers; where over three in ten are under 500 characters, short
    ones merged; incomplete ones repaired; those under 50 dropped; bounds of duration; and the strict length, if asked for."""
    limits = limits or {}
    found = chunker.tiered(F.filter(sentences(text), lambda s: F.length(s) >= 3), **limits)
    least, soft, emergency = limits.get("least", C.MIN_CHARS), limits.get("soft", C.SOFT), limits.get("emergency", C.EMERGENCY)

    def rest(c: Column) -> Column:
        short = F.size(F.filter(c, lambda x: F.length(x) < 500)) > F.size(c) * 0.3
        merged = F.when(short, C.merge_short(c, least, soft, emergency)).otherwise(c)
        kept = F.filter(C.repaired(merged, emergency), lambda x: F.length(x) >= 50)
        kept = C.duration_bounds(kept, least_s) if least_s else kept
        return F.flatten(F.transform(kept, lambda x: C.strict_repack(x, sentences, strict))) if strict else kept

    return F.element_at(F.transform(F.array(found), rest), 1)


@query("D12")
def formed_chunks(spark, sf_dir: str) -> DataFrame:
    """The whole chunking of a text, each step of which has its own query. Coherence of neighbours is ``coherence_adjacent``."""
    return _described(_docs(spark, sf_dir), "doc_id", formed(F.col("text"), least_s=LEAST_S, strict=C.SOFT))


@query("D24", "D25", sql=rf"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS x, generate_subscripts({_SENTENCES}, 1) AS i FROM documents),
m AS (SELECT doc_id, i, x, len(list_filter(regexp_split_to_array(x, '{C.WS}+'), lambda w: w <> '')) AS w, greatest(1, len(regexp_extract_all(x, '[.!?]+'))) AS k, len(regexp_extract_all(lower(x), '[aeiouy]+')) AS v FROM s)
SELECT doc_id, i, length(x) AS chars, length(x) * 60 / CAST(1050 AS DOUBLE) AS est_s, CASE WHEN w < 3 THEN 0 ELSE (206835 * k * w - 1015 * w * w - 84600 * v * k) / CAST(1000 * k * w AS DOUBLE) END AS readability FROM m
""")
def chunk_metadata(spark, sf_dir: str) -> DataFrame:
    """Length, predicted duration and reading ease (in thousandths of its constants) of each chunk, here a sentence; syllables
    are runs of vowels."""
    s = _docs(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "x"))
    n = lambda p: F.regexp_count(F.lower("x"), F.lit(p))
    m = s.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "x", F.size(C.words_of(F.col("x"))).alias("w"), F.greatest(F.lit(1), n("[.!?]+")).alias("k"), n("[aeiouy]+").alias("v"))
    k, w, v = (F.col(c).cast("long") for c in "kwv")
    ease = (206835 * k * w - 1015 * w * w - 84600 * v * k) / (1000 * k * w).cast("double")
    return m.select("doc_id", "i", F.length("x").cast("long").alias("chars"), (F.length("x") * 60 / 1050.0).alias("est_s"), F.when(F.col("w") < 3, 0.0).otherwise(ease).alias("readability"))


def _profiles_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in p) + ")" for p in PROFILES)
    return f"(VALUES {rows}) AS p(name, min_words, max_words, min_c, max_c, min_d, target_d, max_d)"


@query("D27", "D28", "D30", sql=f"""
WITH d AS (SELECT doc_id, ['philosophy', 'fiction', 'academic', 'memoir', 'technical', 'auto'][doc_id % 6 + 1] AS profile, doc_id % 7 = 0 AS fast, n_chars, CASE WHEN doc_id % 2 = 0 THEN 'kokoro' ELSE 'xtts' END AS engine, (doc_id % 13) / CAST(100 AS DOUBLE) AS rate FROM documents),
l AS (SELECT d.*, greatest(420, min_c) AS min_chars, least(2000, max_c) AS hard, coalesce(target_d, 20) AS t0, coalesce(max_d, greatest(coalesce(target_d, 20) + 5, 24)) AS e0 FROM d JOIN {_profiles_sql()} ON profile = name),
t AS (SELECT *, greatest(min_chars, least(1500, hard)) AS soft, greatest(hard + 200, hard + 1) AS emergency, CASE WHEN fast THEN least(t0, 20, 16) ELSE t0 END AS target FROM l)
SELECT doc_id, profile, min_chars, soft, hard, emergency, CAST(target AS DOUBLE) AS target_s, CAST(CASE WHEN fast THEN least(e0, target + 4) ELSE e0 END AS DOUBLE) AS emergency_s,
  greatest(1, CASE WHEN rate > 0.05 THEN CAST(trunc(soft * CAST(0.9 AS DOUBLE)) AS INT) WHEN profile = 'philosophy' THEN CAST(trunc(soft * CAST(0.9 AS DOUBLE)) AS INT) WHEN profile = 'fiction' AND engine = 'kokoro' THEN CAST(trunc(soft * CAST(1.1 AS DOUBLE)) AS INT) ELSE soft END) AS chosen,
  CASE WHEN rate > 0.05 THEN 'reduce_due_to_failures' WHEN profile = 'philosophy' THEN 'philosophy_dense_content' WHEN profile = 'fiction' AND engine = 'kokoro' THEN 'fiction_fast_engine' ELSE 'base_size' END AS reason FROM t
""")
def effective_limits(spark, sf_dir: str) -> DataFrame:
    """Limits of configuration (420, 1500 and 2000 characters, 20 s) and profile together, and the adapted size; the profiles
    are a constant table of six rows."""
    p = F.create_map(*(x for name, *v in PROFILES for x in (F.lit(name), F.array(*(F.lit(k).cast("int") for k in v)))))
    k = F.col("doc_id")
    name = F.element_at(F.array(*(F.lit(n) for n, *_ in PROFILES)), (k % 6 + 1).cast("int"))
    d = _docs(spark, sf_dir).select("doc_id", name.alias("profile"), (k % 7 == 0).alias("fast"), F.when(k % 2 == 0, "kokoro").otherwise("xtts").alias("engine"), ((k % 13) / 100.0).alias("rate"), p[name].alias("p"))
    at = lambda i: F.col("p")[i]
    target = F.coalesce(at(5), F.lit(20))
    low, hard = F.greatest(F.lit(420), at(2)), F.least(F.lit(2000), at(3))
    d = d.select("*", low.alias("min_chars"), hard.alias("hard"), target.alias("t0"), F.coalesce(at(6), F.greatest(target + 5, F.lit(24))).alias("e0"))
    d = d.select("*", F.greatest("min_chars", F.least(F.lit(1500), "hard")).alias("soft"), F.when(F.col("fast"), F.least(F.col("t0"), F.lit(16))).otherwise(F.col("t0")).alias("target"))
    failing, dense, quick = F.col("rate") > 0.05, F.col("profile") == "philosophy", (F.col("profile") == "fiction") & (F.col("engine") == "kokoro")
    size = F.when(failing | dense, (F.col("soft") * 0.9).cast("int")).when(quick, (F.col("soft") * 1.1).cast("int")).otherwise(F.col("soft"))
    reason = F.when(failing, "reduce_due_to_failures").when(dense, "philosophy_dense_content").when(quick, "fiction_fast_engine").otherwise("base_size")
    return d.select(
        "doc_id", "profile", "min_chars", "soft", "hard", (F.col("hard") + 200).alias("emergency"), F.col("target").cast("double").alias("target_s"), F.when(F.col("fast"), F.least(F.col("e0"), F.col("target") + 4)).otherwise(F.col("e0")).cast("double").alias("emergency_s"),
        F.greatest(F.lit(1), size).alias("chosen"), reason.alias("reason"),
    )


#: Characters and seconds of a subtitle at most, in the query of that rule.
SUBTITLE_CHARS, SUBTITLE_S = 400, 25


@query("D29", sql=rf"""
WITH g AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '[pause]' ELSE coalesce(text, '') END AS text, CAST(turn * 6 AS BIGINT) AS b, CAST(turn * 6 + 5 AS BIGINT) AS e FROM conversations),
a AS (SELECT conv_id, list({{'b': b, 'e': e, 't': text}} ORDER BY turn, text) AS segs FROM g GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(segs, lambda s, x: CASE
    WHEN x.t IN ('', '[pause]') THEN {{'done': CASE WHEN s.t = '' THEN s.done ELSE list_append(s.done, s.b || '-' || s.e || ':' || trim(s.t, ' ')) END, 'b': s.b, 'e': s.e, 't': ''}}
    WHEN s.t = '' THEN {{'done': s.done, 'b': x.b, 'e': x.e, 't': x.t}}
    WHEN length(s.t) + length(x.t) + 1 > {SUBTITLE_CHARS} OR x.e - s.b > {SUBTITLE_S} OR regexp_matches(x.t, '[.!?]\z') THEN {{'done': list_append(s.done, s.b || '-' || s.e || ':' || trim(s.t, ' ')), 'b': x.b, 'e': x.e, 't': x.t}}
    ELSE {{'done': s.done, 'b': s.b, 'e': x.e, 't': s.t || ' ' || x.t}} END, {{'done': []::VARCHAR[], 'b': 0::BIGINT, 'e': 0::BIGINT, 't': ''}}) AS s FROM a),
o AS (SELECT conv_id, CASE WHEN s.t = '' THEN s.done ELSE list_append(s.done, s.b || '-' || s.e || ':' || trim(s.t, ' ')) END AS p FROM f)
SELECT conv_id, len(p) AS n, sha256(array_to_string(p, chr(10))) AS digest FROM o
""")
def subtitle_groups(spark, sf_dir: str) -> DataFrame:
    """Turns as timed segments, grouped: a segment that would make the group too long, or ends a sentence, begins a new one;
    blanks and pauses end a group. One fold over a conversation's segments."""
    text = F.when(F.col("turn") % 5 == 3, "[pause]").otherwise(F.coalesce("text", F.lit("")))
    seg = F.struct("turn", text.alias("t"), (F.col("turn") * 6).cast("long").alias("b"), (F.col("turn") * 6 + 5).cast("long").alias("e"))
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("e"), F.lit("").alias("t"))
    shown = lambda s: F.concat(s["done"], F.array(F.concat(s["b"].cast("string"), F.lit("-"), s["e"].cast("string"), F.lit(":"), F.trim(s["t"]))))
    make = lambda done, b, e, t: F.struct(done.alias("done"), b.alias("b"), e.alias("e"), t.alias("t"))

    def step(s: Column, x: Column) -> Column:
        closed = F.when(s["t"] == "", s["done"]).otherwise(shown(s))
        split = (F.length(s["t"]) + F.length(x["t"]) + 1 > SUBTITLE_CHARS) | (x["e"] - s["b"] > SUBTITLE_S) | x["t"].rlike(r"[.!?]\z")
        out = F.when(x["t"].isin("", "[pause]"), make(closed, s["b"], s["e"], F.lit(""))).when(s["t"] == "", make(s["done"], x["b"], x["e"], x["t"]))
        return out.when(split, make(shown(s), x["b"], x["e"], x["t"])).otherwise(make(s["done"], s["b"], x["e"], F.concat(s["t"], F.lit(" "), x["t"])))

    g = a.select("conv_id", F.aggregate("segs", state, step, lambda s: F.when(s["t"] == "", s["done"]).otherwise(shown(s))).alias("p"))
    return g.select("conv_id", F.size("p").cast("long").alias("n"), F.sha2(F.encode(F.array_join("p", "\n"), "UTF-8"), 256).alias("digest"))
