"""Verdicts on texts, audio, retries, logs, reuse and runs of chunks: row rules, and roll-ups with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.functions import chunks as C
from scriptorium.functions import quality
from scriptorium.functions.text import COMMON_WORDS, bound
from scriptorium.plans.kernels import _SIGNALS, _listed_sql, listed, signals
from scriptorium.sources.tables import table

WS = C.WS


def _docs(spark, sf_dir: str, *cols) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*cols)


#: Words and patterns that point to a genre, the least number of hits that counts, and their points in
#: hundredths; titles' words give thirty.
TITLES = (
    ("philosophy", "philosophy|meditations|ethics|metaphysics|epistemology"), ("fiction", "novel|fiction|story|tales|narrative"), ("academic", "introduction|textbook|studies|research|theory"),
    ("memoir", "memoir|autobiography|journal|diary|life of"), ("technical", "manual|guide|handbook|tutorial|programming"),
)
GENRES = tuple(g for g, _ in TITLES)
ABSTRACT, FORMAL, DIALOGUE = "being|existence|nature|essence|truth|virtue|wisdom|knowledge|reality", "therefore|thus|however|furthermore|moreover|consequently", "said|replied|asked|answered|exclaimed|whispered"
FIRST_PERSON, ANECDOTE, INSTRUCTION = "I|my|me|mine", "remember|recall|once|when I was|looking back", "step|first|next|then|finally|install|configure|run"
CITATION, LISTS, CODE, FORMULA = r"\([A-Z][a-z]+,?[ \t\n\r\f]+[0-9]{4}\)", r"(?m)^[ \t]*[0-9]+\.|^[ \t]*[a-z]\)", r"```|def[ \t\n\r\f]+[A-Za-z0-9_]+\(|function[ \t\n\r\f]+[A-Za-z0-9_]+|class[ \t\n\r\f]+[A-Za-z0-9_]+", r"\$[^\n]*?\$|\\[a-z]+\{"
_MADE_TITLES = ("The Ethics of Rivers", "A Novel", "Research Studies", "My Diary", "User Guide", "Plain", "")
SAMPLE = 5000


def genre_points(text: Column, title: Column) -> Column:
    """Points of each genre, in hundredths, of a text's first 5,000 characters and its title; plain and curly quotes count once."""
    n = lambda s, p: F.regexp_count(s, F.lit(p))
    part = lambda test, points: F.when(test, points).otherwise(0)

    def word(s: Column, w: Column, p: str) -> Column:
        """Single words are counted among the text's, phrases looked for where their letters are."""
        one, more = [x.lower() for x in p.split("|") if " " not in x], [x for x in p.split("|") if " " in x]
        phrases = (F.when(F.contains(F.lower(s), F.lit(x.lower())), n(s, f"(?i)(?<![A-Za-z0-9_]){x}(?![A-Za-z0-9_])")).otherwise(0) for x in more)
        return sum(phrases, F.size(F.filter(w, lambda x: x.isin(*one))))

    def points(s: Column) -> Column:
        return bound(F.transform(F.split(s, "[^A-Za-z0-9_]+"), lambda x: F.lower(x)), lambda w: judged(s, w))

    def judged(s: Column, w: Column) -> Column:
        m = F.struct(
            F.size(F.filter(F.split(s, "[.]"), lambda x: x.rlike(r"\S"))).alias("sentences"), F.size(C.words_of(F.replace(s, F.lit("."), F.lit(" ")))).alias("words"), F.size(C.words_of(s)).alias("tokens"), F.length(s).alias("chars"), n(s, '["“”]').alias("quotes"),
            word(s, w, ABSTRACT).alias("abstract"), word(s, w, DIALOGUE).alias("dialogue"), n(s, CITATION).alias("citations"), word(s, w, FORMAL).alias("formal"), n(s, LISTS).alias("lists"), word(s, w, FIRST_PERSON).alias("first"), word(s, w, ANECDOTE).alias("anecdotes"),
            n(s, CODE).alias("code"), n(s, FORMULA).alias("formulas"), word(s, w, INSTRUCTION).alias("steps"),
        )

        def by_genre(m: Column) -> Column:
            long = m["words"] > 25 * m["sentences"]
            lists = part(m["lists"] > 3, 10)
            own = {
                "philosophy": part(long, 20) + part(long & (m["abstract"] > 5), 20), "fiction": part(m["quotes"] * 20 > m["chars"], 30) + part(m["dialogue"] * 10 > m["sentences"], 20),
                "academic": part(long & (m["abstract"] <= 5), 10) + part(m["citations"] * 20 > m["sentences"], 30) + part(m["formal"] > 3, 15) + lists, "memoir": part(m["first"] * 100 > 3 * m["tokens"], 30) + part(m["anecdotes"] > 2, 15),
                "technical": lists + part((m["code"] > 0) | (m["formulas"] > 2), 40) + part(m["steps"] > 5, 20),
            }
            return F.struct(*((own[g] + part(F.lower(title).rlike(p), 30)).alias(g) for g, p in TITLES), m["sentences"].alias("sentences"))

        return bound(m, by_genre)

    return bound(F.substring(text, 1, SAMPLE), points)


def _genre_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(s, '{p}'))"
    word = lambda p: n(rf"(?i)\b(?:{p})\b")
    part = lambda test, points: f"CASE WHEN {test} THEN {points} ELSE 0 END"
    titles = {g: part(f"regexp_matches(lower(title), '{p}')", 30) for g, p in TITLES}
    return f"""
WITH d AS (SELECT doc_id, text, left(text, {SAMPLE}) AS s, {list(_MADE_TITLES)}[doc_id % 7 + 1] AS title FROM documents),
m AS (SELECT doc_id, text, title, len(list_filter(string_split(s, '.'), lambda x: regexp_matches(x, '\\S'))) AS sentences, len(list_filter(regexp_split_to_array(replace(s, '.', ' '), '{WS}+'), lambda w: w <> '')) AS words, len(list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '')) AS tokens,
  length(s) AS chars, {n('["“”]')} AS quotes, {word(ABSTRACT)} AS abstract, {word(DIALOGUE)} AS dialogue, {n(CITATION)} AS citations, {word(FORMAL)} AS formal, {n(LISTS)} AS lists, {word(FIRST_PERSON)} AS first, {word(ANECDOTE)} AS anecdotes, {n(CODE)} AS code, {n(FORMULA)} AS formulas, {word(INSTRUCTION)} AS steps FROM d),
g AS (SELECT doc_id, text, sentences, {part("words > 25 * sentences", 20)} + {part("words > 25 * sentences AND abstract > 5", 20)} + {titles["philosophy"]} AS philosophy, {part("quotes * 20 > chars", 30)} + {part("dialogue * 10 > sentences", 20)} + {titles["fiction"]} AS fiction,
  {part("words > 25 * sentences AND abstract <= 5", 10)} + {part("citations * 20 > sentences", 30)} + {part("formal > 3", 15)} + {part("lists > 3", 10)} + {titles["academic"]} AS academic, {part("first * 100 > 3 * tokens", 30)} + {part("anecdotes > 2", 15)} + {titles["memoir"]} AS memoir,
  {part("lists > 3", 10)} + {part("code > 0 OR formulas > 2", 40)} + {part("steps > 5", 20)} + {titles["technical"]} AS technical FROM m),
b AS (SELECT *, greatest(philosophy, fiction, academic, memoir, technical) AS best, length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) < 100 OR sentences = 0 AS short FROM g)
SELECT doc_id, {", ".join(f"CAST({g} AS BIGINT) AS {g}" for g in GENRES)}, CASE WHEN short OR best < 30 THEN 'auto' {" ".join(f"WHEN {g} = best THEN '{g}'" for g in GENRES)} END AS genre, CASE WHEN short THEN 0 ELSE least(100, best) / CAST(100 AS DOUBLE) END AS confidence FROM b
"""


@query("E1", sql=_genre_sql())
def genre_detection(spark, sf_dir: str) -> DataFrame:
    """The genre of the most points, the first of equals; under thirty, or without text enough, ``auto``. Titles are made up."""
    title = F.element_at(F.array(*map(F.lit, _MADE_TITLES)), (F.col("doc_id") % 7 + 1).cast("int"))
    d = _docs(spark, sf_dir, "doc_id", (F.length(F.regexp_replace("text", f"^{WS}+|{WS}+$", "")) < 100).alias("short"), genre_points(F.col("text"), title).alias("g"))
    best = F.greatest(*(F.col("g")[g] for g in GENRES))
    short = F.col("short") | (F.col("g.sentences") == 0)
    genre = F.when(short | (best < 30), "auto")
    for g in GENRES:
        genre = genre.when(F.col("g")[g] == best, g)
    return d.select("doc_id", *(F.col("g")[g].cast("long").alias(g) for g in GENRES), genre.alias("genre"), F.when(short, 0.0).otherwise(F.least(F.lit(100), best) / 100.0).alias("confidence"))


#: Log patterns by category, in order; the first that fits, case aside, decides.
LOG_PATTERNS = (
    ("oom", "out of memory|MemoryError|CUDA out of memory|OOM|killed|cannot allocate memory"), ("timeout", r"timeout|timed out|exceeded [0-9]+ seconds|too slow|RTF [0-9.]+ > [0-9.]+"),
    ("truncation", "truncat|text too long|max.*char.*exceeded|token limit|split required"), ("quality", "silence detected|no audio|empty.*wav|corrupt|invalid.*audio|WER.*[0-9]+%|duration mismatch"),
    ("schema", "ValidationError|pydantic|missing.*key|invalid.*schema|KeyError"), ("io", "FileNotFoundError|PermissionError|No such file|cannot open|disk.*full|IOError"),
)
_MESSAGES = ("ERROR CUDA Out Of Memory on chunk_", "WARNING Timed out after file_id=abc, chunk-", "INFO rtf 3.5 > 2.0 chunk", "text too long for chunk_", "exception: corrupt output chunk_", "critical KeyError at chunk_", "warn: disk is full chunk_", "fine, nothing for chunk_", "DEBUG WER was 12% chunk_", "all fail chunk_")
_SOURCES = ("logs/phase4.log", "logs/enhancement.log", "logs/orchestrator.log", "logs/chunker.log", "logs/other.log")


@query("E12", "E11", sql=f"""
WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {list(_MESSAGES)}[event_id % 10 + 1] || (event_id % 1000) AS line, {list(_SOURCES)}[user_id % 5 + 1] AS source FROM events)
SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{c}'" for c, p in LOG_PATTERNS)} END AS category, regexp_extract(line, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1) AS at,
  CASE WHEN regexp_matches(line, '(?i)chunk[_-]?[0-9]') THEN 'chunk_' || lpad(regexp_extract(line, '(?i)chunk[_-]?([0-9]+)', 1), 4, '0') END AS chunk_id, nullif(regexp_extract(line, '(?i)file[_-]?id[=: \t]+([^ \t,]+)', 1), '') AS file_id,
  CASE WHEN regexp_matches(source, 'phase4|tts') THEN 'phase4' WHEN regexp_matches(source, 'phase5|enhancement') THEN 'phase5' WHEN regexp_matches(source, 'phase6|orchestrat') THEN 'phase6' WHEN regexp_matches(source, 'phase3|chunk') THEN 'phase3' END AS phase,
  CASE WHEN regexp_matches(line, '(?i)DEBUG|INFO|WARNING|ERROR|CRITICAL') THEN lower(regexp_extract(line, '(?i)(DEBUG|INFO|WARNING|ERROR|CRITICAL)', 1)) WHEN regexp_matches(lower(line), 'error|exception|fail') THEN 'error' WHEN regexp_matches(lower(line), 'warn') THEN 'warning' ELSE 'info' END AS severity FROM l
""")
def log_events(spark, sf_dir: str) -> DataFrame:
    """Category, time, chunk, file, phase and severity of log lines, here made of events; lines without a category stay."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), pick(_MESSAGES, F.col("event_id") % 10), (F.col("event_id") % 1000).cast("string"))
    x = table(spark, sf_dir, "events").select("event_id", line.alias("line"), pick(_SOURCES, F.col("user_id") % 5).alias("source"))
    category = F.lit(None).cast("string")
    for c, p in reversed(LOG_PATTERNS):
        category = F.when(F.col("line").rlike(f"(?i){p}"), c).otherwise(category)
    found = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    phase = F.when(F.col("source").rlike("phase4|tts"), "phase4").when(F.col("source").rlike("phase5|enhancement"), "phase5").when(F.col("source").rlike("phase6|orchestrat"), "phase6").when(F.col("source").rlike("phase3|chunk"), "phase3")
    low = F.lower("line")
    severity = F.coalesce(F.lower(found("(?i)(DEBUG|INFO|WARNING|ERROR|CRITICAL)")), F.when(low.rlike("error|exception|fail"), "error").when(F.contains(low, F.lit("warn")), "warning").otherwise("info"))
    return x.select("event_id", category.alias("category"), F.regexp_extract("line", "([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1).alias("at"), F.concat(F.lit("chunk_"), F.lpad(found("(?i)chunk[_-]?([0-9]+)"), 4, "0")).alias("chunk_id"), found("(?i)file[_-]?id[=: \t]+([^ \t,]+)").alias("file_id"), phase.alias("phase"), severity.alias("severity"))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each word of the pair gets a code point of its own, then characters are compared."""

    def coded(v: Column) -> Column:
        text = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(F.array_position(v, w) + 0x4E00), 8, "0")), "")), "UTF-32")
        return F.levenshtein(text(a), text(b))

    return bound(F.array_distinct(F.concat(a, b)), coded)


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WS}+'), lambda w: w <> '')"


_DISTANCE_SQL = """CASE WHEN len(b) = 0 THEN len(a) ELSE list_reduce(a, lambda s, w: {'i': s.i + 1, 'r': list_reduce(range(1, len(b) + 1), lambda q, j: list_append(q, least(s.r[j + 1] + 1, q[-1] + 1, s.r[j] + CASE WHEN w = b[j] THEN 0 ELSE 1 END)), [s.i + 1])}, {'i': 0::BIGINT, 'r': range(0, len(b) + 1)}).r[-1] END"""
_PAIRS_SQL = f"SELECT conv_id, turn, {_words_sql('coalesce(text, ' + chr(39) * 2 + ')')} AS a, {_words_sql('lead(coalesce(text, ' + chr(39) * 2 + '), 1, ' + chr(39) * 2 + ') OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations"


@query("B13", "H2", "H4", sql=f"""
WITH p AS ({_PAIRS_SQL}), d AS (SELECT conv_id, turn, len(a) AS n, len(b) AS m, len(list_distinct(b)) AS u, {_DISTANCE_SQL} AS dist FROM p),
w AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0 ELSE 1 END ELSE dist / n END AS wer FROM d),
i AS (SELECT conv_id, turn, wer, concat_ws(',', CASE WHEN wer > .4 THEN 'critical_wer' WHEN wer > .2 THEN 'high_wer' END, CASE WHEN m * 10 < n * 7 THEN 'truncation' END, CASE WHEN m > 0 AND u * 10 < m * 3 THEN 'repetition_artifact' END, CASE WHEN wer > .8 AND m > 0 THEN 'possible_gibberish' END) AS issues FROM w)
SELECT conv_id, turn, wer, issues, CASE WHEN wer > .4 OR contains(issues, 'gibberish') THEN 'switch_engine' WHEN wer < .2 THEN 'pass' ELSE 'rewrite' END AS advice FROM i
""")
def word_error_rates(spark, sf_dir: str) -> DataFrame:
    """Word error rate of each turn against the next one, which stands for a transcript, with its issues and advice."""
    text = F.coalesce("text", F.lit(""))
    after = F.coalesce(F.lead(text).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.words_of(F.lower(text)).alias("a"), C.words_of(F.lower(after)).alias("b"))
    d = p.select("conv_id", "turn", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_distinct("b")).alias("u"), word_distance(F.col("a"), F.col("b")).alias("dist"))
    n, m = F.col("n"), F.col("m")
    w = d.withColumn("wer", F.when(n == 0, F.when(m == 0, 0.0).otherwise(1.0)).otherwise(F.col("dist") / n))
    issues = F.concat_ws(",", F.when(F.col("wer") > 0.4, "critical_wer").when(F.col("wer") > 0.2, "high_wer"), F.when(m * 10 < n * 7, "truncation"), F.when((m > 0) & (F.col("u") * 10 < m * 3), "repetition_artifact"), F.when((F.col("wer") > 0.8) & (m > 0), "possible_gibberish"))
    i = w.select("conv_id", "turn", "wer", issues.alias("issues"))
    return i.select("conv_id", "turn", "wer", "issues", F.when((F.col("wer") > 0.4) | F.contains("issues", F.lit("gibberish")), "switch_engine").when(F.col("wer") < 0.2, "pass").otherwise("rewrite").alias("advice"))


#: Weights and limits of the audio score.
AUDIO = {"snr": 0.25, "silence": 0.20, "clip": 0.15, "spectral": 0.20, "duration": 0.20}
_METRICS = """
SELECT user_id, day, CASE WHEN last_id % 9 = 0 THEN NULL ELSE CAST(kmax % 30 AS DOUBLE) END AS snr, (ks % 50) / CAST(100 AS DOUBLE) AS silence, (kmin % 10) / CAST(1000 AS DOUBLE) AS clip, (kmax % 80) / CAST(100 AS DOUBLE) AS spectral, (last_id % 70) / CAST(100 AS DOUBLE) AS variance,
  CAST(-(ks % 60) AS DOUBLE) AS db, ks * 7 % 1500 AS chars, CAST(ks % 97 AS DOUBLE) AS actual, (kmin % 30) / CAST(10 AS DOUBLE) AS gap, last_id % 11 = 0 AS pauses, last_id % 13 = 0 AS phrase
FROM ({signals})
""".replace("{signals}", _SIGNALS)


def _metrics(spark, sf_dir: str) -> DataFrame:
    c = F.col
    return signals(spark, sf_dir).select(
        "user_id", "day", F.when(c("last_id") % 9 != 0, (c("kmax") % 30).cast("double")).alias("snr"), ((c("ks") % 50) / 100.0).alias("silence"), ((c("kmin") % 10) / 1000.0).alias("clip"), ((c("kmax") % 80) / 100.0).alias("spectral"), ((c("last_id") % 70) / 100.0).alias("variance"),
        (-(c("ks") % 60)).cast("double").alias("db"), (c("ks") * 7 % 1500).alias("chars"), (c("ks") % 97).cast("double").alias("actual"), ((c("kmin") % 30) / 10.0).alias("gap"), (c("last_id") % 11 == 0).alias("pauses"), (c("last_id") % 13 == 0).alias("phrase"),
    )


@query("B10", "B11", sql=f"""
WITH m AS ({_METRICS}),
s AS (SELECT *, coalesce(least(1, greatest(0, (snr - 5) / 10)), 0.5) * CAST(.25 AS DOUBLE) + (1 - least(1, silence / CAST(.3 AS DOUBLE))) * CAST(.2 AS DOUBLE) + (1 - least(1, clip / CAST(.01 AS DOUBLE))) * CAST(.15 AS DOUBLE) + least(1, spectral / CAST(.3 AS DOUBLE)) * CAST(.2 AS DOUBLE) + (1 - least(1, variance / CAST(.5 AS DOUBLE))) * CAST(.2 AS DOUBLE) AS score,
  {_listed_sql(low_snr="snr < 15", silence="silence > 0.3", clipping="clip > 0.01", muffled="spectral < 0.3", duration="variance > 0.5", quiet="db < -40")} AS issues, chars / CAST(1050 AS DOUBLE) * 60 AS expected FROM m)
SELECT user_id, day, round(score, 6) AS score, issues, score >= .6 AND issues = '' AS acceptable, CASE WHEN chars < 400 THEN 'short_chunk_skip'
  WHEN abs(expected - actual) > greatest(120, expected * CASE WHEN expected < 20 THEN CAST(.8 AS DOUBLE) WHEN expected < 60 THEN CAST(.25 AS DOUBLE) ELSE CAST(.2 AS DOUBLE) END) THEN 'duration_mismatch' WHEN gap > 2 THEN 'silence_gap' WHEN pauses THEN 'unnatural_pauses_vad'
  WHEN db < -23 THEN 'rms_too_low' WHEN db > -18 THEN 'rms_too_high' WHEN phrase THEN 'error_phrase_suspected' ELSE 'valid' END AS reason FROM s
""")
def audio_verdicts(spark, sf_dir: str) -> DataFrame:
    """The weighted score of measured audio with its issues, and the first reason that fails it; short texts are skipped."""
    c = F.col
    capped = lambda x: F.least(F.lit(1.0), x)
    snr = F.coalesce(capped(F.greatest(F.lit(0.0), (c("snr") - 5) / 10)), F.lit(0.5))
    score = snr * AUDIO["snr"] + (1 - capped(c("silence") / 0.3)) * AUDIO["silence"] + (1 - capped(c("clip") / 0.01)) * AUDIO["clip"] + capped(c("spectral") / 0.3) * AUDIO["spectral"] + (1 - capped(c("variance") / 0.5)) * AUDIO["duration"]
    issues = listed(low_snr=c("snr") < 15, silence=c("silence") > 0.3, clipping=c("clip") > 0.01, muffled=c("spectral") < 0.3, duration=c("variance") > 0.5, quiet=c("db") < -40)
    s = _metrics(spark, sf_dir).select("*", score.alias("score"), issues.alias("issues"), (c("chars") / 1050.0 * 60).alias("expected"))
    share = F.when(c("expected") < 20, 0.8).when(c("expected") < 60, 0.25).otherwise(0.2)
    reason = F.when(c("chars") < 400, "short_chunk_skip").when(F.abs(c("expected") - c("actual")) > F.greatest(F.lit(120.0), c("expected") * share), "duration_mismatch").when(c("gap") > 2, "silence_gap").when(c("pauses"), "unnatural_pauses_vad")
    reason = reason.when(c("db") < -23, "rms_too_low").when(c("db") > -18, "rms_too_high").when(c("phrase"), "error_phrase_suspected").otherwise("valid")
    return s.select("user_id", "day", F.round("score", 6).alias("score"), "issues", ((c("score") >= 0.6) & (c("issues") == "")).alias("acceptable"), reason.alias("reason"))


#: The engines' voices in the order in which they are tried.
KOKORO_VOICES, XTTS_VOICES = ("af_bella", "af_sarah", "bf_emma", "am_adam", "bm_george"), ("claribel_dervla", "gracie_wise", "ana_florence")
_CURRENT = ("af_bella", "bm_george", "gracie_wise", "ana_florence", "someone")
_REASONS = ("duration_mismatch", "rms_too_low", "silence_gap", "too_quiet", "other")


def _next_sql(voices) -> str:
    return "CASE voice " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(voices, voices[1:], strict=False)) + f" WHEN '{voices[-1]}' THEN NULL ELSE '{voices[0]}' END"


@query("B16", sql=f"""
WITH s AS (SELECT user_id, day, CASE WHEN last_id % 10 = 0 THEN 'piper' ELSE engine END AS engine, {list(_REASONS)}[ks % 5 + 1] AS reason, {list(_CURRENT)}[kmax % 5 + 1] AS voice, last_id % 5 AS retries, 10 + kmin % 20 AS expected, ks % 60 AS actual, 10 + kmax % 41 AS penalty FROM ({_SIGNALS})),
n AS (SELECT *, {_next_sql(KOKORO_VOICES)} AS nk, {_next_sql(XTTS_VOICES)} AS nx FROM s),
d AS (SELECT *, retries >= 3 OR engine = 'piper' AS over, reason IN ('rms_too_low', 'rms_too_high', 'too_quiet') AS level FROM n)
SELECT user_id, day, CASE WHEN over THEN NULL WHEN engine = 'xtts' AND reason = 'duration_mismatch' AND actual * 2 > expected * 3 THEN least(penalty + 5, 50) WHEN engine = 'xtts' AND reason = 'duration_mismatch' AND actual * 2 < expected THEN greatest(penalty - 3, 10) WHEN engine = 'xtts' AND reason = 'silence_gap' THEN least(penalty + 3, 40) END / CAST(10 AS DOUBLE) AS penalty,
  CASE WHEN over THEN NULL WHEN engine = 'xtts' AND level THEN nx WHEN engine = 'kokoro' AND (level OR reason = 'duration_mismatch') THEN nk END AS voice,
  CASE WHEN over THEN TRUE WHEN engine = 'xtts' THEN NOT (reason = 'duration_mismatch' AND (actual * 2 > expected * 3 OR actual * 2 < expected) OR level AND nx IS NOT NULL OR reason = 'silence_gap') ELSE NOT ((level OR reason = 'duration_mismatch') AND nk IS NOT NULL) END AS fallback FROM d
""")
def retry_strategies(spark, sf_dir: str) -> DataFrame:
    """What to change before the next try: the repetition penalty, the voice, or the engine after three tries or without rule."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    c = F.col
    s = signals(spark, sf_dir).select("user_id", "day", F.when(c("last_id") % 10 == 0, "piper").otherwise(c("engine")).alias("engine"), pick(_REASONS, c("ks") % 5).alias("reason"), pick(_CURRENT, c("kmax") % 5).alias("voice"), (c("last_id") % 5).alias("retries"), (10 + c("kmin") % 20).alias("expected"), (c("ks") % 60).alias("actual"), (10 + c("kmax") % 41).alias("p"))

    def following(voices) -> Column:
        order = F.array(*map(F.lit, voices))
        at = F.array_position(order, c("voice"))
        return F.when(at == 0, voices[0]).otherwise(F.get(order, at.cast("int")))

    over, xtts = (c("retries") >= 3) | (c("engine") == "piper"), c("engine") == "xtts"
    long, short = c("actual") * 2 > c("expected") * 3, c("actual") * 2 < c("expected")
    length, level, gap = c("reason") == "duration_mismatch", c("reason").isin("rms_too_low", "rms_too_high", "too_quiet"), c("reason") == "silence_gap"
    penalty = F.when(~over & xtts, F.when(length & long, F.least(c("p") + 5, F.lit(50))).when(length & short, F.greatest(c("p") - 3, F.lit(10))).when(gap, F.least(c("p") + 3, F.lit(40)))) / 10.0
    voice = F.when(~over & xtts & level, following(XTTS_VOICES)).when(~over & ~xtts & (level | length), following(KOKORO_VOICES))
    return s.select("user_id", "day", penalty.alias("penalty"), voice.alias("voice")).withColumn("fallback", F.col("penalty").isNull() & F.col("voice").isNull())


@query("A7", "A17", "A19", sql=rf"""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS alpha, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) AS bad FROM conversations),
s AS (SELECT *, n >= 150 OR (n >= 60 AND alpha * 100 >= n * 55) AS texty, CASE WHEN n < 10 THEN 0 WHEN alpha * 2 < n THEN 5 WHEN n < 40 THEN 6 ELSE 9 END AS conf FROM p),
d AS (SELECT conv_id, count(*) AS pages, count(*) FILTER (texty) / count(*) AS text_ratio, sum(n) / count(*) AS mean_n, sum(alpha) / greatest(1, sum(n)) AS alpha, sum(bad) / greatest(1, sum(n)) AS repl, count(*) FILTER (n * 1000 > 200000) / count(*) AS density, count(*) FILTER (conf < 3) AS failed, count(*) FILTER (conf < 7) AS low, sum(conf) / CAST(10 AS DOUBLE) / count(*) AS confidence FROM s GROUP BY conv_id),
c AS (SELECT *, CASE WHEN text_ratio > .8 AND alpha > .6 AND repl < .05 THEN 'text' WHEN (text_ratio < .2 AND mean_n < 800 AND density < .25) OR (repl > .2 AND text_ratio < .5) THEN 'scanned' ELSE 'mixed' END AS class FROM d)
SELECT conv_id, pages, class, CASE WHEN failed * 10 > pages THEN 'failed' WHEN low > 0 THEN 'partial_success' ELSE 'success' END AS status, confidence, CASE WHEN class = 'scanned' OR (class = 'mixed' AND confidence < .6) THEN 'ocr' ELSE 'multipass' END AS route FROM c
""")
def document_classes(spark, sf_dir: str) -> DataFrame:
    """The class of a document from its pages, here turns, the roll-up of their scores (a stand-in of four steps), and the
    way of extraction that both lead to."""
    t = F.coalesce("text", F.lit(""))
    n, alpha = F.length(t), F.regexp_count(t, F.lit("[A-Za-z]"))
    conf = F.when(n < 10, 0).when(alpha * 2 < n, 5).when(n < 40, 6).otherwise(9)
    s = table(spark, sf_dir, "conversations").select("conv_id", n.alias("n"), alpha.alias("alpha"), F.regexp_count(t, F.lit("�")).alias("bad"), ((n >= 150) | ((n >= 60) & (alpha * 100 >= n * 55))).alias("texty"), conf.alias("conf"))
    share = lambda test: F.count_if(test) / F.count("*")
    total = F.greatest(F.lit(1), F.sum("n"))
    d = s.groupBy("conv_id").agg(
        F.count("*").alias("pages"), share("texty").alias("text_ratio"), (F.sum("n") / F.count("*")).alias("mean_n"), (F.sum("alpha") / total).alias("alpha"), (F.sum("bad") / total).alias("repl"), share(F.col("n") * 1000 > 200000).alias("density"),
        F.count_if(F.col("conf") < 3).alias("failed"), F.count_if(F.col("conf") < 7).alias("low"), (F.sum("conf") / 10.0 / F.count("*")).alias("confidence"),
    )
    c = F.col
    kind = F.when((c("text_ratio") > 0.8) & (c("alpha") > 0.6) & (c("repl") < 0.05), "text").when(((c("text_ratio") < 0.2) & (c("mean_n") < 800) & (c("density") < 0.25)) | ((c("repl") > 0.2) & (c("text_ratio") < 0.5)), "scanned").otherwise("mixed")
    status = F.when(c("failed") * 10 > c("pages"), "failed").when(c("low") > 0, "partial_success").otherwise("success")
    route = F.when((c("class") == "scanned") | ((c("class") == "mixed") & (c("confidence") < 0.6)), "ocr").otherwise("multipass")
    return d.withColumn("class", kind).select("conv_id", "pages", "class", status.alias("status"), "confidence", route.alias("route"))


@query("A29", "A30", "A31", "F11", sql="""
WITH c AS (SELECT l_orderkey AS file, l_linenumber AS i, CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'success' END AS status, l_suppkey % 37 <> 0 AS present, CASE WHEN l_partkey % 41 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS bytes, CASE WHEN l_suppkey % 5 = 0 THEN 'kokoro' ELSE 'xtts' END AS engine, CAST(round(l_discount * 100) AS BIGINT) AS rt, CAST(round(l_tax * 100) AS BIGINT) AS mos, l_linestatus = 'F' AS slow FROM lineitem),
f AS (SELECT file, count(*) AS chunks, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (NOT present) AS missing, count(*) FILTER (bytes = 0) AS empty, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, sum(rt) / CAST(100 AS DOUBLE) / count(*) AS avg_rt, count(*) FILTER (slow) AS fallbacks, CAST(sum(bytes) AS BIGINT) AS seconds, sum(mos) / CAST(100 AS DOUBLE) / count(*) AS mos FROM c GROUP BY file),
o AS (SELECT f.*, o_orderstatus AS status, o_custkey % 6 = 0 AS changed, o_custkey % 7 = 0 AS no_hash, CASE WHEN o_orderkey % 3 = 0 THEN chunks + 1 ELSE chunks END AS total, CASE WHEN o_orderkey % 4 = 0 THEN 'kokoro' ELSE 'xtts' END AS want FROM f JOIN orders ON file = o_orderkey)
SELECT file, chunks, failed, engines, avg_rt, fallbacks, seconds, CASE WHEN chunks < total THEN 'incomplete' WHEN failed > 0 THEN 'failed' WHEN missing > 0 THEN 'missing' WHEN empty > 0 THEN 'zero_bytes' ELSE 'ok' END AS integrity,
  status = 'F' AND (no_hash OR NOT changed) AND missing = 0 AS reuse_text, CASE WHEN chunks < total THEN 'chunk_count' WHEN NOT contains(engines, want) THEN 'engine' WHEN mos < 0.03 THEN 'mos' WHEN changed AND NOT no_hash THEN 'input_hash' ELSE 'reuse' END AS reuse_audio FROM o
""")
def chunk_integrity(spark, sf_dir: str) -> DataFrame:
    """Chunks, here order lines, rolled up to their files: counts, engines and rates, the first flaw that breaks integrity, and
    whether the texts and the audio of an earlier run can be used again."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("file"), (c("l_returnflag") == "R").alias("bad"), (c("l_suppkey") % 37 != 0).alias("present"), F.when(c("l_partkey") % 41 == 0, 0).otherwise(c("l_quantity").cast("long")).alias("bytes"), F.when(c("l_suppkey") % 5 == 0, "kokoro").otherwise("xtts").alias("engine"),
        F.round(c("l_discount") * 100).cast("long").alias("rt"), F.round(c("l_tax") * 100).cast("long").alias("mos"), (c("l_linestatus") == "F").alias("slow"),
    )
    mean = lambda x: F.sum(x) / 100.0 / F.count("*")
    f = lines.groupBy("file").agg(
        F.count("*").alias("chunks"), F.count_if("bad").alias("failed"), F.count_if(~c("present")).alias("missing"), F.count_if(c("bytes") == 0).alias("empty"), F.array_join(F.sort_array(F.collect_set("engine")), ",").alias("engines"), mean("rt").alias("avg_rt"),
        F.count_if("slow").alias("fallbacks"), F.sum("bytes").alias("seconds"), mean("mos").alias("mos"),
    )
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("file"), c("o_orderstatus").alias("status"), (c("o_custkey") % 6 == 0).alias("changed"), (c("o_custkey") % 7 == 0).alias("no_hash"), F.when(c("o_orderkey") % 4 == 0, "kokoro").otherwise("xtts").alias("want"), (c("o_orderkey") % 3 == 0).alias("more"))
    short = c("more")
    integrity = F.when(short, "incomplete").when(c("failed") > 0, "failed").when(c("missing") > 0, "missing").when(c("empty") > 0, "zero_bytes").otherwise("ok")
    audio = F.when(short, "chunk_count").when(~F.contains("engines", "want"), "engine").when(c("mos") < 0.03, "mos").when(c("changed") & ~c("no_hash"), "input_hash").otherwise("reuse")
    return f.join(o, "file").select("file", "chunks", "failed", "engines", "avg_rt", "fallbacks", "seconds", integrity.alias("integrity"), ((c("status") == "F") & (c("no_hash") | ~c("changed")) & (c("missing") == 0)).alias("reuse_text"), audio.alias("reuse_audio"))


_PHASES = ("phase1", "phase2", "phase3", "phase4", "phase5")


@query("F14", sql=f"""
WITH s AS (SELECT user_id, {", ".join(f"['success', 'failed', 'running', 'pending', 'partial', 'unknown', NULL][(last_id + {i * 3}) % 7 + 1] AS p{i}" for i in range(5))} FROM ({_SIGNALS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1)
SELECT user_id, {_listed_sql(**{p: f"p{i} = 'failed'" for i, p in enumerate(_PHASES)})} AS failed, {_listed_sql(**{p: f"p{i} = 'success'" for i, p in enumerate(_PHASES)})} AS completed, {_listed_sql(**{p: f"p{i} IN ('running', 'pending', 'partial')" for i, p in enumerate(_PHASES)})} AS in_progress,
  {_listed_sql(**{p: f"p{i} IS NULL" for i, p in enumerate(_PHASES)})} AS missing, {" OR ".join(f"coalesce(p{i} = 'failed', FALSE)" for i in range(5))} AS has_errors FROM s
""")
def phase_statuses(spark, sf_dir: str) -> DataFrame:
    """Phases of the latest state by status; one without a block is missing."""
    latest = signals(spark, sf_dir).groupBy("user_id").agg(F.max_by("last_id", "day").alias("k"))
    words = F.array(*(F.lit(x) for x in ("success", "failed", "running", "pending", "partial", "unknown")), F.lit(None).cast("string"))
    p = {name: F.element_at(words, ((F.col("k") + i * 3) % 7 + 1).cast("int")) for i, name in enumerate(_PHASES)}
    of = lambda *w: listed(**{k: v.isin(*w) for k, v in p.items()})
    return latest.select("user_id", of("failed").alias("failed"), of("success").alias("completed"), of("running", "pending", "partial").alias("in_progress"), listed(**{k: v.isNull() for k, v in p.items()}).alias("missing"), (of("failed") != "").alias("has_errors"))


#: The strict score's characters that break speech.
GLYPHS = ("□", "■", "●", "◆", "▯")
_GLYPH_SQL = {f"glyph{i}": f"contains(text, '{g}')" for i, g in enumerate(GLYPHS)}


@query("B3", sql=rf"""
WITH d AS (SELECT doc_id, text, left(text, 20000) AS s FROM documents),
m AS (SELECT doc_id, text, length(text) AS n, length(s) AS k, length(regexp_replace(s, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(s, '[\x00-\x7F]', '', 'g')) AS wide, {" + ".join(f"CAST(contains(lower(s), ' {w} ') AS INT)" for w in COMMON_WORDS)} AS common,
  len(list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '')) AS words, length(regexp_replace(s, '[^.!?,;:]', '', 'g')) AS marks, len(list_filter(regexp_split_to_array(s, '[.!?]+'), lambda x: regexp_matches(x, '\S'))) AS sentences FROM d),
i AS (SELECT doc_id, n, {_listed_sql(replacement="contains(text, chr(65533))", private_use=r"regexp_matches(text, '[\x{E000}-\x{F8FF}]')", letters_low="letters * 100 < k * 65", non_ascii="wide * 100 > k * 15", common_words="common < 8", punctuation="marks * 20 < words", few_sentences="sentences < 10", **_GLYPH_SQL)} AS issues,
  100 - CASE WHEN contains(text, chr(65533)) THEN 50 ELSE 0 END - CASE WHEN regexp_matches(text, '[\x{{E000}}-\x{{F8FF}}]') THEN 50 ELSE 0 END - CASE WHEN letters * 100 < k * 65 THEN 30 WHEN letters * 100 < k * 75 THEN 10 ELSE 0 END - CASE WHEN wide * 100 > k * 15 THEN 30 WHEN wide * 100 > k * 5 THEN 10 ELSE 0 END
  - CASE WHEN common < 8 THEN 40 ELSE 0 END - CASE WHEN marks * 20 < words OR words = 0 THEN 20 ELSE 0 END - CASE WHEN sentences < 10 THEN 20 ELSE 0 END {" ".join(f"- CASE WHEN {t} THEN 30 ELSE 0 END" for t in _GLYPH_SQL.values())} AS points FROM m)
SELECT doc_id, CASE WHEN n < 100 THEN 0 ELSE greatest(0, points) / CAST(100 AS DOUBLE) END AS score, CASE WHEN n < 100 THEN 'too_short' ELSE issues END AS issues FROM i
""")
def strict_scores(spark, sf_dir: str) -> DataFrame:
    """The strict score of an extracted text, in hundredths, and its issues."""
    n = lambda p: F.regexp_count("s", F.lit(p))
    d = _docs(spark, sf_dir, "doc_id", "text", F.substring("text", 1, 20000).alias("s"))
    low = F.lower("s")
    m = d.select(
        "doc_id", F.length("text").alias("n"), F.length("s").alias("k"), n(r"\p{L}").alias("letters"), n(r"[^\x00-\x7F]").alias("wide"), sum((F.contains(low, F.lit(f" {w} ")).cast("int") for w in COMMON_WORDS), F.lit(0)).alias("common"), F.size(C.words_of(F.col("s"))).alias("words"),
        n("[.!?,;:]").alias("marks"), F.size(F.filter(F.split("s", "[.!?]+"), lambda x: x.rlike(r"\S"))).alias("sentences"), F.contains("text", F.lit("�")).alias("broken"), F.col("text").rlike(r"[\x{E000}-\x{F8FF}]").alias("private"), *(F.contains("text", F.lit(g)).alias(f"glyph{i}") for i, g in enumerate(GLYPHS)),
    )
    c = F.col
    glyphs = {f"glyph{i}": c(f"glyph{i}") for i in range(len(GLYPHS))}
    off = lambda *steps: F.coalesce(*(F.when(t, p) for t, p in steps), F.lit(0))
    points = 100 - off((c("broken"), 50)) - off((c("private"), 50)) - off((c("letters") * 100 < c("k") * 65, 30), (c("letters") * 100 < c("k") * 75, 10)) - off((c("wide") * 100 > c("k") * 15, 30), (c("wide") * 100 > c("k") * 5, 10))
    points = points - off((c("common") < 8, 40)) - off(((c("marks") * 20 < c("words")) | (c("words") == 0), 20)) - off((c("sentences") < 10, 20)) - sum((off((g, 30)) for g in glyphs.values()), F.lit(0))
    issues = listed(replacement=c("broken"), private_use=c("private"), letters_low=c("letters") * 100 < c("k") * 65, non_ascii=c("wide") * 100 > c("k") * 15, common_words=c("common") < 8, punctuation=c("marks") * 20 < c("words"), few_sentences=c("sentences") < 10, **glyphs)
    return m.select("doc_id", F.when(c("n") < 100, 0.0).otherwise(F.greatest(F.lit(0), points) / 100.0).alias("score"), F.when(c("n") < 100, "too_short").otherwise(issues).alias("issues"))


#: The report's order of endings: its auxiliaries have three more, and dialogue comes last.
_REPORT = tuple((p.replace("might|must)", "might|must|do|does|did)"), r) for p, r in quality.UNFINISHED if r != "dialogue") + ((r"\b(said|replied|asked|answered),?\s*$", "dialogue"),)


@query("B9", sql=rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN (length(t) - length(replace(t, chr(34), ''))) % 2 = 1 THEN 'quotes' {" ".join(f"WHEN regexp_matches(lower(right(t, {quality.ENDING})), '{p}') THEN '{r}'" for p, r in _REPORT)} ELSE 'complete' END AS reason FROM t
""")
def report_completeness(spark, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "doc_id", F.regexp_replace("text", quality.exact(f"^{WS}+|{WS}+$"), "").alias("t"))
    out = F.when(F.col("t") == "", "empty").when(F.regexp_count("t", F.lit('"')) % 2 == 1, "quotes")
    for p, r in _REPORT:
        out = out.when(quality.lowered(F.right("t", F.lit(quality.ENDING))).rlike(quality.exact(p)), r)
    return d.select("doc_id", out.otherwise("complete").alias("reason"))


#: Beginnings of titles in a table of contents.
TOC = r"(?i)^(?:[IVX]+\.|[0-9]+\.|Chapter [0-9]+|Contents?|Part [IVX0-9]+)"
_HEADS = ("I. Rivers", "Chapter 3", "Of stones and what they hold", "Contents", "Plain words", "12. Bells", "Part II")


@query("B17", "B18", sql=f"""
WITH h AS (SELECT user_id, {list(_HEADS)}[event_id % 7 + 1] AS title, event_id % 4 AS level, (event_id * 37) % 900 AS chars FROM events), n AS (SELECT *, (chars < 200 AND regexp_matches(title, '{TOC}')) OR (level <= 2 AND chars < 150) AS toc FROM h)
SELECT user_id, count(*) AS n, count(*) FILTER (NOT toc) AS n_real, count(*) FILTER (NOT toc AND chars > 0) AS n_valid, count(*) >= 3 AND count(*) FILTER (NOT toc) >= 3 AND count(*) FILTER (NOT toc AND chars > 0) >= 3 AS usable FROM n GROUP BY user_id
""")
def structure_usable(spark, sf_dir: str) -> DataFrame:
    """Headings without those of a table of contents, by the length of their sections, and whether enough are left."""
    title = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("event_id") % 7 + 1).cast("int"))
    h = table(spark, sf_dir, "events").select("user_id", title.alias("title"), (F.col("event_id") % 4).alias("level"), ((F.col("event_id") * 37) % 900).alias("chars"))
    real = ~(((F.col("chars") < 200) & F.col("title").rlike(TOC)) | ((F.col("level") <= 2) & (F.col("chars") < 150)))
    g = h.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(real).alias("n_real"), F.count_if(real & (F.col("chars") > 0)).alias("n_valid"))
    return g.withColumn("usable", (F.col("n") >= 3) & (F.col("n_real") >= 3) & (F.col("n_valid") >= 3))


#: Policies of rewriting and their confidences.
POLICIES = (("minimal_fix", 0.6), ("tts_stability", 0.7), ("semantic_preserve", 0.8), ("style_strict", 0.65), ("style_relaxed", 0.5))


@query("E53", sql=f"""
WITH d AS (SELECT doc_id, text, ['minimal_fix', 'tts_stability', 'semantic_preserve', 'style_strict', 'style_relaxed', 'unheard_of'][doc_id % 6 + 1] AS asked FROM documents), p AS (SELECT *, CASE WHEN asked = 'unheard_of' THEN 'minimal_fix' ELSE asked END AS policy FROM d)
SELECT doc_id, policy, CAST(CASE policy {" ".join(f"WHEN '{n}' THEN {c}" for n, c in POLICIES)} END AS DOUBLE) AS confidence, sha256(CASE policy WHEN 'tts_stability' THEN regexp_replace(replace(text, '...', '.'), '^{WS}+|{WS}+$', '', 'g') WHEN 'style_strict' THEN trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') ELSE text END) AS digest FROM p
""")
def rewrite_policies(spark, sf_dir: str) -> DataFrame:
    """Texts by the rewrite policy that is asked for; an unknown one is the minimal one."""
    known = F.create_map(*(F.lit(x) for p in POLICIES for x in p))
    asked = F.element_at(F.array(*(F.lit(n) for n, _ in POLICIES), F.lit("unheard_of")), (F.col("doc_id") % 6 + 1).cast("int"))
    d = _docs(spark, sf_dir, "doc_id", "text", F.when(known[asked].isNull(), POLICIES[0][0]).otherwise(asked).alias("policy"))
    stable = F.regexp_replace(F.replace("text", F.lit("..."), F.lit(".")), f"^{WS}+|{WS}+$", "")
    text = F.when(F.col("policy") == "tts_stability", stable).when(F.col("policy") == "style_strict", F.trim(F.regexp_replace("text", WS + "+", " "))).otherwise(F.col("text"))
    return d.select("doc_id", "policy", known[F.col("policy")].alias("confidence"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
