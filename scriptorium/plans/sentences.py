"""Sentences, chunks and repetition. Each text is one row throughout: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.functions.text import bound
from scriptorium.sources.tables import table

#: Abbreviations and what they are read as, in order.
ABBREVIATIONS = (
    (r"\bMr\b\.?", "Mister"), (r"\bMrs\b\.?", "Missus"), (r"\bDr\b\.?", "Doctor"), (r"\bProf\b\.?", "Professor"), (r"\bSt\b\.", "Saint"), (r"\bGen\b\.?", "General"),
    (r"\bSgt\b\.?", "Sergeant"), (r"\bLt\b\.?", "Lieutenant"), (r"\bCapt\b\.?", "Captain"), (r"\bCol\b\.?", "Colonel"), (r"\betc\b\.?", "et cetera"), (r"\be\.g\b\.?", "for example"),
    (r"\bi\.e\b\.?", "that is"), (r"\bvs\b\.?", "versus"), (r"\bw/", "with"), (r"\bw/o\b", "without"), (r"\b&\b", "and"),
)
#: Traces that extraction leaves in a text.
ARTIFACTS = (r"OceanofPDF\.com", r"Downloaded from.*\.com", r"Visit us at.*\.com")
#: The failure category that a log's words point to, in order, and its confidence.
FAILURES = (
    ("oom", 0.8, ("out of memory", "memoryerror", "cuda oom", "killed")), ("timeout", 0.7, ("timeout", "timed out", "exceeded", "too slow")), ("truncation", 0.8, ("truncat", "text too long", "max", "exceeded limit")),
    ("quality", 0.6, ("silence", "no audio", "corrupt", "invalid", "empty")), ("schema", 0.7, ("pydantic", "validationerror", "schema", "missing key")),
    ("io", 0.8, ("filenotfounderror", "permissionerror", "no such file", "cannot open", "disk full", "ioerror", "permission denied")),
)

#: White space of the reference's patterns, as a class that Java and RE2 read alike; ends of a text made of it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = rf"^{SPACE}+|{SPACE}+\z"
#: Fixed value: the reference's pace of speech.
CHARS_PER_MINUTE = 2700


def sentences(text) -> Column:
    """Pieces between a sentence mark and the white space after it, trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _size(a) -> Column:
    return F.size(a).cast("long")


def _digest(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def fold_sql(text: str, rules, flags: str = "gi") -> str:
    for pattern, new in rules:
        text = f"regexp_replace({text}, '{pattern}', '{new}', '{flags}')"
    return text


@query("D1", sql=f"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents)
SELECT doc_id, count(*) AS n, min(length(s)) AS shortest, max(length(s)) AS longest, round(avg(length(s)), 4) AS mean, count(*) FILTER (length(s) > 250) AS n_long, round(max(length(s)) / 1050.0 * 60, 4) AS max_seconds FROM s GROUP BY doc_id
""")
def sentence_metrics(spark, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", F.transform(sentences(F.col("text")), lambda x: F.length(x)).alias("n")).where(F.size("n") > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select(
        "doc_id", _size("n").alias("n"), F.array_min("n").cast("long").alias("shortest"), F.array_max("n").cast("long").alias("longest"), F.round(total / F.size("n"), 4).alias("mean"),
        _size(F.filter("n", lambda x: x > 250)).alias("n_long"), F.round(F.array_max("n") / 1050.0 * 60, 4).alias("max_seconds"),
    )


@query("D23", sql=rf"""
WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents), m AS (SELECT doc_id, length(s) AS n, len(list_filter(regexp_split_to_array(s, '{SPACE}+'), lambda x: x <> '')) AS w, length(s) / {CHARS_PER_MINUTE} * 60 AS t FROM s)
SELECT doc_id, count(*) AS n, round(avg(n), 4) AS mean_chars, round(avg(w), 4) AS mean_words, CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(n) * 600000 // ({CHARS_PER_MINUTE} * count(*)) AS BIGINT) / CAST(10000 AS DOUBLE) AS mean_s, round(max(t), 4) AS longest_s, round(min(t), 4) AS shortest_s,
  count(*) FILTER (n <= 250) AS soft, count(*) FILTER (n > 250 AND n <= 300) AS hard, count(*) FILTER (n > 300 AND n <= 400) AS emergency, count(*) FILTER (n > 400) AS exceeding FROM m GROUP BY doc_id
""")
def chunk_metrics(spark, sf_dir: str) -> DataFrame:
    """Characters, words, seconds and disjoint bands of size of a text's sentences, which stand for chunks. The mean of seconds is
    cut off behind four places, as whole numbers are divided."""
    total = lambda a, f: F.aggregate(F.transform(a, lambda x: x[f]), F.lit(0).cast("long"), lambda s, x: s + x)
    part = F.transform(sentences(F.col("text")), lambda x: F.struct(F.length(x).alias("n"), F.size(F.filter(F.split(x, SPACE + "+"), lambda w: w != "")).alias("w")))
    m = _docs(spark, sf_dir).select("doc_id", part.alias("m")).where(F.size("m") > 0)
    n, seconds = F.size("m"), lambda x: F.round(x / CHARS_PER_MINUTE * 60, 4)
    band = lambda lo, hi: _size(F.filter("m", lambda x: (x["n"] > lo) & (x["n"] <= hi)))
    return m.select(
        "doc_id", n.cast("long").alias("n"), F.round(total("m", "n") / n, 4).alias("mean_chars"), F.round(total("m", "w") / n, 4).alias("mean_words"), total("m", "w").alias("n_words"), (F.call_function("div", total("m", "n") * 600_000, n.cast("long") * CHARS_PER_MINUTE) / 10_000.0).alias("mean_s"),
        seconds(F.array_max("m.n")).alias("longest_s"), seconds(F.array_min("m.n")).alias("shortest_s"), band(0, 250).alias("soft"), band(250, 300).alias("hard"), band(300, 400).alias("emergency"), _size(F.filter("m", lambda x: x["n"] > 400)).alias("exceeding"),
    )


@query("D3", sql="""
SELECT doc_id, len(string_split(text, ';')) AS n_parts, sha256(array_to_string(list_filter(list_transform(string_split(replace(text, ';', ';' || chr(1)), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS digest FROM documents
""")
def semicolon_parts(spark, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "(?<=;)"), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(spark, sf_dir).select("doc_id", _size(F.split("text", ";")).alias("n_parts"), _digest(F.array_join(parts, "\n")).alias("digest"))


@query("C3", sql=f"SELECT doc_id, sha256({fold_sql('text', [(p, '') for p in ARTIFACTS])}) AS digest FROM documents")
def text_artifacts(spark, sf_dir: str) -> DataFrame:
    t = F.col("text")
    for p in ARTIFACTS:
        t = F.regexp_replace(t, f"(?i){p}", "")
    return _docs(spark, sf_dir).select("doc_id", _digest(t).alias("digest"))


def abbreviations(text) -> Column:
    """Abbreviations spelled out, by the rules in order; word boundaries are Unicode's."""
    for p, new in ABBREVIATIONS:
        text = F.regexp_replace(text, f"(?iU){p}", new)
    return text


@query("C35")
def text_abbreviations(spark, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB's word boundaries are ASCII's. Tests compare it with Python's regular expressions."""
    t = abbreviations(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", _digest(t).alias("digest"))


def dropped_repeats(items, least: int) -> Column:
    """Items that equal the one before them, both of ``least`` characters or more."""
    return F.filter(F.arrays_zip(items.alias("x"), F.concat(F.array(F.lit(None).cast("string")), F.slice(items, F.lit(1), F.size(items) - 1)).alias("y")), lambda p: (F.length(p["x"]) >= least) & (p["x"] == p["y"]))


def _consecutive_sql(mark: str, least: int) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, {mark})) AS x, generate_subscripts(string_split(text, {mark}), 1) AS i FROM documents), p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM l)
SELECT doc_id, count(*) AS n, count(*) FILTER (length(x) >= {least} AND x = y) AS n_dropped, count(*) FILTER (x = y) AS n_equal FROM p GROUP BY doc_id
"""


def _consecutive(spark, sf_dir: str, mark: str, least: int) -> DataFrame:
    items = _docs(spark, sf_dir).select("doc_id", F.split("text", mark).alias("a"))
    return items.select("doc_id", _size("a").alias("n"), _size(dropped_repeats(F.col("a"), least)).alias("n_dropped"), _size(dropped_repeats(F.col("a"), 0)).alias("n_equal"))


@query("G2", "G4", sql=_consecutive_sql("chr(10) || chr(10)", 20))
def dedupe_paragraphs(spark, sf_dir: str) -> DataFrame:
    return _consecutive(spark, sf_dir, "\n\n", 20)


@query("G3", "G4", sql=_consecutive_sql("chr(10)", 5))
def dedupe_text_lines(spark, sf_dir: str) -> DataFrame:
    return _consecutive(spark, sf_dir, "\n", 5)


@query("G5", sql=r"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+[ \t\n\r\f]*')) AS s FROM documents), k AS (SELECT doc_id, trim(regexp_replace(lower(s), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS k FROM s)
SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT k) AS n_removed FROM k WHERE k <> '' GROUP BY doc_id
""")
def dedupe_sentences(spark, sf_dir: str) -> DataFrame:
    """Sentences of a text and how many repeat an earlier one, case and white space aside."""
    keys = F.filter(F.transform(F.split("text", r"[.!?]+[ \t\n\r\f]*"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[ \t\n\r\f]+", " "))), lambda k: k != "")
    d = _docs(spark, sf_dir).select("doc_id", keys.alias("k")).where(F.size("k") > 0)
    return d.select("doc_id", _size("k").alias("n"), (F.size("k") - F.size(F.array_distinct("k"))).cast("long").alias("n_removed"))


@query("W23", sql=r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM x), r AS (SELECT doc_id, x, g, count(*) AS n FROM g WHERE length(x) > 2 GROUP BY ALL)
SELECT doc_id, max(n) AS longest_run, count(*) FILTER (n >= 3) AS n_runs FROM r GROUP BY doc_id
""")
def word_runs(spark, sf_dir: str) -> DataFrame:
    """Longest run of one word, and the number of runs of three or more, by one fold over a text's words."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda x: x != "")
    zero = lambda: F.lit(0).cast("long")
    state = F.struct(F.lit("").alias("last"), zero().alias("run"), zero().alias("best"), zero().alias("runs"))

    def step(s, w):
        run = F.when(w == s["last"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
        counts = F.length(w) > 2
        return F.struct(w.alias("last"), run.alias("run"), F.when(counts, F.greatest(s["best"], run)).otherwise(s["best"]).alias("best"), (s["runs"] + F.when(counts & (run == 3), 1).otherwise(0).cast("long")).alias("runs"))

    folded = _docs(spark, sf_dir).select("doc_id", F.aggregate(words, state, step).alias("s"))
    return folded.where("s.best > 0").select("doc_id", F.col("s.best").alias("longest_run"), F.col("s.runs").alias("n_runs"))


def stripped(text) -> Column:
    return F.regexp_replace(text, _ENDS, "")


@query("G6", sql=rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '{_ENDS}', '', 'g'), '([.!?]){SPACE}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '{_ENDS}', '', 'g')), lambda x: length(x) >= 20) AS a FROM t),
e AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM s),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(s), '{SPACE}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), '{_ENDS}', '', 'g') AS k FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS nth FROM k),
d AS (SELECT doc_id, count(*) AS n, count(DISTINCT k) AS u, sha256(string_agg(s, ' ' ORDER BY i) FILTER (nth = 1)) AS digest FROM o GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '') AS w FROM t), x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM x), r AS (SELECT doc_id, x, g, count(*) AS n FROM g WHERE length(x) > 2 GROUP BY ALL), b AS (SELECT doc_id, max(n) AS run FROM r GROUP BY doc_id),
j AS (SELECT t.doc_id, coalesce(n, 0) AS n, coalesce(u, 0) AS u, digest, run, CASE WHEN u < n THEN 'sentence_duplication' WHEN n >= 2 AND run >= 3 THEN 'word_repetition' END AS issue FROM t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN b ON t.doc_id = b.doc_id)
SELECT doc_id, issue, n AS n_sentences, n - u AS n_duplicates, CASE WHEN u < n THEN round(1 - u / n, 6) ELSE 0 END AS ratio, CASE WHEN issue = 'word_repetition' THEN run ELSE 0 END AS run, CASE WHEN u < n THEN digest END AS deduped FROM j
""")
def text_repetition(spark, sf_dir: str) -> DataFrame:
    """Sentences of 20 characters or more that repeat an earlier one, case, white space and punctuation aside, and the text
    without them; where none does and there are two or more, the longest run of one word, if of three or more."""
    key = lambda x: stripped(F.regexp_replace(F.regexp_replace(F.lower(x), SPACE + "+", " "), r"[^\p{L}\p{N}_ ]", ""))
    text = F.coalesce("text", F.lit(""))
    found = F.filter(F.transform(F.split(stripped(text), rf"(?<=[.!?]){SPACE}+(?=[A-Z])"), stripped), lambda x: F.length(x) >= 20)

    def judged(a):
        n, u = _size(a), _size(F.array_distinct(a["k"]))
        first = F.filter(a, lambda x, i: F.array_position(a["k"], x["k"]) == i + 1)
        return F.struct(n.alias("n"), u.alias("u"), F.when(u < n, _digest(F.array_join(first["s"], " "))).alias("deduped"))

    zero = lambda: F.lit(0).cast("long")

    def step(s, w):
        run = F.when(w == s["last"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(w.alias("last"), run.alias("run"), F.when(F.length(w) > 2, F.greatest(s["best"], run)).otherwise(s["best"]).alias("best"))

    words = F.filter(F.split(F.lower(text), SPACE + "+"), lambda x: x != "")
    best = F.aggregate(words, F.struct(F.lit("").alias("last"), zero().alias("run"), zero().alias("best")), step)["best"]
    # the one-element array binds the sentences to a variable, as in phrase_repeats
    bound = F.transform(F.array(F.transform(found, lambda x: F.struct(x.alias("s"), key(x).alias("k")))), judged)
    d = _docs(spark, sf_dir).select("doc_id", F.element_at(bound, 1).alias("j"), best.alias("best")).select("doc_id", "j.n", "j.u", "j.deduped", "best")
    issue = F.when(F.col("u") < F.col("n"), "sentence_duplication").when((F.col("n") >= 2) & (F.col("best") >= 3), "word_repetition")
    return d.select(
        "doc_id", issue.alias("issue"), F.col("n").alias("n_sentences"), (F.col("n") - F.col("u")).alias("n_duplicates"), F.when(F.col("u") < F.col("n"), F.round(1 - F.col("u") / F.col("n"), 6)).otherwise(0.0).alias("ratio"),
        F.when(issue == "word_repetition", F.col("best")).otherwise(0).alias("run"), "deduped",
    )


def packed(items, soft: int, hard: int) -> Column:
    """Greedy chunks of sentences: up to ``soft`` characters, on to ``hard`` while the candidate ends in no closing mark."""

    def step(s, x):
        both = F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x))
        fits = (F.length(both) <= soft) | ((F.length(both) <= hard) & ~F.right(both, F.lit(1)).isin(".", "!", "?", '"', "'"))
        done = F.when(fits | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(done.alias("done"), F.when(fits, both).otherwise(x).alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(items, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


_PACKED = f"""
WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES} AS a FROM documents),
f AS (SELECT doc_id, 0 AS i, '' AS now, CAST(NULL AS VARCHAR) AS done FROM s
 UNION ALL SELECT doc_id, i, CASE WHEN fits THEN cand ELSE x END, CASE WHEN fits OR now = '' THEN NULL ELSE now END FROM (
  SELECT *, length(cand) <= 450 OR (length(cand) <= 500 AND right(cand, 1) NOT IN ('.', '!', '?', '"', '''')) AS fits FROM (
   SELECT f.doc_id, f.i + 1 AS i, f.now, s.a[f.i + 1] AS x, CASE WHEN f.now = '' THEN s.a[f.i + 1] ELSE f.now || ' ' || s.a[f.i + 1] END AS cand FROM f JOIN s ON f.doc_id = s.doc_id WHERE f.i < len(s.a)))),
c AS (SELECT doc_id, i, done AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT f.doc_id, 1000000000, now FROM f JOIN s ON f.doc_id = s.doc_id WHERE f.i = len(s.a) AND now <> '')"""


@query(sql=f"""{_PACKED}
SELECT doc_id, count(*) AS n_chunks, max(length(chunk)) AS longest, sha256(string_agg(chunk, chr(10) ORDER BY i)) AS digest FROM c GROUP BY doc_id
""")
def greedy_chunks(spark, sf_dir: str) -> DataFrame:
    """The first half of D11: chunks as packed."""
    d = _docs(spark, sf_dir).select("doc_id", packed(sentences(F.col("text")), 450, 500).alias("c")).where(F.size("c") > 0)
    return d.select("doc_id", _size("c").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest"), _digest(F.array_join("c", "\n")).alias("digest"))


def balanced(chunks) -> Column:
    """Chunks of which one with an odd number of double quotes is joined to its successor; what is joined is not looked at again."""

    def step(s, x):
        odd = F.regexp_count(x, F.lit('"')) % 2 == 1
        one = F.when(s["held"].isNotNull(), F.concat(s["held"], F.lit(" "), x)).when(~odd, x)
        return F.struct(F.when(one.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(one))).alias("done"), F.when(one.isNull(), x).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))
    return F.aggregate(chunks, start, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


@query("D11", sql=f"""
{_PACKED},
k AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, (length(chunk) - length(replace(chunk, '"', ''))) % 2 = 1 AS odd FROM c),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, odd ORDER BY k) AS run FROM k),
o AS (SELECT *, odd AND row_number() OVER (PARTITION BY doc_id, odd, run ORDER BY k) % 2 = 1 AS opens FROM r),
l AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY k), false) AS joined FROM o),
g AS (SELECT *, count(*) FILTER (NOT joined) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM l),
b AS (SELECT doc_id, g, string_agg(chunk, ' ' ORDER BY k) AS chunk FROM g GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_chunks, max(length(chunk)) AS longest, sha256(string_agg(chunk, chr(10) ORDER BY g)) AS digest FROM b GROUP BY doc_id
""")
def balanced_chunks(spark, sf_dir: str) -> DataFrame:
    p = _docs(spark, sf_dir).select("doc_id", packed(sentences(F.col("text")), 450, 500).alias("p")).where(F.size("p") > 0)
    d = p.select("doc_id", balanced(F.col("p")).alias("c"))
    return d.select("doc_id", _size("c").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest"), _digest(F.array_join("c", "\n")).alias("digest"))


@query("E11", "F20", sql="""
SELECT CASE """ + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, _, words in FAILURES) + """ ELSE 'unknown' END AS category, count(*) AS n FROM conversations GROUP BY 1
""")
def failure_categories(spark, sf_dir: str) -> DataFrame:
    """Messages by the first failure category whose words they hold."""
    low = F.lower("text")
    out = F.when(F.lit(False), F.lit(""))
    for name, _, words in FAILURES:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = out.when(test, name)
    return table(spark, sf_dir, "conversations").groupBy(out.otherwise("unknown").alias("category")).agg(F.count("*").alias("n"))


@query("H5", sql=r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 8)), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n_phrases, max(n) AS most, max(n) || 'x_4words' AS label FROM c WHERE n >= 3 GROUP BY doc_id
""")
def phrase_repeats(spark, sf_dir: str) -> DataFrame:
    """Four-word phrases that occur three times or more in a text of eight words or more; whenever a longer phrase does, its
    first four words do too, so the label is of four words. Phrases are hashed and the hashes sorted; only phrases whose hash
    comes three times are written out, sorted and counted. A text is one row: no shuffle."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda x: x != "")
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 4), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(4))))
    thrice = lambda s: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 3), lambda i: F.when(F.get(s, i) == F.get(s, i + 2), F.get(s, i))), lambda x: x.isNotNull()))
    written = lambda w, h, r: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, F.get(h, i))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(4)), " ")))
    # binding an array to a lambda's variable keeps it from being built anew for each use
    repeated = lambda w, h: bound(bound(F.sort_array(h), thrice), lambda r: F.when(F.size(r) > 0, written(w, h, r)))
    phrases = bound(words, lambda w: F.when(F.size(w) >= 8, bound(hashes(w), lambda h: repeated(w, h))))
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce(phrases, F.array().cast("array<string>")).alias("g"))
    zero = lambda: F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), zero().alias("run"), zero().alias("n"), zero().alias("most"))

    def step(s, g):
        run = F.when(g == s["last"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(g.alias("last"), run.alias("run"), (s["n"] + (run == 3).cast("long")).alias("n"), F.greatest(s["most"], run).alias("most"))

    folded = d.select("doc_id", F.aggregate("g", start, step).alias("s")).where("s.n > 0")
    return folded.select("doc_id", F.col("s.n").alias("n_phrases"), F.col("s.most").alias("most"), F.concat(F.col("s.most").cast("string"), F.lit("x_4words")).alias("label"))


@query("H3", "B14", sql=r"""
WITH p AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\x00-\x7F]', '', 'g') AS a, regexp_replace(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[^\x00-\x7F]', '', 'g') AS b FROM conversations),
e AS (SELECT conv_id, turn, least(1, CAST(levenshtein(a, b) AS DOUBLE) / greatest(1, len(list_filter(regexp_split_to_array(a, '[ \t\n\r\f]+'), lambda x: x <> '')))) AS wer FROM p WHERE b IS NOT NULL AND a IS NOT NULL)
SELECT conv_id, turn, round(wer, 4) AS wer, CASE WHEN wer < .2 THEN 'pass' WHEN wer > .4 THEN 'switch_engine' ELSE 'rewrite' END AS advice FROM e
""")
def turn_distance(spark, sf_dir: str) -> DataFrame:
    """Character distance of a turn's ASCII text to the next one's over its words, one at most, and the advice for it."""
    ascii_ = lambda c: F.regexp_replace(F.lower(c), r"[^\x00-\x7F]", "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", ascii_("text").alias("a"), ascii_(F.lead("text").over(w)).alias("b")).where("a is not null and b is not null")
    words = F.size(F.filter(F.split("a", r"[ \t\n\r\f]+"), lambda x: x != ""))
    wer = F.least(F.lit(1.0), F.levenshtein("a", "b") / F.greatest(words, F.lit(1)))
    return p.select("conv_id", "turn", F.round(wer, 4).alias("wer"), F.when(wer < 0.2, "pass").when(wer > 0.4, "switch_engine").otherwise("rewrite").alias("advice"))
