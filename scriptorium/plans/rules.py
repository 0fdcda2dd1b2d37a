"""Row-level text rules, names and times, each a projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.functions import quality as Q
from scriptorium.functions import scalars as S
from scriptorium.plans.sentences import SPACE, stripped
from scriptorium.sources.tables import table

_PAGE_COMMON = " + ".join(f"CAST(contains(lower(text), ' {w} ') AS INT)" for w in Q.PAGE_WORDS)
_ENDS = " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{r}'" for p, r in Q.UNFINISHED)
_NON = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text)"


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("B2", "A8", sql=rf"""
WITH w AS (SELECT doc_id, avg(CAST(length(regexp_replace(w, '\P{{L}}', '', 'g')) AS DOUBLE) / length(w)) AS r FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) < 10 THEN 0 ELSE round(greatest(0, 1.0 - CASE WHEN contains(text, chr(65533)) THEN 0.5 ELSE 0 END
  - CASE WHEN CAST(length(regexp_replace(text, '\P{{L}}', '', 'g')) AS DOUBLE) / length(text) < 0.5 THEN 0.3 ELSE 0 END - CASE WHEN {_PAGE_COMMON} < 2 THEN 0.2 ELSE 0 END), 4) END AS score,
  round(coalesce(r, 0), 4) AS alphabetic FROM documents AS d LEFT JOIN w ON d.doc_id = w.doc_id
""")
def text_page_score(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(Q.page_score(F.col("text")), 4).alias("score"), F.round(Q.alphabetic_ratio(F.col("text")), 4).alias("alphabetic"))


@query("B4", "B6", sql=rf"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, ' {{2,}}') THEN 'multiple_spaces' END, CASE WHEN {_NON} > 0.05 THEN 'non_ascii' END, CASE WHEN contains(text, 'OceanofPDF.com') THEN 'watermark' END,
  CASE WHEN regexp_matches(text, '\n{{4,}}') THEN 'excess_newlines' END) AS issues, round(CASE WHEN strlen(text) = 0 THEN 0 ELSE length(text) / strlen(text) END, 6) AS text_yield FROM documents
""")
def text_speech_ready(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", Q.speech_issues(F.col("text")).alias("issues"), F.round(Q.text_yield(F.octet_length("text"), F.length("text")), 6).alias("text_yield"))


@query("B8", sql=rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS t FROM documents), w AS (SELECT *, regexp_split_to_array(t, '[ \t\n\r\f]+') AS w FROM t),
l AS (SELECT *, regexp_extract(lower(array_to_string(list_slice(w, greatest(len(w) - 9, 1), len(w)), ' ')), '\b({"|".join(Q.RELATIVES)})\s+([\p{{L}}\p{{N}}_]+)', 2) AS next FROM w)
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN (length(t) - length(replace(t, chr(34), ''))) % 2 = 1 THEN 'quotes' {_ENDS}
  WHEN len(w) >= 5 AND next <> '' AND next NOT IN {Q.COMPLETING} AND NOT ends_with(t, '.') THEN 'clause' ELSE 'complete' END AS reason FROM l
""")
def text_completeness(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", Q.completeness(F.col("text")).alias("reason"))


@query("C23", sql=r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\s*[—–]\s*', ', ', 'g'), ';', '.'), '\.{2,}', '.', 'g'), '[!?]+([!?])', '\1', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS digest FROM documents
""")
def text_simple_punctuation(spark, sf_dir: str) -> DataFrame:
    """Dashes to commas, semicolons to points, runs of marks to the last one, white space to one space."""
    t = F.replace(F.regexp_replace("text", r"\s*[—–]\s*", ", "), F.lit(";"), F.lit("."))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.{2,}", "."), "[!?]+([!?])", "$1"), r"[ \t\n\r\f]+", " ")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.encode(F.trim(t), "UTF-8"), 256).alias("digest"))


@query("C6", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, line, regexp_matches(line, '^\s*\d+\s*$') AS digits, regexp_matches(line, '^\s*[-=_]{3,}\s*$') AS rule, regexp_matches(line, '(?i)^\s*page \d+( of \d+)?\s*$') AS page, regexp_matches(line, '^\d{1,4}\s+[A-Z]') AS lead FROM l)
SELECT doc_id, count(*) FILTER (digits OR rule OR page) AS n_junk, count(*) FILTER (NOT (digits OR rule OR page)) AS n_kept, count(*) FILTER (lead AND NOT (digits OR rule OR page)) AS n_stripped FROM m GROUP BY doc_id
""")
def text_junk_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of digits, rules or page marks go; a leading page number before a capital is stripped."""
    lines = F.split("text", "\n")
    junk = lambda x: x.rlike(r"^\s*\d+\s*$") | x.rlike(r"^\s*[-=_]{3,}\s*$") | x.rlike(r"(?i)^\s*page \d+( of \d+)?\s*$")
    n = lambda test: F.size(F.filter(lines, test)).cast("long")
    return _docs(spark, sf_dir).select("doc_id", n(junk).alias("n_junk"), n(lambda x: ~junk(x)).alias("n_kept"), n(lambda x: ~junk(x) & x.rlike(r"^\d{1,4}\s+[A-Z]")).alias("n_stripped"))


@query("C24", sql=r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS digest FROM documents
""")
def text_wer_form(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.encode(S.wer_text(F.col("text")), "UTF-8"), 256).alias("digest"))


@query("C25", "C26", "C29", sql=r"""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS file_id,
  regexp_replace(regexp_replace(translate(lower(url), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, replace(lower(url), ' ', '_') AS voice_id FROM pages
""")
def name_ids(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.file_id(F.col("url")).alias("file_id"), S.slug(F.col("url")).alias("slug"), F.replace(F.lower("url"), F.lit(" "), F.lit("_")).alias("voice_id"))


@query("A2", "C27", "C28", sql=r"""
WITH p AS (SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '_chunk_' WHEN 1 THEN '/chunk-' WHEN 2 THEN '-' ELSE '/part' END || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.HTM' WHEN 1 THEN '.epub' ELSE '.md' END AS path FROM documents),
f AS (SELECT *, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, CAST(nullif(regexp_extract(lower(path), 'chunk[_-]?(\d+)', 1), '') AS BIGINT) AS n FROM p)
SELECT doc_id, CASE WHEN ext IN ('pdf', 'epub', 'docx') THEN ext WHEN ext IN ('html', 'htm') THEN 'html' ELSE 'txt' END AS format, 'chunk_' || CASE WHEN coalesce(n, doc_id) < 1000 THEN lpad(CAST(coalesce(n, doc_id) AS VARCHAR), 4, '0') ELSE CAST(coalesce(n, doc_id) AS VARCHAR) END AS chunk_id,
  CAST(coalesce(nullif(regexp_extract(path, '_chunk_(\d+)', 1), ''), nullif(regexp_extract(path, 'chunk_(\d+)', 1), ''), nullif(regexp_extract(path, '(\d+)', 1), ''), '0') AS BIGINT) AS chunk_number FROM f
""")
def path_parts(spark, sf_dir: str) -> DataFrame:
    """Format, chunk id and chunk number of made-up paths."""
    k = F.col("doc_id")
    mark = F.when(k % 4 == 0, "_chunk_").when(k % 4 == 1, "/chunk-").when(k % 4 == 2, "-").otherwise("/part")
    path = F.concat("source", mark, k.cast("string"), F.when(k % 3 == 0, ".HTM").when(k % 3 == 1, ".epub").otherwise(".md"))
    return _docs(spark, sf_dir).select("doc_id", S.file_format(path).alias("format"), S.chunk_id(path, k).alias("chunk_id"), S.chunk_number(path).alias("chunk_number"))


def _clock_sql(n: str, mark: str, places: int, hours: int) -> str:
    unit = 10**places
    part = lambda x, w: f"CASE WHEN length(CAST({x} AS VARCHAR)) < {w} THEN lpad(CAST({x} AS VARCHAR), {w}, '0') ELSE CAST({x} AS VARCHAR) END"
    s = f"({n} // {unit})"
    return " || ".join((part(f"({s} // 3600)", hours), "':'", part(f"({s} // 60 % 60)", 2), "':'", part(f"({s} % 60)", 2), f"'{mark}'", part(f"({n} % {unit})", places)))


_MS, _CS, _RMS = "CAST(floor(s * 1000) AS BIGINT)", "CAST(floor(s * 100) AS BIGINT)", "CAST(round(s * 1000) AS BIGINT)"


@query("C30", "C31", "C32", "C33", sql=f"""
SELECT event_id, {_clock_sql(_MS, ",", 3, 2)} AS srt, {_clock_sql(_MS, ".", 3, 2)} AS vtt, {_clock_sql(_CS, ".", 2, 1)} AS ass, {_clock_sql(_RMS, ",", 3, 2)} AS rounded FROM (SELECT event_id, value * event_id / 7.0 AS s FROM events)
""")
def time_formats(spark, sf_dir: str) -> DataFrame:
    s = F.col("value") * F.col("event_id") / 7.0
    return table(spark, sf_dir, "events").select("event_id", S.clock(s).alias("srt"), S.clock(s, ".").alias("vtt"), S.clock(s, ".", 2, 1).alias("ass"), S.clock(s, rounded=True).alias("rounded"))


@query("C34", "N7", "N8", sql=r"""
SELECT event_id, coalesce(epoch(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP)), 0.0) AS seconds, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS kind FROM events
""")
def loose_values(spark, sf_dir: str) -> DataFrame:
    when = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select("event_id", S.iso_seconds(when).alias("seconds"), S.safe_number(F.get_json_object("props", "$.k")).alias("k"), S.safe_number(F.col("event_type")).alias("kind"))


_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.STATUS_ALIASES.items())


@query("N4", sql=f"""
WITH s AS (SELECT event_id, lower(CASE event_type WHEN 'view' THEN 'Complete' WHEN 'click' THEN 'in_progress' WHEN 'signup' THEN 'Failed' WHEN 'error' THEN 'weird' END) AS v FROM events)
SELECT event_id, CASE WHEN v IN {S.STATUSES} THEN v ELSE CASE v {_ALIASES} ELSE 'pending' END END AS status FROM s
""")
def status_coerce(spark, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "view", "Complete").when(kind == "click", "in_progress").when(kind == "signup", "Failed").when(kind == "error", "weird")
    return table(spark, sf_dir, "events").select("event_id", S.status(raw).alias("status"))


@query("D22", sql="""
WITH s AS (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(length(text) - 1, 0) AS BIGINT), 2500)) AS pos FROM documents)
SELECT doc_id, pos, length(substr(text, pos + 1, 3000)) AS n, md5(substr(text, pos + 1, 3000)) AS digest FROM s
""")
def overlapping_segments(spark, sf_dir: str) -> DataFrame:
    """Windows of 3,000 characters, each 2,500 after the one before."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(2500)))
    part = F.substring(F.col("text"), F.col("pos") + 1, F.lit(3000))
    return _docs(spark, sf_dir).select("doc_id", "text", at.alias("pos")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length(part).cast("long").alias("n"), F.md5(F.encode(part, "UTF-8")).alias("digest"))


@query(sql=r"""
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '')) AS n_empty, len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 20)) AS n_short,
  len(list_filter(regexp_split_to_array(text, '\n\n+'), lambda x: trim(x, ' ') <> '')) AS n_paragraphs, length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS n_marks, length(text) - length(replace(text, chr(65533), '')) AS n_broken FROM documents
""")
def text_file_stats(spark, sf_dir: str) -> DataFrame:
    lines, size = F.split("text", "\n"), lambda a: F.size(a).cast("long")
    return _docs(spark, sf_dir).select(
        "doc_id", size(lines).alias("n_lines"), size(F.filter(lines, lambda x: F.trim(x) == "")).alias("n_empty"), size(F.filter(lines, lambda x: F.length(x) < 20)).alias("n_short"),
        size(F.filter(F.split("text", r"\n\n+"), lambda x: F.trim(x) != "")).alias("n_paragraphs"), F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_marks"), F.regexp_count("text", F.lit("�")).cast("long").alias("n_broken"),
    )


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query("F36", sql=rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, regexp_split_to_array(text, '{_LINE_END}') AS a, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, text, w, length(text) AS n, CASE WHEN a[len(a)] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END AS l FROM p),
s AS (SELECT *, list_transform(l, lambda x: length(regexp_replace(x, '^{SPACE}+|{SPACE}+\z', '', 'g'))) AS z, length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) AS odd FROM l)
SELECT doc_id, n AS size, len(l) AS n_lines, len(w) AS n_words, CASE WHEN len(l) > 0 THEN round(list_sum(list_transform(l, lambda x: length(x))) / len(l), 4) ELSE 0 END AS mean_line, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 4) ELSE 0 END AS mean_word,
  len(regexp_extract_all(text, ' {{2,}}')) AS n_spaces, odd AS n_odd, CASE WHEN n > 0 THEN round(odd / n * 100, 4) ELSE 0 END AS odd_pct, len(list_filter(z, lambda x: x = 0)) AS n_empty, CASE WHEN len(l) > 0 THEN round(len(list_filter(z, lambda x: x = 0)) / len(l) * 100, 4) ELSE 0 END AS empty_pct,
  len(list_filter(z, lambda x: x > 0 AND x < 10)) AS n_short, len(regexp_extract_all(text, '[.!?]+{SPACE}+')) + 1 AS n_sentences, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]'))) AS n_paragraphs,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\p{{Nd}}+\z'))) AS n_page_numbers, len(regexp_extract_all(text, '(?i)OceanofPDF\.com')) AS n_ocean FROM s
""")
def text_file_analysis(spark, sf_dir: str) -> DataFrame:
    """A text's size, lines, words, average lengths, odd characters, structure and page numbers."""
    size, count = (lambda a: F.size(a).cast("long")), lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    total = lambda a: F.aggregate(F.transform(a, lambda x: F.length(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x, n: F.when(n > 0, F.round(x / n, 4)).otherwise(0.0)
    p = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("a", F.split("text", _LINE_END)).withColumn("w", F.filter(F.split("text", SPACE + "+"), lambda x: x != ""))
    p = p.withColumn("l", F.when(F.element_at("a", -1) == "", F.slice("a", F.lit(1), F.size("a") - 1)).otherwise(F.col("a"))).withColumn("z", F.transform("l", lambda x: F.length(stripped(x))))
    empty, odd = size(F.filter("z", lambda x: x == 0)), count(r"[^\x00-\x7f]")
    return p.select(
        "doc_id", F.length("text").cast("long").alias("size"), size("l").alias("n_lines"), size("w").alias("n_words"), part(total("l"), F.size("l")).alias("mean_line"), part(total("w"), F.size("w")).alias("mean_word"),
        count(" {2,}").alias("n_spaces"), odd.alias("n_odd"), part(odd * 100, F.length("text")).alias("odd_pct"), empty.alias("n_empty"), part(empty * 100, F.size("l")).alias("empty_pct"),
        size(F.filter("z", lambda x: (x > 0) & (x < 10))).alias("n_short"), (count(rf"[.!?]+{SPACE}+") + 1).alias("n_sentences"), size(F.filter(F.split("text", "\n\n"), lambda x: stripped(x) != "")).alias("n_paragraphs"),
        size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\p{Nd}+\z"))).alias("n_page_numbers"), count(r"(?i)OceanofPDF\.com").alias("n_ocean"),
    )


@query("D17", "D18", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS pos, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM l),
h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*(part|book|volume)\s+[0-9ivxlc]+') THEN 0 WHEN regexp_matches(line, '(?i)^\s*chapter\s+[0-9ivxlc]+') THEN 1 WHEN regexp_matches(line, '(?i)^\s*section\s+[0-9]+') THEN 2
  WHEN length(line) BETWEEN 5 AND 60 AND contains(line, ' ') AND upper(line) = line AND lower(line) <> line THEN 2 END AS level FROM o)
SELECT doc_id, CAST(pos AS BIGINT) AS start, CAST(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), total) AS BIGINT) AS stop, level FROM h WHERE level IS NOT NULL
""")
def heading_sections(spark, sf_dir: str) -> DataFrame:
    """Headings by form of line, and the section that each begins; lines are placed by a running sum over their text."""
    level = F.when(F.col("line").rlike(r"(?i)^\s*(part|book|volume)\s+[0-9ivxlc]+"), 0).when(F.col("line").rlike(r"(?i)^\s*chapter\s+[0-9ivxlc]+"), 1).when(F.col("line").rlike(r"(?i)^\s*section\s+[0-9]+"), 2)
    caps = F.length("line").between(5, 60) & F.contains("line", F.lit(" ")) & (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("total"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    placed = lines.withColumn("at", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).withColumn("level", level.when(caps, 2)).where("level is not null")
    return placed.select("doc_id", F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("total")).cast("long").alias("stop"), "level")
