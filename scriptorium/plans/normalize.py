"""Normalizers of text for speech, each over whole documents; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import spoken
from scriptorium.functions.numbers import int_words, int_words_sql, ordinal, ordinal_sql
from scriptorium.plans.sentences import abbreviations
from scriptorium.sources.tables import table


def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _changed(spark, sf_dir: str, new: Column) -> DataFrame:
    """Length and digest of each new text, and whether it differs."""
    d = _docs(spark, sf_dir).select("doc_id", "text", new.alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), (F.col("t") != F.col("text")).alias("changed"), _digest(F.col("t")).alias("digest"))


def _changed_sql(new: str) -> str:
    return f"WITH n AS (SELECT doc_id, text, {new} AS t FROM documents) SELECT doc_id, length(t) AS n_chars, t <> text AS changed, sha256(t) AS digest FROM n"


@query("C2")
def text_unicode_fold(spark, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no NFKC. Tests compare it with Python's."""
    return _changed(spark, sf_dir, spoken.unicode_fold(F.col("text")))


@query("C5")
def text_spoken(spark, sf_dir: str) -> DataFrame:
    """The first normalizer with its lengths; no SQL for NFKC, tests compare it with Python's steps."""
    d = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("original_length"), spoken.spoken_v1(F.col("text")).alias("t"))
    n = F.length("t").cast("long")
    return d.select("doc_id", "original_length", n.alias("final_length"), (n - F.col("original_length")).alias("size_change"), _digest(F.col("t")).alias("digest"))


@query("C7", sql=None)
def text_ocr_cleaned(spark, sf_dir: str) -> DataFrame:
    """No SQL: the rules on single letters overlap, which RE2's word boundaries read otherwise. Tests compare it with Python's."""
    return _changed(spark, sf_dir, spoken.ocr_cleaned(F.col("text")))


@query("C8", sql=_changed_sql(spoken.heading_numbers_sql("text")))
def text_heading_numbers(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.heading_numbers(F.col("text")))


@query("C9", sql=r"""
WITH s AS (SELECT doc_id, text, string_split(text, '[') AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS n FROM s),
m AS (SELECT *, i > 1 AND regexp_matches(x, CASE WHEN i = n THEN '\A[0-9]+\][^\n]+\n?\z' ELSE '\A[0-9]+\][^\n]+\z' END) AND (i = n OR regexp_matches(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '\A[0-9]+\]')) AS is_note FROM e),
f AS (SELECT *, is_note AND trim(regexp_extract(x, '\A[0-9]+\]([^\n]+)', 1), ' ') <> '' AS has_text FROM m)
SELECT doc_id, count(*) FILTER (has_text) AS n_notes, coalesce(string_agg(regexp_extract(x, '\A([0-9]+)', 1) || '=' || trim(regexp_extract(x, '\A[0-9]+\]([^\n]+)', 1), ' '), '|' ORDER BY i) FILTER (has_text), '') AS notes,
  sha256(CASE WHEN bool_or(has_text) THEN string_agg(CASE WHEN is_note THEN '[FOOTNOTE]' || CASE WHEN suffix(x, chr(10)) THEN chr(10) ELSE '' END WHEN i > 1 THEN '[' || x ELSE x END, '' ORDER BY i) ELSE string_agg(CASE WHEN i > 1 THEN '[' || x ELSE x END, '' ORDER BY i) END) AS digest
FROM f GROUP BY doc_id
""")
def text_footnotes(spark, sf_dir: str) -> DataFrame:
    """Footnotes of each text and the text with marks in their place."""
    d = _docs(spark, sf_dir).select("doc_id", spoken.footnotes(F.col("text")).alias("f"), spoken.without_footnotes(F.col("text")).alias("t"))
    notes = F.array_join(F.transform("f", lambda x: F.concat(x["number"], F.lit("="), x["text"])), "|")
    return d.select("doc_id", F.size("f").cast("long").alias("n_notes"), notes.alias("notes"), _digest(F.col("t")).alias("digest"))


@query("C10")
def text_ascii_clean(spark, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB has no NFKD. Tests compare it with Python's."""
    return _changed(spark, sf_dir, spoken.ascii_clean(F.col("text")))


@query("C11", sql=_changed_sql(spoken.currency_words_sql("text")))
def text_currency_words(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.currency_words(F.col("text")))


@query("C12", sql=_changed_sql(spoken.percent_words_sql("text")))
def text_percent_words(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.percent_words(F.col("text")))


@query("C13", sql=f"WITH n AS (SELECT o_orderkey AS order_id, CAST(floor(o_totalprice) AS BIGINT) * (o_custkey + 1) AS n FROM orders), w AS (SELECT order_id, n, {int_words_sql('n')} AS words FROM n) SELECT order_id, n, words, {ordinal_sql('words')} AS nth FROM w")
def number_in_words(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.floor("o_totalprice").cast("long") * (F.col("o_custkey") + 1)).alias("n"))
    w = n.select("order_id", "n", int_words(F.col("n")).alias("words"))
    return w.select("order_id", "n", "words", ordinal(F.col("words")).alias("nth"))


@query("C14", sql=_changed_sql(spoken.simple_punctuation_sql("text")))
def text_marks_simplified(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.simple_punctuation(F.col("text")))


@query("C15", sql=_changed_sql(spoken.abbreviation_words_sql("replace(text, 'St.', 'St')")).replace("t <> text", "t <> replace(text, 'St.', 'St')"))
def text_abbreviation_words(spark, sf_dir: str) -> DataFrame:
    """Here ``St.`` loses its point first, as its rule for saints looks ahead, which the SQL cannot."""
    plain = F.replace("text", F.lit("St."), F.lit("St"))
    d = _docs(spark, sf_dir).select("doc_id", plain.alias("text")).select("doc_id", "text", spoken.abbreviation_words(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), (F.col("t") != F.col("text")).alias("changed"), _digest(F.col("t")).alias("digest"))


@query("C16", sql=_changed_sql(spoken.ordinal_words_sql("text")))
def text_ordinal_words(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.ordinal_words(F.col("text")))


@query("C17", sql=_changed_sql(spoken.number_words_sql("text")))
def text_number_words(spark, sf_dir: str) -> DataFrame:
    """The pattern looks ahead and steps back; tests compare it with Python's regular expressions as well."""
    return _changed(spark, sf_dir, spoken.number_words(F.col("text")))


@query("C18")
def text_spoken_v2(spark, sf_dir: str) -> DataFrame:
    """The second normalizer: which steps changed the text, and the result. Each step has its own SQL but for the saints'."""
    d, before, flags = _docs(spark, sf_dir).select("doc_id", "text"), "text", []
    for name, step in spoken.STEPS_V2:
        d = d.withColumn(f"_{name}", step(F.col(before)))
        differs = F.length(before) != F.length(f"_{name}") if name in ("currency", "percent") else F.col(before) != F.col(f"_{name}")
        flags.append(differs.alias(name))
        before = f"_{name}"
    out = d.select("doc_id", *flags, (F.col(before) != F.col("text")).alias("changed"), _digest(F.col(before)).alias("digest"))
    return out.withColumn("n_kinds", sum((F.col(n).cast("long") for n, _ in spoken.STEPS_V2), F.lit(0).cast("long")))


@query("C19")
def text_sanitized(spark, sf_dir: str) -> DataFrame:
    """No SQL for NFKC; tests have literal cases. The lexicon is a parameter, here two words."""
    return _changed(spark, sf_dir, spoken.speech_sanitized(F.col("text"), {"SQL": "sequel", "the": "thee"}))


@query("C20", sql=_changed_sql(spoken.spaced_abbreviations_sql("text")))
def text_spaced_abbreviations(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.spaced_abbreviations(F.col("text")))


@query("C21", sql=_changed_sql(spoken.universal_normalized_sql("text")))
def text_universal(spark, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir, spoken.universal_normalized(F.col("text")))


@query("C22")
def text_all_numbers(spark, sf_dir: str) -> DataFrame:
    """No SQL: British number words with points and scales. Tests have literal cases."""
    return _changed(spark, sf_dir, spoken.all_number_words(F.col("text")))


@query("C36")
def text_preprocessed(spark, sf_dir: str) -> DataFrame:
    """Abbreviations, then numbers, then punctuation; each has its own query."""
    return _changed(spark, sf_dir, spoken.validator_punctuation(spoken.all_number_words(abbreviations(F.col("text")))))


@query("C6")
def text_normalized(spark, sf_dir: str) -> DataFrame:
    """The whole normalizer of extracted texts: junk lines, heading numbers, footnotes, a count of headings, the first
    normalizer for speech, repeated paragraphs, and the yield. No SQL for NFKC; tests compare it with Python's steps."""
    d = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("original_length"), spoken.without_junk_lines(F.col("text")).alias("j"))
    d = d.select("doc_id", "original_length", F.col("j.junk").alias("n_junk"), F.col("j.stripped").alias("n_stripped"), spoken.heading_numbers(F.col("j.text")).alias("t"))
    d = d.select("*", F.size(spoken.footnotes(F.col("t"))).cast("long").alias("n_footnotes"), spoken.without_footnotes(F.col("t")).alias("u")).drop("t")
    d = d.select("*", F.regexp_count("u", F.lit("<HEADING:[0-9]+>")).cast("long").alias("n_headings"), spoken.spoken_v1(F.col("u")).alias("v")).drop("u")
    d = d.select("*", spoken.deduped_paragraphs(F.col("v")).alias("w"))
    n = F.length("w").cast("long")
    share = F.when(F.col("original_length") > 0, n / F.col("original_length")).otherwise(0.0)
    return d.select("doc_id", "original_length", "n_junk", "n_stripped", "n_footnotes", "n_headings", (F.length("v").cast("long") - n).alias("duplicates_removed"), n.alias("final_length"), F.round(share, 6).alias("text_yield"), _digest(F.col("w")).alias("digest"))
