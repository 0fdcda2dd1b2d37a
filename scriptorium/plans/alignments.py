"""Differences of two texts: an expected and a heard one, two versions, two candidates for a page.

SQL cannot say these: tests compare them with textbook tables and literal cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import quality as Q
from scriptorium.functions import scalars as S
from scriptorium.operators.alignment import by_row, codes, differences, ratio, replaced
from scriptorium.operators.ordered import following
from scriptorium.plans.sentences import SPACE
from scriptorium.sources.tables import table

#: A word of a replacement has more letters than this; the part of two candidates that is compared; the
#: confidences below which a page has failed or is in doubt; differences that are shown, and the characters around them.
SHORT_WORD, COMPARED, FAILED, DOUBTFUL, SHOWN, AROUND = 4, 500, 0.3, 0.7, 5, 30


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, a and b: the text of each turn and of the conversation's next one. Null texts count as empty, rows
    without an id or turn have no place; rows of one turn meet each of the next. A long conversation goes range by range."""
    t = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"))
    after = following(t.select("conv_id", "turn").distinct(), "conv_id", "turn").where("next is not null")
    later = t.select("conv_id", F.col("turn").alias("next"), F.col("a").alias("b"))
    return t.join(after, ["conv_id", "turn"]).join(later, ["conv_id", "next"]).drop("next")


def mispronounced(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_replaced and words: of each pair the words of ``a`` that a least edit of the normalized words replaces, and
    of those the longer, capitalized ones that are in ``a`` as they are, in order and without repetition."""

    def found(a: list[str], b: list[str], cased: list[str]) -> tuple[int, list[str]]:
        at = [i for i, _ in replaced(*codes(a, b))]
        said = {cased[i] for i in at if len(a[i]) > SHORT_WORD and i < len(cased) and cased[i][:1].isupper() and cased[i].lower() == a[i]}
        return len(at), sorted(said)

    words = lambda c: F.filter(F.split(c, SPACE + "+"), lambda x: x != "")
    split = pairs.select(*keys, words(S.wer_text(F.col("a"))).alias("a"), words(S.wer_text(F.col("b"))).alias("b"), words(F.col("a")).alias("cased"))
    return by_row(split, ["a", "b", "cased"], keys, "n_replaced bigint, words array<string>", found)


@query("H7")
def mispronounced_words(spark, sf_dir: str) -> DataFrame:
    """A turn stands for the expected text, the next one for what was heard."""
    out = mispronounced(turn_pairs(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "n_replaced", F.array_join("words", ",").alias("words"))


def text_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_differences, similarity and shown: the first differences of ``a`` and ``b`` as kind and places, each with
    its surroundings in both."""

    def found(a: str, b: str) -> tuple[int, float, list[str]]:
        ops = differences(a, b)
        near = lambda t, i, j: t[max(0, i - AROUND) : j + AROUND]
        shown = [f"{kind} {i1}-{i2} {j1}-{j2}\n{near(a, i1, i2)}\n{near(b, j1, j2)}" for kind, i1, i2, j1, j2 in ops[:SHOWN]]
        total, gone = len(a) + len(b), sum(i2 - i1 + j2 - j1 for _, i1, i2, j1, j2 in ops)
        return len(ops), (total - gone) / total if total else 1.0, shown

    return by_row(pairs, ["a", "b"], keys, "n_differences bigint, similarity double, shown array<string>", found)


@query("H8")
def text_differences(spark, sf_dir: str) -> DataFrame:
    """Each turn against the next one; the first five differences are the feature."""
    out = text_changes(turn_pairs(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])
    places = F.array_join(F.transform("shown", lambda x: F.split(x, "\n")[0]), ";")
    return out.select("conv_id", "turn", "n_differences", F.round("similarity", 6).alias("similarity"), places.alias("places"), F.sha2(F.encode(F.array_join("shown", "\n\n"), "UTF-8"), 256).alias("digest"))


def consensus(pages: DataFrame, methods: list[str], key: str = "page_id") -> DataFrame:
    """key, method, score, confidence and status of each page's best candidate; ``methods`` are columns of candidate texts.

    Empty and null candidates are out; of equal scores the earlier method stands. With two candidates or more, the score is
    weighed by how alike the first two begin. A page without any has the method ``none``."""
    one = lambda m: F.struct(F.lit(m).alias("method"), F.col(m).alias("text"), Q.page_score(F.col(m)).alias("score"))
    had = pages.select(key, F.filter(F.array(*map(one, methods)), lambda x: F.coalesce(x["text"], F.lit("")) != "").alias("c"))
    best = F.get(F.filter("c", lambda x: x["score"] == F.array_max("c.score")), F.lit(0))
    begun = lambda i: F.substring(F.get(F.col("c"), F.lit(i))["text"], 1, COMPARED)
    asked = had.select(key, best["method"].alias("method"), best["score"].alias("score"), begun(0).alias("a"), begun(1).alias("b"))
    like = by_row(asked, ["method", "score", "a", "b"], [key], "method string, score double, alike double", lambda m, s, a, b: (m or "none", s or 0.0, 1.0 if b is None else ratio(a, b)))
    sure = F.col("score") * F.col("alike")
    return like.select(key, "method", F.round("score", 4).alias("score"), F.round(sure, 6).alias("confidence"), F.when(sure < FAILED, "failed").when(sure < DOUBTFUL, "low").otherwise("ok").alias("status"))


@query("A18")
def page_consensus(spark, sf_dir: str) -> DataFrame:
    """Three readings of a page stand for three extraction methods: its lines without scripts and navigation, all its text, and
    its paragraphs alone."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>", " ")
    squeezed = lambda c: F.trim(F.regexp_replace(c, SPACE + "+", " "))
    lines = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(bare, "<[^>]*>", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")
    paragraphs = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda p: squeezed(F.regexp_replace(p, "<[^>]*>", " "))), "\n")
    pages = table(spark, sf_dir, "pages").select("page_id", lines.alias("lines"), squeezed(F.regexp_replace("html", "<[^>]*>", " ")).alias("plain"), paragraphs.alias("paragraphs"))
    return consensus(pages, ["lines", "plain", "paragraphs"])
