"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English words, and the part of a text that the extraction score looks at.
COMMON_WORDS = ("the", "and", "of", "to", "a", "in", "is", "that", "for", "it")
SAMPLE_CHARS = 20000


def normalize_spaces(text) -> Column:
    """Tabs to spaces, runs of spaces to one, three or more line ends to two, no spaces at a line's end."""
    out = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " +", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), " +(\n|$)", "$1")


def punctuation_spacing(text) -> Column:
    """No white space before a mark, one space after it."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\f]+([.,!?;:])", "$1"), r"([.,!?;:])([^ \t\n\r\f])", "$1 $2")


def bound(value, f) -> Column:
    """``f(value)`` with ``value`` computed once: as a lambda's variable it is not copied into each of its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def extraction_score(text) -> Column:
    """Quality of an extracted text from 0 to 1, by replacement characters, letters, common words and digits."""

    def measures(part):
        found = bound(F.lower(part), lambda low: sum((F.contains(low, F.lit(f" {w} ")).cast("int") for w in COMMON_WORDS), F.lit(0)))
        return F.struct(
            F.length(text).alias("n"), F.length(part).alias("len"), (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))).alias("broken"), found.alias("common"),
            F.regexp_count(part, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(part, F.lit(r"\p{Nd}")).alias("digits"),
        )

    def score(m):
        step = lambda bad, big, poor, small: F.when(bad, big).when(poor, small).otherwise(0.0)
        broken, alpha = m["broken"] / m["n"], m["letters"] / m["len"]
        points = 1.0 - step(broken > 0.01, 0.3, broken > 0, 0.1) - step(alpha < 0.65, 0.3, alpha < 0.75, 0.1) - step(m["common"] < 6, 0.3, m["common"] < 8, 0.1) - F.when(m["digits"] / F.greatest(m["letters"], F.lit(1)) > 0.35, 0.2).otherwise(0.0)
        return F.when(F.coalesce(m["n"], F.lit(0)) < 100, 0.0).otherwise(F.greatest(F.lit(0.0), points))

    return bound(bound(F.substring(text, 1, SAMPLE_CHARS), measures), score)


def duration_seconds(text, chars_per_minute: int = 2700) -> Column:
    """Predicted speaking time."""
    return F.length(text) / F.lit(float(chars_per_minute)) * 60.0


def phase_status(quality, score) -> Column:
    return F.when((quality >= 0.8) & (score >= 0.85), "success").when((quality >= 0.6) | (score >= 0.6), "partial_success").otherwise("failed")
