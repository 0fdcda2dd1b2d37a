"""Column functions over names, times, statuses and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The statuses of a phase, and how other spellings map to them.
STATUSES = ("pending", "running", "success", "partial", "partial_success", "failed", "error", "skipped", "unknown")
STATUS_ALIASES = {"complete": "success", "completed": "success", "ok": "success", "ready": "success", "in_progress": "running"}


def wer_text(text) -> Column:
    """Lower case, marks to spaces, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def file_id(path) -> Column:
    """Identifier of a file: its stem in lower case, other characters as single underscores."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(value) -> Column:
    """As :func:`file_id` for any string; common Latin accents are dropped first."""
    plain = F.translate(F.lower(value), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_number(path) -> Column:
    """Number in a chunk's file name: after ``_chunk_``, else after ``chunk_``, else the first one, else 0."""
    pick = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.coalesce(pick(r"_chunk_(\d+)"), pick(r"chunk_(\d+)"), pick(r"(\d+)"), F.lit("0")).cast("long")


def chunk_id(path, index) -> Column:
    number = F.nullif(F.regexp_extract(F.lower(path), r"chunk[_-]?(\d+)", 1), F.lit("")).cast("long")
    return F.concat(F.lit("chunk_"), _padded(F.coalesce(number, index), 4))


def _padded(n: Column, width: int) -> Column:
    """Decimal digits with leading zeros; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def clock(seconds, mark: str = ",", places: int = 3, hours: int = 2, rounded: bool = False) -> Column:
    """``HH:MM:SS`` with ``places`` decimals after ``mark``: cut off, or rounded."""
    unit = 10**places
    n = (F.round(seconds * unit) if rounded else F.floor(seconds * unit)).cast("long")
    s = F.floor(n / unit).cast("long")
    part = lambda x, width: _padded(x.cast("long"), width)
    return F.concat(part(F.floor(s / 3600), hours), F.lit(":"), part(F.floor(s / 60) % 60, 2), F.lit(":"), part(s % 60, 2), F.lit(mark), part(n % unit, places))


def status(value) -> Column:
    low = F.lower(value)
    out = F.when(low.isin(*STATUSES), low)
    for k, v in STATUS_ALIASES.items():
        out = out.when(low == k, v)
    return out.otherwise("pending")


def safe_number(value) -> Column:
    return value.try_cast("double")


def iso_seconds(value) -> Column:
    """Seconds since the epoch of an ISO time, read as UTC; 0 for what is no time."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.regexp_replace(value, "Z$", ""))) / 1e6, F.lit(0.0))


def file_format(path) -> Column:
    """Format by extension; what is unknown is text."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("pdf", "epub", "docx"), ext).when(ext.isin("html", "htm"), "html").otherwise("txt")
