"""The two chunkers that look ahead, a text's sentences to pieces: the clause split and the three-tier chunker."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scriptorium.functions import quality
from scriptorium.functions.chunks import EMERGENCY, EMERGENCY_S, HARD, MAX_S, MIN_CHARS, PACE, SOFT

#: Where a clause may end, in order of preference: the words that must stand before it, and whether what
#: marks it stays on the left.
CLAUSES = (
    (r"\s+(?:which|that|who|whom|whose)\s+", 5, True), (r"\s+(?:because|although|though|while|since|when|where|whereas|unless)\s+", 3, True), (r"\s+(?:and|but|yet|or|nor|for)\s+", 5, True),
    (r"\s*--\s*", 10, False), (r"\s*—\s*", 10, False), (r",\s+", 15, False),
)
#: Fixed value: sentences that may be added to complete a chunk.
AHEAD = 10
_ENDINGS = [re.compile(quality.exact(p)) for p, _ in quality.UNFINISHED]
_RELATIVE = re.compile(quality.exact(rf"\b(?:{'|'.join(quality.RELATIVES)})\s+(\w+)"))


def _seconds(text: str) -> float:
    return len(text) / PACE * 60.0


def is_complete(text: str) -> bool:
    """:func:`scriptorium.functions.quality.completeness` of one text."""
    t = text.strip(" \t\n\r\f")
    tail, words = t[-quality.ENDING :].replace("İ", "i").lower(), re.split(r"[ \t\n\r\f]+", t)
    if not t or t.count('"') % 2 or any(p.search(tail) for p in _ENDINGS):
        return False
    after = _RELATIVE.search(" ".join(words[-10:]).replace("İ", "i").lower())
    return not (len(words) >= 5 and after and after[1] not in quality.COMPLETING and not t.endswith("."))


def word_pieces(text: str, most: int, most_s: float = EMERGENCY_S) -> list[str]:
    out, cur, n = [], "", 0
    for w in text.split():
        longer = f"{cur} {w}" if cur else w
        if cur and (n + len(w) + 1 > most or _seconds(longer) > most_s):
            out.append(cur)
            cur, n = w, len(w) + 1
        else:
            cur, n = longer, n + len(w) + 1
    return [*out, cur] if cur else out


def semicolon_pieces(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split("(?<=;)", text)) if p]


def clause_pieces(text: str, most: int = SOFT) -> list[str]:
    """Pieces of a long sentence: at semicolons, else at the first kind of clause end that leaves a left part within ``most``
    (nearest the middle where both parts fit, else nearest ``most``), the rest split again; else by words."""
    out, todo = [], [text]
    while todo:
        t = todo.pop()
        if len(t) <= most:
            out.append(t)
            continue
        parts = semicolon_pieces(t)
        if len(parts) > 1:
            todo += reversed(parts)
            continue
        for pattern, least, stays in CLAUSES:
            cuts = []
            for m in re.finditer(pattern, t, re.IGNORECASE):
                at = m.end() if stays else m.start()
                left, right = t[:at].strip(), t[at:].strip()
                if len(left.split()) >= least and len(left) <= most:
                    cuts.append((abs(len(left) - (most // 2 if len(right) <= most else most)), len(cuts), left, right))
            if cuts:
                _, _, left, right = min(cuts)
                out.append(left)
                todo.append(right)
                break
        else:
            out += word_pieces(t, most)
    return out


def merge_back(chunks: list[str], text: str, most: int, most_s: float) -> None:
    """Appends an incomplete ``text`` to the last chunk, or what both give when split at semicolons or by words."""
    if not chunks:
        chunks.append(text)
        return
    merged = f"{chunks.pop()} {text}"
    fits = lambda t: len(t) <= most and _seconds(t) <= most_s
    parts = semicolon_pieces(merged)
    if fits(merged) or len(parts) < 2:
        chunks += [merged] if fits(merged) else word_pieces(merged, most, most_s)
        return
    chunks.append(parts[0])
    for p in parts[1:]:
        chunks += [p] if fits(p) else word_pieces(p, most, most_s)


def _completed(text: str, ahead: list[str], most: int, most_s: float) -> tuple[str, int, bool]:
    """(text with sentences from ``ahead``, how many, whether it is complete then)."""
    for k, s in enumerate(ahead[:AHEAD]):
        longer = f"{text} {s}"
        if len(longer) > most or _seconds(longer) > most_s:
            return text, k, False
        text = longer
        if is_complete(text):
            return text, k + 1, True
    return text, min(AHEAD, len(ahead)), False


def three_tiers(sentences: list[str], least: int = MIN_CHARS, soft: int = SOFT, hard: int = HARD, emergency: int = EMERGENCY, most_s: float = MAX_S, emergency_s: float = EMERGENCY_S) -> list[str]:
    """Chunks of whole sentences: up to ``soft``, up to ``hard`` to complete one, up to ``emergency`` rather than leave one
    incomplete, and an incomplete one joined to its predecessor. Each sentence is used once."""
    todo = [x for x in (s.strip() for s in sentences) if x]
    chunks: list[str] = []
    cur, i = "", 0

    def close(i: int) -> int:
        text, used, whole = _completed(cur, todo[i:], emergency, emergency_s)
        if whole:
            chunks.append(text)
        else:
            merge_back(chunks, text, emergency, emergency_s)
        return i + used

    while i < len(todo):
        longer = f"{cur} {todo[i]}" if cur else todo[i]
        if cur and len(longer) > hard and len(cur) >= least:
            if is_complete(cur):
                chunks.append(cur)
                cur, i = todo[i], i + 1
            else:
                i, cur = close(i), ""
            continue
        cur, i = longer, i + 1
        if len(cur) <= soft and _seconds(cur) <= most_s:
            ready = len(cur) >= least and is_complete(cur)
        elif len(cur) <= hard:
            ready = is_complete(cur)
            if not ready and len(cur) >= soft:
                i, cur = close(i), ""
        else:
            ready = False
        if ready:
            chunks.append(cur)
            cur = ""
    if len(cur) >= least and is_complete(cur):
        chunks.append(cur)
    elif cur and len(cur) >= min(least, MIN_CHARS):
        merge_back(chunks, cur, emergency, emergency_s)
    return chunks


def _over(f):
    @F.pandas_udf(ArrayType(StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else f(list(x)))

    return run


def clause_split(sentences, most: int = SOFT):
    """Column of a text's sentences, those of more than ``most`` characters split at clauses."""
    return _over(lambda s: [p for x in (y.strip() for y in s) if x for p in clause_pieces(x, most)])(sentences)


def tiered(sentences, **limits):
    """Column of the chunks of :func:`three_tiers`."""
    return _over(lambda s: three_tiers(s, **limits))(sentences)
