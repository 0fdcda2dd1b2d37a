"""URL filters: all glob rules at once, as a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import table

#: The production rules (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"


#: Wildcards of a glob.
STAR, STARS, ANY = "*", "**", "?"


def glob(pattern: str) -> list[int | str]:
    """A pattern's bytes and wildcards: ``*``, ``**`` and ``?``; a backslash makes the next character plain."""
    out: list[int | str] = []
    for plain, star, one in re.findall(r"(?s)\\(.)|(\*+)|(.)", pattern):
        if star:
            out.append(STARS if len(star) > 1 else STAR)
        else:
            out += [ANY] if one == "?" else list((plain or one).encode("utf-8", "surrogatepass"))
    return out


@dataclass(frozen=True)
class Automaton:
    """Globs packed end to end into 64-bit words. A glob is a list of bytes and of the marks STAR (any run of bytes but
    ``/``), STARS (any run of bytes) and ANY (one byte but ``/``). Bit ``p`` stands for "what stands for the pattern's first
    p bytes has been read"; a bit before a star keeps itself alive.
    """

    masks: np.ndarray  # [256, words]: bits whose byte is this one
    stay: np.ndarray  # [256, words]: bits that a star keeps over this byte
    start: np.ndarray  # [words]: first bit of each glob
    final: tuple[tuple[int, int, int], ...]  # (word, bit, rule) of each glob's last bit

    @staticmethod
    def of(globs: list[tuple[list[int | str], int]]) -> Automaton:
        total = sum(1 + sum(x not in (STAR, STARS) for x in g) for g, _ in globs)
        w = (total + 63) // 64 or 1
        masks, stay, start, final, at = np.zeros((256, w), np.uint64), np.zeros((256, w), np.uint64), np.zeros(w, np.uint64), [], 0
        set_bit = lambda row, p: row.__setitem__(p // 64, row[p // 64] | np.uint64(1 << (p % 64)))
        for g, rule in globs:
            set_bit(start, at)
            for x in g:
                if x in (STAR, STARS):
                    for c in range(256):
                        if c != 0x2F or x == STARS:
                            set_bit(stay[c], at)
                else:
                    at += 1
                    for c in range(256) if x == ANY else (x,):
                        if x != ANY or c != 0x2F:
                            set_bit(masks[c], at)
            final.append((at // 64, at % 64, rule))
            at += 1
        return Automaton(masks, stay, start, tuple(final))

    def matched(self, lines: list[bytes], n_rules: int) -> np.ndarray:
        """[lines, rules]: whether a glob of the rule fits a beginning of the line. All patterns of all lines advance
        together, a byte a step; lines are taken longest first, so that a step touches only those that still have bytes."""
        n, w = len(lines), len(self.start)
        hit = np.zeros((n, n_rules), bool)
        order = sorted(range(n), key=lambda i: -len(lines[i]))
        lens = np.array([len(lines[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(lines[i] for i in order) or b"\0", np.uint8)
        offs = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.tile(self.start, (n, 1))  # a glob that is all stars has matched already
        seen = state.copy()
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(lens[0]) if n else 0):
            m = int(np.searchsorted(-lens, -j, side="left"))  # lines longer than j
            c = flat[offs[:m] + j]
            s = state[:m]
            moved = s << one
            if w > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:m] = (moved & self.masks[c]) | (s & self.stay[c])
            if not state[:m].any():
                break
            seen[:m] |= state[:m]
        for word, bit, rule in self.final:
            hit[order, rule] |= (seen[:, word] >> np.uint64(bit) & one).astype(bool) if n else False
        return hit


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)") if isinstance(url, str) else F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def url_verdicts(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    A rule is (verdict, host, path), which fits its host and all subdomains if the path starts with the rule's: the globs
    ``host path`` and ``*.host path``; or (verdict, glob), which fits if a beginning of ``host + path`` matches (:func:`glob`).
    The longest that fits wins, the first of equals. Null urls and those without ``://`` have an empty host and path, fit no rule and get ``default``. Rows are judged alone:
    repeated ones alike. Other columns are not read. The rules are a parameter that every task holds whole.
    """
    names = ["".join(r[1:]) for r in rules]
    rank = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    globs = []
    for k, r in enumerate(rules):
        if len(r) == 2:
            globs.append((glob(r[1]), k))
        else:
            tail = list(names[k].encode("utf-8", "surrogatepass"))
            globs += [(tail, k), ([STAR, 0x2E, *tail], k)]
    machine, verdict = Automaton.of(globs), [r[0] for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [x.encode("utf-8", "surrogatepass") for x in b.column("_line").to_pylist()]
            hit = machine.matched(lines, len(rules))
            best = np.full(len(lines), -1)
            for k in reversed(rank):
                best[hit[:, k]] = k
            rule = [names[k] if k >= 0 else None for k in best]
            said = [verdict[k] if k >= 0 else default for k in best]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_line", F.concat("host", "path"))
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), hp AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, host, path, h || p AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM hp LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
