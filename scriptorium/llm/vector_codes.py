"""Vector code compression: product codebooks trained by Yinyang Lloyd rounds in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discard, materialize, table
from scriptorium.llm.vectors import pack, unpack, usable, whole

#: Parts of a vector, entries of a part's codebook, rounds, and what components are scaled by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a codebook a group of them, on average.
GROUP = 16
#: Distances computed at once.
BLOCK = 1 << 21
#: Room for the rounding of a bound in single precision.
ROOM = 1e-6


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from each entry, exact whole numbers."""
    a, b = x.astype(np.int64), entries.astype(np.int64)
    top = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * top * top * a.shape[1] < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(1) for e in b], 1)


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries themselves, from evenly spaced ones."""
    k = max(1, len(book) // GROUP)
    x = book.astype(np.float64)
    centre = x[np.linspace(0, len(book) - 1, k).astype(int)]
    for _ in range(5):
        of = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([x[of == g].mean(0) if (of == g).any() else centre[g] for g in range(k)])
    return np.unique(of, return_inverse=True)[1]


class Codebook:
    """One part's entries with their groups, and how far each has moved since the bounds were set."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries, self.group = entries, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max(initial=-1) + 1)]
        self.drift = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(1, dtype=np.float64))
        self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The nearest entry of each row, ties to the lower index, with its bounds, from those of the round before.

        ``upper`` bounds the distance from the row's own entry from above, ``lower`` the distances from every group's other
        entries from below. Both are moved by the drift. Only where they meet is the own distance computed, and only where
        they still meet are a group's entries looked at. Entries are compared by squared distances in whole numbers; a bound
        that equals another one counts as met, so that no tie is passed over.
        """
        code, upper, lower = code.astype(np.int64), (upper + self.drift[code]) * (1 + ROOM) + ROOM, (lower - self.group_drift) * (1 - ROOM) - ROOM
        todo = np.flatnonzero(upper >= lower.min(1))
        own = ((x[todo].astype(np.int64) - self.entries[code[todo]]) ** 2).sum(1)
        upper[todo] = np.sqrt(own)
        met = upper[todo] * (1 + ROOM) >= lower[todo].min(1)
        todo, own = todo[met], own[met]
        for lo in range(0, len(todo), max(1, BLOCK // max(1, len(self.entries)))):
            r = todo[lo : lo + max(1, BLOCK // max(1, len(self.entries)))]
            self._scan(x, r, own[lo : lo + len(r)], code, upper, lower)
        return code, upper, lower

    def _scan(self, x: np.ndarray, r: np.ndarray, own: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        old, best, least = code[r].copy(), code[r].copy(), own.copy()
        seen = np.zeros((len(r), len(self.members)), bool)
        first, second, which = (np.zeros(seen.shape, np.int64) for _ in range(3))
        far = np.iinfo(np.int64).max
        for g, m in enumerate(self.members):
            at = np.flatnonzero(lower[r, g] <= np.sqrt(least) * (1 + ROOM) + ROOM)
            if not len(at):
                continue
            d = squared(x[r[at]], self.entries[m])
            j = d.argmin(1)
            near = d[np.arange(len(at)), j]
            d[np.arange(len(at)), j] = far
            seen[at, g], first[at, g], second[at, g], which[at, g] = True, near, d.min(1), m[j]
            win = (near < least[at]) | (near == least[at]) & (m[j] < best[at])
            least[at[win]], best[at[win]] = near[win], m[j[win]]
        rest = np.where(which == best[:, None], second, first)
        bound = np.where(rest == far, np.inf, np.sqrt(rest.astype(np.float64)))
        low = np.where(seen, bound, lower[r])
        left = np.flatnonzero(best != old)  # the entry left behind now counts among its group's others
        g = self.group[old[left]]
        low[left, g] = np.minimum(low[left, g], np.sqrt(own[left]))
        code[r], upper[r], lower[r] = best, np.sqrt(least), low


def _round(rows: DataFrame, books: list[Codebook], width: int, fresh: bool) -> DataFrame:
    """``rows`` with codes and bounds for ``books``, and beside them each task's sums by part and entry (rows with ``slot``)."""
    step, groups = width // PARTS, [len(b.members) for b in books]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b.entries), step + 1), np.int64) for b in books]
        like = None
        for batch in batches:
            n = batch.num_rows
            q = whole(batch.column("embedding"), SCALE, width) if fresh else unpack(batch.column("q"), np.int32, width)
            if fresh:
                code, upper, lower = np.zeros((n, PARTS), np.uint8), np.full((n, PARTS), np.inf), np.zeros((n, sum(groups)))
            else:
                code, upper, lower = unpack(batch.column("code"), np.uint8, PARTS), unpack(batch.column("upper"), np.float32, PARTS).astype(np.float64), unpack(batch.column("lower"), np.float32, sum(groups)).astype(np.float64)
            codes, uppers, lowers, error = [], [], [], np.zeros(n, np.int64)
            at = 0
            for k, book in enumerate(books):
                x = q[:, k * step : (k + 1) * step]
                c, u, low = book.assign(x, code[:, k], upper[:, k], lower[:, at : at + groups[k]])
                at += groups[k]
                np.add.at(sums[k], c, np.column_stack([x, np.ones(n, np.int64)]))
                error += ((x.astype(np.int64) - book.entries[c]) ** 2).sum(1)
                codes.append(c.astype(np.uint8))
                uppers.append(np.nextafter(u.astype(np.float32), np.float32(np.inf)))
                lowers.append(np.nextafter(low.astype(np.float32), np.float32(-np.inf)))
            like = batch.schema
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pack(q), pack(np.stack(codes, 1)), pack(np.stack(uppers, 1)), pack(np.concatenate(lowers, 1)), pa.array(error), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                names=["vec_id", "label", "q", "code", "upper", "lower", "error", "slot", "sums"],
            )
        if like is not None:
            used = [(k * ENTRIES + e, s) for k, part in enumerate(sums) for e, s in enumerate(part.tolist()) if s[-1]]
            n = len(used)
            blank = [pa.nulls(n, like.field(c).type) for c in ("vec_id", "label")] + [pa.nulls(n, pa.binary())] * 4 + [pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([s for s, _ in used], pa.int32()), pa.array([v for _, v in used], pa.list_(pa.int64()))], names=["vec_id", "label", "q", "code", "upper", "lower", "error", "slot", "sums"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary, code binary, upper binary, lower binary, error bigint, slot int, sums array<bigint>")


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of vec_id, label, code, error; codebooks): every usable row's nearest entries after ``rounds`` rounds.

    A row without a vector, or with a null, NaN or infinite component, is dropped. Components become floor(1024 * x), all
    roundings go down; beyond 2**25 they count as 2**25, so that sums fit a long. A vector shorter than the longest, or of a
    length that 4 doesn't divide, is filled up with zeros. The codebooks start as the parts of the first 256 rows by vec_id,
    nulls last, then vector; fewer rows give fewer entries. Repeated rows each count. Other columns are not read. An empty
    table gives an empty result and codebooks.

    A round reads the rows' whole-number vectors, codes and bounds from a table and writes them anew; a task adds up its rows
    by entry, and sums of at most 4 * 256 entries reach the driver.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings.select("vec_id", "label", "embedding"), "embedding")
    width = -(-(rows.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS) * PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint"), []
    start, step = whole(pa.array([r[0] for r in first], pa.list_(pa.float64())), SCALE, width).astype(np.int64), width // PARTS
    entries = [start[:, k * step : (k + 1) * step] for k in range(PARTS)]
    groups = [grouped(e) for e in entries]
    state, books = rows, [Codebook(e, g) for e, g in zip(entries, groups, strict=True)]
    for k in range(rounds):
        done = materialize(_round(state, books, width, not k), "vector-codes")
        if k:
            discard(state)
        found = done.where(F.col("slot").isNotNull()).groupBy("slot").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(step + 1))).collect()
        after = [e.copy() for e in entries]
        for slot, *sums in found:
            after[slot // ENTRIES][slot % ENTRIES] = np.array(sums[:-1], np.int64) // sums[-1]
        books = [Codebook(e, g, before) for e, g, before in zip(after, groups, entries, strict=True)]
        entries, state = after, done.where(F.col("slot").isNull())
    last = materialize(_round(state, books, width, not rounds).where(F.col("slot").isNull()).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes")
    if rounds:
        discard(state)
    return last, entries


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as common table expressions over (row, part) and (part, entry)."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS x FROM kept, range(4) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, parts.p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM parts JOIN book{k} b ON parts.p = b.p GROUP BY r, parts.p)")
        if k < ROUNDS:
            steps.append(
                f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT a.p, a.m % 256 AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM near{k} a JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)"
            )
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"whole AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS v FROM book{ROUNDS}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), whole"


SQL = _sql()
