"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of texts whose fingerprints agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WS_CHARS, discard, materialize, table

#: A prime below 2**126 (2**126 - 137). The fingerprint of a byte string is its base-256 number modulo this prime.
PRIME = (1 << 126) - 137
CHUNK_CHARS = 1 << 16
#: A group is dealt over up to SALTS tasks wherever its members meet: one for each SHARE rows in the comparison.
SHARE, SALTS = 50, 64


def fingerprint(chunk: bytes, prime: int = PRIME) -> int:
    return int.from_bytes(chunk, "big") % prime


def combine(left: int, right: int, right_len: int, prime: int = PRIME) -> int:
    """Fingerprint of two strings set end to end, from theirs: the left one is shifted by the right one's length."""
    return (left * pow(256, right_len, prime) + right) % prime


def normalized(text) -> F.Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WS_CHARS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunked(docs: DataFrame, chunk: int = CHUNK_CHARS) -> DataFrame:
    """A row a chunk of ``_norm``, at most ``chunk`` characters long; a huge document never enters one Arrow batch whole."""
    n = F.greatest(F.ceil(F.length("_norm") / chunk), F.lit(1)).cast("int")
    df = docs.withColumn("_parts", F.when(F.length("_norm") <= chunk, F.array("_norm")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_norm"), i * chunk + 1, F.lit(chunk)))))
    return df.select(*(c for c in docs.columns if c != "_norm"), F.posexplode("_parts").alias("_seq", "_chunk"))


def chunk_hashes(chunks: DataFrame, prime: int = PRIME) -> DataFrame:
    """Replaces ``_chunk`` by ``_fp`` (32 hexadecimal digits) and ``_len`` (bytes), chunk by chunk and in parallel."""
    rest = [f for f in chunks.schema.fields if f.name != "_chunk"]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.encode("utf-8", "surrogatepass") for x in b.column("_chunk").to_pylist()]
            cols = [b.column(n) for n in names] + [pa.array([f"{fingerprint(x, prime):032x}" for x in raw], pa.string()), pa.array([len(x) for x in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "_fp", "_len"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", _fp string, _len bigint"
    return chunks.mapInArrow(run, schema)


def document_fingerprints(hashes: DataFrame, keys: list[str], prime: int = PRIME) -> DataFrame:
    """Combines chunk hashes to a row a document: ``_fp`` and ``_len`` of its whole normalised text.

    Only documents of several chunks go through the combining function; the shuffle moves hashes, never text.
    """
    one = hashes.where("_n = 1").select(*keys, "_fp", "_len")
    many = hashes.where("_n > 1").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_seq", "_fp", "_len"))).alias("_parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, lens = [], []
            for parts in b.column("_parts").to_pylist():
                value = 0
                for x in parts:
                    value = combine(value, int(x["_fp"], 16), x["_len"], prime)
                fps.append(f"{value:032x}")
                lens.append(sum(x["_len"] for x in parts))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fps, pa.string()), pa.array(lens, pa.int64())], names=[*keys, "_fp", "_len"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema.fields if f.name != "_parts") + ", _fp string, _len bigint"
    return one.unionByName(many.mapInArrow(joined, schema))


def _groups(docs: DataFrame, prime: int, chunk: int) -> DataFrame:
    """A row a document: doc_id, ``_t`` (a hash of its raw text), row_key, text_sha256, group_size, ``_best``.

    Each text is normalised and hashed once, and only hashes are kept of it. ``row_key`` is written before it is read
    again, so a task that is repeated cannot number rows anew.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", F.xxhash64("text").alias("_t"), F.length(F.coalesce("text", F.lit(""))).alias("_cp"), normalized(F.col("text")).alias("_norm"))
    base = base.withColumn("text_sha256", F.sha2(F.encode("_norm", "UTF-8"), 256)).withColumn("_n", F.greatest(F.ceil(F.length("_norm") / chunk), F.lit(1)).cast("int"))
    keys = ["row_key", "doc_id", "_t", "_cp", "text_sha256"]
    hashes = materialize(chunk_hashes(chunked(base, chunk), prime), "exact-hashes")
    shared = materialize(_members(document_fingerprints(hashes, keys, prime), ["_fp", "_len"]), "exact-members")
    broken = materialize(_mismatched(docs, shared, chunk), "exact-collisions")
    discard(hashes)
    fine, out = shared.join(broken, ["_fp", "_len"], "left_anti"), ["doc_id", "_t", "row_key", "text_sha256", "group_size", "_best"]
    again = shared.join(broken, ["_fp", "_len"], "left_semi").select(*keys, "_fp", "_len")
    return fine.select(out).unionByName(_members(again, ["_fp", "_len", "text_sha256"]).select(out))


def exact_groups(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK_CHARS) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; null counts as empty. Of equal texts the row with the
    most code points stays, then the smallest doc_id (a null id comes last), then the first row; repeated rows are
    members like any others and exactly one row of a group is ``kept``. Equal fingerprints alone decide nothing: each
    member's chunks are compared with those of its group's first text, and a group in which any differ is told apart by
    SHA-256 as well. Other columns are not read. An empty table gives an empty result.
    """
    return _groups(docs, prime, chunk).select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("row_key") == F.col("_best.row_key")).alias("kept"), "text_sha256")


def _members(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its group's ``group_size`` and first row ``_best``.

    Every key is salted: a task meets at most a SALTS-th of a group, and a group's row is told to its salts only.
    """
    first = F.struct("_cp", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("a"), F.bitwise_not("row_key").alias("b"), "doc_id", "row_key", "text_sha256")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)))
    parts = rows.groupBy(*by, "_salt").agg(F.count("*").alias("_c"), F.max(first).alias("_b"))
    groups = parts.groupBy(*by).agg(F.sum("_c").alias("group_size"), F.max("_b").alias("_best"))
    return rows.join(parts.select(*by, "_salt").join(groups, by), [*by, "_salt"]).drop("_salt")


def _mismatched(docs: DataFrame, shared: DataFrame, chunk: int) -> DataFrame:
    """Groups in which some member's text differs from the first one's, chunk by chunk.

    A group's first text is sent to as many salts as the group has SHARE rows, SALTS at most, and its members spread over
    them. Texts meet what is known of them by id and raw hash; only those of groups are normalised again, and only hashes
    leave the tasks that compare.
    """
    salts = F.least(F.lit(SALTS), F.ceil(F.col("group_size") / SHARE)).cast("int")
    some = shared.where("group_size > 1").withColumn("_is_first", F.col("row_key") == F.col("_best.row_key"))
    # repeated rows of one id and text need one comparison
    some = some.groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_raw"), "_fp", "_len").agg(F.max("_is_first").alias("_is_first"), F.max(salts).alias("_salts"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_t"))
    met = texts.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_raw")))
    parts = chunked(met.select("doc_id", "_t", "_fp", "_len", "_is_first", "_salts", normalized(F.col("text")).alias("_norm")), chunk)
    at = ["_fp", "_len", "_seq", "_salt"]
    firsts = parts.where("_is_first").select(*at[:3], F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("_chunk").alias("_of_first")).dropDuplicates(at)
    rest = parts.where("not _is_first").select(*at[:3], F.pmod(F.hash("doc_id", "_t"), F.col("_salts")).alias("_salt"), "_chunk")
    return rest.join(firsts, at, "left").where("_of_first is null or _chunk <> _of_first").select("_fp", "_len").distinct()


def exact_dedup(docs: DataFrame, prime: int = PRIME, chunk: int = CHUNK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names: one row for each text, even where ids repeat.

    Rows of one id and raw text are alike but for their other columns; where such stay, one of them does. An empty table
    gives an empty result."""
    kept = F.col("row_key") == F.col("_best.row_key")
    keep = _groups(docs, prime, chunk).groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_raw")).agg(F.max(kept).alias("_kept"), F.count("*").alias("_rows")).where("_kept")
    carried = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_t"))
    met = carried.join(keep, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_raw")))
    again = met.where("_rows > 1").groupBy("_id", "_raw").agg(F.first("_row").alias("_row")).select("_row")
    return met.where("_rows = 1").select("_row").unionByName(again).select("_row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
