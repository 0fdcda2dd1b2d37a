"""State-store queries: intake, reuse, lookups, comparisons and paging over driver tables that stand for state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.operators.ordered import following
from scriptorium.sources.tables import table
from scriptorium.sources.versions import StateConflict, VersionedTable, scratch, upserted

_FORMS = ("pdf", "epub", "docx", "txt")


def _docs(spark, sf_dir: str, *cols) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*cols)


@query("A3", "A4", sql="""
WITH f AS (SELECT doc_id, strlen(text) AS size, ['pdf', 'epub', 'docx', 'txt', 'exe'][doc_id % 5 + 1] AS ext, sha256(text) AS sha FROM documents)
SELECT doc_id, sha, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN ext NOT IN ('pdf', 'epub', 'docx', 'txt') THEN 'unsupported' ELSE 'accepted' END AS verdict FROM f
""")
def intake_guards(spark, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (*_FORMS, "exe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    size = F.octet_length("text")
    verdict = F.when(size == 0, "empty").when(size > 20000, "too_large").when(~ext.isin(*_FORMS), "unsupported").otherwise("accepted")
    return _docs(spark, sf_dir, "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), verdict.alias("verdict"))


@query("A5", "A6", sql="""
WITH f AS (SELECT source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k, sha256(text) AS sha FROM documents)
SELECT source, count(*) AS files, count(*) FILTER (k > 1) AS duplicates, count(DISTINCT sha) AS hashes FROM f GROUP BY source
""")
def duplicate_rollup(spark, sf_dir: str) -> DataFrame:
    """Files, later copies of a text seen before, and distinct hashes, by source: the first id of each hash comes from an
    aggregate with partial sums, so a large group of copies is never sorted in one task."""
    h = _docs(spark, sf_dir, "doc_id", "source", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    c = h.groupBy("source", "sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    lead = c.groupBy("sha").agg(F.min_by("source", "first").alias("home")).select(F.col("home").alias("source")).groupBy("source").agg(F.count("*").alias("leads"))
    s = c.groupBy("source").agg(F.sum("n").alias("files"), F.count("*").alias("hashes"))
    return s.join(lead, "source", "left").select("source", "files", (F.col("files") - F.coalesce("leads", F.lit(0))).alias("duplicates"), "hashes")


@query("A16", sql="""
WITH c AS (SELECT item_id, i, CASE i WHEN 1 THEN length(text) - length(replace(text, 'e', '')) WHEN 2 THEN length(text) - length(replace(text, 'a', '')) ELSE length(text) - length(replace(text, 'i', '')) END AS score FROM benchmark, (SELECT unnest([1, 2, 3]) AS i))
SELECT item_id, ['pypdf', 'pdfplumber', 'pymupdf'][i] AS method, score FROM c WHERE TRUE QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) = 1
""")
def best_extraction(spark, sf_dir: str) -> DataFrame:
    """The candidate with the best score, the earlier method on ties; candidates are scored within the row."""
    n = lambda ch: F.regexp_count("text", F.lit(ch))
    one = lambda k, name, ch: F.struct(n(ch).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("method"))
    best = F.array_max(F.array(one(1, "pypdf", "e"), one(2, "pdfplumber", "a"), one(3, "pymupdf", "i")))
    return table(spark, sf_dir, "benchmark").select("item_id", best.alias("b")).select("item_id", "b.method", F.col("b.score").cast("long").alias("score"))


@query("A11", sql=r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>', ' ', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
x AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10)) AS x FROM t)
SELECT page_id, sha256(x) AS digest, CASE WHEN length(x) = 0 THEN 0 WHEN length(x) < 100 THEN 0.5 ELSE CASE WHEN (length(x) - length(replace(x, chr(10), ''))) / length(x) > 0.1 THEN 0.9 ELSE 1 END END AS quality FROM x
""")
def html_text(spark, sf_dir: str) -> DataFrame:
    """Page text without scripts, styles and navigation, a line an element, and its quality."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer)\b.*?</(script|style|nav|header|footer)>", " "), "<[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    x = table(spark, sf_dir, "pages").select("page_id", F.array_join(lines, "\n").alias("x"))
    dense = F.regexp_count("x", F.lit("\n")) / F.length("x") > 0.1
    return x.select("page_id", F.sha2(F.encode("x", "UTF-8"), 256).alias("digest"), F.when(F.length("x") == 0, 0.0).when(F.length("x") < 100, 0.5).otherwise(F.when(dense, 0.9).otherwise(1.0)).alias("quality"))


@query("A21", "A26", sql="SELECT user_id, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def recent_events(spark, sf_dir: str) -> DataFrame:
    """The last five errors of each log; the limit is the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 5").drop("k")


@query("A28", sql="""
SELECT d.doc_id, l.doc_id IS NOT NULL AND d.n_chars > 0 AND (l.quality IS NULL OR l.quality = 1) AS reuse, CASE WHEN l.doc_id IS NULL THEN 'no record' WHEN d.n_chars = 0 THEN 'zero bytes' WHEN l.quality = 0 THEN 'changed' ELSE 'same' END AS reason
FROM documents AS d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) AS l ON d.doc_id = l.doc_id
""")
def reuse_predicates(spark, sf_dir: str) -> DataFrame:
    """Whether an earlier result holds; a label of quality 1 stands for an equal hash."""
    record = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    d = _docs(spark, sf_dir, "doc_id", "n_chars").join(record, F.col("doc_id") == F.col("_id"), "left")
    reuse = F.col("_id").isNotNull() & (F.col("n_chars") > 0) & (F.col("quality").isNull() | (F.col("quality") == 1))
    reason = F.when(F.col("_id").isNull(), "no record").when(F.col("n_chars") == 0, "zero bytes").when(F.col("quality") == 0, "changed").otherwise("same")
    return d.select("doc_id", F.coalesce(reuse, F.lit(False)).alias("reuse"), reason.alias("reason"))


@query("A32", sql="SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chunk_hash(spark, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"))
    return c.select("conv_id", F.sha2(F.encode(F.array_join("p.text", ""), "UTF-8"), 256).alias("digest"))


@query("J2", sql="""
SELECT o.o_orderkey AS order_id, coalesce(s.s_name, c.c_name) AS voice, c.c_mktsegment AS segment FROM orders AS o LEFT JOIN customer AS c ON o.o_custkey = c.c_custkey LEFT JOIN supplier AS s ON o.o_orderkey = s.s_suppkey
""")
def override_lookup(spark, sf_dir: str) -> DataFrame:
    """The first lookup that answers; Catalyst and AQE choose between broadcast and shuffle by measured size."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(s, F.col("o_orderkey") == F.col("s_suppkey"), "left")
    return j.select(F.col("o_orderkey").alias("order_id"), F.coalesce("s_name", "c_name").alias("voice"), F.col("c_mktsegment").alias("segment"))


@query("J3", sql=r"""
WITH f AS (SELECT o_orderkey, 'CUSTOMER ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS file_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'pending' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'take2_chunk_' || o_orderkey || '.wav' WHEN 1 THEN 'chunk_' || o_orderkey || '_v2.wav' WHEN 2 THEN o_orderkey || '.wav' ELSE 'last.wav' END AS path FROM orders),
n AS (SELECT *, CAST(coalesce(nullif(regexp_extract(path, '_chunk_(\d+)', 1), ''), nullif(regexp_extract(path, 'chunk_(\d+)', 1), ''), nullif(regexp_extract(path, '(\d+)', 1), ''), '0') AS BIGINT) AS chunk_id FROM f WHERE status IN ('success', 'complete', 'partial'))
SELECT c_name AS title, o_orderkey AS order_id, path, chunk_id, row_number() OVER (PARTITION BY c_name ORDER BY chunk_id, o_orderkey) AS place
FROM customer JOIN n ON regexp_replace(lower(c_name), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(lower(file_id), '[^\p{L}\p{N}]', '', 'g')
""")
def audio_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks of finished files by title, names compared by letters and digits alone, placed by the number in their path;
    orders stand for files of one chunk."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("take2_chunk_"), k, F.lit(".wav"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("chunk_"), k, F.lit("_v2.wav"))).when(F.col("o_orderkey") % 4 == 2, F.concat(k, F.lit(".wav"))).otherwise("last.wav")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("pending")
    f = o.select("o_orderkey", F.concat(F.lit("CUSTOMER "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("file_id"), status.alias("status"), path.alias("path"))
    number = F.coalesce(*(F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (r"_chunk_(\d+)", r"chunk_(\d+)", r"(\d+)")), F.lit("0")).cast("long")
    done = f.where(F.col("status").isin("success", "complete", "partial")).select(key("file_id").alias("_k"), F.col("o_orderkey").alias("order_id"), "path", number.alias("chunk_id"))
    j = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), key("c_name").alias("_k")).join(done, "_k")
    return j.select("title", "order_id", "path", "chunk_id", F.row_number().over(Window.partitionBy("title").orderBy("chunk_id", "order_id")).cast("long").alias("place"))


@query("J4", sql="""
WITH m AS (SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = documents.doc_id)), g AS (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) - doc_id AS gap FROM m)
SELECT doc_id, coalesce(gap, 0) AS gap, CASE WHEN n_chars < 100 THEN 'tiny' WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size_class FROM g JOIN documents AS d USING (doc_id)
""")
def missing_outputs(spark, sf_dir: str) -> DataFrame:
    """Documents without a label, how far it is to the next such one, 0 at the last, and the class of their size."""
    m = _docs(spark, sf_dir, "doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    near = following(m.select("doc_id", F.lit(0).alias("_all")), "_all", "doc_id")
    size = F.when(F.col("n_chars") < 100, "tiny").when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    return m.join(near, "doc_id").select("doc_id", F.coalesce(F.col("next") - F.col("doc_id"), F.lit(0)).alias("gap"), size.alias("size_class"))


@query("J5", "J7", sql="""
WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'missing' WHEN a.n = b.n THEN 'equal' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def phase_consistency(spark, sf_dir: str) -> DataFrame:
    """Counts of two phases side by side: one conditional aggregate in place of a full outer join of two scans."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    c = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n_before"), F.count_if(F.col("event_type") == "purchase").alias("n_after"))
    return c.withColumn("state", F.when(F.col("n_before") == 0, "new").when(F.col("n_after") == 0, "missing").when(F.col("n_before") == F.col("n_after"), "equal").otherwise("differs"))


@query("J8", "J9", sql="""
WITH f AS (SELECT user_id, event_type, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS kept, value FROM events)
SELECT user_id, max(kept) AS kept, count(*) FILTER (value <> kept) AS conflicts, bool_and(event_type <> 'error') AS allowed FROM f GROUP BY user_id
""")
def policy_merge(spark, sf_dir: str) -> DataFrame:
    """The first value of each key stays, later ones that differ are conflicts, flags are joined by AND."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") != "error").alias("ok"))
    counted = e.groupBy("user_id", "value").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.bool_and("ok").alias("ok"))
    m = counted.groupBy("user_id").agg(F.min_by(F.struct("value", "n"), "first").alias("k"), F.sum("n").alias("n"), F.bool_and("ok").alias("allowed"))
    return m.select("user_id", F.col("k.value").alias("kept"), (F.col("n") - F.col("k.n")).alias("conflicts"), "allowed")


@query("J11", "J12", sql="""
WITH g AS (SELECT * FROM (VALUES ('en', 'xtts'), ('fr', 'kokoro')) AS t(lang, engine)) SELECT doc_id, coalesce(engine, 'piper') AS engine, CASE coalesce(engine, 'piper') WHEN 'xtts' THEN 'kokoro,piper' WHEN 'kokoro' THEN 'xtts,piper' ELSE 'xtts,kokoro' END AS fallbacks
FROM documents LEFT JOIN g ON documents.lang = g.lang
""")
def engine_lookup(spark, sf_dir: str) -> DataFrame:
    """The registry has a fixed handful of rows, so it is a broadcast literal table."""
    g = spark.createDataFrame([("en", "xtts"), ("fr", "kokoro")], "lang string, engine string")
    d = _docs(spark, sf_dir, "doc_id", "lang").join(F.broadcast(g), "lang", "left").withColumn("engine", F.coalesce("engine", F.lit("piper")))
    return d.select("doc_id", "engine", F.array_join(F.array_remove(F.array(F.lit("xtts"), F.lit("kokoro"), F.lit("piper")), F.col("engine")), ",").alias("fallbacks"))


@query("G7", sql="SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL")
def affected_users(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error' and user_id is not null").select("user_id").distinct()


@query("G8", sql="""
WITH k AS (SELECT event_id, json_keys(props) AS k FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT list_contains(k, 'k') THEN 'missing k' END, CASE WHEN len(list_filter(k, lambda x: x <> 'k')) > 0 THEN 'unknown key' END) AS errors FROM k
""")
def schema_errors(spark, sf_dir: str) -> DataFrame:
    """Required and allowed keys of each JSON object."""
    k = table(spark, sf_dir, "events").select("event_id", F.json_object_keys("props").alias("k"))
    missing, extra = ~F.array_contains("k", "k"), F.size(F.array_except("k", F.array(F.lit("k")))) > 0
    return k.select("event_id", F.concat_ws(",", F.when(missing, "missing k"), F.when(extra, "unknown key")).alias("errors"))


@query("N12", sql="""
WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, i // 2 + 1 AS page, CAST(ceil(n / 2) AS BIGINT) AS pages FROM p
""")
def chunk_pages(spark, sf_dir: str) -> DataFrame:
    """The page of two turns that each turn is on, and the number of pages."""
    w = Window.partitionBy("conv_id")
    i = F.row_number().over(w.orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.floor(i / 2) + 1).alias("page"), F.ceil(F.count("*").over(w) / 2).alias("pages"))


@query("D26", sql="""
SELECT doc_id, CAST(trunc(1800 * CASE source WHEN 'web' THEN 0.8 WHEN 'books' THEN 1.15 ELSE 1.0 END) AS BIGINT) AS soft, CAST(trunc(greatest(400, least(2000, n_chars)) * CASE lang WHEN 'fr' THEN 0.9 ELSE 1.0 END) AS BIGINT) AS size FROM documents
""")
def chunk_limits(spark, sf_dir: str) -> DataFrame:
    pace = F.when(F.col("source") == "web", 0.8).when(F.col("source") == "books", 1.15).otherwise(1.0)
    size = F.greatest(F.lit(400), F.least(F.lit(2000), F.col("n_chars"))) * F.when(F.col("lang") == "fr", 0.9).otherwise(1.0)
    return _docs(spark, sf_dir, "doc_id", (1800 * pace).cast("long").alias("soft"), size.cast("long").alias("size"))


@query("E2", "E3", sql="""
WITH s AS (SELECT doc_id, lang, (length(text) - length(replace(text, ' the ', ''))) // 5 AS a, (length(text) - length(replace(text, ' de ', ''))) // 4 AS b, (length(text) - length(replace(text, ' und ', ''))) // 5 AS c FROM documents)
SELECT doc_id, round(a / greatest(1, a + b + c), 6) AS en, round(b / greatest(1, a + b + c), 6) AS fr, round(c / greatest(1, a + b + c), 6) AS de, coalesce(lang, 'auto') AS hint FROM s
""")
def keyword_shares(spark, sf_dir: str) -> DataFrame:
    n = lambda w: F.regexp_count("text", F.lit(w))
    d = _docs(spark, sf_dir, "doc_id", "lang", n(" the ").alias("a"), n(" de ").alias("b"), n(" und ").alias("c"))
    total = F.greatest(F.lit(1), F.col("a") + F.col("b") + F.col("c"))
    share = lambda k, name: F.round(F.col(k) / total, 6).alias(name)
    return d.select("doc_id", share("a", "en"), share("b", "fr"), share("c", "de"), F.coalesce("lang", F.lit("auto")).alias("hint"))


@query("B12", sql="""
WITH i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, i <= 1 OR i > n - 1 OR (conv_id * 31 + turn) % 100 < 5 AS sampled FROM i
""")
def tier_two_rule(spark, sf_dir: str) -> DataFrame:
    """First and last turn of each conversation, and one in twenty of the others by a rule on the ids."""
    w = Window.partitionBy("conv_id")
    i, n = F.row_number().over(w.orderBy("turn")), F.count("*").over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((i <= 1) | (i > n - 1) | ((F.col("conv_id") * 31 + F.col("turn")) % 100 < 5)).alias("sampled"))


@query("A6", "A23", "A24", sql="""
WITH a AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 'success' ELSE 'failed' END) AS status FROM labels GROUP BY doc_id), b AS (SELECT doc_id, length(text) AS size, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN a.status WHEN a.status = 'failed' THEN 'retried' ELSE coalesce(a.status, 'new') END AS status, b.sha, CAST(b.size AS BIGINT) AS size, CAST(2 AS BIGINT) AS version FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def state_upserts(spark, sf_dir: str) -> DataFrame:
    """Records of files in a versioned table: the labels are the first version, an upsert of the documents the second; a writer
    that read the first one then comes too late, is rolled back, and leaves no trace in what is read."""
    t = VersionedTable(spark, f"{scratch(spark)}/scriptorium-state/{uuid.uuid4().hex}", lambda rows: ["no id"] if rows.where("doc_id is null").limit(1).count() else [])
    record = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "success").otherwise("failed")).alias("status"))
    with t.transaction("phase_1") as first:
        first.write(record.select("doc_id", "status", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("size")))
    late = t.transaction("late").__enter__()
    with t.transaction("phase_2") as second:
        known = second.rows.select("doc_id", F.col("status").alias("was"))
        seen = _docs(spark, sf_dir, "doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha"), F.length("text").cast("long").alias("size")).join(known, "doc_id", "left")
        changes = seen.select("doc_id", F.when(F.col("was") == "failed", "retried").otherwise(F.coalesce("was", F.lit("new"))).alias("status"), "sha", "size", F.lit(0).alias("at"))
        second.write(upserted(second.rows, changes, ["doc_id"], "at"))
    late.write(late.rows.limit(0))
    try:
        late.__exit__(None, None, None)
    except StateConflict:
        pass
    return t.read().withColumn("version", F.lit(t.version()).cast("long"))
