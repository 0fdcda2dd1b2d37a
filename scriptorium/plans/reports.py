"""State documents, logs, lookups and reports: canonical state, schema checks, key resolution, merges and research counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.catalog import query
from scriptorium.functions import chunks as C
from scriptorium.functions.scalars import STATUS_ALIASES, STATUSES
from scriptorium.plans.kernels import _SIGNALS, REVIEW, _dimensions_sql, _listed_sql, dimensions, listed, signals
from scriptorium.operators.ordered import order_statistics, running_totals
from scriptorium.sources.tables import table

WS = C.WS


def _pick(names, k) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


_LINES = """
SELECT event_id, user_id, ts, CASE event_id % 17 WHEN 0 THEN '{"event_type": "x", "v"' WHEN 1 THEN '' WHEN 2 THEN 'plain text' ELSE '{"event_type": "' || event_type || '", "v": ' || (event_id % 100) || ', "run": "r' || user_id || '"}' END AS line FROM events
"""


def log_lines(spark, sf_dir: str) -> DataFrame:
    """A user's log: a JSON object a line, some broken, blank or no JSON at all."""
    k = F.col("event_id") % 17
    good = F.concat(F.lit('{"event_type": "'), "event_type", F.lit('", "v": '), (F.col("event_id") % 100).cast("string"), F.lit(', "run": "r'), F.col("user_id").cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(k == 0, '{"event_type": "x", "v"').when(k == 1, "").when(k == 2, "plain text").otherwise(good).alias("line"))


@query("A20", "A27", sql=f"""
WITH l AS ({_LINES}), j AS (SELECT event_id, ts, CASE WHEN json_valid(line) THEN line END AS j FROM l)
SELECT event_id, json_extract_string(j, '$.event_type') AS event_type, CAST(json_extract_string(j, '$.v') AS BIGINT) AS v, json_extract_string(j, '$.run') AS run_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS sequence, strftime(ts, '%Y%m%d') || '.log' AS file FROM j WHERE j IS NOT NULL
""")
def log_scan(spark, sf_dir: str) -> DataFrame:
    """Lines that parse, blank and malformed ones skipped, with the sequence and the day's file under which a sink writes them."""
    parsed = F.from_json("line", "event_type string, v bigint, run string")
    j = log_lines(spark, sf_dir).select("event_id", "ts", parsed.alias("j")).where("j.event_type is not null")
    j = running_totals(j.withColumns({"day": F.to_date("ts"), "one": F.lit(1)}), "day", "event_id", "one")
    return j.select("event_id", "j.event_type", "j.v", F.col("j.run").alias("run_id"), F.col("upto").cast("long").alias("sequence"), F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".log")).alias("file"))


@query("A22", sql="""
WITH f AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 3), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events WHERE user_id IN (SELECT user_id FROM f))
SELECT user_id, event_id, back FROM r WHERE back <= 1000
""")
def newest_logs(spark, sf_dir: str) -> DataFrame:
    """The last thousand lines of the three newest logs; the limits are the feature."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    newest = e.groupBy("user_id").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), "user_id").limit(3).select("user_id")
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return e.join(F.broadcast(newest), "user_id").select("user_id", "event_id", back.cast("long").alias("back")).where("back <= 1000")


@query("A25", sql="SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 50")
def old_backups(spark, sf_dir: str) -> DataFrame:
    """Backups beyond the newest fifty of a state, here a user's events, that rotation deletes: those before the fiftieth, which
    a limited rank finds without sorting a user's others."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = e.withColumn("back", back).where("back <= 50").where("back = 50").select("user_id", F.struct("ts", "event_id").alias("last"))
    return e.join(last, "user_id").where(F.struct("ts", "event_id") < F.col("last")).select("user_id", "event_id")


@query("A5", sql="SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def duplicate_flags(spark, sf_dir: str) -> DataFrame:
    """Whether a text was seen before, by id: the first id of each hash comes from an aggregate, a large group is never sorted."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(False).alias("again"))
    return h.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("again", F.lit(True)).alias("duplicate"))


def _positions_sql(mark: str, least: int) -> str:
    return f"WITH l AS (SELECT doc_id, unnest(string_split(text, {mark})) AS x, generate_subscripts(string_split(text, {mark}), 1) AS i FROM documents), p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM l) SELECT doc_id, count(*) FILTER (x = y) = 0 AS clean, coalesce(string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) FILTER (x = y), '') AS positions, sha256(string_agg(x, {mark} ORDER BY i) FILTER (y IS NULL OR x <> y OR length(x) < {least})) AS digest FROM p GROUP BY doc_id"


@query("G4", sql=_positions_sql("chr(10)", 5))
def duplicate_positions(spark, sf_dir: str) -> DataFrame:
    """Places (from 0) of lines that equal the one before, and the text without those of five characters or more."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("a"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("a", F.lit(1), F.size("a") - 1))
    d = d.withColumn("p", F.arrays_zip(F.col("a").alias("x"), before.alias("y"), F.sequence(F.lit(0), F.size("a") - 1).alias("i")))
    same = F.filter("p", lambda z: z["x"] == z["y"])
    kept = F.transform(F.filter("p", lambda z: ~z["x"].eqNullSafe(z["y"]) | (F.length(z["x"]) < 5)), lambda z: z["x"])
    return d.select("doc_id", (F.size(same) == 0).alias("clean"), F.array_join(F.transform(same, lambda z: z["i"].cast("string")), ",").alias("positions"), F.sha2(F.encode(F.array_join(kept, "\n"), "UTF-8"), 256).alias("digest"))


def coerced_status(value: Column) -> Column:
    """A known status, one of its aliases, or ``pending``."""
    low = F.lower(value)
    aliases = F.create_map(*(F.lit(x) for p in STATUS_ALIASES.items() for x in p))
    return F.coalesce(F.when(low.isin(*STATUSES), low), aliases[low], F.lit("pending"))


def _coerced_sql(value: str) -> str:
    return f"CASE WHEN lower({value}) IN ({', '.join(repr(s) for s in STATUSES)}) THEN lower({value}) {' '.join(f'WHEN lower({value}) = {a!r} THEN {b!r}' for a, b in STATUS_ALIASES.items())} ELSE 'pending' END"


_WORDS = ("Complete", "success", "in_progress", "FAILED", "weird", "ok")


@query("N1", "N2", "N3", "N5", "N9", sql=f"""
WITH c AS (SELECT l_orderkey AS file, l_linenumber AS i, {_coerced_sql(f"{list(_WORDS)}[(l_partkey % 7) + 1]")} AS status, CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS errors FROM lineitem),
f AS (SELECT file, count(*) AS n_chunks, string_agg('chunk_' || lpad(CAST(i AS VARCHAR), 4, '0') || ':' || status || ':' || errors, ',' ORDER BY i, status || ':' || errors) AS chunks FROM c GROUP BY file)
SELECT file, 'phase' || (o_custkey % 5 + 1) AS phase, {_coerced_sql("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ready' ELSE NULL END")} AS status, n_chunks, chunks FROM f JOIN orders ON file = o_orderkey
""")
def canonical_state(spark, sf_dir: str) -> DataFrame:
    """State of files in its canonical shape: entries that were written file first stand under their phase, chunk keys are one
    ordered list with ids, statuses are coerced, and errors, a string, a list or nothing, are lists. Order lines stand for
    chunks that a file's entry holds under keys."""
    c = F.col
    raw = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("file"), F.concat(F.lit("chunk_"), F.lpad(c("l_linenumber").cast("string"), 4, "0")).alias("key"), F.when(c("l_partkey") % 7 < 6, _pick(_WORDS, F.least(c("l_partkey") % 7, F.lit(5)))).alias("status"), c("l_suppkey").alias("s"))
    # one value, a list of two, a blank or none, as JSON
    written = raw.withColumn("errors", F.when(c("s") % 4 == 1, '"late"').when(c("s") % 4 == 2, '""').when(c("s") % 4 == 3, '["late", "loud"]'))
    as_list = F.coalesce(F.from_json("errors", "array<string>"), F.filter(F.array(F.regexp_replace("errors", '^"|"$', "")), lambda x: x != ""), F.array().cast("array<string>"))
    chunk = F.struct(F.regexp_extract("key", "chunk_0*([0-9]+)", 1).cast("int").alias("i"), F.concat("key", F.lit(":"), coerced_status(c("status")), F.lit(":"), F.size(F.filter(as_list, lambda x: x.isNotNull())).cast("string")).alias("shown"))
    f = written.groupBy("file").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["shown"]), ",").alias("chunks"))
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("file"), F.concat(F.lit("phase"), (c("o_custkey") % 5 + 1).cast("string")).alias("phase"), coerced_status(F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "ready")).alias("status"))
    return f.join(o, "file").select("file", "phase", "status", "n_chunks", "chunks")


_STATE_SQL = """SELECT event_id, '{"pipeline_version": ' || CASE WHEN event_id % 5 = 0 THEN '4' ELSE '"4.0.0"' END || ', "phase1": ' || CASE event_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN 'null' ELSE '{"status": "success", "errors": ' || CASE WHEN event_id % 3 = 0 THEN '"none"' ELSE '[]' END || '}' END || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "batch_runs": ' || CASE WHEN event_id % 11 = 0 THEN '{}' ELSE '[]' END END || '}' AS doc FROM events"""


@query("N6", "N10", sql=f"""
WITH d AS ({_STATE_SQL}), t AS (SELECT event_id, json_type(doc, '$.pipeline_version') AS v, json_type(doc, '$.phase1') AS p, json_type(doc, '$.phase1.errors') AS e, json_type(doc, '$.batch_runs') AS b FROM d)
SELECT event_id, concat_ws(',', CASE WHEN v <> 'VARCHAR' THEN 'pipeline_version must be a string' END, CASE WHEN p NOT IN ('OBJECT', 'NULL') THEN 'phase1 must be an object' END, CASE WHEN e <> 'ARRAY' THEN 'phase1.errors must be an array' END, CASE WHEN b <> 'ARRAY' THEN 'batch_runs must be an array' END,
  CASE WHEN p IS NULL OR p = 'NULL' THEN 'Missing required phase block phase1' END) AS errors, CASE WHEN p = 'NULL' THEN 'missing_value' WHEN p <> 'OBJECT' THEN 'missing_or_not_dict' ELSE '' END AS lint FROM t
""")
def state_errors(spark, sf_dir: str) -> DataFrame:
    """What keeps a state document from being valid, by the types of its values, and the lint's warning on its phase."""
    k = F.col("event_id")
    errors = F.when(k % 3 == 0, '"none"').otherwise("[]")
    phase = F.when(k % 7 == 0, "[]").when(k % 7 == 1, "null").otherwise(F.concat(F.lit('{"status": "success", "errors": '), errors, F.lit("}")))
    runs = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "batch_runs": '), F.when(k % 11 == 0, "{}").otherwise("[]")))
    doc = F.concat(F.lit('{"pipeline_version": '), F.when(k % 5 == 0, "4").otherwise('"4.0.0"'), F.lit(', "phase1": '), phase, runs, F.lit("}"))
    v = table(spark, sf_dir, "events").select("event_id", F.parse_json(doc).alias("v"))
    kind = lambda path: F.schema_of_variant(F.variant_get("v", path, "variant"))
    t = v.select("event_id", kind("$.pipeline_version").alias("version"), kind("$.phase1").alias("p"), kind("$.phase1.errors").alias("e"), kind("$.batch_runs").alias("b"))
    array = lambda c: F.startswith(F.col(c), F.lit("ARRAY"))
    none = F.col("p").isNull() | (F.col("p") == "VOID")
    bad_phase = ~none & ~F.startswith("p", F.lit("OBJECT"))
    errors = F.concat_ws(
        ",", F.when(F.col("version") != "STRING", "pipeline_version must be a string"), F.when(bad_phase, "phase1 must be an object"), F.when(~array("e"), "phase1.errors must be an array"),
        F.when(~array("b"), "batch_runs must be an array"), F.when(none, "Missing required phase block phase1"),
    )
    return t.select("event_id", errors.alias("errors"), F.when(none, "missing_value").when(bad_phase, "missing_or_not_dict").otherwise("").alias("lint"))


@query("N13", sql="""
WITH v AS (SELECT o_orderkey AS id, 'phase' || (o_custkey % 5 + 1) AS target, '3.' || (o_orderkey % 3) AS have, '3.' || (o_custkey % 3) AS want FROM orders)
SELECT id, CASE WHEN have = want THEN target || '-noop' ELSE target || '-' || have || '-to-' || want END AS step, have = want AS noop FROM v
""")
def migration_plans(spark, sf_dir: str) -> DataFrame:
    c = F.col
    v = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("phase"), (c("o_custkey") % 5 + 1).cast("string")).alias("target"), F.concat(F.lit("3."), (c("o_orderkey") % 3).cast("string")).alias("have"), F.concat(F.lit("3."), (c("o_custkey") % 3).cast("string")).alias("want"))
    same = c("have") == c("want")
    return v.select("id", F.when(same, F.concat("target", F.lit("-noop"))).otherwise(F.concat("target", F.lit("-"), "have", F.lit("-to-"), "want")).alias("step"), same.alias("noop"))


#: Keys of a state's files, a parameter of the lookup; it has a fixed handful of rows.
FILE_KEYS = ("src0", "The_Book", "src-12", "cafe_notes", "src", "Émile")


def _slug(text: Column) -> Column:
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _slug_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace(translate(lower({text}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("J1", sql=f"""
WITH k AS (SELECT unnest({list(FILE_KEYS)}) AS key, unnest(range(1, {len(FILE_KEYS) + 1})) AS i), s AS (SELECT key, i, {_slug_sql("key")} AS slug FROM k),
a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN upper(source) WHEN 2 THEN 'the book' WHEN 3 THEN 'my ' || source || ' copy' ELSE 'zzz' END AS asked FROM documents), b AS (SELECT doc_id, asked, {_slug_sql("asked")} AS slug FROM a),
m AS (SELECT doc_id, key, CASE WHEN asked = key THEN 1 WHEN b.slug = s.slug THEN 2 WHEN contains(s.slug, b.slug) THEN 3 WHEN contains(b.slug, s.slug) THEN 4 END AS tier, i FROM b, s)
SELECT a.doc_id, coalesce(['exact', 'slug', 'substring', 'reverse'][min(tier)], 'none') AS how, arg_min(key, tier * 100 + i) FILTER (tier IS NOT NULL) AS key FROM a JOIN m ON a.doc_id = m.doc_id GROUP BY a.doc_id
""")
def key_resolution(spark, sf_dir: str) -> DataFrame:
    """The state's key that a file id means: equal, of the same slug, whose slug holds it, or which holds it; the first of a
    tier. The last tier, close matches by a sequence ratio, is left out. Keys are matched within the row."""
    k = F.col("doc_id")
    asked = F.when(k % 5 == 0, F.col("source")).when(k % 5 == 1, F.upper("source")).when(k % 5 == 2, "the book").when(k % 5 == 3, F.concat(F.lit("my "), "source", F.lit(" copy"))).otherwise("zzz")
    d = table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked")).withColumn("slug", _slug(F.col("asked")))
    keys = F.transform(F.array(*map(F.lit, FILE_KEYS)), lambda x, i: F.struct(x.alias("key"), _slug(x).alias("slug"), i.alias("i")))

    def tier(x: Column) -> Column:
        level = F.when(F.col("asked") == x["key"], 1).when(F.col("slug") == x["slug"], 2).when(F.contains(x["slug"], F.col("slug")), 3).when(F.contains(F.col("slug"), x["slug"]), 4)
        return F.struct(level.alias("tier"), x["i"].alias("i"), x["key"].alias("key"))

    best = F.array_min(F.filter(F.transform(keys, tier), lambda x: x["tier"].isNotNull()))
    return d.select("doc_id", best.alias("b")).select("doc_id", F.coalesce(F.get(F.array(*map(F.lit, ("exact", "slug", "substring", "reverse"))), F.col("b.tier") - 1), F.lit("none")).alias("how"), F.col("b.key").alias("key"))


@query("J6", "F40", sql=f"""
WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS p3, count(*) FILTER (event_type = 'click') AS p4, count(*) FILTER (event_type = 'purchase') AS p5, count(DISTINCT event_id % 2) AS runs, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_id % 97 = 0) AS odd FROM events GROUP BY user_id)
SELECT user_id, runs <= 1 AS id_stability, (p3 + p4 = 0 OR p3 = p4) AND NOT (p5 > 0 AND p4 > 0 AND p5 <> p4) AS counts_match, NOT odd AS engine_valid, {_listed_sql(run_id_mismatch="runs > 1", unexpected_engine_metadata="odd", enhancement_count_mismatch="p5 > 0 AND p4 > 0 AND p5 <> p4")} AS warnings,
  CASE WHEN errors > 10 THEN 'high' WHEN errors > 5 THEN 'medium' ELSE 'low' END AS drift_severity, {_listed_sql(failure_rate_nonzero="errors > 0", policy_logs_present="p4 > 0", benchmark_history_present="p5 > 0")} AS evidence FROM u
""")
def cross_phase_counts(spark, sf_dir: str) -> DataFrame:
    """Whether run ids, counts of chunks and engines agree across phases, and the drift that counts of signals show; kinds of
    events stand for the outputs of phases."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    one = F.min(F.col("event_id") % 2) == F.max(F.col("event_id") % 2)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(of("view").alias("p3"), of("click").alias("p4"), of("purchase").alias("p5"), one.alias("one"), of("error").alias("errors"), F.bool_or(F.col("event_id") % 97 == 0).alias("odd"))
    c = F.col
    apart = (c("p5") > 0) & (c("p4") > 0) & (c("p5") != c("p4"))
    return u.select(
        "user_id", c("one").alias("id_stability"), (((c("p3") + c("p4") == 0) | (c("p3") == c("p4"))) & ~apart).alias("counts_match"), (~c("odd")).alias("engine_valid"), listed(run_id_mismatch=~c("one"), unexpected_engine_metadata=c("odd"), enhancement_count_mismatch=apart).alias("warnings"),
        F.when(c("errors") > 10, "high").when(c("errors") > 5, "medium").otherwise("low").alias("drift_severity"), listed(failure_rate_nonzero=c("errors") > 0, policy_logs_present=c("p4") > 0, benchmark_history_present=c("p5") > 0).alias("evidence"),
    )


@query("J10", sql="""
WITH s AS (SELECT user_id, event_type AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, event_id FROM events), m AS (SELECT user_id, key, arg_max(v, event_id) AS last, string_agg(CAST(v AS VARCHAR), ',' ORDER BY event_id) AS list FROM s GROUP BY ALL)
SELECT user_id, string_agg(key || '=' || last, ',' ORDER BY key) AS scalars, sha256(string_agg(key || '=' || list, ';' ORDER BY key)) AS lists FROM m GROUP BY user_id
""")
def deep_merges(spark, sf_dir: str) -> DataFrame:
    """Documents merged in order, here a user's events: of a scalar the last value stays, lists grow by each, keys are joined."""
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("v"), "event_id")
    grown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"].cast("string")), ",")
    m = s.groupBy("user_id", "key").agg(F.max_by("v", "event_id").alias("last"), grown.alias("list"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", F.col(c).cast("string").alias("x")))), lambda p: F.concat(p["key"], F.lit("="), p["x"])), by)
    return m.groupBy("user_id").agg(joined("last", ",").alias("scalars"), F.sha2(F.encode(joined("list", ";"), "UTF-8"), 256).alias("lists"))


_HEADINGS = ("the", "Chapter", "an", "of the")


@query("D19", sql=f"""
WITH n AS (SELECT doc_id, lower(text) AS t, g.title, g.k, CASE WHEN g.k % 2 = 0 THEN 0 ELSE doc_id % 50 END AS off FROM documents, (SELECT unnest({[*_HEADINGS, "THE", "Chapter"]}) AS title, unnest(range(1, 7)) AS k) AS g),
o AS (SELECT doc_id, title, k, CASE WHEN off = 0 AND position(lower(title) IN t) > 0 THEN position(lower(title) IN t) - 1 ELSE off END AS off FROM n), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title), off ORDER BY k) AS nth FROM o)
SELECT doc_id, string_agg(title || '@' || off, ',' ORDER BY off, k) AS nodes FROM u WHERE nth = 1 GROUP BY doc_id
""")
def merged_nodes(spark, sf_dir: str) -> DataFrame:
    """Structure nodes of several detectors: one without an offset is looked for in the text, the first of a title and an
    offset stays, all by offset; within the row."""
    titles = F.array(*map(F.lit, (*_HEADINGS, "THE", "Chapter")))
    low = F.lower("text")

    def placed(title: Column, i: Column) -> Column:
        k = i + 1
        off = F.when(k % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("doc_id") % 50)
        found = F.call_function("instr", low, F.lower(title)).cast("long")
        return F.struct(F.when((off == 0) & (found > 0), found - 1).otherwise(off).alias("off"), k.alias("k"), title.alias("title"))

    nodes = F.array_sort(F.transform(titles, placed))
    first = F.filter(nodes, lambda x: F.size(F.filter(nodes, lambda y: (y["off"] == x["off"]) & (F.lower(y["title"]) == F.lower(x["title"])) & (y["k"] < x["k"]))) == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(first, lambda x: F.concat(x["title"], F.lit("@"), x["off"].cast("string"))), ",").alias("nodes"))


@query("D20", sql=r"""
WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), 1) AS i FROM pages),
f AS (SELECT page_id, i, trim(x, ' ') AS t, (i * 7 + page_id) % 23 + 8 AS size FROM l WHERE trim(x, ' ') <> ''), m AS (SELECT page_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM f GROUP BY page_id),
h AS (SELECT f.* FROM f JOIN m ON f.page_id = m.page_id WHERE size >= median + 2 AND length(t) < 100 AND (regexp_matches(t, '(?i)\b(chapter|part|section|book|volume)\b') OR length(regexp_replace(t, '[^A-Z]', '', 'g')) * 10 > 7 * greatest(1, length(regexp_replace(t, '[^A-Za-z]', '', 'g')))))
SELECT page_id, i, size, dense_rank() OVER (PARTITION BY page_id ORDER BY size DESC) - 1 AS level FROM h
""")
def font_headings(spark, sf_dir: str) -> DataFrame:
    """Lines two sizes or more above their document's upper median, short, with a heading's word or mostly capitals; levels by
    size. Sizes of a page's lines are made up."""
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n", -1)).alias("i", "x")).select("page_id", (F.col("i") + 1).cast("long").alias("i"), F.trim("x").alias("t")).where("t <> ''")
    f = lines.withColumn("size", (F.col("i") * 7 + F.col("page_id")) % 23 + 8)
    median = order_statistics(f, "page_id", "size", {"median": F.floor(F.col("n") / 2)}).select("page_id", "median")
    caps, letters = F.regexp_count("t", F.lit("[A-Z]")), F.regexp_count("t", F.lit("[A-Za-z]"))
    named = F.col("t").rlike(r"(?i)(?<![A-Za-z0-9_])(chapter|part|section|book|volume)(?![A-Za-z0-9_])")
    h = f.join(median, "page_id").where((F.col("size") >= F.col("median") + 2) & (F.length("t") < 100) & (named | (caps * 10 > 7 * F.greatest(F.lit(1), letters))))
    return h.select("page_id", "i", "size", (F.dense_rank().over(Window.partitionBy("page_id").orderBy(F.desc("size"))) - 1).cast("long").alias("level"))


#: Labels of failures by what their text says, and phrases that synthesis leaves when it fails.
LABELS = (("tts_failure", "tts"), ("extraction_failure", "extract|pdf|ocr"), ("chunk_failure", "chunk"))
PHRASES = ("the end", "error", "thank you", "of the", "subscribe")
_ERRORS = ("TTS crashed", "cannot extract PDF", "chunk too long for tts", "odd", "OCR chunk lost")


@query("F25", "F26", "F27", "F28", sql=f"""
WITH e AS (SELECT user_id, user_id % 2 AS engine, {list(_ERRORS)}[event_id % 5 + 1] AS msg FROM events WHERE event_type = 'error'), c AS (SELECT user_id, msg, count(*) AS k FROM e GROUP BY ALL)
SELECT user_id, CAST(sum(k) AS BIGINT) AS failures, string_agg(msg || ':' || k, ',' ORDER BY msg) AS patterns, {", ".join(f"CAST(coalesce(sum(k) FILTER (regexp_matches(msg, '(?i){p}')), 0) AS BIGINT) AS {n}" for n, p in LABELS)}, {_listed_sql(**{n: f"bool_or(regexp_matches(msg, '(?i){p}'))" for n, p in LABELS})} AS hypotheses FROM c GROUP BY user_id
""")
def failure_patterns(spark, sf_dir: str) -> DataFrame:
    """Failures of a run's history by message, by label, and the hypotheses that the labels give."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", _pick(_ERRORS, F.col("event_id") % 5).alias("msg"))
    c = e.groupBy("user_id", "msg").agg(F.count("*").alias("k"))
    of = lambda p: F.coalesce(F.sum(F.when(F.col("msg").rlike(f"(?i){p}"), F.col("k"))), F.lit(0))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg", "k"))), lambda x: F.concat(x["msg"], F.lit(":"), x["k"].cast("string"))), ",")
    return c.groupBy("user_id").agg(F.sum("k").alias("failures"), shown.alias("patterns"), *(of(p).alias(n) for n, p in LABELS), listed(**{n: of(p) > 0 for n, p in LABELS}).alias("hypotheses"))


@query("F32", sql=f"""
WITH d AS (SELECT user_id, {_dimensions_sql(REVIEW, 0.75)} FROM ({_SIGNALS})), h AS (SELECT user_id, {", ".join(f"CAST(round({k} * 100) AS BIGINT) AS {k}" for k in REVIEW)} FROM d)
SELECT user_id, count(*) AS n, {", ".join(f"CAST(sum({k}) AS BIGINT) / CAST(100 AS DOUBLE) / count(*) AS {k}" for k in REVIEW)}, count(*) FILTER ({" OR ".join(f"{k} < 30" for k in REVIEW)}) AS outliers FROM h GROUP BY user_id
""")
def review_aggregates(spark, sf_dir: str) -> DataFrame:
    """Means of a user's reviews by dimension, summed as whole hundredths, and the reviews with one below .3."""
    h = signals(spark, sf_dir).select("user_id", *(F.round(v * 100).cast("long").alias(k) for k, v in dimensions(REVIEW, 0.75).items()))
    low = F.lit(False)
    for k in REVIEW:
        low = low | (F.col(k) < 30)
    return h.groupBy("user_id").agg(F.count("*").alias("n"), *((F.sum(k) / 100.0 / F.count("*")).alias(k) for k in REVIEW), F.count_if(low).alias("outliers"))


@query("F37", sql=rf"""
WITH d AS (SELECT doc_id, text, left(text, 50000) AS s, left(text, 20000) AS h FROM documents)
SELECT doc_id, length(text) - length(replace(text, chr(65533), '')) AS replacements, len(regexp_extract_all(h, '  +')) AS multi_spaces, {" + ".join(f"CAST(contains(regexp_replace(lower(s), ' +', ' ', 'g'), ' {w} ') AS BIGINT)" for w in ("the", "and", "of", "to", "a", "in", "is", "that"))} AS common_words,
  length(regexp_replace(s, '[^.!?,;:]', '', 'g')) AS marks, len(list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '')) AS words, contains(lower(text), 'oceanofpdf') AS watermark FROM d
""")
def speech_issue_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of what disturbs speech, in the first 50,000 and 20,000 characters as the rule says; density is marks by words."""
    s, h = F.substring("text", 1, 50000), F.substring("text", 1, 20000)
    low = F.regexp_replace(F.lower(s), " +", " ")
    common = sum((F.contains(low, F.lit(f" {w} ")).cast("long") for w in ("the", "and", "of", "to", "a", "in", "is", "that")), F.lit(0).cast("long"))
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("text", "�").alias("replacements"), count(h, "  +").alias("multi_spaces"), common.alias("common_words"), count(s, "[.!?,;:]").alias("marks"), F.size(C.words_of(s)).cast("long").alias("words"), F.contains(F.lower("text"), F.lit("oceanofpdf")).alias("watermark"))


@query("F38", sql=f"""
SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(lower(text), '{p}') THEN '{p}'" for p in PHRASES)} END AS phrase, turn * 6 AS start_s FROM conversations WHERE {" OR ".join(f"contains(lower(text), '{p}')" for p in PHRASES)}
""")
def phrase_hits(spark, sf_dir: str) -> DataFrame:
    """Segments, here turns, with the first target phrase that each holds; the phrases are a parameter."""
    low = F.lower("text")
    phrase = F.coalesce(*(F.when(F.contains(low, F.lit(p)), p) for p in PHRASES))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", phrase.alias("phrase"), (F.col("turn") * 6).alias("start_s")).where("phrase is not null")
