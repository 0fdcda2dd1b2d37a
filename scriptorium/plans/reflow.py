"""Plain texts re-flowed, and nested outputs flattened and scanned for keys that they must not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions.chunks import WS
from scriptorium.functions.text import bound
from scriptorium.sources.tables import table

#: Fixed value: a shorter line that follows others stands alone.
SHORT = 10
_TRIM = f"^{WS}+|{WS}+$"


def reflowed(text: Column) -> Column:
    """Hard-wrapped lines joined to paragraphs: a blank line ends one, a short line stands alone, an indented successor ends
    one, and so does a sentence's end before a capital; paragraphs are lines then."""

    def fold(lines: Column) -> Column:
        state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
        pair = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
        after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
        items = F.zip_with(lines, after, lambda x, y: F.struct(F.regexp_replace(x, _TRIM, "").alias("x"), y.alias("y"), F.regexp_replace(y, _TRIM, "").alias("z")))

        def step(s: Column, p: Column) -> Column:
            x, joined = p["x"], F.when(s["cur"] == "", p["x"]).otherwise(F.concat(s["cur"], F.lit(" "), p["x"]))
            ends = (p["y"].rlike(f"^{WS}") & (p["z"] != "")) | (x.rlike(r"[.!?]$") & p["z"].rlike("^[A-Z]"))
            closed = F.concat(s["done"], F.filter(F.array(s["cur"]), lambda c: c != ""))
            blank = F.when(x == "", pair(closed, F.lit(""))).when((F.length(x) < SHORT) & (s["cur"] != ""), pair(F.concat(closed, F.array(x)), F.lit("")))
            return blank.when(ends, pair(F.concat(s["done"], F.array(joined)), F.lit(""))).otherwise(pair(s["done"], joined))

        return F.aggregate(items, state, step, lambda s: F.array_join(F.concat(s["done"], F.filter(F.array(s["cur"]), lambda c: c != "")), "\n"))

    return bound(F.split(text, "\n", -1), fold)


_STEP = rf"""CASE WHEN p.x = '' THEN {{'done': CASE WHEN s.cur = '' THEN s.done ELSE list_append(s.done, s.cur) END, 'cur': ''}}
  WHEN length(p.x) < {SHORT} AND s.cur <> '' THEN {{'done': list_append(list_append(s.done, s.cur), p.x), 'cur': ''}}
  WHEN (regexp_matches(p.y, '^{WS}') AND p.z <> '') OR (regexp_matches(p.x, '[.!?]$') AND regexp_matches(p.z, '^[A-Z]')) THEN {{'done': list_append(s.done, CASE WHEN s.cur = '' THEN p.x ELSE s.cur || ' ' || p.x END), 'cur': ''}}
  ELSE {{'done': s.done, 'cur': CASE WHEN s.cur = '' THEN p.x ELSE s.cur || ' ' || p.x END}} END"""


@query("A10", sql=rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, text, len(l) AS n_lines, list_transform(list_zip(l, list_append(l[2:], '')), lambda z: {{'x': regexp_replace(z[1], '{_TRIM}', '', 'g'), 'y': z[2], 'z': regexp_replace(z[2], '{_TRIM}', '', 'g')}}) AS i FROM l),
f AS (SELECT doc_id, text, n_lines, list_reduce(i, lambda s, p: {_STEP}, {{'done': []::VARCHAR[], 'cur': ''}}) AS s FROM i),
t AS (SELECT doc_id, text, n_lines, array_to_string(CASE WHEN s.cur = '' THEN s.done ELSE list_append(s.done, s.cur) END, chr(10)) AS t FROM f)
SELECT doc_id, n_lines, length(t) AS n_chars, sha256(t) AS digest, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) < 100 THEN 5 ELSE 10 END * CASE WHEN contains(t, chr(65533)) THEN 9 ELSE 10 END / CAST(100 AS DOUBLE) AS quality FROM t
""")
def text_reflowed(spark, sf_dir: str) -> DataFrame:
    """Plain texts with their wrapped lines joined, and their quality; one fold over a text's lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), reflowed(F.col("text")).alias("t"))
    n = F.length("t")
    quality = F.when(n == 0, 0).when(n < 100, 5).otherwise(10) * F.when(F.contains("t", F.lit("�")), 9).otherwise(10) / F.lit(100.0)
    return d.select("doc_id", "n_lines", n.cast("long").alias("n_chars"), F.sha2(F.encode("t", "UTF-8"), 256).alias("digest"), quality.alias("quality"))


#: Parts of keys that research outputs must not have, and the sections that they must.
DISALLOWED, REQUIRED = ("engine_suggestion", "chunk_size", "override", "rewrite", "auto_fix"), ("raw", "analysis")
#: Levels of nesting that are flattened; what lies deeper stays whole.
DEPTH = 4


def flattened(df: DataFrame, key: str, doc: str, depth: int = DEPTH) -> DataFrame:
    """key, path and value of each setting of a JSON object, those of inner objects under dotted paths, inner objects too."""
    level = df.select(key, F.lit("").alias("_at"), F.col(doc).alias("_doc"))
    found = None
    for _ in range(depth):
        pairs = level.select(key, "_at", F.explode(F.from_json("_doc", "map<string,string>")).alias("_k", "value"))
        level = pairs.select(key, F.concat("_at", "_k").alias("path"), "value")
        found = level if found is None else found.unionByName(level)
        level = level.where(F.startswith("value", F.lit("{"))).select(key, F.concat("path", F.lit(".")).alias("_at"), F.col("value").alias("_doc"))
    return found


_OUTPUTS = """
SELECT event_id, '{' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"raw": {"value": ' || (event_id % 10) || ', "' || ['note', 'Engine_Suggestion', 'size', 'auto_fixes'][event_id % 4 + 1] || '": {"deep": {"' || CASE WHEN event_id % 9 = 0 THEN 'my_override' ELSE 'plain' END || '": 1}}}, ' END || '"analysis": {"phase": "' || event_type || '"}}' AS doc FROM events
"""


@query("B26", "N11", sql=f"""
WITH o AS ({_OUTPUTS}), t AS (SELECT o.event_id, replace(j.fullkey, '$.', '') AS path, lower(j.key) AS k FROM o, json_tree(o.doc) AS j WHERE j.key IS NOT NULL),
g AS (SELECT event_id, count(*) AS n_settings, string_agg(path, ',' ORDER BY path) AS paths, coalesce(string_agg(path, ',' ORDER BY path) FILTER ({" OR ".join(f"contains(k, '{d}')" for d in DISALLOWED)}), '') AS blocked, bool_or(path = 'raw') AS raw, bool_or(path = 'analysis') AS analysis FROM t GROUP BY event_id)
SELECT event_id, n_settings, paths, blocked, concat_ws(',', CASE WHEN NOT analysis THEN 'analysis' END, CASE WHEN NOT raw THEN 'raw' END) AS missing, blocked = '' AND raw AND analysis AS valid FROM g
""")
def output_keys(spark, sf_dir: str) -> DataFrame:
    """The settings of nested outputs by their dotted paths, keys that hold a disallowed part, and sections that are missing."""
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("note", "Engine_Suggestion", "size", "auto_fixes"))), (k % 4 + 1).cast("int"))
    raw = F.concat(F.lit('"raw": {"value": '), (k % 10).cast("string"), F.lit(', "'), name, F.lit('": {"deep": {"'), F.when(k % 9 == 0, "my_override").otherwise("plain"), F.lit('": 1}}}, '))
    doc = F.concat(F.lit("{"), F.when(k % 5 == 0, "").otherwise(raw), F.lit('"analysis": {"phase": "'), "event_type", F.lit('"}}'))
    t = flattened(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc")
    last = F.lower(F.substring_index("path", ".", -1))
    bad = F.lit(False)
    for d in DISALLOWED:
        bad = bad | F.contains(last, F.lit(d))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    g = t.groupBy("event_id").agg(F.count("*").alias("n_settings"), joined("path").alias("paths"), joined(F.when(bad, F.col("path"))).alias("blocked"), *(F.bool_or(F.col("path") == r).alias(r) for r in REQUIRED))
    missing = F.concat_ws(",", F.when(~F.col("analysis"), "analysis"), F.when(~F.col("raw"), "raw"))
    return g.select("event_id", "n_settings", "paths", "blocked", missing.alias("missing"), ((F.col("blocked") == "") & F.col("raw") & F.col("analysis")).alias("valid"))
