"""Clips cut, gated, joined and judged; embedding vectors stand for short clips of samples, turns for spoken segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import audio as A
from scriptorium.functions.spectrum import mean_centroid
from scriptorium.operators.intervals import merged, subtracted
from scriptorium.operators.ordered import running_totals
from scriptorium.plans.audio import clips
from scriptorium.plans.reports import PHRASES
from scriptorium.sources.tables import table

#: Milliseconds that a character takes to say, that a hole spreads on either side, a window of the file, and a crossfade.
PACE_MS, MARGIN_MS, WINDOW_MS, CROSSFADE_MS = 22, 1500, 10_000, 20
_HIT = " OR ".join(f"contains(lower(text), '{p}')" for p in PHRASES)
_HOLES = f"""s AS (SELECT conv_id, turn, coalesce(text, '') AS text, {PACE_MS} * (length(coalesce(text, '')) + 1) AS ms FROM conversations),
t AS (SELECT conv_id, text, CAST(sum(ms) OVER w - ms AS BIGINT) AS a, CAST(sum(ms) OVER w AS BIGINT) AS z FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT conv_id, a - {MARGIN_MS} AS a, z + {MARGIN_MS} AS z FROM t WHERE {_HIT}),
g AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY conv_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM h),
m AS (SELECT conv_id, min(a) AS a, max(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS u FROM g) GROUP BY conv_id, u),
f AS (SELECT conv_id, max(z) AS total FROM t GROUP BY conv_id)"""


def _segments(spark, sf_dir: str) -> DataFrame:
    """conv_id, text, start and end of every turn, one after another at the same pace."""
    text = F.coalesce("text", F.lit(""))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), ((F.length(text) + 1) * PACE_MS).cast("long").alias("ms"))
    return running_totals(t, "conv_id", "turn", "ms").select("conv_id", "text", (F.col("upto") - F.col("ms")).alias("start"), F.col("upto").alias("end"))


def _holes(segments: DataFrame) -> DataFrame:
    """What is to go: segments that hold a target phrase, and a margin."""
    low, hit = F.lower("text"), F.lit(False)
    for p in PHRASES:
        hit = hit | F.contains(low, F.lit(p))
    return segments.where(hit).select("conv_id", (F.col("start") - MARGIN_MS).alias("start"), (F.col("end") + MARGIN_MS).alias("end"))


@query("M14", sql=f"""
WITH {_HOLES}, c AS (SELECT conv_id, total, sum(greatest(0, least(z, total) - greatest(a, 0))) AS gone, count(*) AS holes, count(*) FILTER (a <= 0) AS head, count(*) FILTER (z >= total) AS rear FROM m JOIN f USING (conv_id) GROUP BY ALL)
SELECT conv_id, total AS total_ms, CAST(coalesce(holes, 0) AS BIGINT) AS n_holes, CAST(coalesce(holes - head - rear, 0) + 1 AS BIGINT) AS n_pieces, CAST(total - coalesce(gone, 0) AS BIGINT) AS kept_ms,
  CAST(total - coalesce(gone, 0) - {CROSSFADE_MS} * greatest(0, coalesce(holes - head - rear, 0)) AS BIGINT) AS result_ms FROM f LEFT JOIN c USING (conv_id, total)
""")
def phrase_excisions(spark, sf_dir: str) -> DataFrame:
    """Each file without its holes: pieces left, their length, and that of the result, whose pieces overlap by the crossfade."""
    s = _segments(spark, sf_dir)
    total = s.groupBy("conv_id").agg(F.lit(0).cast("long").alias("start"), F.max("end").alias("end"))
    holes = merged(_holes(s), "conv_id").groupBy("conv_id").agg(F.count("*").alias("n_holes"))
    pieces = subtracted(total, _holes(s), "conv_id", WINDOW_MS).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.col("piece_end") - F.col("piece_start")).alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = total.join(holes, "conv_id", "left").join(pieces, "conv_id", "left")
    return out.select("conv_id", F.col("end").alias("total_ms"), zero("n_holes").alias("n_holes"), zero("n").alias("n_pieces"), zero("kept").alias("kept_ms"), (zero("kept") - CROSSFADE_MS * F.greatest(zero("n") - 1, F.lit(0))).cast("long").alias("result_ms"))


@query("M14", sql=f"""
WITH {_HOLES}, w AS (SELECT conv_id, i * {WINDOW_MS} AS a, least((i + 1) * {WINDOW_MS}, total) AS z FROM (SELECT conv_id, total, unnest(range(0, (total - 1) // {WINDOW_MS} + 1)) AS i FROM f)),
x AS (SELECT w.conv_id, w.a, w.z, list(struct_pack(a := greatest(m.a, w.a), z := least(m.z, w.z)) ORDER BY m.a) FILTER (m.a IS NOT NULL) AS h FROM w LEFT JOIN m ON w.conv_id = m.conv_id AND m.a < w.z AND m.z > w.a GROUP BY ALL),
p AS (SELECT conv_id, a AS clip_ms, list_filter(list_zip(list_concat([a], coalesce(list_transform(h, lambda o: o.z), [])), list_concat(coalesce(list_transform(h, lambda o: o.a), []), [z])), lambda o: o[1] < o[2]) AS p FROM x)
SELECT conv_id, clip_ms, CAST(len(p) AS BIGINT) AS n_pieces, CAST(list_sum(list_transform(p, lambda x: x[2] - x[1])) AS BIGINT) AS kept_ms, CAST(p[1][1] AS BIGINT) AS first_ms FROM p WHERE len(p) > 0
""")
def excised_clips(spark, sf_dir: str) -> DataFrame:
    """Windows of each file that something is left of, and how much."""
    s = _segments(spark, sf_dir)
    last = s.groupBy("conv_id").agg(F.max("end").alias("total"))
    windows = last.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(WINDOW_MS).cast("long"))).alias("start"))
    left = subtracted(windows.select("conv_id", "start", F.least(F.col("start") + WINDOW_MS, "total").alias("end")), _holes(s), "conv_id", WINDOW_MS)
    return left.groupBy("conv_id", F.col("start").alias("clip_ms")).agg(F.count("*").alias("n_pieces"), F.sum(F.col("piece_end") - F.col("piece_start")).alias("kept_ms"), F.min("piece_start").alias("first_ms"))


#: Frames that suit clips of 64 samples, and the threshold of a gate that closes on some of them.
_SIZE, _HOP, _GATE_DB = 16, 8, -18.0
_RMS = "sqrt(list_sum(list_transform({0}, lambda y: y * y)) / len({0}))"


@query("M17", sql=f"""
WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), e AS (SELECT *, list_transform(range(0, greatest(len(a) - {_SIZE}, 0), {_HOP}), lambda i: {_RMS.format(f"list_slice(a, i + 1, i + {_SIZE})")}) AS e FROM a),
g AS (SELECT vec_id, a, list_transform(a, lambda x, k: x * CASE WHEN coalesce(e[(k - 1) // {_HOP} + 1], 0) < 10 ^ ({_GATE_DB} / 20) THEN 10 ^ (-1) ELSE 1 END) AS g FROM e)
SELECT vec_id, CAST(len(list_filter(list_zip(a, g), lambda x: x[1] <> x[2])) AS BIGINT) AS n_gated, round(list_sum(list_transform(g, lambda x, k: x * (k % 7))), 4) AS checksum FROM g
""")
def noise_gates(spark, sf_dir: str) -> DataFrame:
    """Samples that the gate turns down, and a weighted sum of the result."""
    d = clips(spark, sf_dir).select("vec_id", "a", A.gated(F.col("a"), _GATE_DB, -20.0, _SIZE, _HOP).alias("g"))
    changed = F.size(F.filter(F.zip_with("a", "g", lambda x, y: x != y), lambda t: t)).cast("long")
    return d.select("vec_id", changed.alias("n_gated"), F.round(_checksum("g"), 4).alias("checksum"))


def _checksum(samples: str) -> F.Column:
    return F.aggregate(F.transform(samples, lambda x, k: x * ((k + 1) % 7)), F.lit(0.0), lambda s, x: s + x)


#: Chunks of a file; samples that neighbours share; silent samples that keep them apart; samples whose levels are compared.
_FILE, _FADE, _GUARD, _SEAM = 8, 12, 20, 16


@query("M11", sql=f"""
WITH c AS (SELECT vec_id // {_FILE} AS file_id, vec_id, CASE WHEN vec_id % 5 = 0 THEN list_concat(list_transform(range({_GUARD}), lambda i: CAST(0 AS DOUBLE)), CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS a FROM embeddings),
n AS (SELECT *, lag(a) OVER w AS p, lead(a) OVER w AS q, vec_id % 5 <> 0 AND lag(a) OVER w IS NOT NULL AS over_, lead(vec_id) OVER w % 5 <> 0 AS next_over FROM c WINDOW w AS (PARTITION BY file_id ORDER BY vec_id)),
r AS (SELECT *, {_RMS.format(f"list_slice(p, len(p) - {_SEAM - 1}, len(p))")} AS x, {_RMS.format(f"list_slice(a, 1, {_SEAM})")} AS y FROM n),
s AS (SELECT file_id, vec_id, over_ AND abs(x - y) / greatest(x, y, 0.001) > 0.2 AS warn, list_concat(CASE WHEN over_ THEN list_transform(range({_FADE}), lambda i: p[len(p) - {_FADE} + i + 1] * (1 - i / {_FADE - 1}.0) + a[i + 1] * (i / {_FADE - 1}.0)) ELSE [] END,
  list_slice(a, CASE WHEN over_ THEN {_FADE + 1} ELSE 1 END, len(a) - CASE WHEN coalesce(next_over, FALSE) THEN {_FADE} ELSE 0 END)) AS part FROM r),
f AS (SELECT file_id, count(*) AS n_chunks, count(*) FILTER (warn) AS n_warnings, flatten(list(part ORDER BY vec_id)) AS g FROM s GROUP BY file_id)
SELECT file_id, n_chunks, n_warnings, CAST(len(g) AS BIGINT) AS n_samples, round(list_sum(list_transform(g, lambda x, k: x * (k % 7))), 4) AS checksum FROM f
""")
def seam_joins(spark, sf_dir: str) -> DataFrame:
    """Files of eight clips, every fifth clip after a pause, as one array each; its place decides a sample's weight in the sum."""
    pause = F.array_repeat(F.lit(0.0), _GUARD)
    c = clips(spark, sf_dir).select(F.floor(F.col("vec_id") / _FILE).alias("file_id"), "vec_id", F.when(F.col("vec_id") % 5 == 0, F.concat(pause, "a")).otherwise(F.col("a")).alias("a"))
    files = c.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "a"))), lambda x: x["a"]).alias("chunks"))
    j = files.select("file_id", "n_chunks", A.joined(F.col("chunks"), _FADE, _GUARD, _SEAM).alias("j")).select("file_id", "n_chunks", F.col("j.warnings").alias("n_warnings"), F.col("j.samples").alias("g"))
    return j.select("file_id", "n_chunks", "n_warnings", F.size("g").cast("long").alias("n_samples"), F.round(_checksum("g"), 4).alias("checksum"))


#: Samples a second, and frames that suit clips of 64 samples.
_RATE, _FRAME, _STEP = 22_050, 64, 16


@query("E27", sql=f"""
WITH a AS (SELECT vec_id, list_concat(list_transform(range({_FRAME // 2}), lambda i: CAST(0 AS DOUBLE)), list_concat(CAST(embedding AS DOUBLE[]), list_transform(range({_FRAME // 2}), lambda i: CAST(0 AS DOUBLE)))) AS a FROM embeddings),
f AS (SELECT vec_id, s, list_transform(range({_FRAME}), lambda t: a[s + t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / {_FRAME}))) AS x FROM (SELECT vec_id, a, unnest(range(0, len(a) - {_FRAME} + 1, {_STEP})) AS s FROM a)),
d AS (SELECT vec_id, s, list_transform(range({_FRAME // 2 + 1}), lambda k: sqrt(list_sum(list_transform(x, lambda v, t: v * cos(2 * pi() * k * (t - 1) / {_FRAME}))) ^ 2 + list_sum(list_transform(x, lambda v, t: v * sin(2 * pi() * k * (t - 1) / {_FRAME}))) ^ 2)) AS p FROM f),
c AS (SELECT vec_id, avg(CASE WHEN list_sum(p) > 0 THEN list_sum(list_transform(p, lambda v, k: v * (k - 1) * {_RATE} / {_FRAME}.0)) / list_sum(p) ELSE 0 END) AS c FROM d GROUP BY vec_id)
SELECT vec_id, round(least(c / 2000, 5), 4) AS mos FROM c
""")
def mos_proxy(spark, sf_dir: str) -> DataFrame:
    """Mean spectral centroid over 2,000 Hz, five at most."""
    c = mean_centroid(F.col("a"), _RATE, _FRAME, _STEP)
    return clips(spark, sf_dir).select("vec_id", F.round(F.least(c / 2000, F.lit(5.0)), 4).alias("mos"))
