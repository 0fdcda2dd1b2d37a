"""Intervals by key: overlapping ones merged, and taken out of others. Ends are excluded; all work goes range by range, so one
key may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.operators.ordered import RANGES, following, ranged


def merged(df: DataFrame, key: str, start: str = "start", end: str = "end", ranges: int = RANGES) -> DataFrame:
    """key, start, end: the unions of intervals that overlap or touch. Rows with a null or an end not after the start are out.

    Equal intervals count once, so that rows have one order. A row begins a union if no earlier one of its key reaches it. How far earlier rows reach is a running maximum within the
    key's range and one number from the ranges before; unions are numbered in the same way."""
    r = ranged(df.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(key, start, end).distinct(), start, ranges)
    w, before = Window.partitionBy(key, "_range").orderBy(start, end), Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach = r.groupBy(key, "_range").agg(F.max(end).alias("_m")).select(key, "_range", F.max("_m").over(before).alias("_before"))
    own = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_own", own).join(reach, [key, "_range"]).withColumn("_reach", F.greatest("_own", "_before"))
    r = r.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long"))
    n = r.groupBy(key, "_range").agg(F.sum("_new").alias("_k")).select(key, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_n"))
    numbered = r.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(n, [key, "_range"])
    return numbered.groupBy(key, (F.col("_n") + F.col("_in")).alias("_u")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_u")


def subtracted(clips: DataFrame, holes: DataFrame, key: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``clips``, once for each piece that the union of the key's ``holes`` leaves of it, with ``piece_start`` and
    ``piece_end``; a clip that is covered as a whole gives none.

    The gaps between merged holes meet the clips by key and bucket of ``width``, and a pair is told by the bucket in which it
    begins, so no row meets all of its key's. Starts and ends are whole numbers; clips with a null, or that are empty, are out."""
    c = clips.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    span = c.groupBy(key).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    m = merged(holes, key, start, end)
    after = m.join(following(m, key, start), [key, start]).select(key, F.col(end).alias("_a"), F.col("next").alias("_z"))
    first = m.groupBy(key).agg(F.min(start).alias("_z")).select(key, F.lit(None).cast("long").alias("_a"), "_z")
    none = span.select(key).join(m.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("long").alias("_a"), F.lit(None).cast("long").alias("_z"))
    gaps = after.union(first).union(none).join(span, key).select(key, F.greatest("_a", "_lo").alias("_a"), F.least("_z", "_hi").alias("_z")).where("_a < _z")
    bucket = lambda x: F.floor(x / width)
    buckets = lambda a, z: F.explode(F.sequence(bucket(a), bucket(z - 1)))
    left, right = c.withColumn("_bucket", buckets(F.col(start), F.col(end))), gaps.withColumn("_bucket", buckets(F.col("_a"), F.col("_z")))
    met = left.join(right, [key, "_bucket"]).withColumns({"piece_start": F.greatest(start, "_a"), "piece_end": F.least(end, "_z")})
    return met.where((F.col("piece_start") < F.col("piece_end")) & (F.col("_bucket") == bucket(F.col("piece_start")))).select(*clips.columns, "piece_start", "piece_end")
