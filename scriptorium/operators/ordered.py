"""Ordered analytics of which one key may hold most rows: a key's rows are cut into ranges, each settled by itself.

The ranges' bounds are approximate quantiles of the ordering column over all rows, RANGES - 1 numbers, whatever the input.
They only balance the work: a window runs within a key's range, and what passes from range to range is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that a key's rows are cut into.
RANGES = 64


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``, rising with ``order``; a null is in the first one."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), 10 * ranges)).first()[0] or []))
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    return df.withColumn("_range", F.when(F.col(order).isNull(), 0).otherwise(above))


def running_totals(df: DataFrame, key: str, order: str, amount: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``upto``, the sum of ``amount`` over the key's rows up to this one, and ``n``, over all. Rows of equal
    ``order`` must be one already."""
    r = ranged(df, order, ranges)
    parts = r.groupBy(key, "_range").agg(F.sum(amount).alias("_part"))
    w = Window.partitionBy(key)
    before = parts.select(key, "_range", (F.sum("_part").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_part")).alias("_before"), F.sum("_part").over(w).alias("n"))
    own = F.sum(amount).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_own", own).join(before, [key, "_range"]).withColumn("upto", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def order_statistics(df: DataFrame, key: str, value: str, places: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """The values at given places (from 0, expressions over ``n``, the key's number of rows) of each key's rows by ``value``.

    Equal values are counted before they are ordered, so nothing is sorted row by row. Nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_k"))
    totals = running_totals(counts, key, value, "_k", ranges)
    return totals.groupBy(key).agg(F.first("n").alias("n"), *(F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()))


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact percentiles of each key's values, interpolated between neighbours."""
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    places = {f"_lo_{k}": F.floor(x) for k, x in at.items()} | {f"_hi_{k}": F.ceil(x) for k, x in at.items()}
    s = order_statistics(df, key, value, places, ranges)
    between = lambda k: F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (at[k] - F.floor(at[k]))
    return s.select(key, *(between(k).alias(k) for k in shares))


def following(df: DataFrame, key: str, order: str, ranges: int = RANGES) -> DataFrame:
    """key, order and ``next``, the key's next value of ``order``, null at its end. Only these two columns are moved."""
    r = ranged(df.select(key, order), order, ranges)
    firsts = r.groupBy(key, "_range").agg(F.min(order).alias("_first"))
    later = firsts.select(key, "_range", F.lead("_first").over(Window.partitionBy(key).orderBy("_range")).alias("_later"))
    own = F.lead(order).over(Window.partitionBy(key, "_range").orderBy(order))
    return r.withColumn("_next", own).join(later, [key, "_range"]).select(key, order, F.coalesce("_next", "_later").alias("next"))
