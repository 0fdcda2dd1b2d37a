"""Column functions over sample arrays (``array<double>``), folded in place: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import bound

#: The floor of a level in dB, and the smallest amplitude that has one.
FLOOR_DB, SILENT = -100.0, 1e-10


def decibels(x) -> Column:
    return F.when(x < SILENT, FLOOR_DB).otherwise(20 * F.log10(x))


def rms(samples) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.size(samples))


def peak(samples) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def share_of(samples, test) -> Column:
    return F.size(F.filter(samples, test)) / F.size(samples)


def noise_floor(samples, threshold: float = 0.01, least: int = 100) -> Column:
    quiet = F.filter(samples, lambda x: F.abs(x) < threshold)
    return F.when(F.size(quiet) < least, FLOOR_DB).otherwise(decibels(rms(quiet)))


def quantile(samples, p: float) -> Column:
    """Linear percentile of an array's absolute values."""
    ordered = F.array_sort(F.transform(samples, F.abs))
    k = (F.size(samples) - 1) * p
    low = F.floor(k).cast("int")
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(samples)))
    return a + (b - a) * (k - low)


def scaled(samples, gain) -> Column:
    return F.transform(samples, lambda x: x * gain)


def limited(samples, most_db: float = -3.0) -> Column:
    """The whole array turned down to the given peak if it is above."""
    top = peak(samples)
    return F.when(decibels(top) > most_db, scaled(samples, F.lit(10 ** (most_db / 20)) / top)).otherwise(samples)


def longest_run(samples, test) -> Column:
    """Length of the longest run of samples that pass."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(test(x), s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(samples, zero, step, lambda s: s["best"])


def gated(samples, threshold_db: float = -50.0, reduction_db: float = -20.0, size: int = 1024, hop: int = 512) -> Column:
    """Samples turned down where the level of their frame is under the threshold. Frames of ``size`` begin ``hop`` apart as long
    as samples follow them, and each rules its first ``hop`` samples; the tail that no frame rules has level 0."""
    low, less = 10 ** (threshold_db / 20), 10 ** (reduction_db / 20)
    n = F.size(samples)
    frames = F.when(n > size, F.transform(F.sequence(F.lit(0), n - size - 1, F.lit(hop)), lambda i: rms(F.slice(samples, i + 1, F.lit(size))))).otherwise(F.array().cast("array<double>"))
    return bound(frames, lambda f: F.transform(samples, lambda x, i: F.when(F.coalesce(F.get(f, F.floor(i / hop).cast("int")), F.lit(0.0)) < low, x * less).otherwise(x)))


def joined(chunks, fade: int, guard: int, seam: int = 100, silent: float = 1e-4, jump: float = 0.2, least: int = 4) -> Column:
    """An array of chunks, in order, as one array: struct of samples and warnings.

    Each chunk overlaps what came before by ``fade`` samples, faded out and in linearly, unless it begins with ``guard`` silent
    samples or more, ``fade`` is under ``least``, or either side is shorter. ``warnings`` counts overlaps whose levels, over
    ``seam`` samples on both sides, differ by more than the share ``jump`` of the louder one. Null and empty chunks are skipped. The fold
    holds on to the last samples alone; what is settled is kept as pieces that are put together once.
    """
    keep = max(fade, seam)
    zero = F.struct(F.array().cast("array<array<double>>").alias("done"), F.array().cast("array<double>").alias("tail"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("warnings"))
    last = lambda a, k: F.slice(a, F.greatest(F.size(a) - k, F.lit(0)) + 1, F.lit(k))
    first = lambda a, k: F.slice(a, 1, F.greatest(k, F.lit(0)))

    def step(s, chunk):
        n, had = F.size(chunk), F.size(s["tail"])
        quiet = (n >= guard) & ~F.exists(F.slice(chunk, 1, F.lit(guard)), lambda x: F.abs(x) > silent)
        over = (s["n"] > 0) & ~quiet & F.lit(fade >= least) & (s["n"] >= fade) & (n >= fade)
        out, come = last(s["tail"], fade), F.slice(chunk, 1, F.lit(fade))
        mixed = F.zip_with(F.zip_with(out, F.sequence(F.lit(0), F.lit(max(fade - 1, 0))), lambda x, i: x * (1 - i / F.lit(float(max(fade - 1, 1))))), F.transform(come, lambda x, i: x * (i / F.lit(float(max(fade - 1, 1))))), lambda x, y: x + y)
        a, b = rms(last(s["tail"], seam)), rms(F.slice(chunk, 1, F.lit(seam)))
        pop = (s["n"] >= seam) & (n >= seam) & ((a >= 1e-6) | (b >= 1e-6)) & (F.abs(a - b) / F.greatest(a, b, F.lit(1e-3)) > jump)
        whole = F.when(over, F.concat(first(s["tail"], had - fade), mixed, F.slice(chunk, F.lit(fade + 1), F.greatest(n - fade, F.lit(0))))).otherwise(F.concat(s["tail"], chunk))

        def settled(w):
            return F.struct(
                F.concat(s["done"], F.array(first(w, F.size(w) - keep))).alias("done"), last(w, keep).alias("tail"),
                (s["n"] + n - F.when(over, fade).otherwise(0)).cast("long").alias("n"), (s["warnings"] + (over & pop).cast("long")).alias("warnings"),
            )

        return bound(whole, settled)

    some = F.filter(chunks, lambda c: F.size(c) > 0)
    return F.aggregate(some, zero, step, lambda s: F.struct(F.concat(F.flatten(s["done"]), s["tail"]).alias("samples"), s["warnings"].alias("warnings")))
