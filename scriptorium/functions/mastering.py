"""A chain of effects on sample arrays, step by step, as Column functions."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.audio import decibels, peak, rms, scaled
from scriptorium.functions.text import bound

_log = logging.getLogger(__name__)


def _level(db: float) -> float:
    return 10 ** (db / 20)


def noise_gate(samples, threshold_db: float = -40.0) -> Column:
    """Samples at or under the threshold are silent."""
    return F.transform(samples, lambda x: F.when(F.abs(x) > _level(threshold_db), x).otherwise(x * 0.0))


def compressor(samples, threshold_db: float = -20.0, ratio: float = 4.0) -> Column:
    """What is above the threshold keeps one part in ``ratio`` of its excess."""
    t = _level(threshold_db)
    return F.transform(samples, lambda x: F.when(F.abs(x) > t, x * (1 - (1 - 1 / ratio) * ((F.abs(x) - t) / F.abs(x)))).otherwise(x))


def limiter(samples, ceiling_db: float = -1.0) -> Column:
    top = F.lit(_level(ceiling_db))
    return F.transform(samples, lambda x: F.greatest(-top, F.least(top, x)))


def harmonic_exciter(samples, amount: float = 0.1) -> Column:
    return F.transform(samples, lambda x: x * (1 - amount) + F.tanh(x * (1 + amount * 2)) * amount)


def stereo_widener(samples, width_percent: float = 0.0) -> Column:
    """One channel cannot be widened."""
    return samples


def loudness(samples, target_db: float = -20.0, max_peak_db: float = -1.0, least_db: float = -60.0) -> Column:
    """The array at a level, or at the peak that it may have; a silent or empty one stays."""
    gained = bound(samples, lambda a: F.when(F.size(a) == 0, a).when(decibels(rms(a)) < least_db, a).otherwise(scaled(a, F.pow(F.lit(10.0), (target_db - decibels(rms(a))) / 20))))
    top = _level(max_peak_db)
    return bound(gained, lambda a: F.when(peak(a) > top, scaled(a, F.lit(top) / peak(a))).otherwise(a))


EFFECTS = {f.__name__: f for f in (noise_gate, compressor, limiter, harmonic_exciter, stereo_widener, loudness)}


def _applied(effect, params: dict):
    return lambda a: effect(a, **params)


def chain(samples, steps: list[dict]) -> Column:
    """``samples`` after each step in order; a step has a ``type`` and its parameters. Steps of an unknown type, or with
    parameters that it doesn't have, are skipped and logged."""
    for step in steps:
        effect, params = EFFECTS.get(step.get("type")), {k: v for k, v in step.items() if k != "type"}
        try:
            done = effect(F.col("_x"), **params) if effect else None
        except (TypeError, ValueError, ArithmeticError) as e:
            _log.error("effect %s failed: %s", step.get("type"), e)
            continue
        if done is None:
            _log.warning("unknown effect: %s", step.get("type"))
            continue
        samples = bound(samples, _applied(effect, params))
    return samples
