"""Confidence of captures, positions and recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .geometry import clamp


def freshness(age_ms: Column) -> Column:
    return F.when(age_ms < 200, 1.0).when(age_ms > 2000, 0.3).otherwise(1.0 - (age_ms - 200) / 1800.0 * 0.7)


def stability(delta: Column, height: Column) -> Column:
    """Neutral without a delta; the limits scale with the reference height if known."""
    known = height.isNotNull() & (height > 0)
    low = F.when(known, clamp(0.15 * height, 5.0, 20.0)).otherwise(10.0)
    high = F.when(known, clamp(height, 30.0, 120.0)).otherwise(60.0)
    line = 1.0 - (delta - low) / (high - low) * 0.7
    return F.when(delta.isNull(), 0.5).when(delta <= low, 1.0).when(delta >= high, 0.3).otherwise(line)


def position_confidence(fresh: Column, stable: Column) -> Column:
    return clamp(0.5 * fresh + 0.5 * stable, 0.0, 1.0)


def raw_text_confidence(text: Column, width: Column, height: Column) -> Column:
    """Heuristic from script, letter variety and shape, without a recogniser's score."""
    n = F.length(text)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    dominance = F.array_max(counts) / F.greatest(n, F.lit(1))
    variety = F.when(n <= 2, 0.5).when(dominance > 0.6, 0.5 + 0.5 * (1 - dominance)).otherwise(1.0)
    shape = F.try_divide(width, height * n)
    aspect = F.when(shape > 3, 0.6).when(shape > 2, 0.8).otherwise(1.0)
    score = 0.5 * (0.5 + 0.4 * T.cjk_fraction(text)) + 0.3 * variety + 0.2 * aspect
    return F.when(n == 0, 0.3).otherwise(score)


def weighted_text_confidence(conf: Column, text: Column) -> Column:
    """Aggregate: mean confidence weighted by length; null if there is none."""
    good = conf.isNotNull() & ~F.isnan(conf)
    weight = F.when(good, F.length(text)).otherwise(0)
    return F.try_divide(F.sum(F.when(good, conf * F.length(text))), F.sum(weight).cast("double"))
