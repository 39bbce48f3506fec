"""Overlap of two placed blocks and which of them survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions import text as T
from glyphtrail.functions.geometry import Box, overlap_ratio

from .blocks import rename, side

CONFIDENCE_MAD, SAME_PLACE, GIANT_TIMES = 0.1, 0.70, 3.0


def threshold_for(text: Column) -> Column:
    """Share of overlap that makes two blocks one, by script and length."""
    cjk = T.cjk_fraction(text)
    return F.when(cjk >= 0.6, 0.35).when((cjk < 0.3) & (F.length(text) <= 8), 0.65).otherwise(0.50)


def quality(pconf: Column, tconf: Column) -> Column:
    return 0.4 * pconf + 0.6 * tconf


def checks_overlap(new: str, old: str, threshold: Column, margin: Column | float = 0.0) -> Column:
    """Whether the new row overlaps the old one enough, in comparable coordinates."""
    a, b = side(new), side(old)
    inner = (F.col(f"{new}kind") == "inner") & (F.col(f"{old}kind") == "inner")
    a = Box(a.left, a.top - F.when(inner, F.col(f"{new}inner_top")).otherwise(0.0), a.right, a.bottom - F.when(inner, F.col(f"{new}inner_top")).otherwise(0.0))
    b = Box(b.left, b.top - F.when(inner, F.col(f"{old}inner_top")).otherwise(0.0), b.right, b.bottom - F.when(inner, F.col(f"{old}inner_top")).otherwise(0.0))
    same_view = (F.col(f"{new}kind") == "viewport") == (F.col(f"{old}kind") == "viewport")
    same_carousel = (F.col(f"{new}hz") < 0) | (F.col(f"{old}hz") < 0) | (F.col(f"{new}hz") == F.col(f"{old}hz"))
    smaller = F.least(a.area, b.area)
    return same_view & same_carousel & (smaller > 0) & (F.try_divide(a.grow(margin).common_area(b), smaller) >= threshold)


def resolve(new: str, old: str, ratio: Column, fence: float | None = None) -> Column:
    """'evict' the old row, 'drop' the new one, or 'keep' both."""
    a, b = side(new).area, side(old).area
    qa, qb = (quality(F.col(f"{p}pconf"), F.col(f"{p}tconf")) for p in (new, old))
    limit = F.lit(fence) if fence is not None else GIANT_TIMES * a
    giant = (a > 0) & (qa >= qb) & (b > limit)
    margin = F.when(ratio >= SAME_PLACE, 0.0).otherwise(CONFIDENCE_MAD)
    return (
        F.when(F.col(f"{new}weight") > F.col(f"{old}weight"), "evict").when(F.col(f"{new}weight") < F.col(f"{old}weight"), "drop")
        .when(giant, "evict").when(qa >= qb + margin, "evict").otherwise("keep")
    )


def overlapping_pairs(blocks: DataFrame, scope: list[str], step: float = 100.0) -> DataFrame:
    """Unordered pairs of one capture with a common area, once each.

    A rectangle is registered in every grid row it crosses; a pair counts in the first
    row both have, so that it appears once.
    """
    rows = F.sequence(F.floor(F.col("t") / step).cast("long"), F.floor(F.col("b") / step).cast("long"))
    placed = blocks.where("r > l and b > t").select("*", F.explode(rows).alias("band"))
    keep = (*scope, "band")
    pairs = rename(placed, "f_", keep).join(rename(placed, "c_", keep), [*scope, "band"]).where("f_id < c_id")
    first = F.floor(F.greatest("f_t", "c_t") / step).cast("long")
    common = side("f_").common_area(side("c_"))
    return pairs.where((F.col("band") == first) & (common > 0)).withColumn("common", common).drop("band")


def shape(common: Column, a: Column, b: Column) -> Column:
    """How two overlapping rectangles lie: one inside the other, the same, or partly."""
    small, big = F.try_divide(common, F.least(a, b)), F.try_divide(common, F.greatest(a, b))
    return F.when((small >= 0.9) & (big < 0.5), "small-inside-large").when((small >= 0.5) & (big >= 0.5), "near-duplicate").otherwise("partial")


def ratio(new: str, old: str, margin: Column | float = 0.0) -> Column:
    return overlap_ratio(side(new), side(old), margin)
