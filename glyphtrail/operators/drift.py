"""Drift of a region: medians over the last twenty displacements of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrail.functions.geometry import block_height, clamp
from glyphtrail.functions.stats import median, stretches

RING, MINIMUM, STRETCH = 20, 3, 4096


def running(df: DataFrame, keys: list[str], order: list[str], dx: str, dy: str, height: str, ring: int = RING) -> DataFrame:
    """Adds the ring size, median drift, median height and margin after each row.

    A row frame of ``ring`` rows bounds every array; unusable numbers are left out first.
    Groups are cut into stretches that overlap by a ring, so none is one task's.
    """
    good = df.where(F.col(dx).isNotNull() & F.col(dy).isNotNull() & ~F.isnan(dx) & ~F.isnan(dy) & (F.abs(dx) < float("inf")) & (F.abs(dy) < float("inf")))
    good = stretches(good, keys, order, STRETCH, ring - 1)
    frame = Window.partitionBy(*keys, "_stretch").orderBy("_rank").rowsBetween(1 - ring, 0)
    rings = good.withColumn("_h", block_height(F.col(height)))
    for name, column in (("_dx", dx), ("_dy", dy), ("_hs", "_h")):
        rings = rings.withColumn(name, F.collect_list(column).over(frame))
    n, tall = F.size("_dx"), median(F.col("_hs"))
    axis = lambda c: F.when(n < MINIMUM, 0.0).otherwise(clamp(median(F.col(c)), -F.col("height"), F.col("height")))
    out = rings.withColumn("samples", n).withColumn("height", tall).withColumn("drift_x", axis("_dx")).withColumn("drift_y", axis("_dy"))
    return out.withColumn("margin", margin(F.col("drift_x"), F.col("drift_y"), F.col("height"))).where("not _echo").drop("_dx", "_dy", "_hs", "_h", "_stretch", "_rank", "_echo")


def margin(dx: Column, dy: Column, height: Column) -> Column:
    return clamp(F.abs(dx) + F.abs(dy), 0.0, height)


def propagation_threshold(height: Column) -> Column:
    return F.greatest(F.lit(2.0), 0.1 * height)


def key_summary(df: DataFrame, keys: list[str], region: Column) -> DataFrame:
    """Observations of every key and its region number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.first(region).alias("region"))


def without_region(df: DataFrame, top: float, bottom: float, region: Column, size: float = 500.0) -> DataFrame:
    """Rows outside the regions between two page offsets, both included."""
    low, high = int(top // size), int(bottom // size)
    return df.where(~region.between(low, high))
