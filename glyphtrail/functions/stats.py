"""Robust statistics over small arrays, and exact order statistics over large groups.

The array forms suit bounded lists such as a ring of twenty values. Groups of unbounded
size go through :func:`ranked`, which sorts by range over all tasks and derives ranks
from per-task counts, so that a group with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrail.context import cut_lineage

MAD_SCALE, IQR_SCALE = 1.4826, 1.35


def _at(arr: Column, i: Column) -> Column:
    return F.get(arr, i.cast("int"))


def median_of_sorted(arr: Column, low: Column | None = None, size: Column | None = None) -> Column:
    """Median of a sorted array or of a slice of it; null if empty."""
    low = F.lit(0) if low is None else low
    n = F.size(arr) if size is None else size
    half = F.floor(n / 2)
    return F.when(n <= 0, None).when(n % 2 == 1, _at(arr, low + half)).otherwise((_at(arr, low + half - 1) + _at(arr, low + half)) / 2)


def median(arr: Column) -> Column:
    return median_of_sorted(F.array_sort(arr))


def mad(arr: Column) -> Column:
    """Scaled median absolute deviation; 0 for one value, null for none."""
    m = median(arr)
    return F.when(F.size(arr) == 1, 0.0).otherwise(MAD_SCALE * median(F.transform(arr, lambda x: F.abs(x - m))))


def hinges(arr: Column) -> tuple[Column, Column]:
    """Medians of the lower and upper half, the middle left out of odd sizes."""
    s = F.array_sort(arr)
    n = F.size(s)
    half = F.floor(n / 2)
    return median_of_sorted(s, F.lit(0), half), median_of_sorted(s, n - half, half)


def iqr(arr: Column) -> Column:
    low, high = hinges(arr)
    return F.when(F.size(arr) < 4, None).otherwise(high - low)


def mad_or_fallback(arr: Column, minimum: float = 1.0) -> Column:
    return fallback_spread(F.size(arr), mad(arr), iqr(arr), median(arr), minimum)


def fallback_spread(n: Column, mad_: Column, iqr_: Column, median_: Column, minimum: float = 1.0) -> Column:
    low = F.lit(minimum)
    return (
        F.when(n < 3, low).when(mad_ > 0, F.greatest(mad_, low)).when(iqr_ > 0, F.greatest(iqr_ / IQR_SCALE, low))
        .when(F.abs(median_) > 0, F.greatest(0.1 * F.abs(median_), low)).otherwise(low)
    )


def fence_limits(n: Column, q1: Column, q3: Column, low: Column, high: Column, minimum: int = 4, k: float | None = None) -> tuple[Column, Column]:
    """Lower and upper outlier fence; null for too few values or no spread at all."""
    spread = F.when(q3 - q1 == 0, (high - low) / 4).otherwise(q3 - q1)
    factor = F.lit(k) if k is not None else F.when(n < 15, 2.2).otherwise(1.5)
    good = (n >= max(2, minimum)) & (spread > 0)
    return F.when(good, q1 - factor * spread), F.when(good, q3 + factor * spread)


def fences(arr: Column, minimum: int = 4, k: float | None = None) -> tuple[Column, Column]:
    q1, q3 = hinges(arr)
    return fence_limits(F.size(arr), q1, q3, F.array_min(arr), F.array_max(arr), minimum, k)


def nearest_rank(arr: Column, p: float) -> Column:
    return _at(F.array_sort(arr), F.round(F.lit(p) * (F.size(arr) - 1)))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part * 1000 / F.nullif(whole, F.lit(0))) / 1000)


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``rank`` (from 0, by value within the keys) and ``n`` of the group.

    Sorted by range over all tasks; a task's rows of a group are consecutive, so a rank
    is a row's place in its task plus the group's rows in earlier tasks. Only counts for
    (group, task) are joined back. The sorted rows are written once so that places hold.
    """
    placed = df.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    placed = cut_lineage(placed.withColumn("_place", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()))
    parts = placed.groupBy(*keys, "_task").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy(*keys).orderBy("_task")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_task").alias("_t"), before.alias("_before"), "_first", F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"))
    same = F.col("_task") == F.col("_t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(offsets, same).withColumn("rank", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_task", "_t", "_first", "_before", *[f"_k_{k}" for k in keys])


def stretches(df: DataFrame, keys: list[str], order: list[str], size: int, halo: int) -> DataFrame:
    """Rows in stretches of ``size`` consecutive rows of their group, for windows of bounded reach.

    Adds ``_stretch``, ``_rank`` (place in the group by ``order``) and ``_echo``: each
    stretch also has the last ``halo`` rows before it, as echoes. A window over
    (keys, _stretch) ordered by _rank then sees what one over the whole group would, for
    frames of up to ``halo`` rows back, and a group of any size spreads over all tasks.
    """
    placed = ranked(df.withColumn("_by", F.struct(*order)), keys, "_by").drop("_by", "n").withColumnRenamed("rank", "_rank")
    own = F.floor(F.col("_rank") / size)
    near = F.when(F.col("_rank") % size >= size - halo, F.array(F.struct(own.alias("s"), F.lit(False).alias("e")), F.struct((own + 1).alias("s"), F.lit(True).alias("e")))).otherwise(F.array(F.struct(own.alias("s"), F.lit(False).alias("e"))))
    return placed.withColumn("_at", F.explode(near)).withColumn("_stretch", F.col("_at.s")).withColumn("_echo", F.col("_at.e")).drop("_at")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 4096) -> DataFrame:
    """``value`` of every row, or the last one before it in its group that is not null.

    Filled inside stretches first; what a stretch starts with comes from a window over
    one row for each stretch.
    """
    placed = stretches(df, keys, order, size, 0).drop("_echo")
    inner = Window.partitionBy(*keys, "_stretch").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_filled", F.last(value, ignorenulls=True).over(inner))
    ends = placed.groupBy(*keys, "_stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_rank"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_s"), F.last("_end", ignorenulls=True).over(before).alias("_start"))
    same = F.col("_stretch") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = filled.join(start, same, "left").withColumn(value, F.coalesce("_filled", "_start"))
    return out.select(*df.columns)


def _pick(value: str, spot: Column) -> Column:
    return F.max(F.when(F.col("rank") == spot, F.col(value)))


def _middle(value: str, low: Column, size: Column) -> Column:
    half = F.floor(size / 2)
    odd, a, b = _pick(value, low + half), _pick(value, low + half - 1), _pick(value, low + half)
    n = F.max(size)
    return F.when(n <= 0, None).when(n % 2 == 1, odd).otherwise((a + b) / 2)


def order_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, n, low, high, median, q1, q3): exact median and hinges of any group."""
    rows = ranked(df.select(*keys, value), keys, value)
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    return rows.groupBy(*keys).agg(F.max("n").alias("n_"), F.min(value).alias("low"), F.max(value).alias("high"), _middle(value, F.lit(0), n).alias("median"), _middle(value, F.lit(0), half).alias("q1"), _middle(value, n - half, half).alias("q3")).withColumnRenamed("n_", "n")


def robust_summary(df: DataFrame, keys: list[str], value: str, minimum: float = 1.0) -> DataFrame:
    """Order statistics with MAD, hinge spread, fallback spread and fences of any group."""
    first = order_statistics(df, keys, value)
    off = df.join(first.select(*keys, "median"), keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("off"))
    second = order_statistics(off, keys, "off").select(*keys, (MAD_SCALE * F.col("median")).alias("mad"))
    out = first.join(second, keys)
    iqr_ = F.when(F.col("n") >= 4, F.col("q3") - F.col("q1"))
    lower, upper = fence_limits(F.col("n"), F.col("q1"), F.col("q3"), F.col("low"), F.col("high"))
    return out.select(*keys, "n", "median", F.when(F.col("n") == 1, 0.0).otherwise(F.col("mad")).alias("mad"), iqr_.alias("iqr"), "q1", "q3", "low", "high", fallback_spread(F.col("n"), F.when(F.col("n") == 1, 0.0).otherwise(F.col("mad")), iqr_, F.col("median"), minimum).alias("spread"), lower.alias("lower_fence"), upper.alias("upper_fence"))


def otsu(df: DataFrame, keys: list[str], value: str, fallback: float | None = None) -> DataFrame:
    """Rows (keys, threshold): the value that splits each group best in two.

    Few values use rules of thumb; from ten on the largest between-class variance at a
    change of value decides, the first of equals, if it explains a fifth of the variance.
    """
    counted = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys).orderBy("v")
    every = Window.partitionBy(*keys)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stats = counted.select(*keys, "v", "c", F.sum("c").over(upto).alias("w0"), F.sum(F.col("c") * F.col("v")).over(upto).alias("s0"), F.sum("c").over(every).alias("n"), F.sum(F.col("c") * F.col("v")).over(every).alias("s"), F.lead("v").over(order).alias("next"))
    w1 = F.col("n") - F.col("w0")
    gap = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("s") - F.col("s0"), w1)
    between = (F.col("w0") / F.col("n")) * (w1 / F.col("n")) * gap * gap
    mean = F.col("s") / F.col("n")
    spread = F.col("c") * (F.col("v") - mean) * (F.col("v") - mean)
    scored = stats.withColumn("between", F.when(F.col("next").isNotNull(), between)).withColumn("spread", spread)
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.round("between", 12).alias("b"), (-F.col("v")).alias("turn"), ((F.col("v") + F.col("next")) / 2).alias("cut"))).alias("best"), (F.sum("spread") / F.max("n")).alias("variance"), F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    middle = order_statistics(df, keys, value).select(*keys, "median")
    m, n = F.col("median"), F.col("n")
    split = F.when((F.col("variance") < 1e-6) | (F.col("best.b") < 0.2 * F.col("variance")), None).otherwise(F.col("best.cut"))
    rule = (
        F.when(n < 2, None).when(F.col("low") == F.col("high"), F.col("low") + 1).when(n < 5, 1.8 * m)
        .when(n < 10, F.when(F.col("high") > 3 * m, (m + F.col("high")) / 2).otherwise(1.8 * m)).otherwise(split)
    )
    return best.join(middle, keys).select(*keys, "n", (rule if fallback is None else F.coalesce(rule, F.lit(fallback))).alias("threshold"))


def number_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, nearest-rank p50 and p90, and max, rounded to three places."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value)
    rows = ranked(clean, keys, value)
    at = lambda p: F.max(F.when(F.col("rank") == F.round(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.round(F.avg(value), 3).alias("mean"), F.round(at(0.5), 3).alias("p50"), F.round(at(0.9), 3).alias("p90"), F.round(F.max(value), 3).alias("high")).withColumnRenamed("n_", "n")
