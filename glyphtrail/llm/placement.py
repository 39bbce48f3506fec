"""Route rectangles so that any two with enough overlap meet in one task.

Two rectangles whose intersection over union is at least 1/2 have heights within a
factor of two of each other, and their tops are at most half a height apart. So each
rectangle lives in one cell, given by the power of two of its height and its top in
steps of twice that, and looks into the few cells where such a partner can live.

A cell may be hot. Cells with more than ``HOT`` inhabitants are split into parts by the
id of the inhabitant, and every visitor is sent to all parts, so that a task never holds
more than about ``HOT`` rows of one cell and no pair is lost. The list of hot cells has
at most (rows / HOT) entries; it is broadcast only below a checked size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 20_000
#: Hot cells that may be broadcast: 24 bytes each.
BROADCAST_CELLS = 100_000


def edges(rect: str) -> list[Column]:
    return [F.get(F.col(rect), i).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def solid() -> Column:
    """Finite edges and a positive area; anything else overlaps nothing."""
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)
    return finite & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))


def _level() -> Column:
    return F.floor(F.log2(F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6)))).cast("int")


def home(df: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``cell``: a hash of the scope columns and the cell the row lives in."""
    level = _level()
    step = F.pow(F.lit(2.0), level + 1)
    return df.withColumn("cell", F.xxhash64(*scope, level, F.floor(F.col("y0") / step).cast("long")))


def visits(df: DataFrame, scope: list[str], *, upward: bool = False) -> DataFrame:
    """One row per cell in which a partner may live.

    ``upward``: only cells not below the row's own one in (level, cell) order, which
    finds every pair of a self-join from one of its two sides (from both within a cell).
    """
    own = _level()
    height = F.col("y1") - F.col("y0")

    def cells(level: Column) -> Column:
        step = F.pow(F.lit(2.0), level + 1)
        slack = step * 1e-9
        low = F.floor((F.col("y0") - step / 2 - slack) / step).cast("long")
        high = F.floor((F.col("y0") + height / 2 + slack) / step).cast("long")
        spots = F.sequence(low, high)
        if upward:
            mine = F.floor(F.col("y0") / F.pow(F.lit(2.0), own + 1)).cast("long")
            spots = F.filter(spots, lambda s: (level > own) | (s >= mine))
        return F.transform(spots, lambda s: F.xxhash64(*scope, level, s))

    levels = [own, own + 1] if upward else [own - 1, own, own + 1]
    return df.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.array(*[cells(x) for x in levels])))))


def crowded(rows: DataFrame, key: str, hot: int) -> DataFrame | None:
    """(key, parts) of the keys with more than ``hot`` rows, ready to join; None for none.

    Broadcast only while there are at most ``BROADCAST_CELLS`` of them.
    """
    found = rows.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    some = found.limit(BROADCAST_CELLS + 1).count()
    return None if not some else F.broadcast(found) if some <= BROADCAST_CELLS else found


def spread(living: DataFrame, visiting: DataFrame, row_id: str, hot: int) -> DataFrame:
    """Both sides with ``part`` and ``side``: hot cells split, their visitors copied."""
    cells = crowded(living, "cell", hot)
    left, right = living.withColumn("side", F.lit(0)), visiting.withColumn("side", F.lit(1))
    if cells is not None:
        left = left.join(cells, "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        copies = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        right = right.join(cells, "cell", "left").withColumn("part", F.explode(copies)).drop("parts")
    else:
        left, right = left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    return left.unionByName(right)


def meet(living: DataFrame, visiting: DataFrame, row_id: str, hot: int = HOT) -> DataFrame:
    """Both sides placed by (cell, part), inhabitants (side 0) before visitors (side 1).

    Both frames have the same columns, ``cell`` among them.
    """
    return spread(living, visiting, row_id, hot).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")


def runs(batches: Iterator[pa.RecordBatch], group: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(group key, inhabitants, visitors) of every group of sorted rows.

    A group with many visitors comes in several pieces with the same list object of
    inhabitants, so memory holds the inhabitants and one piece. Rows are tuples in the
    order of ``rest``.
    """
    at, living, visiting = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in group)))
        sides = batch.column("side").to_pylist()
        rows = zip(*(batch.column(c).to_pylist() for c in rest))
        for key, side, row in zip(keys, sides, rows):
            if key != at:
                if visiting:
                    yield at, living, visiting
                at, living, visiting = key, [], []
            (visiting if side else living).append(row)
        if len(visiting) > 4096:
            yield at, living, visiting
            visiting = []
    if visiting:
        yield at, living, visiting


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two rectangles with positive area."""
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)
