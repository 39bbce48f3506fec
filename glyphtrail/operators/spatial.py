"""Grid joins: fuzzy spatial neighbourhoods as hash equi-joins on cells.

Every block has one cell in the absolute layer and, inside a scroller, a second one
relative to the scroller. Blocks are neighbours if one's cell is among the nine around
the other's, so it is the smaller, tracked side that is copied to nine cells. The join
key includes the scope columns, so a session of any size spreads over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions import coordinates as C
from glyphtrail.functions.geometry import Box

from .blocks import box, rename


def _cells(df: DataFrame, bw: float, bh: float, reach: int) -> Column:
    """Cell structs (layer, column, row) within ``reach`` of the block's own."""
    column, row, inner = C.cell_axes(box(), F.col("inner_top"), bw, bh)
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    view = F.col("kind") == "viewport"

    def around(layer: Column, at: Column) -> Column:
        return F.flatten(F.transform(steps, lambda x: F.transform(steps, lambda y: F.struct(layer.alias("layer"), (column + x).alias("x"), (at + y).alias("y")))))

    own = around(F.when(view, "vr").otherwise("abs"), row)
    return F.when(F.col("kind") == "inner", F.concat(own, around(F.lit("ic"), inner))).otherwise(own)


def cells(df: DataFrame, bw: float = C.BUCKET, bh: float = C.BUCKET) -> DataFrame:
    """One row per block and layer: the cell it is stored in."""
    return df.select("*", F.explode(_cells(df, bw, bh, 0)).alias("cell"))


def candidates(fresh: DataFrame, tracked: DataFrame, scope: list[str], bw: float = C.BUCKET, bh: float = C.BUCKET, extra: Column | None = None) -> DataFrame:
    """Pairs of fresh (``f_``) and tracked (``c_``) rows in neighbouring cells.

    The tracked side is copied to the cells around its own, with all its columns: give
    it only those that the join needs. Pairs found in both layers come once. ``extra``
    is a further condition on the pair, tested inside the join.
    """
    left = rename(cells(fresh, bw, bh), "f_", (*scope, "cell"))
    right = rename(tracked.select("*", F.explode(_cells(tracked, bw, bh, 1)).alias("cell")), "c_", (*scope, "cell"))
    met = left.join(right, [*scope, "cell"])
    # A pair of inner blocks may meet in two layers; keep the absolute meeting if any.
    once = (F.col("cell.layer") != "ic") | ~_beside("f_", "c_", bw, bh)
    return met.where(once if extra is None else once & extra).drop("cell")


def _spot(prefix: str, bw: float, bh: float) -> tuple[Column, Column, Column]:
    box = Box(*[F.col(prefix + e) for e in "ltrb"])
    return C.cell_axes(box, F.col(prefix + "inner_top"), bw, bh)


def _beside(f: str, c: str, bw: float, bh: float) -> Column:
    (x, y, _), (u, v, _) = _spot(f, bw, bh), _spot(c, bw, bh)
    return (F.abs(x - u) <= 1) & (F.abs(y - v) <= 1)


def near(f: str = "f_", c: str = "c_", bw: float = C.BUCKET, bh: float = C.BUCKET) -> Column:
    """Whether two blocks of the same view are in neighbouring cells of a layer they share."""
    (x, _, y), (u, _, v) = _spot(f, bw, bh), _spot(c, bw, bh)
    inner = (F.col(f + "kind") == "inner") & (F.col(c + "kind") == "inner") & (F.abs(x - u) <= 1) & (F.abs(y - v) <= 1)
    return _beside(f, c, bw, bh) | inner


def region(hosts: DataFrame, page: DataFrame, scope: list[str], bw: float = C.BUCKET, bh: float = C.BUCKET) -> DataFrame:
    """Pairs of hosts (``h_``) and page-layer rows (``p_``) of the cells a host covers.

    Coarse on purpose: one more ring than the rectangle needs; exact tests follow (J2b).
    """
    xs = F.sequence((F.floor(F.col("l") / bw) - 1).cast("long"), (F.ceil(F.col("r") / bw) + 1).cast("long"))
    ys = F.sequence((F.floor(F.col("t") / bh) - 1).cast("long"), (F.ceil(F.col("b") / bh) + 1).cast("long"))
    spots = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    left = rename(hosts.select("*", F.explode(spots).alias("spot")), "h_", (*scope, "spot"))
    column, row, _ = C.cell_axes(box(), F.col("inner_top"), bw, bh)
    right = rename(page.where("kind <> 'viewport'").select("*", F.struct(column.alias("x"), row.alias("y")).alias("spot")), "p_", (*scope, "spot"))
    return left.join(right, [*scope, "spot"]).drop("spot")
