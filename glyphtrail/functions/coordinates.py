"""Coordinate context, hierarchy, drift namespaces and keys of a block.

A block row has: kind ('page', 'inner', 'viewport'), hz (carousel index, -1 for none),
cid (container id or null), inner_top, rect and text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .geometry import Box

REGION = 500.0
BUCKET = 200.0


def hierarchy_weight(kind: Column, hz: Column) -> Column:
    inner, carousel = kind == "inner", hz >= 0
    return F.when(kind == "viewport", 40).when(inner & carousel, 30).when(inner | carousel, 20).otherwise(10)


def region_of(top: Column, size: float = REGION) -> Column:
    return F.floor(top / size).cast("int")


def space_key(weight: Column, kind: Column, cid: Column, top: Column, size: float = REGION) -> Column:
    region = region_of(top, size).cast("string")
    inner = F.when(cid.isNotNull(), F.concat(F.lit("ic:"), cid, F.lit(":"), region)).otherwise("unknown:0")
    return F.when(weight >= 30, "unknown:0").when((weight == 20) & (kind == "inner"), inner).otherwise(F.concat(F.lit("normal:"), region))


def region_index(key: Column) -> Column:
    return F.coalesce(F.substring_index(key, ":", -1).try_cast("int"), F.lit(0))


def excluded_from_drift(weight: Column, hz: Column, cid: Column) -> Column:
    return (weight >= 30) | ((weight == 20) & ((hz >= 0) | cid.isNull()))


def flag_fault(kind: Column, isc: Column, hsc: Column, cid: Column, hz: Column) -> Column:
    """The first illegal mix of coordinate flags, or null."""
    return (
        F.when(~isc & cid.isNotNull(), "container_without_inner").when((kind == "viewport") & (isc | hsc), "viewport_excludes_others")
        .when(hsc != (hz >= 0), "carousel_flag_mismatch")
    )


def bucket_sizes(width: Column, height: Column) -> tuple[Column, Column]:
    """Grid cell of a viewport: a share of its size within limits."""
    low, high = F.lit(80.0), F.lit(220.0)
    return F.least(F.greatest(0.18 * width, low), high), F.least(F.greatest(0.15 * height, low), high)


def cell_axes(box: Box, inner_top: Column, bw: float | Column = BUCKET, bh: float | Column = BUCKET) -> tuple[Column, Column, Column]:
    """Column, row and inner-relative row of the cell of a block's centre."""
    row = F.round(box.center_y / bh).cast("long")
    return F.round(box.center_x / bw).cast("long"), row, F.round((box.center_y - inner_top) / bh).cast("long")


def block_key(kind: Column, hz: Column, rect: Column, inner_top: Column, text: Column, scale: float = 1.0, bw: float = BUCKET, bh: float = BUCKET, dx: int = 0, dy: int = 0) -> Column:
    """The dedup key: prefix, cell, scale and text. The text stands in for its hash."""
    box = Box.of(rect)
    plain = T.normalize_whitespace(text)
    cjk = T.cjk_only(text)
    view = F.concat(F.lit("vr:"), F.when(F.length(cjk) >= 3, T.short_head(cjk, 20)).otherwise(T.short_head(plain, 30)))
    prefix = F.concat(F.when(kind == "inner", "ic:").otherwise(""), F.when(hz >= 0, F.concat(F.lit("hz"), hz.cast("string"), F.lit(":"))).otherwise(""))
    top = box.top - F.when(kind == "inner", inner_top).otherwise(0.0)
    column, row = F.round(box.left / bw).cast("long") + dx, F.round(top / bh).cast("long") + dy
    spot = F.concat(prefix, column.cast("string"), F.lit(":"), row.cast("string"), F.lit(f":s{int(scale * 10 + 0.5)}:"))
    return F.when(kind == "viewport", view).otherwise(F.concat(spot, plain))


def neighbor_keys(kind: Column, hz: Column, rect: Column, inner_top: Column, text: Column, **sizes: float) -> Column:
    """The key at the eight cells around; none for viewport blocks."""
    around = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
    keys = F.array(*[block_key(kind, hz, rect, inner_top, text, dx=x, dy=y, **sizes) for x, y in around])
    return F.when(kind == "viewport", F.array().cast("array<string>")).otherwise(keys)


def group_signature(texts: Column) -> Column:
    """0 for at most one text, else a hash that does not depend on order."""
    return F.when(F.size(texts) <= 1, F.lit(0)).otherwise(F.xxhash64(F.array_join(F.array_sort(texts), "\x1f")))
