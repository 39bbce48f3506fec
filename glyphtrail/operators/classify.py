"""Project recognised groups to page coordinates and classify their context.

Groups and the geometry of their capture meet in one equi-join on the capture. All
tests are array expressions over the capture's few rectangles, so nothing leaves the
JVM. Groups that are excluded, animating or too tall are reported with the reason.

Group columns: session_id, cap, id, l, t, r, b (image pixels), text, conf.
Geometry columns: session_id, cap, scale, scroll_x, scroll_y, page_top, view_height,
inner (struct top, height, cid or null), sticky (array of struct<rect array<double>,
fixed boolean>), exclusions (array of array<double>), carousels (array of struct<rect
array<double>, scroll_left double, animating boolean>), age_ms.
Position columns, if there is a table of last known positions: session_id, text, x, y,
where the text stood before, and cap if that differs by capture. Without a table, or for a text not in it,
stability is neutral; of several positions of a text the nearest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrail.functions import confidence as conf
from glyphtrail.functions.geometry import Box, distance
from glyphtrail.functions.stats import fence_limits

EXCLUSION, MIN_SHARE, DEFAULT_SHARE, STICKY_COVER = 0.5, 0.30, 0.6, 0.5


def _cover(box: Box, rect: Column) -> Column:
    """Share of ``box`` that ``rect`` covers; 1 for a box without area."""
    return F.when(box.area <= 0, 1.0).otherwise(F.try_divide(box.common_area(Box.of(rect)), box.area))


def height_fence(groups: DataFrame) -> DataFrame:
    """Adds the upper outlier fence of block heights of the capture, null for few."""
    w = Window.partitionBy("session_id", "cap").orderBy("h", "id")
    every = Window.partitionBy("session_id", "cap")
    rows = groups.withColumn("place", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(every))
    half = F.floor(F.col("n") / 2)
    pick = lambda low: (F.max(F.when(F.col("place") == low + F.floor((half - 1) / 2), F.col("h"))).over(every) + F.max(F.when(F.col("place") == low + F.floor(half / 2), F.col("h"))).over(every)) / 2
    upper = fence_limits(F.col("n"), pick(F.lit(0)), pick(F.col("n") - half), F.min("h").over(every), F.max("h").over(every))[1]
    return rows.withColumn("fence", upper).drop("place", "n")


def classify(groups: DataFrame, geometry: DataFrame, exclusion: float = EXCLUSION, positions: DataFrame | None = None) -> DataFrame:
    """One row per group: fate, context, page rectangle and confidences."""
    per = F.when(F.col("scale") > 0.001, 1 / F.col("scale")).otherwise(1.0)
    rows = groups.join(geometry, ["session_id", "cap"])
    for e in "ltrb":
        rows = rows.withColumn(e, F.col(e) * per)
    rows = height_fence(rows.withColumn("h", F.col("b") - F.col("t")))
    box = Box(*[F.col(e) for e in "ltrb"])
    x, y = box.center_x, box.center_y
    held = F.filter("sticky", lambda s: Box.of(s["rect"]).contains(x, y) & (_cover(box, s["rect"]) >= STICKY_COVER))
    rows = rows.withColumn("holder", F.get(held, F.lit(0)))
    rows = rows.withColumn("is_sticky", F.col("holder").isNotNull()).withColumn("from_sticky", F.coalesce(~F.col("holder.fixed"), F.lit(False)))
    excluded = ~F.col("is_sticky") & (box.area > 0) & F.exists("exclusions", lambda e: _cover(box, e) >= exclusion)
    lane = F.array_position(F.transform("carousels", lambda c: Box.of(c["rect"]).contains(x, y)), True).cast("int") - 1
    rows = rows.withColumn("excluded", excluded).withColumn("hz", F.coalesce(lane, F.lit(-1)))
    rows = rows.withColumn("carousel", F.get("carousels", F.when(F.col("hz") >= 0, F.col("hz"))))
    deferred = ~F.col("is_sticky") & F.coalesce(F.col("carousel.animating"), F.lit(False))
    top = F.col("inner.top") - F.col("page_top")
    inner = ~F.col("is_sticky") & F.coalesce((y >= top) & (y < top + F.col("inner.height")), F.lit(False))
    limit = F.greatest(F.coalesce("fence", DEFAULT_SHARE * F.col("view_height")), MIN_SHARE * F.col("view_height"))
    tall = (F.col("view_height") > 0) & (F.col("h") > limit)
    rows = rows.withColumn("in_inner", inner)
    up = F.when(F.col("is_sticky"), 0.0).when(F.col("in_inner"), F.col("scroll_y")).otherwise(F.col("page_top"))
    side = F.when(F.col("is_sticky"), 0.0).otherwise(F.coalesce("carousel.scroll_left", "scroll_x"))
    page = box.shift(side, up)
    kind = F.when(F.col("is_sticky"), "viewport").when(F.col("in_inner"), "inner").otherwise("page")
    fate = F.when(F.col("excluded"), "excluded").when(deferred, "deferred").when(tall, "too_tall").otherwise("classified")
    height = F.col("b") - F.col("t")
    text = F.when(F.col("conf").isNull() | F.isnan("conf"), conf.raw_text_confidence(F.col("text"), box.width, height)).otherwise(F.col("conf"))
    if positions is None:
        stable = F.lit(0.5)
    else:
        rows = _moved(rows, positions, page)
        stable = conf.stability(F.col("delta"), F.col("mean_height"))
    pos = conf.position_confidence(conf.freshness(F.col("age_ms")), stable)
    return rows.select("session_id", "cap", "id", fate.alias("fate"), kind.alias("kind"), F.when(F.col("is_sticky"), -1).otherwise(F.col("hz")).alias("hz"), "from_sticky", F.when(F.col("in_inner"), F.col("inner.cid")).alias("cid"), *[F.round(e, 6).alias(n) for n, e in zip("ltrb", page.edges)], F.round(pos, 6).alias("pconf"), F.round(text, 6).alias("tconf"))


def _moved(rows: DataFrame, positions: DataFrame, page: Box) -> DataFrame:
    """Adds ``delta``, how far a text is from where it stood, and the capture's mean height."""
    key = [c for c in ("session_id", "cap", "text") if c in positions.columns]
    placed = rows.withColumn("page_x", page.left).withColumn("page_y", page.top).withColumn("mean_height", F.avg(F.col("b") - F.col("t")).over(Window.partitionBy("session_id", "cap")))
    met = placed.select("session_id", "cap", "text", "id", "page_x", "page_y").join(positions.select(*key, "x", "y"), key)
    away = met.groupBy("session_id", "cap", "id").agg(F.min(distance(F.col("page_x") - F.col("x"), F.col("page_y") - F.col("y"))).alias("delta"))
    return placed.join(away, ["session_id", "cap", "id"], "left")
