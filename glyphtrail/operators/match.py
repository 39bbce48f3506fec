"""Match fresh blocks to tracked ones by text similarity over the grid.

A neighbour with equal text is as similar as can be, so equal texts are joined first, by
a hash of the text and without any score; only rows left over meet all neighbours in the
cells around them. There the tracked side, slim, is the one that is copied to nine cells.

The best candidate is an aggregation with one comparable struct (``max_by``), not a
sort: partial maxima are taken on the map side, so a fresh row with very many candidates
costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions import text as T
from glyphtrail.functions.geometry import distance, overlap_ratio

from . import spatial
from .blocks import rename, side

NESTED_COVER = 0.8
BAND_OVERLAP = 0.80

_SLIM = ("id", "kind", "inner_top", *"ltrb", "sig")


def same_view(f: str = "f_", c: str = "c_") -> Column:
    return (F.col(f + "kind") == "viewport") == (F.col(c + "kind") == "viewport")


def _allowed(share: float) -> Column:
    """The largest distance at which the ratio of a pair is still at least ``share``."""
    longer = F.greatest(F.length("f_sig"), F.length("c_sig"))
    return F.floor((1 - share) * longer + 1e-9).cast("int")


def _ratio(gap: Column) -> Column:
    return 1.0 - gap / F.greatest(F.length("f_sig"), F.length("c_sig"))


def similar_candidates(fresh: DataFrame, tracked: DataFrame, scope: list[str], **sizes: float) -> DataFrame:
    """Neighbouring pairs with ``lev`` that pass the match test.

    Both sides have the number of different letters of their text, ``letters``. The distance is given up as soon as it is too large, and the character sets are
    compared only if their sizes allow it. Scores are made by a generator, which keeps
    the optimizer from working them out once for the filter and once for the result.
    """
    pairs = spatial.candidates(fresh, tracked, scope, extra=same_view() & (F.length("f_sig") > 0) & (F.length("c_sig") > 0), **sizes)
    m, n = F.col("f_letters"), F.col("c_letters")
    common = F.size(F.array_intersect(T.char_set(F.col("f_sig")), T.char_set(F.col("c_sig"))))
    gap = F.call_function("levenshtein", F.col("f_sig"), F.col("c_sig"), _allowed(T.LEVENSHTEIN_MATCH))
    alike = (F.least(m, n) >= T.JACCARD_MATCH * F.greatest(m, n)) & (common / (m + n - common) >= T.JACCARD_MATCH)
    scored = pairs.withColumn("s", F.explode(F.array(F.struct(gap.alias("gap"), alike.alias("alike")))))
    kept = scored.where((F.col("s.gap") >= 0) | F.col("s.alike"))
    return kept.withColumn("lev", F.when(F.col("s.gap") >= 0, _ratio(F.col("s.gap"))).otherwise(_ratio(F.levenshtein("f_sig", "c_sig")))).drop("s")


def _best(pairs: DataFrame, scope: list[str], carry: tuple[str, ...]) -> Column:
    """The best candidate of a fresh row: similarity, distance of centres, rectangle."""
    a, b = side("f_"), side("c_")
    dist = distance(a.center_x - b.center_x, a.center_y - b.center_y)
    order = F.when(F.col("c_id").isNotNull(), F.struct(F.col("lev"), -F.round(dist, 9), *[-F.col("c_" + e) for e in "tlrb"], -F.col("c_id")))
    return F.max_by(F.struct("c_id", "lev", dist.alias("dist"), "c_sig", *[F.col("c_" + x).alias("v_" + x) for x in carry]), order).alias("m")


def primary_match(fresh: DataFrame, tracked: DataFrame, scope: list[str], carry: tuple[str, ...] = (), **sizes: float) -> DataFrame:
    """The best similar candidate of every fresh row that has one.

    Order: similarity, distance of centres, then the rectangle. Columns: scope, f_id,
    c_id, lev, jac, dist, and ``carry`` columns of both sides. Ids of fresh rows are
    unique within the scope.
    """
    extra = [x for x in carry if x not in _SLIM]
    left = rename(fresh.select(*scope, *_SLIM, *extra), "f_", tuple(scope))
    right = rename(tracked.select(*scope, *_SLIM, *extra), "c_", tuple(scope))
    same = [F.col(x) == F.col("k_" + x) for x in scope]
    keyed = right.select(*[F.col(x).alias("k_" + x) if x in scope else F.col(x) for x in right.columns]).where(F.length("c_sig") > 0)
    met = left.join(keyed, [*same, F.col("f_sig") == F.col("c_sig"), same_view(), spatial.near("f_", "c_", **sizes)], "left").withColumn("lev", F.lit(1.0))
    whole = F.struct(*[c for c in left.columns if c not in (*scope, "f_id")])
    first = met.groupBy(*scope, "f_id").agg(F.first(whole).alias("f"), _best(met, scope, carry))
    done = first.where("m is not null").select(*scope, "f_id", "f.*", "m.*")
    rest = first.where("m is null").select(*scope, "f_id", "f.*")
    rest = rest.select(*scope, *[F.col(c).alias(c[2:]) for c in left.columns if c not in scope])
    letters = F.size(T.char_set(F.col("sig"))).alias("letters")
    pairs = similar_candidates(rest.select("*", letters), tracked.select(*scope, *_SLIM, letters), scope, **sizes)
    second = pairs.groupBy(*scope, "f_id").agg(F.first(F.struct(*["f_" + c for c in (*_SLIM[1:], *extra)])).alias("f"), _best(pairs, scope, ())).select(*scope, "f_id", "f.*", "m.*")
    if carry:
        more = tracked.select(*scope, F.col("id").alias("c_id"), *[F.col(x).alias("v_" + x) for x in carry])
        second = second.join(more, [*scope, "c_id"])
    both = done.unionByName(second)
    jac = T.jaccard(T.char_set(F.col("f_sig")), T.char_set(F.col("c_sig")))
    return both.select(*scope, "f_id", "c_id", "lev", jac.alias("jac"), "dist", *["f_" + x for x in carry], *[F.col("v_" + x).alias("c_" + x) for x in carry])


def band_funnel(fresh: DataFrame, tracked: DataFrame, scope: list[str], lev_floor: float = 0.50, jac_floor: float = 0.60, observations: int = 4) -> DataFrame:
    """Counters of the relaxed match in observe-only mode, per scope.

    The spatial test runs without drift. Every candidate that is not a primary match is
    counted once, in the first stage that stops it.
    """
    slim = lambda x: x.select(*scope, *_SLIM, "chars", "obs")
    pairs = spatial.candidates(slim(fresh), slim(tracked), scope, extra=same_view() & ((F.col("f_sig") != F.col("c_sig")) | (F.length("f_sig") == 0)))
    gap = F.call_function("levenshtein", F.col("f_sig"), F.col("c_sig"), _allowed(min(lev_floor, T.LEVENSHTEIN_MATCH)))
    m, n = F.size("f_chars"), F.size("c_chars")
    common = F.size(F.array_intersect("f_chars", "c_chars"))
    # Letters are only compared where their numbers leave open that they are alike.
    jac = F.when(F.least(m, n) < min(jac_floor, T.JACCARD_MATCH) * F.greatest(m, n), 0.0).otherwise(F.when(m + n == 0, 1.0).otherwise(common / F.greatest(m + n - common, F.lit(1))))
    scored = pairs.withColumn("s", F.explode(F.array(F.struct(gap.alias("gap"), jac.alias("jac")))))
    gap, longer = F.col("s.gap"), F.greatest(F.length("f_sig"), F.length("c_sig"))
    lev = F.when(longer == 0, 1.0).when((F.length("f_sig") == 0) | (F.length("c_sig") == 0), 0.0).when(gap >= 0, 1.0 - gap / F.greatest(longer, F.lit(1))).otherwise(0.0)
    rest = scored.where(~T.text_similar(lev, F.col("s.jac"), F.col("f_sig"), F.col("c_sig")))
    near = overlap_ratio(side("f_"), side("c_")) >= BAND_OVERLAP
    stage = F.when(F.col("c_obs") < observations, "floor").when(~near, "spatial").when((lev < lev_floor) & (F.col("s.jac") < jac_floor), "text").otherwise("identified")
    count = lambda s: F.count(F.when(stage == s, 1)).alias(s)
    return rest.groupBy(*scope).agg(F.count(F.lit(1)).alias("considered"), count("floor").alias("rejected_floor"), count("spatial").alias("rejected_spatial"), count("text").alias("rejected_text"), count("identified").alias("identified"))


def nested_hosts(fresh: DataFrame, tracked: DataFrame, scope: list[str]) -> DataFrame:
    """The smallest tracked block that holds a fresh fragment of its text."""
    slim = lambda x, *more: x.select(*scope, "id", "kind", "hz", "inner_top", *"ltrb", "sig", *more)
    pairs = spatial.region(slim(fresh), slim(tracked, "obs", "provisional"), scope)  # fresh rows are h_, tracked ones p_
    f, c = side("h_"), side("p_")
    fits = (
        ~F.col("p_provisional") & (F.col("p_obs") >= 1) & (F.col("h_kind") != "viewport")
        & ((F.col("h_hz") < 0) | (F.col("p_hz") < 0) | (F.col("h_hz") == F.col("p_hz"))) & (f.area > 0) & (c.area > f.area)
        & (F.try_divide(f.common_area(c), f.area) >= NESTED_COVER)
    )
    window = T.best_window(F.col("h_sig"), F.col("p_sig"))
    hit = pairs.where(fits).withColumn("window", window).where(F.col("window") >= T.LEVENSHTEIN_MATCH)
    best = hit.groupBy(*scope, F.col("h_id").alias("f_id")).agg(F.min(F.struct(F.round(c.area, 6).alias("area"), F.col("p_id").alias("c_id"), F.col("window"))).alias("m"))
    return best.select(*scope, "f_id", "m.c_id", "m.window")


def consecutive(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, tracked) views of one table: every capture against the one before it."""
    return blocks, blocks.withColumn("cap", F.col("cap") + 1)


def as_of(terminals: DataFrame, stamps: DataFrame, scope: list[str], reach: float = 200.0) -> DataFrame:
    """The latest stamp with the same text, not after, within ``reach`` of each terminal.

    Cells of the size of the reach are part of the join key. Columns: scope, id, stamp_id,
    latency (null if there is none).
    """
    x, y = F.floor((F.col("l") + F.col("r")) / 2 / reach), F.floor((F.col("t") + F.col("b")) / 2 / reach)
    near = F.array(*[F.struct((x + i).alias("x"), (y + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    keys = [*scope, "text", "cell"]
    left = rename(terminals.select(*scope, "text", "id", "cap", *"ltrb", F.explode(near).alias("cell")), "f_", tuple(keys))
    right = rename(stamps.select(*scope, "text", "id", "cap", *"ltrb", F.struct(x.alias("x"), y.alias("y")).alias("cell")), "c_", tuple(keys))
    a, b = side("f_"), side("c_")
    close = distance(a.center_x - b.center_x, a.center_y - b.center_y) <= reach
    hits = left.join(right, keys).where((F.col("c_cap") <= F.col("f_cap")) & close)
    best = hits.groupBy(*scope, F.col("f_id").alias("id")).agg(F.max(F.struct(F.col("c_cap").alias("cap"), (-F.col("c_id")).alias("turn"))).alias("m"))
    out = terminals.join(best, [*scope, "id"], "left")
    return out.select(*scope, "id", (-F.col("m.turn")).alias("stamp_id"), (F.col("cap") - F.col("m.cap")).alias("latency"))
