"""What happens around a match: contradictions, supersession, retention, census, fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glyphtrail.context import cut_lineage
from glyphtrail.functions import text as T
from glyphtrail.functions.geometry import distance
from glyphtrail.functions.stats import order_statistics
from glyphtrail.plans import scalar as S

from . import spatial
from .blocks import side
from .overlap import threshold_for

WELL_OBSERVED = 3
COVER_FLOOR = 0.5
_PIECE = ("id", "kind", "inner_top", *"ltrb", "sig")


def grouping_contradictions(tracked: DataFrame, fresh: DataFrame, scope: list[str]) -> DataFrame:
    """Tracked blocks whose text now appears as several smaller blocks.

    Columns: scope, id (of the tracked block), evidence (fresh ids by top), lev.
    """
    settled = tracked.where((F.col("obs") >= WELL_OBSERVED) & (F.col("kind") != "viewport") & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    pairs = spatial.region(settled.select(*scope, *_PIECE), fresh.select(*scope, *_PIECE, "seq"), scope)
    h, p = side("h_"), side("p_")
    part = (p.height < 0.7 * h.height) & (F.try_divide(h.common_area(p), h.area) >= 0.3)
    pieces = pairs.where(part).groupBy(*scope, F.col("h_id").alias("id")).agg(F.first("h_sig").alias("sig"), F.array_sort(F.collect_list(F.struct(F.col("p_t").alias("t"), F.col("p_seq").alias("seq"), F.col("p_id").alias("id"), F.col("p_sig").alias("sig")))).alias("parts"))
    joined = F.array_join(F.col("parts.sig"), "")
    lev = T.levenshtein_ratio(F.col("sig"), joined)
    return pieces.where(F.size("parts") >= 2).withColumn("lev", lev).where("lev >= 0.60").select(*scope, "id", F.col("parts.id").alias("evidence"), "lev")


def splitting_contradictions(fresh: DataFrame, tracked: DataFrame, scope: list[str]) -> DataFrame:
    """Fresh blocks that swallow several tracked ones.

    Evidence is consumed: a tracked block speaks for the first fresh one that it makes a
    split of, in the order of (seq, id). Only candidate pieces reach the ordered pass,
    which holds one fresh block and the tracks used in its scope.
    """
    tall = fresh.where((F.col("kind") != "viewport") & (F.col("r") > F.col("l")) & (F.col("b") > F.col("t")))
    pairs = spatial.region(tall.select(*scope, *_PIECE, "seq"), tracked.where(F.col("obs") >= WELL_OBSERVED).select(*scope, *_PIECE), scope)
    h, p = side("h_"), side("p_")
    inside = (p.height < 0.7 * h.height) & (F.try_divide(h.common_area(p), p.area) >= 0.80)
    order = ["h_seq", "h_id", "p_t", "p_id"]
    placed = pairs.where(inside).repartition(*scope).sortWithinPartitions(*scope, *order)
    kinds = {f.name: f.dataType for f in fresh.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn, parts, used, sig = None, None, [], set(), ""
        out: list[tuple] = []

        def close() -> None:
            free = [q for q in parts if q[0] not in used]
            if len(free) >= 2 and (lev := S.levenshtein_ratio(sig, "".join(q[1] for q in free))) >= 0.60:
                used.update(q[0] for q in free)
                out.append((*at, turn, [q[0] for q in free], lev))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, key in enumerate(zip(*columns[: len(scope)])):
                h_id, h_sig, p_id, p_sig = (c[i] for c in columns[len(scope) :])
                if key != at or h_id != turn:
                    if parts:
                        close()
                    used = used if key == at else set()
                    at, turn, parts, sig = key, h_id, [], h_sig
                parts.append((p_id, p_sig))
            yield batch_of(out)
            out.clear()
        if parts:
            close()
        yield batch_of(out)

    names = [*scope, "id", "evidence", "lev"]
    types = [*(to_arrow_type(kinds[c]) for c in scope), pa.int64(), pa.list_(pa.int64()), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in scope), "id long, evidence array<long>, lev double"])
    return placed.select(*scope, "h_id", "h_sig", "p_id", "p_sig").mapInArrow(run, schema)


def superseded(tracked: DataFrame, fresh: DataFrame, scope: list[str]) -> DataFrame:
    """Tracked rows covered by a fresh one: ids (``c_id``), once each."""
    slim = lambda x, *more: x.select(*scope, "id", "kind", "hz", "inner_top", *"ltrb", *more)
    covers = spatial.region(slim(fresh), slim(tracked, F.greatest(threshold_for(F.col("text")), F.lit(COVER_FLOOR)).alias("need")), scope)
    f, c = side("h_"), side("p_")
    same = ((F.col("h_kind") == "viewport") == (F.col("p_kind") == "viewport")) & ((F.col("h_hz") < 0) | (F.col("p_hz") < 0) | (F.col("h_hz") == F.col("p_hz")))
    hit = covers.where(same & (c.area > 0) & (F.try_divide(f.common_area(c), c.area) >= F.col("p_need")))
    return hit.select(*scope, F.col("p_id").alias("c_id")).distinct()


def retention(tracked: DataFrame, matched: DataFrame, covered: DataFrame, scope: list[str], missed_frames: int, misses: Column | None = None) -> DataFrame:
    """Unmatched tracked rows with their fate: 'retained' or 'dropped' (J16, ST8)."""
    rest = tracked.join(matched.select(*scope, F.col("c_id").alias("id")), [*scope, "id"], "left_anti")
    gone = covered.select(*scope, F.col("c_id").alias("id"), F.lit(True).alias("covered"))
    count = (F.lit(0) if misses is None else misses) + 1
    flagged = rest.join(gone, [*scope, "id"], "left")
    fate = F.when(F.lit(missed_frames <= 0) | F.col("covered") | (count > missed_frames), "dropped").otherwise("retained")
    return flagged.select(*scope, "id", fate.alias("fate"), count.alias("misses"))


def census(fresh: DataFrame, tracked: DataFrame, matched: DataFrame, scope: list[str]) -> DataFrame:
    """merged, admitted, dropped and the share of admitted rows per capture."""
    n = fresh.groupBy(*scope).agg(F.count(F.lit(1)).alias("fresh"))
    old = tracked.groupBy(*scope).agg(F.count(F.lit(1)).alias("tracked"))
    hit = matched.groupBy(*scope).agg(F.count(F.lit(1)).alias("merged"), F.countDistinct("c_id").alias("held"))
    out = n.join(old, scope, "left").join(hit, scope, "left").na.fill(0, ["tracked", "merged", "held"])
    admitted = F.col("fresh") - F.col("merged")
    return out.select(*scope, "fresh", "merged", admitted.alias("admitted"), (F.col("tracked") - F.col("held")).alias("unmatched"), F.when(F.col("fresh") == 0, 0.0).otherwise(admitted / F.greatest("fresh", F.lit(1))).alias("admitted_share"))


def fit_transform(pairs: DataFrame, scope: list[str], minimum: int = 3) -> DataFrame:
    """Least-squares scale and shift from old (x0, y0) to new (x1, y1) centres.

    Two passes of sums: the first fit's residuals are trimmed once at three medians if
    enough pairs remain. Scopes without a sound fit give no row.
    """
    # Written twice only: the pairs, which may come from a match, and the pairs used.
    pairs = cut_lineage(pairs)
    first = _least_squares(pairs, scope, minimum)
    off = pairs.join(first.select(*scope, "scale", "tx", "ty"), scope).select(*scope, "x0", "y0", "x1", "y1", _residual().alias("off"))
    limit = order_statistics(off, scope, "off").select(*scope, "median")
    marked = off.join(limit, scope).withColumn("cut", F.col("off") > 3 * F.col("median")).drop("median")
    counts = marked.groupBy(*scope).agg(F.count(F.when(F.col("cut"), 1)).alias("far"), F.count(F.lit(1)).alias("total"))
    trim = F.when((F.col("far") > 0) & (F.col("total") - F.col("far") >= minimum), F.col("far")).otherwise(0)
    used = cut_lineage(marked.join(counts.select(*scope, trim.alias("rejected")), scope).where((F.col("rejected") == 0) | ~F.col("cut")))
    fit = _least_squares(used, scope, minimum, F.first("rejected").alias("rejected"))
    error = used.join(fit.select(*scope, "scale", "tx", "ty"), scope).groupBy(*scope).agg(F.sqrt(F.avg(F.pow(_residual(), 2))).alias("residual"))
    return fit.join(error, scope).join(largest_gap_share(used, scope), scope).select(*scope, "pairs", "rejected", "scale", "tx", "ty", "residual", "span", "largest_gap", *fixed_point())


def fixed_point() -> list[Column]:
    free = F.abs(1 - F.col("scale")) >= 1e-9
    return [F.when(free, F.try_divide(F.col(t), 1 - F.col("scale"))).alias(n) for t, n in (("tx", "fixed_x"), ("ty", "fixed_y"))]


def _residual() -> Column:
    return distance(F.col("scale") * F.col("x0") + F.col("tx") - F.col("x1"), F.col("scale") * F.col("y0") + F.col("ty") - F.col("y1"))


def _least_squares(pairs: DataFrame, scope: list[str], minimum: int, *more: Column) -> DataFrame:
    """One aggregation: variances are merged from centred parts, so large coordinates lose no digits."""
    n = F.count(F.lit(1))
    sums = pairs.groupBy(*scope).agg(
        n.alias("pairs"), *[F.avg(c).alias("m" + c) for c in ("x0", "y0", "x1", "y1")], (F.var_pop("x0") + F.var_pop("y0")).alias("vxx"), (F.covar_pop("x0", "x1") + F.covar_pop("y0", "y1")).alias("vxy"), *more
    )
    kept = [c for c in sums.columns if c not in (*scope, "pairs", "mx0", "my0", "mx1", "my1", "vxx", "vxy")]
    fit = sums.where((F.col("pairs") >= minimum) & (F.col("vxx") > 0)).withColumn("scale", F.try_divide(F.col("vxy"), F.col("vxx"))).where((F.col("scale") > 0) & ~F.isnan("scale"))
    return fit.select(*scope, "pairs", *kept, "scale", (F.col("mx1") - F.col("scale") * F.col("mx0")).alias("tx"), (F.col("my1") - F.col("scale") * F.col("my0")).alias("ty"), F.sqrt("vxx").alias("span"))


def largest_gap_share(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Largest gap between neighbours along the longer axis, over its extent."""
    ext = pairs.groupBy(*scope).agg((F.max("x0") - F.min("x0")).alias("ex"), (F.max("y0") - F.min("y0")).alias("ey"))
    along = pairs.join(ext, scope).select(*scope, F.when(F.col("ex") >= F.col("ey"), F.col("x0")).otherwise(F.col("y0")).alias("v"), F.greatest("ex", "ey").alias("extent"))
    gap = F.col("v") - F.lag("v").over(Window.partitionBy(*scope).orderBy("v"))
    return along.withColumn("gap", gap).groupBy(*scope).agg(F.coalesce(F.try_divide(F.max("gap"), F.first("extent")), F.lit(0.0)).alias("largest_gap"))
