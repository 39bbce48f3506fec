"""Reports over decision logs and recorded events, all as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtrail.functions.stats import share

MATURE, SURE = 5, 0.8


def _band() -> Column:
    n = F.col("obs_before")
    return F.when(n <= 2, "n1-2").when(n <= 5, "n3-5").when(n <= 10, "n6-10").otherwise("n11+")


def displacement_bands(log: DataFrame) -> DataFrame:
    """Mean movement of merges by arm and maturity of the track."""
    merges = log.where((F.col("event") == "merge") & (F.col("how") != "admit"))
    move = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return merges.withColumn("band", _band()).groupBy("arm", "band").agg(F.count(F.lit(1)).alias("merges"), F.round(F.avg(move), 4).alias("displacement"), F.count(F.when(F.col("how") == "nested", 1)).alias("nested"))


def arm_summary(log: DataFrame) -> DataFrame:
    """Confidence of mature merges, saturated share and step events of every arm."""
    merges = log.where((F.col("event") == "merge") & (F.col("how") != "admit"))
    old = F.col("obs_before") >= MATURE
    return merges.groupBy("arm").agg(F.count(F.lit(1)).alias("merges"), F.round(F.avg(F.when(old, F.col("pconf"))), 4).alias("mature_pconf"), share(F.count(F.when(F.col("pconf") >= 0.999, 1)), F.count(F.lit(1))).alias("saturated"), F.round(F.avg("top_lag"), 4).alias("top_lag"), F.count("response").alias("step_events"))


def capture_series(log: DataFrame, captures: DataFrame) -> DataFrame:
    """Per capture: lag, step events and identity share; every capture is listed."""
    merges = log.where((F.col("event") == "merge") & (F.col("how") != "admit")).groupBy("session_id", "cap").agg(F.round(F.avg("top_lag"), 4).alias("top_lag"), F.count("response").alias("step_events"))
    kept = log.where("event = 'capture'").groupBy("session_id", "cap").agg(F.max("merged").alias("merged"), F.max("admitted").alias("admitted"))
    out = captures.select("session_id", "cap").distinct().join(kept, ["session_id", "cap"], "left").join(merges, ["session_id", "cap"], "left")
    fresh = F.col("merged") + F.col("admitted")
    return out.select("session_id", "cap", "top_lag", F.coalesce("step_events", F.lit(0)).alias("step_events"), share(F.col("merged"), fresh).alias("identity_share"))


def arm_digests(log: DataFrame) -> DataFrame:
    """One digest per arm over all its capture digests.

    A sum of hashes of (session, capture, digest): the same for any order, with partial
    sums on the map side, and no list of captures or sessions anywhere.
    """
    rows = log.where("event = 'capture'")
    part = F.xxhash64("session_id", "cap", "digest").cast("decimal(38,0)")
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("captures"), F.sha2(F.sum(part).cast("string"), 256).alias("digest"))


def _beside_damp(rows: DataFrame, **columns: str) -> DataFrame:
    """Rows of sessions that have a damped arm, with that arm's columns under new names.

    ``rows`` has one row for each session and arm. A join of the log with itself would
    replay it again for each side.
    """
    damped, session = F.col("arm") == "damp", Window.partitionBy("session_id")
    out = rows.withColumns({"_damped": F.max(damped).over(session)} | {new: F.max(F.when(damped, F.col(old))).over(session) for old, new in columns.items()})
    return out.where("_damped").drop("_damped")


def step_rule(log: DataFrame, move: int = 7, after: tuple[int, ...] = (0, 3, 5)) -> DataFrame:
    """Lag of every arm at the move and some captures later, against half of the damped arm's.

    Columns: session_id, arm, lag_0, lag_3, ..., passes: at each of these captures that
    the damped arm has, the lag is there and at most half of the damped one. ``move`` is
    the place of the capture at which the page moved, counted from 0.
    """
    merged, seen = F.col("event") == "merge", F.max(F.col("event") == "capture")
    lags = log.groupBy("session_id", "arm").agg(seen.alias("seen"), *[F.avg(F.when(merged & (F.col("cap") == move + o), F.col("top_lag"))).alias(f"lag_{o}") for o in after]).where("seen")
    lags = _beside_damp(lags, **{f"lag_{o}": f"damp_{o}" for o in after})
    fine = [F.col(f"damp_{o}").isNull() | F.coalesce(F.col(f"lag_{o}") <= F.col(f"damp_{o}") / 2, F.lit(False)) for o in after]
    return lags.select("session_id", "arm", *[F.round(f"lag_{o}", 4).alias(f"lag_{o}") for o in after], reduce(Column.__and__, fine).alias("passes"))


def half_of_damp(log: DataFrame) -> DataFrame:
    """Arms whose mean lag stays within half of the damped arm's."""
    lag = log.where("event = 'merge'").groupBy("session_id", "arm").agg(F.avg("top_lag").alias("lag"))
    return _beside_damp(lag, lag="damp").groupBy("arm").agg(F.count(F.lit(1)).alias("sessions"), F.count(F.when(F.col("lag") <= 0.5 * F.col("damp"), 1)).alias("passing"), F.round(F.min("lag"), 4).alias("lowest"), F.round(F.max("lag"), 4).alias("highest"))


def freeze_report(freezes: DataFrame, merges: DataFrame) -> DataFrame:
    """Funnel of freezes per session (A21): shares, differing and confident discards."""
    held = freezes.groupBy("session_id").agg(F.count(F.lit(1)).alias("freezes"), F.count(F.when(F.col("differs"), 1)).alias("differing"), F.count(F.when(F.col("differs") & (F.col("freshtconf") >= SURE) & ~F.isnan("freshtconf"), 1)).alias("confident_discards"), F.count(F.when(F.col("remaining") <= 1, 1)).alias("expiring"))
    done = merges.groupBy("session_id").agg(F.count(F.lit(1)).alias("merges"))
    out = done.join(held, "session_id", "full").na.fill(0, ["freezes", "differing", "confident_discards", "expiring", "merges"])
    return out.select("session_id", "merges", "freezes", "differing", "confident_discards", "expiring", share(F.col("freezes"), F.col("freezes") + F.col("merges")).alias("frozen_share"))


def live_report(merges: DataFrame, freezes: DataFrame, captures: DataFrame) -> DataFrame:
    """Event counts per session by type and the frozen share."""
    kinds = [(captures, "engine"), (merges, "merge"), (freezes, "freeze")]
    rows = None
    for df, kind in kinds:
        part = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("t") == k, F.col("n"))), F.lit(0)).alias(k) for _, k in kinds])
    return out.select("session_id", "engine", "merge", "freeze", share(F.col("freeze"), F.col("merge") + F.col("freeze")).alias("frozen_share"))
