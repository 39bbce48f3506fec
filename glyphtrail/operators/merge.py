"""Merge a fresh block into its track: position, confidence and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions.geometry import Box, agreement_scale, clamp, distance

SATURATED = 0.999
MAX_VOTES = 5


def weight(fresh: Column, existing: Column, observations: Column, legacy: bool = False) -> Column:
    """How far the merged rectangle moves from the old to the fresh one."""
    anchor = existing if legacy else existing * F.greatest(F.lit(1), observations)
    return F.when(anchor + fresh > 0, fresh / F.nullif(anchor + fresh, F.lit(0.0))).otherwise(0.5)


def confidence(existing: Column, observations: Column, residual: Column, scale: Column) -> Column:
    """Mean agreement so far; the fresh row's own confidence is not used."""
    n = F.greatest(F.lit(1), observations)
    agreement = F.when(scale > 0, clamp(1.0 - residual / scale, 0.0, 1.0)).otherwise(0.0)
    return (existing * n + agreement) / (n + 1)


def legacy_confidence(fresh: Column, existing: Column) -> Column:
    return F.least(existing + fresh, F.lit(1.0))


def step_eligible(fresh_kind: Column, fresh_hz: Column, existing_hz: Column) -> Column:
    """Pairs that may follow a step of the page (P7); also those of a fit."""
    return (fresh_kind != "viewport") & (fresh_hz < 0) & (existing_hz < 0)


def merged(fresh: Box, existing: Box, fresh_conf: Column, existing_conf: Column, observations: Column, snap: float | None = None, legacy: bool = False) -> tuple[Box, Column]:
    """Merged rectangle and position confidence of a pair without drift.

    ``snap``: residuals over that many agreement scales take the fresh rectangle as is.
    """
    residual = distance(fresh.left - existing.left, fresh.top - existing.top)
    scale = agreement_scale(existing.height)
    w = weight(fresh_conf, existing_conf, observations, legacy)
    if snap is not None and not legacy:
        jump = residual > snap * scale
        w, residual = F.when(jump, 1.0).otherwise(w), F.when(jump, 0.0).otherwise(residual)
    conf = legacy_confidence(fresh_conf, existing_conf) if legacy else confidence(existing_conf, observations, residual, scale)
    return existing.lerp(fresh, w), conf


def text_confidence(promoted: Column, same: Column, best: Column, existing: Column, fresh: Column) -> Column:
    """Confidence of the winning text."""
    total = existing + fresh
    w = F.when(total > 0, fresh / F.nullif(total, F.lit(0.0))).otherwise(0.5)
    return F.when(promoted, best).when(same, clamp(existing * (1 - w) + fresh * w, 0.0, 1.0)).otherwise(existing)


def text_votes(rows: DataFrame, keys: list[str], vote: str, raw: str, conf: str, turn: str) -> DataFrame:
    """Score, best confidence and spelling of every voted text, best ones first.

    ``turn`` orders the rows; the first spelling with the highest confidence is kept.
    Rank counts from 1 by score, then by first appearance; ranks over MAX_VOTES are
    the entries that the running cap would let go of last.
    """
    scored = rows.groupBy(*keys, vote).agg(F.sum(conf).alias("score"), F.max(conf).alias("best"), F.max_by(raw, F.struct(F.col(conf), -F.col(turn))).alias("spelling"), F.min(turn).alias("since"))
    return scored


def histogram(rows: DataFrame, keys: list[str], value: str, turn: str) -> DataFrame:
    """Votes for each value with its first appearance."""
    return rows.groupBy(*keys, F.col(value).alias("vote")).agg(F.count(F.lit(1)).alias("votes"), F.min(turn).alias("since"))


def winner(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent vote, the earlier one of equals."""
    return votes.groupBy(*keys).agg(F.max_by("vote", F.struct(F.col("votes"), -F.col("since"))).alias("winner"), F.sum("votes").alias("votes"))
