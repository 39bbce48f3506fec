"""The common block row, and adapters from the recorded tables to it.

Columns: session_id, cap, seq, id, kind, hz, cid, inner_top, l, t, r, b, text, sig,
chars, pconf, tconf, srcq, obs, provisional, weight, skey. ``sig`` is the significant
text and ``chars`` its character set; both are computed once, before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions import coordinates as C
from glyphtrail.functions import text as T
from glyphtrail.functions.geometry import Box


def box(alias: str = "") -> Box:
    p = f"{alias}." if alias else ""
    return Box(*[F.col(p + e) for e in ("l", "t", "r", "b")])


def rename(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def side(prefix: str) -> Box:
    return Box(*[F.col(prefix + e) for e in ("l", "t", "r", "b")])


def enrich(df: DataFrame) -> DataFrame:
    """Adds sig, chars, weight and skey to the raw block columns."""
    sig = T.significant(F.col("text"))
    weight = C.hierarchy_weight(F.col("kind"), F.col("hz"))
    out = df.withColumn("sig", sig).withColumn("weight", weight)
    return out.withColumn("chars", T.char_set(F.col("sig"))).withColumn("skey", C.space_key(F.col("weight"), F.col("kind"), F.col("cid"), F.col("t")))


def observed(obs_blocks: DataFrame, row_id: str = "block_id") -> DataFrame:
    """Visible observations: a null or blank text is noise and left out."""
    rect = [F.get("rect", F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    kind = F.when(F.col("isc"), "inner").otherwise("page")
    rows = obs_blocks.where(F.col("otext").isNotNull() & ~T.is_blank(F.col("otext"))).select(
        "session_id", "cap", "seq", F.col(row_id).alias("id"), kind.alias("kind"),
        F.when(F.col("hsc"), F.get("sc", F.lit(2)).cast("int")).otherwise(-1).alias("hz"), "cid",
        F.when(F.col("isc"), F.coalesce(F.get("sc", F.lit(0)), F.lit(0.0))).otherwise(0.0).alias("inner_top"), *rect,
        F.col("otext").alias("text"), "pconf", F.coalesce("tconf", F.lit(0.0)).alias("tconf"), F.coalesce("srcq", F.lit(0)).alias("srcq"),
        F.coalesce("obsn", F.lit(1)).alias("obs"), F.col("prov").alias("provisional"),
    )
    return enrich(rows)


def tracked(tracks: DataFrame) -> DataFrame:
    rect = [F.get("rect", F.lit(i)).alias(n) for i, n in enumerate("ltrb")]
    rows = tracks.where(F.col("text").isNotNull()).select(
        "session_id", F.lit(0).alias("cap"), F.lit(0).alias("seq"), F.col("track_id").alias("id"), "kind", F.col("hz_index").alias("hz"),
        F.lit(None).cast("string").alias("cid"), F.lit(0.0).alias("inner_top"), *rect, "text", "pconf", "tconf",
        F.coalesce("source_quality", F.lit(0)).alias("srcq"), F.col("obs_count").alias("obs"), F.col("is_provisional").alias("provisional"),
    )
    return enrich(rows)


def confidence_fault(c: Column) -> Column:
    """Whether a confidence is missing, not finite or outside [0, 1]."""
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 1)


def faults(obs_blocks: DataFrame, row_id: str = "block_id") -> DataFrame:
    """Rows (id, fault) of observations that may not enter the engine."""
    kind = F.when(F.col("isc"), "inner").otherwise("page")
    hz = F.when(F.col("hsc"), F.coalesce(F.get("sc", F.lit(2)).cast("int"), F.lit(-1))).otherwise(-1)
    fault = (
        F.when(confidence_fault(F.col("pconf")), "pconf_invalid").when(confidence_fault(F.col("tconf")), "tconf_invalid")
        .when(F.col("otext").isNull() | T.is_blank(F.col("otext")), "noise").otherwise(C.flag_fault(kind, F.col("isc"), F.col("hsc"), F.col("cid"), hz))
    )
    return obs_blocks.select(F.col(row_id).alias("id"), fault.alias("fault")).where(F.col("fault").isNotNull())
