"""Read and write capture streams: one JSON object per line, told apart by ``t``.

Files are read as text with one JSON parse per line in the JVM; bad lines, unknown
shapes and events are counted rather than dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtrail.functions.stats import carried

#: Fields read from a line; absent ones are null. ``sf`` is mixed and stays text.
RECORD = (
    "t string, ts bigint, cap int, raw int, v int, note string, vp array<double>, bk array<double>, dx double, dy double, obsN int, pconf double, tconf double, "
    "heldText string, freshText string, differs boolean, freshTconf double, remaining int, eng string, "
    "blocks array<struct<rect:array<double>,otext:string,pconf:double,tconf:double,srcQ:int,isc:boolean,iscTop:double,hsc:boolean,vr:boolean,cid:string,sc:array<double>,obsN:int,prov:boolean,provN:int,cvotes:map<string,int>,carVotes:map<string,int>>>"
)


def records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``record`` (null for bad lines) and ``status``: obs, meta, event or skipped (O1)."""
    parsed = F.from_json(F.col(line), RECORD, {"mode": "PERMISSIVE"})
    rows = lines.where(F.length(F.trim(line)) > 0).withColumn("record", parsed)
    kind = F.col("record.t")
    status = F.when(kind.isNull(), "skipped").when(kind.isin("obs", "meta"), kind).otherwise("event")
    return rows.withColumn("status", status)


def pair(values: Column) -> Column:
    """Two finite positive numbers, else null."""
    good = (F.size(values) == 2) & (F.get(values, F.lit(0)) > 0) & (F.get(values, F.lit(1)) > 0)
    return F.when(F.coalesce(good, F.lit(False)), values)


def viewport_text(s: Column) -> Column:
    """'412x780' as two numbers, null for any other form."""
    pattern = r"^(\d+(?:\.\d+)?)x(\d+(?:\.\d+)?)$"
    return F.when(s.rlike(pattern), F.array(F.regexp_extract(s, pattern, 1).cast("double"), F.regexp_extract(s, pattern, 2).cast("double")))


def with_buckets(rows: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """The latest valid bucket pair of each stream applies to all later records (O3)."""
    return carried(rows.withColumn("bk", pair(F.col("record.bk"))), stream, order, "bk")


def blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block of the obs records, with defaults for absent fields (O2)."""
    out = rows.where("status = 'obs'").select(*keys, F.col("record.cap").alias("cap"), F.posexplode("record.blocks").alias("seq", "x"))
    number = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].try_cast("int"), e["value"])))
    return out.select(
        *keys, "cap", "seq", F.col("x.rect").alias("rect"), F.col("x.otext").alias("otext"), F.col("x.pconf").alias("pconf"), F.col("x.tconf").alias("tconf"),
        F.coalesce("x.srcQ", F.lit(0)).alias("srcq"), F.coalesce("x.isc", F.lit(False)).alias("isc"), F.coalesce("x.hsc", F.lit(False)).alias("hsc"), F.col("x.cid").alias("cid"),
        F.col("x.sc").alias("sc"), F.coalesce("x.obsN", F.lit(1)).alias("obsn"), F.coalesce("x.prov", F.lit(False)).alias("prov"), number(F.col("x.cvotes")).alias("class_votes"),
    )


def to_lines(obs: DataFrame) -> DataFrame:
    """Captures as JSON lines: blocks in order inside one record."""
    body = F.struct("rect", "otext", "pconf", "tconf", F.col("srcq").alias("srcQ"), F.col("obsn").alias("obsN"))
    grouped = obs.groupBy("session_id", "cap").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("seq", "block_id", body.alias("b")))).alias("parts"))
    record = F.struct(F.lit("obs").alias("t"), "ts", "cap", F.col("parts.b").alias("blocks"))
    return grouped.select("session_id", "cap", F.to_json(record).alias("line"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Text files of JSON lines, partitioned by session."""
    lines.select("session_id", "line").write.mode("overwrite").partitionBy("session_id").text(folder)


def pregroup(obs: DataFrame, members: DataFrame) -> DataFrame:
    """Paragraph units of captures (O8, O9): union rectangle, joined text, mean confidence.

    ``members`` are rows of :func:`glyphtrail.plans.paragraphs.paragraphs`.
    """
    rows = obs.join(members, ["session_id", "cap", "id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("session_id", "cap", "paragraph").agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), text.alias("text"), F.avg("pconf").alias("pconf"), F.avg("tconf").alias("tconf"), F.count(F.lit(1)).alias("members"), F.min_by("kind", "position").alias("kind"))
