"""Queries of the training-data operators over the shared tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrail.context import cut_lineage, table

from . import bpe, canon, incremental, leaks, qdigest, sentences, survivor, tokengroups

#: Where the vocabularies of public tokenizers are; a parameter, never copied.
TOKENIZER_DIR = os.environ.get("GLYPHTRAIL_TOKENIZERS", "/opt/tokenizers")

_SLOT = ["session_id", "cap", "seq"]


def _observed(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "obs_blocks").select(F.lit("obs_blocks").alias("src_table"), F.col("block_id").alias("row_id"), "session_id", F.col("otext").alias("observed"))
    frozen = table(spark, d, "freezes").select(F.lit("freezes").alias("src_table"), F.col("freeze_id").alias("row_id"), "session_id", F.col("heldtext").alias("observed"))
    return blocks.unionByName(frozen)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d)
    hits = canon.canonical_texts(rows, table(spark, d, "tracks"), "session_id", "observed", "text", matched_only=True)
    return rows.join(hits.select("session_id", "observed"), ["session_id", "observed"], "left_semi").select("src_table", "row_id")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its consistent form; null and blank texts keep their value."""
    rows = _observed(spark, d)
    forms = canon.canonical_texts(rows, table(spark, d, "tracks"), "session_id", "observed", "text")
    return rows.join(forms, ["session_id", "observed"], "left").select("src_table", "row_id", F.coalesce("form", "observed").alias("form"), F.coalesce("matched", F.lit(False)).alias("matched"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.best_values(table(spark, d, "obs_blocks"), _SLOT, "block_id", ["srcq", "tconf", "obsn"]).select("field_name", "block_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per slot: the best value of each field, side by side."""
    best = survivor.best_values(table(spark, d, "obs_blocks"), _SLOT, "block_id", ["srcq", "tconf", "obsn"])
    pick = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in ("srcq", "tconf", "obsn")]
    return best.groupBy(*_SLOT).agg(*pick)


def _delivery() -> Column:
    """A delivery's source: where the text came from and how late it arrived, by powers of two hours."""
    late = (F.unix_millis(F.col("recv_at").cast("timestamp")) - F.col("ts")) / 3_600_000
    step = F.when(late < 1, 0).otherwise(F.floor(F.log2(late)) + 1)
    return F.concat_ws(" ", F.coalesce("origin", F.lit("unknown")), step.cast("string"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each slot judged true, by the two-sided quality of origin and lateness."""
    return survivor.true_values(table(spark, d, "obs_blocks").withColumn("delivery", _delivery()), _SLOT, "delivery", "otext")


def p3_model(spark: SparkSession, d: str) -> DataFrame:
    """srcq, tconf and obsn of each slot of several deliveries as the quality model judges them."""
    found = survivor.model_values(table(spark, d, "obs_blocks"), _SLOT, "block_id", ["srcq", "tconf", "obsn"], _delivery())
    return found.select(*_SLOT, "field_name", "value", "support", "truth", "block_id")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("day")
    moves = table(spark, d, "merges").select("session_id", day, F.explode(F.create_map(F.lit("dx"), F.col("dx"), F.lit("dy"), F.col("dy"))).alias("field_name", "value"))
    held = table(spark, d, "freezes").select("session_id", day, F.lit("freshtconf").alias("field_name"), F.col("freshtconf").alias("value"))
    return moves.unionByName(held)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per session, per day and overall, from partial digests of one pass."""
    parts = qdigest.build_scopes(_measures(spark, d), ["field_name"], {"session": "session_id", "day": "day", "overall": None}, "value")
    return qdigest.scoped_percentiles(parts, ["field_name", "group_id"])


def p5_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per day and overall, merged from written digests of each session and day."""
    digests = cut_lineage(qdigest.build(_measures(spark, d), ["field_name", "session_id", "day"], "value"))
    days = qdigest.percentiles(qdigest.roll_up(digests, ["field_name", "day"]), ["field_name", "day"])
    every = qdigest.percentiles(qdigest.roll_up(digests, ["field_name"]), ["field_name"])
    return days.withColumn("scope", F.lit("day")).unionByName(every.withColumn("scope", F.lit("overall")).withColumn("day", F.lit("all")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.repeated_rows(table(spark, d, "incoming_blocks"), table(spark, d, "obs_blocks"), key=["session_id", "cap"], new_id="new_id", history_id="block_id", text="otext", rect="rect", batch="batch_no")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = tokengroups.similar_pairs(table(spark, d, "units"), row_id="unit_id", text="otext", rect="rect")
    return pairs.select(F.col("a").alias("unit_a"), F.col("b").alias("unit_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class of every unit; a unit in no pair is its own class."""
    found = tokengroups.classes_of(table(spark, d, "units"), row_id="unit_id", text="otext", rect="rect")
    return found.select(F.col("id").alias("unit_id"), "class_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.contaminated(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", lang="lang")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of an item that may differ in two words or letters."""
    return leaks.contaminated(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", lang="lang", max_edits=2)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p3_found, p3_records, p3_texts, p3_model, p5_percentiles, p5_rollup, p6_found, p7_found, p7_groups, p8_ids, p9_found, p9_near, p10_found)}

_DELIVERED = """
WITH slots AS (
  SELECT *, count(*) OVER (PARTITION BY session_id, cap, seq) AS deliveries FROM obs_blocks
  WHERE session_id IS NOT NULL AND cap IS NOT NULL AND seq IS NOT NULL)
"""

ORACLE = {
    "p3_found": _DELIVERED
    + """
SELECT 'srcq' AS field_name, arg_max(block_id, (srcq, -block_id)) AS block_id FROM slots WHERE deliveries > 1 AND srcq IS NOT NULL GROUP BY session_id, cap, seq
UNION ALL
SELECT 'tconf', arg_max(block_id, (tconf, -block_id)) FROM slots WHERE deliveries > 1 AND tconf IS NOT NULL AND NOT isnan(tconf) GROUP BY session_id, cap, seq
UNION ALL
SELECT 'obsn', arg_max(block_id, (obsn, -block_id)) FROM slots WHERE deliveries > 1 AND obsn IS NOT NULL GROUP BY session_id, cap, seq
""",
    "p3_records": _DELIVERED
    + """
SELECT session_id, cap, seq, max(srcq)::DOUBLE AS srcq, max(tconf) FILTER (NOT isnan(tconf)) AS tconf, max(obsn)::DOUBLE AS obsn
FROM slots WHERE deliveries > 1 GROUP BY session_id, cap, seq
HAVING max(srcq) IS NOT NULL OR max(tconf) IS NOT NULL OR max(obsn) IS NOT NULL
""",
}
