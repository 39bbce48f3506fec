"""Queries of the loaders: rejected lines and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphtrail.context import table

from . import evolution, rejects


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "raw_lines")).select("raw_id")


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Every rejected line with its reason."""
    return rejects.rejected(table(spark, d, "raw_lines"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Every block of the valid records."""
    return rejects.loaded_blocks(table(spark, d, "raw_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return evolution.schema_changes(table(spark, d, "stream_lines")).select("file_id", "rec", "field_name", "change_kind")


def p4_log(spark: SparkSession, d: str) -> DataFrame:
    """All differences in the order of their files, renames with the new name."""
    return evolution.change_log(table(spark, d, "stream_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per record, cast to the columns of the union schema."""
    return evolution.unified_records(table(spark, d, "stream_lines"))


def p4_cells(spark: SparkSession, d: str) -> DataFrame:
    """One row per value, entries of the container included."""
    return evolution.unified_cells(table(spark, d, "stream_lines"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rejects, p2_loaded, p4_found, p4_log, p4_table, p4_cells)}
ORACLE: dict[str, str] = {}
