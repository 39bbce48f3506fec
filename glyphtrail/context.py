"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is chosen only where neither that setting nor an explicit
    checkpoint folder exists and all tasks run in this one process, as in tests. On a
    cluster executors share no such folder, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphtrail-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
