"""Intermediate tables in the folder that the cluster shares, so that a lost executor costs no recomputation of what is read twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that are copied to all executors at most, some 50 MB.
MOST_COPIED = 2_000_000


def shared_dir(spark: SparkSession) -> None:
    """Sees that a checkpoint folder is set: the session's spark.checkpoint.dir, else (tests on one machine) a new temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="covara-"))


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def copied(df: DataFrame, most_rows: int = MOST_COPIED) -> DataFrame:
    """df, a stored table of few numbers a row, marked to be copied to all executors where it is small; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= most_rows else df


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
