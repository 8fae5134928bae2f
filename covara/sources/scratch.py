"""Small intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that are copied to all executors at most, some 50 MB.
MOST_COPIED = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests on one machine) a new temporary one is."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="covara-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once; its lineage ends in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def copied(df: DataFrame, most_rows: int = MOST_COPIED) -> DataFrame:
    """df, a stored table of few numbers a row, marked to be copied to all executors where it is small; else Spark shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
