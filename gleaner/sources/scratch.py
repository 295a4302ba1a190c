"""Results that are written once and read several times, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    """See that there is a checkpoint folder: the one of ``spark.checkpoint.dir``; only where it is unset and Spark runs in one process, a
    temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="gleaner-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: what reads them again doesn't compute them again, and lost executors lose nothing. Spark deletes
    the files with the last plan that reads them, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)
