"""Schedules run by ticks: each batch of a stream of ticks starts what is due at its last tick and says when it runs next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..sources import sinks


def advance(spark: SparkSession, schedules: str, runs: str, now: str, batch: int) -> None:
    """Write the runs due at ``now`` to the folder ``runs``, and their next times to the table ``schedules`` (``id, frequency, enabled,
    next_run_at, version``). Run again, the same batch leaves the same runs: those it has written are read back instead of found anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{runs}/batch={batch}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        due = history.due(spark.read.parquet(schedules).drop("part"), now)
        started = due.select(
            "id", "frequency", F.to_timestamp(F.lit(now)).alias("started_at"), "next", (F.col("version") + 1).alias("version"),
        )
        started.write.mode("overwrite").parquet(f"{runs}/batch={batch}")
    written = spark.read.parquet(f"{runs}/batch={batch}")
    changes = written.select("id", "frequency", F.lit(True).alias("enabled"), F.col("next").alias("next_run_at"), "version")
    sinks.upsert_table(spark, schedules, changes, "id", "version")


def on_ticks(ticks: DataFrame, schedules: str, runs: str):
    """A writer for a stream of ticks (``tick TIMESTAMP``); schedules count on from the tick, so what was late stays late once only."""

    def batch(rows: DataFrame, n: int) -> None:
        now = rows.agg(F.max("tick").alias("now")).first()["now"]
        if now is not None:
            advance(rows.sparkSession, schedules, runs, str(now), n)

    return ticks.writeStream.foreachBatch(batch)
