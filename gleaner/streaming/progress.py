"""Progress of running jobs as a stream: late events within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job_id BIGINT, domain BIGINT, stage STRING, percent DOUBLE, at TIMESTAMP"


def progress_source(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Progress events from JSON files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path)


def windowed(events: DataFrame, late: str | None = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events, jobs seen (approximately) and furthest percent of each stage by window; ``late`` is None if they have a watermark."""
    return (
        (events.withWatermark("at", late) if late else events)
        .groupBy(F.window("at", width).alias("w"), "stage")
        .agg(F.count("*").alias("events"), F.approx_count_distinct("job_id").alias("jobs"), F.max("percent").alias("furthest"))
        .select(F.col("w.start").alias("start"), "stage", "events", "jobs", "furthest")
    )


def once_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of an event dropped, with state that the watermark bounds."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "stage", "percent"])
