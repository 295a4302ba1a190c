"""Run history: jobs ``(job_id, domain, type, status, score, at)`` over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def jobs_of(events: DataFrame) -> DataFrame:
    """An event log as jobs: the user is the domain, clicks and views are scans, others checks, errors failed jobs."""
    kind = F.when(F.col("event_type").isin("view", "click"), "scan").otherwise("check")
    return events.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("domain"), kind.alias("type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("score"),
        F.col("ts").alias("at"), "props",
    )


def latest(jobs: DataFrame, *keys: str) -> DataFrame:
    """The newest job of each key, by an aggregation that combines before the shuffle (ties: larger id)."""
    best = jobs.groupBy(*keys).agg(F.max(F.struct("at", "job_id", "status", "score")).alias("b"))
    return best.select(*keys, "b.job_id", "b.at", "b.status", "b.score")


def trend(jobs: DataFrame, *keys: str) -> DataFrame:
    """Number, mean, first, last and change of scores over time; no change under two."""
    rows = jobs.where("status = 'completed' AND score IS NOT NULL").withColumn("order", F.struct("at", "job_id"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), scores.one_decimal(F.avg("score")).alias("average"), F.min_by("score", "order").alias("first_score"),
        F.max_by("score", "order").alias("last_score"),
    )
    return sums.withColumn("change", F.when(F.col("n") >= 2, scores.one_decimal(F.col("last_score") - F.col("first_score"))))


def diagnostics(jobs: DataFrame, shipped: DataFrame, now: str) -> DataFrame:
    """Since each domain shipped: counts, failure rate, weeks, reliability and confidence. ``shipped(domain, shipped_at)``."""
    since = jobs.join(shipped, "domain").where("at >= shipped_at")
    done = F.col("status") == "completed"
    order = F.struct("at", "job_id")
    scan, check = done & (F.col("type") == "scan"), done & (F.col("type") == "check")
    first = lambda c: F.min_by(F.when(c, F.col("score")), F.when(c, order))
    last = lambda c: F.max_by(F.when(c, F.col("score")), F.when(c, order))
    rows = since.groupBy("domain", "shipped_at").agg(
        F.count_if(scan).alias("scans"), F.count_if(check).alias("checks"), F.count("*").alias("jobs"),
        F.count_if(F.col("status") == "failed").alias("failed"), (last(scan) - first(scan)).alias("scan_change"),
        (last(check) - first(check)).alias("check_change"),
    )
    rows = rows.withColumn("failure_rate", F.col("failed") / F.col("jobs")).withColumn(
        "weeks",
        F.greatest(
            F.lit(0.0),
            (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("shipped_at").cast("timestamp"))) / F.lit(7 * 86_400_000_000),
        ),
    )
    step = lambda c, *steps: _steps(F.col(c), steps)
    change = lambda c, n: F.when(F.col(n) >= 2, F.abs(F.col(c)))
    impact = F.lit(15) + step("scans", (4, 20), (2, 10)) + step("checks", (2, 20), (1, 10)) + _steps(change("scan_change", "scans"), ((8, 15), (3, 8))) + _steps(change("check_change", "checks"), ((10, 15), (4, 8))) + step("weeks", (4, 15)) + F.when(F.col("failure_rate") <= 0.1, 10).otherwise(0)
    rows = rows.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), impact)))
    return rows.select(
        "domain", "scans", "checks", "jobs", "failed", F.round("failure_rate", 6).alias("failure_rate"), F.round("weeks", 6).alias("weeks"),
        "confidence", scores.confidence_level(F.col("confidence")).alias("level"),
    )


def _steps(value, steps):
    found = F.lit(0)
    for least, points in reversed(steps):
        found = F.when(value >= least, points).otherwise(found)
    return found


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after the changes: of each key the newest row of both, changes winning ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = [c for c in current.columns if c != key]
    best = both.groupBy(key).agg(F.max(F.struct(order, "_new", *(c for c in columns if c != order))).alias("b"))
    return best.select(key, *(F.col(f"b.{c}") for c in columns))


def recent(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The newest rows: a sort that keeps only that many in each task."""
    return rows.orderBy(F.desc(order), F.desc("job_id")).limit(most)


def due(schedules: DataFrame, now: str) -> DataFrame:
    """Enabled schedules whose time has come, and their next run: a month is 30 days."""
    days = F.when(F.col("frequency") == "daily", 1).when(F.col("frequency") == "weekly", 7).otherwise(30)
    at = F.to_timestamp(F.lit(now))
    return schedules.where(
        F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= at))
    ).withColumn("next", at + F.make_dt_interval(days))


def running_best(jobs: DataFrame) -> DataFrame:
    """Every job with the best score of its domain so far."""
    w = Window.partitionBy("domain").orderBy("at", "job_id")
    return jobs.select("job_id", "domain", F.max("score").over(w).alias("best"), F.row_number().over(w).alias("run"))
