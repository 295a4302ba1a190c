"""Results that runs have stored as JSON, read by what they hold: no schema is asked of them, and what can't be read is kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variants import parsed


def _field(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "variant")


def _number(name: str) -> Column:
    """A field that is a number; text that looks like one is none."""
    kind = F.schema_of_variant(_field(name))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get("v", f"$.{name}", "double"))


def read(jobs: DataFrame, payload: str = "result_json") -> DataFrame:
    """The jobs with ``v``, their payload as VARIANT: null where there is none or it isn't JSON."""
    return jobs.withColumn("v", parsed(F.col(payload)))


def rejects(jobs: DataFrame, payload: str = "result_json") -> DataFrame:
    """Jobs whose payload is there but isn't JSON, with it."""
    return jobs.where(F.col(payload).isNotNull() & parsed(F.col(payload)).isNull())


def measures(jobs: DataFrame, payload: str = "result_json") -> DataFrame:
    """``job_id, pages, service_score, crawl_errors`` of ``job_id, status, score`` and the payload: numbers in it, else 0 pages, the job's own score,
    and one error if it failed."""
    rows = read(jobs, payload)
    failed = F.when(F.col("status") == "failed", 1.0).otherwise(0.0)
    return rows.select(
        "job_id",
        F.coalesce(_number("pagesScanned"), F.lit(0.0)).alias("pages"),
        F.coalesce(_number("geoServiceScore"), F.col("score")).alias("service_score"),
        F.coalesce(_number("crawlErrors"), failed).alias("crawl_errors"),
    )


def recommendations(jobs: DataFrame, payload: str = "result_json", most: int = 4) -> DataFrame:
    """``job_id, place, recommendation``: the first texts, trimmed and not empty, that the actions in a payload recommend."""
    spark = jobs.sparkSession
    actions = read(jobs, payload).select(
        "job_id", _field("priorityActions").alias("actions"),
    ).where(F.schema_of_variant("actions").startswith("ARRAY"))
    each = spark.sql("SELECT job_id, pos, value FROM {actions}, LATERAL variant_explode(actions)", actions=actions)
    told = F.try_variant_get("value", "$.recommendation", "variant")
    text = F.trim(F.when(F.schema_of_variant(told) == "STRING", F.try_variant_get("value", "$.recommendation", "string")))
    rows = each.select("job_id", "pos", text.alias("recommendation")).where("recommendation <> ''")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("pos"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("job_id", "place", "recommendation")
