"""Tables in Parquet; only the columns a query selects are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, if they would be read in fewer: a small table often lies in one row group, and work on
    whole texts is heavy. A table that is read in many parts is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, :func:`spread`."""
    return spread(table(spark, sf_dir, name))


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """Queries from a text file, one a line; blank lines and those that start with ``#`` are no queries."""
    return spark.read.text(path).selectExpr("trim(value) AS query").where("query <> '' AND NOT startswith(query, '#')")
