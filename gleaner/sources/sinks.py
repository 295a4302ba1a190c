"""Writers whose rerun leaves the same files: a batch replaces the sites, or the parts of a table, that it holds, and nothing else.

Paths are the cluster's own, local ones in tests. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _replacing(df: DataFrame, *by: str):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def write_files(files: DataFrame, path: str) -> None:
    """``site, name, content``, a text each, as ``path/site=.../name=...``: one file for each, as it is."""
    rows = files.select("site", "name", F.coalesce("content", F.lit("")).alias("value")).repartition("site", "name")
    _replacing(rows, "site", "name").option("lineSep", "\x00").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_files` wrote."""
    rows = spark.read.option("lineSep", "\x00").option("recursiveFileLookup", "false").schema(
        "value string, site string, name string"
    ).text(path)
    return rows.select("site", "name", F.col("value").alias("content"))


def write_sections(sections: DataFrame, path: str, *order: str) -> None:
    """``site, name, content`` in many rows a file, in the order of columns: text files that make one when read by name. A site's rows are
    dealt out by order, so a large one is written by several tasks."""
    rows = sections.repartitionByRange("site", "name", *order).sortWithinPartitions("site", "name", *order).select(
        "site", "name", F.col("content").alias("value"),
    )
    _replacing(rows, "site", "name").text(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    """``site`` and columns as JSON lines by site."""
    _replacing(summaries.repartition("site"), "site").json(path)


def write_csv(rows: DataFrame, path: str, by: str = "site", order: str = "seq") -> None:
    """Quoted CSV with a header, a quote inside a field twice; a folder for each site, its rows in order."""
    told = rows.repartition(by).sortWithinPartitions(by, order)
    _replacing(told, by).option("quoteAll", True).option("escape", '"').option("header", True).option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False,
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_csv` wrote; ``schema`` ends with the column that the folders are named by."""
    return spark.read.option("quote", '"').option("escape", '"').option("header", True).option("multiLine", True).schema(schema).csv(path)


def append_log(events: DataFrame, path: str, at: str = "at") -> None:
    """Events by day; a batch replaces the days that it holds."""
    _replacing(events.withColumn("day", F.to_date(at)), "day").parquet(path)


def upsert_table(
    spark: SparkSession, path: str, changes: DataFrame, key: str, order: str, parts: int = 16, deleted: str | None = None,
) -> None:
    """Merge changes into a Parquet table in ``parts`` folders by key: of each key the newest row by ``order`` stays, of equals the changes'.

    Only folders that a change falls into are read and written. The merged rows are written beside the table first, so that a batch which is
    stopped and run again does no harm. Rows where ``deleted`` (a column of the changes) holds take their key away.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    columns = [c for c in changes.columns if c != deleted]
    gone = F.col(deleted) if deleted else F.lit(False)
    fresh = changes.select(*columns, F.coalesce(gone, F.lit(False)).alias("_gone"), F.lit(1).alias("_new"), part.alias("part"))
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    both = fresh
    if system.exists(jpath):
        held = spark.read.parquet(path)
        held = held.join(fresh.select("part").distinct(), "part", "left_semi")
        both = held.select(*columns, F.lit(False).alias("_gone"), F.lit(0).alias("_new"), "part").unionByName(fresh)
    best = both.groupBy("part", key).agg(F.max_by(F.struct(*(c for c in columns if c != key), "_gone"), F.struct(order, "_new")).alias("b"))
    merged = best.where("NOT b._gone").select("part", key, *(F.col(f"b.{c}") for c in columns if c != key)).select(*columns, "part")
    beside = f"{path}_next"
    merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(beside)
    touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most ``parts`` numbers
    left = {r["part"] for r in spark.read.schema(merged.schema).parquet(beside).select("part").distinct().collect()}
    _replacing(spark.read.schema(merged.schema).parquet(beside), "part").parquet(path)
    for p in touched:
        if p not in left:  # all its keys are gone
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={p}"), True)
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)
