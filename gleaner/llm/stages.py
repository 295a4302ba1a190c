"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and decides over all rows it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, mixing, ngram_join, pii
from ._store import saved


#: A name that no table has, for the number that stands for a row.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a 64-bit hash of doc_id, source and text. Decisions are about such numbers, so that a null doc_id, or one that
    several texts share, is judged like any other; rows that agree in all three are judged alike, and so would be two rows whose hashes
    collide. A column named ``__row`` can't be in the documents: it raises."""
    if ROW in docs.columns:
        raise ValueError(f"documents may not have a column {ROW}")
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return docs.withColumn(ROW, F.xxhash64(told("doc_id"), told("source"), F.col("text").isNull(), "text"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number is in ``rows``.

    The numbers are written first, so that their size is known: Spark sends them round where they are few, else it shuffles.
    """
    return docs.join(saved(rows.select(ROW).distinct(), "dropped"), ROW, "left_anti").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: what it rejects goes, null and empty texts too. ``lang`` stays as it was; an empty table stays empty, repeated rows are
    judged alike, and columns of any other name are kept."""
    rows = numbered(docs)
    found = language_id.identify(rows, language_id.train(docs), ROW, host=F.col("source"))
    return without(rows, found.where(~F.col("accepted"))).drop(ROW)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the row with the least doc_id stays, one of them if it is repeated; where no row has an
    id, any one. Rows without words are in no component, and all stay."""
    rows = numbered(docs)
    groups = ngram_join.near_duplicates(rows, ROW).where("n_shingles > 0")
    sizes = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = saved(groups.join(sizes, "component_id").select("component_id", ROW), "members")
    repeated = members.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = members.distinct().join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = without(rows, members.join(first, "component_id").where(F.col(ROW) != F.col(f"first.{ROW}")))
    repeated = saved(repeated, "repeated")
    once = kept.join(repeated, ROW, "left_semi").dropDuplicates([ROW])
    return without(kept, repeated).unionByName(once.select(kept.columns)).drop(ROW)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go; null and empty texts hold none. Repeated rows go or stay together;
    columns of any name are kept."""
    rows = numbered(docs)
    return without(rows, decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW)).drop(ROW)


def private_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind, n_chars follows. No row goes; null texts stay null, empty ones empty, and columns of any other
    name are kept."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document with its text as the stages before left it, and how many of its words the mix takes (``taken``), so that the mix
    can be written from this result. Rows that are null or empty take part with 0 words; rows that agree in doc_id, source and text each keep a
    row. Other columns of the documents follow, but for those whose names the mix uses."""
    rows = numbered(docs)
    counts = mixing.mix(rows.select(ROW, "text", "source"), ROW)
    own = [c for c in docs.columns if c not in ("doc_id", *counts.columns)]
    # of rows that agree one has the columns of all; it is joined by number
    kept = rows.dropDuplicates([ROW]).select(ROW, "doc_id", *own)
    return counts.join(kept.hint("merge"), ROW).select("doc_id", *(c for c in counts.columns if c != ROW), *own)
