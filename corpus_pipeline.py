"""The corpus pipeline: each stage works on all that the one before it kept, read back from Parquet."""

from __future__ import annotations

from gleaner.llm import stages
from gleaner.llm._store import finished
from pyspark.sql import DataFrame, SparkSession

STAGES = [
    ("language ID", stages.known_language),
    ("n-gram Jaccard join", stages.one_of_each),
    ("benchmark decontamination", stages.decontaminated),
    ("PII", stages.private_masked),
    ("mixing", stages.mixed),
]

#: The first three stages learn or search by models that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage has written on its way goes once its result stands, and its result once the next one's does; the
    last one's is written too, and stays for the caller."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs, at = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage", *before)
        before = [at]
    return docs
