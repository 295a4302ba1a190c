"""Odd and large inputs: texts without words, sites with many links, records that are read once."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import audit, context, extract, json_ld, texts
from gleaner.plans import rich

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_style_of_texts_without_words(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \n\u00a0"), (4, "My word.")], "doc_id int, text string")
    got = texts.machine_style(rows, "doc_id", separator="\n").select("doc_id", "words", "uniformity", "personal", "style_score")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, False, 0), (2, 0, 0, False, 0), (3, 0, 0, False, 0), (4, 2, 0, True, 0)]


def counted(spark, rows):
    """The rows, and a counter of how often one of them was made."""
    made = spark.sparkContext.accumulator(0)

    def seen(url):
        made.add(1)
        return url

    return rows.withColumn("url", F.udf(seen, "string").asNondeterministic()("url")), made


@needs_tables
def test_contexts_and_queries_read_records_once(spark):
    fields = dict.fromkeys((*context.FIELDS, "title", "words"))
    rows, made = counted(spark, rich.rich_records(spark, SF, *fields))
    kept = context.kept_pages(rows)
    names = kept.select("site").distinct().selectExpr("site", "site AS name", "'' AS industry", "'' AS location")
    found = context.all_queries(context.template_queries(context.context_of(kept)), context.page_queries(kept, names)).count()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (found > 0, made.value) == (True, n)
    rows, made = counted(spark, rich.rich_records(spark, SF, *context.FIELDS))
    assert (context.business_context(rows).count() > 0, made.value) == (True, n)


@needs_tables
def test_all_links_of_a_site_are_probed(spark):
    rows = rich.rich_records(spark, SF).withColumn("external", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.concat(F.lit("https://o.example/"), k)))
    found = spark.range(1, 301).select(F.concat(F.lit("https://o.example/"), "id").alias("url"), F.when(F.col("id") > 250, 404).otherwise(200).alias("status"))
    counts = lambda **more: {
        (r["out_checked"], r["out_broken"])
        for r in audit.site_facts(kept, rich.site_files(spark, SF), statuses=found, **more).select("out_checked", "out_broken").collect()
    }
    kept = audit.kept_facts(rows)
    assert (counts(), counts(most=250)) == ({(300, 50)}, {(250, 0)})


@needs_tables
def test_summary_reads_records_once(spark):
    rows, made = counted(spark, rich.rich_records(spark, SF))
    kept = audit.kept_facts(rows)
    items = audit.items(audit.site_facts(kept, rich.site_files(spark, SF), **rich.probes(spark, SF)))
    assert audit.summary(items, audit.affected_urls(kept)).count() > 0
    assert made.value == spark.read.parquet(f"{SF}/documents.parquet").count()


@needs_tables
def test_json_ld_reads_records_once(spark):
    rows, made = counted(spark, rich.rich_records(spark, SF, *json_ld.PAGE_FIELDS, "identity"))
    kept = json_ld.kept_pages(rows)
    got = json_ld.page_json_ld(kept, extract.site_identity(kept)).collect()
    assert (len(got) > 0, made.value) == (True, spark.read.parquet(f"{SF}/documents.parquet").count())
