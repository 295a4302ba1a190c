"""Answer-engine visibility: what answers say of a domain or brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores


def context(text: Column, term: Column, around: int = 100) -> Column:
    """The first place of the term with what stands around it, ellipses where more does; null without it."""
    at = F.instr(F.lower(text), F.lower(term))
    start, end = F.greatest(F.lit(1), at - around), F.least(F.length(text), at + F.length(term) - 1 + around)
    cut = F.concat(
        F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1),
        F.when(end < F.length(text), "...").otherwise(""),
    )
    return F.when(at > 0, cut)


def citations(responses: DataFrame, domain: str, brand: str) -> DataFrame:
    """``responses(engine, response, citations, error)`` with ``mention`` (cited, mentioned, absent) and ``context``."""
    d, b, text = F.lit(domain), F.lit(brand), F.coalesce("response", F.lit(""))
    cited = F.exists("citations", lambda c: c.contains(domain))
    in_text = F.contains(F.lower(text), F.lower(d))
    branded = F.lit(len(brand) > 1) & F.contains(F.lower(text), F.lower(b))
    mention = F.when(cited, "cited").when(in_text | branded, "mentioned").otherwise("absent")
    found = F.when(cited, F.coalesce(context(text, d), context(text, b))).when(in_text, context(text, d)).when(branded, context(text, b))
    return responses.select("*", mention.alias("mention"), found.alias("context"))


def engine_scores(rows: DataFrame) -> DataFrame:
    """Visibility of each engine: failed answers don't count; an engine of failures alone has 0."""
    ran = F.col("error").isNull()
    sums = rows.groupBy("engine").agg(
        F.count_if(ran).alias("run"), F.count_if(ran & (F.col("mention") == "cited")).alias("cited"),
        F.count_if(ran & (F.col("mention") == "mentioned")).alias("mentioned"),
    )
    score = F.when(F.col("run") > 0, scores.half_up((100 * F.col("cited") + 50 * F.col("mentioned")) / F.col("run"))).otherwise(0)
    return sums.withColumn("score", score)


def overall(engines: DataFrame) -> DataFrame:
    rows = engines.agg(scores.half_up(F.avg("score")).alias("visibility"))
    return rows.select(F.coalesce("visibility", F.lit(0)).alias("visibility")).withColumn("grade", scores.grade(F.col("visibility")))
