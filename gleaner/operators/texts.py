"""Operators on texts: one projection over words, sentences and phrases of each row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores, text


def readability(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, words, sentences, syllables and reading ease of ``text``."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(
        *keep, text.word_count(t).alias("words"), text.sentence_count(t).alias("sentences"), text.syllable_count(t).alias("syllables"),
    )
    return rows.withColumn("flesch", text.flesch(F.col("words"), F.col("sentences"), F.col("syllables")))


def readability_check(docs: DataFrame, site: str) -> DataFrame:
    """Mean reading ease of texts over 100 words, by site, with score and status."""
    rows = readability(docs, site).where("words > 100").groupBy(site).agg(F.count("*").alias("pages"), F.avg("flesch").alias("avg_flesch"))
    score = F.least(F.lit(100), scores.half_up(F.col("avg_flesch") * 100 / 60))
    return rows.select(
        site, "pages", F.round("avg_flesch", 6).alias("avg_flesch"), score.alias("score"),
        scores.status(F.col("avg_flesch"), 50, 30).alias("status"),
    )


def machine_style(docs: DataFrame, *keep: str, separator: str = r"\n\s*\n") -> DataFrame:
    """``keep``, the six signals of machine-like writing and their score; 0 under 100 words."""
    t = F.coalesce("text", F.lit(""))
    # each pattern only where its words are: few texts have any, and looking for words is much faster
    spelled = lambda p: [p.replace("('|a)", x) for x in ("'", "a")] if "('|a)" in p else [p]
    here = lambda p: reduce(or_, map(F.col("low").contains, spelled(p)))
    personal = reduce(or_, (here(p) & F.col("low").rlike(text.bounded(p)) for p in catalog.PERSONAL))
    # what is used more than once is a column first, or it would be computed as often
    rows = docs.select(
        *keep, F.lower(t).alias("low"), text.word_count(t).alias("words"),
        text.paragraph_words(text.paragraphs(t, separator)).alias("parts"), text.long_words(t).alias("long"),
    )
    rows = rows.select(
        *keep, "words", text.moments(F.col("parts")).alias("parts"), text.diversity(F.col("long")).alias("diversity"),
        personal.alias("personal"),
        *(
            text.phrase_count(F.col("low"), p).alias(n)
            for n, p in (("transitions", catalog.TRANSITIONS), ("openers", catalog.OPENERS), ("hedges", catalog.HEDGES))
        ),
    )
    per_1000 = lambda n: F.when(F.col("words") > 0, F.col(n) / F.col("words") * 1000).otherwise(0.0).alias(n)
    rows = rows.select(
        *keep, "words", *map(per_1000, ("transitions", "openers", "hedges")), text.uniformity(F.col("parts")).alias("uniformity"),
        "diversity", "personal",
    )
    two = lambda c, high, a, low, b: F.when(F.col(c) > high, a).when(F.col(c) > low, b).otherwise(0)
    score = (
        two("transitions", 8, 25, 4, 12) + two("openers", 5, 20, 2, 10) + two("hedges", 6, 20, 3, 10)
        + F.when(F.col("uniformity") >= 70, 15).when(F.col("uniformity") >= 30, 7).otherwise(0)
        + F.when(F.col("diversity") < 0.35, 10).when(F.col("diversity") < 0.45, 5).otherwise(0)
        + F.when(~F.col("personal") & (F.col("words") > 300), 10).otherwise(0)
    )
    return rows.withColumn("style_score", F.when(F.col("words") < 100, 0).otherwise(F.least(F.lit(100), score)))


def machine_style_check(docs: DataFrame, site: str, separator: str = r"\n\s*\n") -> DataFrame:
    rows = machine_style(docs, site, separator=separator).where("words >= 100")
    return rows.groupBy(site).agg(
        F.count("*").alias("pages"), scores.half_up(F.avg("style_score")).alias("average_score"),
        F.count_if(F.col("style_score") >= 60).alias("likely_machine"), F.count_if(F.col("style_score") < 30).alias("likely_human"),
    )


def passages(docs: DataFrame, *keep: str, separator: str = r"\n\s*\n", least: int = 15, most: int = 300) -> DataFrame:
    """A row for each paragraph of 15 to 300 words: ``keep``, its place among those, words."""
    told = F.transform(
        text.paragraphs(F.col("text"), separator),
        lambda p: F.struct(p.alias("passage"), F.greatest(text.word_count(p), F.lit(1)).alias("words")),
    )
    return docs.select(
        *keep, F.posexplode(F.filter(told, lambda x: x["words"].between(least, most))).alias("place", "p"),
    ).select(*keep, "place", "p.passage", "p.words")


def snippet_check(docs: DataFrame, site: str) -> DataFrame:
    """Share of texts over 100 words with a sentence of 30 to 70 words, and of those that define something."""
    defines = F.col("text").rlike("(?i)" + text.bounded("is a|is an|refers to|is defined as|means"))
    long_enough = F.exists(text.sentences(F.col("text"), rf"\.{text.SPACE}+"), lambda s: text.tokens_split(s).between(30, 70))
    rows = docs.where(text.word_count(F.col("text")) > 100).groupBy(site).agg(
        F.count("*").alias("pages"), F.count_if(long_enough).alias("ready"), F.count_if(defines).alias("defining"),
    )
    score = scores.half_up(F.col("ready") / F.col("pages") * 70 + F.col("defining") / F.col("pages") * 30)
    return rows.withColumn("score", score)


def statistics_found(docs: DataFrame, *keep: str) -> DataFrame:
    """Different figures in each text: percentages, multiples, money, ``n out of m``; texts without any are left out."""
    ascii_edge = lambda p: p.replace(r"\b", "(?![A-Za-z0-9_])")
    found = F.array_distinct(F.concat(*(F.regexp_extract_all("text", F.lit(ascii_edge(p)), F.lit(0)) for p in catalog.STATISTICS)))
    return docs.select(*keep, F.transform(found, lambda x: F.trim(x)).alias("figures")).where(F.size("figures") > 0)
