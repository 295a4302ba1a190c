"""URL filters: exact host-and-path rules, and gradient-boosted trees on lexical features where no rule fits.

Labelled URLs come as ``(url, label)``, 1 for unwanted. The share of label 1 by suffix is counted over all of them in Spark
and smoothed; the trees are fitted on at most ``SAMPLE`` of them, picked by a hash. The query has no labelled table, so
:func:`seeded` marks URLs by the words in their host names; the trees never see words, only lengths, depths, ratios,
entropies, counts and suffix statistics. It learns from two thirds of the hosts; on the others its verdicts can be measured.

Null URLs and URLs without ``://`` have an empty host and path and meet no rule; they are scored like any other. Null ids and
repeated rows stay rows. Very long URLs are used whole. Columns beside id and URL are ignored by :func:`judge` and kept by
:func:`score`, but for ``url_score``, which it sets. Empty tables give no rows; labels of one kind give everything one score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .lm_scoring import held_out
from .trees import Trees, fit

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host's labels that mark a seed of unwanted sites.
SEED_WORDS = ("adult", "ads", "bets", "betting", "casino", "loan", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Labelled URLs that the trees are fitted on at most, and suffixes that have a statistic of their own (the most frequent).
SAMPLE, SUFFIXES = 20_000, 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def seeded(urls: DataFrame, words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """``url`` -> ``(url, label)``: 1 where a part of the host name is a seed word."""
    return urls.select(
        "url", F.arrays_overlap(F.split(host_of(F.col("url")), "[.-]"), F.array(*map(F.lit, words))).cast("int").alias("label"),
    )


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def features(urls: pd.Series, rates: dict[str, float], rate: float) -> np.ndarray:
    rows = np.zeros((len(urls), 22))
    for i, url in enumerate(urls):
        url = url or ""
        scheme, sep, rest = url.partition("://")
        if not sep:
            scheme, rest = "", url
        rest, _, fragment = rest.partition("#")
        rest, _, query = rest.partition("?")
        host, slash, path = rest.partition("/")
        labels = host.lower().split(".")
        suffix = labels[-1] if sep else ""
        name = max(labels, key=len)
        n = max(len(url), 1)
        digits = sum(c.isdigit() for c in url)
        rows[i] = (
            len(url), len(host), len(path), len(query), len(fragment), len(labels), len(name),
            path.strip("/").count("/") + bool(path.strip("/")), digits / n, sum(c.isdigit() for c in host) / max(len(host), 1),
            host.count("-"), path.count("-") + path.count("_"), query.count("&") + query.count(";") + bool(query), query.count("="),
            url.count("%"), _entropy(url), _entropy(name), sum(c in "aeiou" for c in name) / max(len(name), 1), scheme.lower() == "https",
            sum(ord(c) > 127 for c in url) / n, path.endswith("/"), rates.get(suffix, rate),
        )
    return rows


@dataclass(frozen=True)
class Model:
    trees: Trees
    rates: dict[str, float]
    rate: float


def train(labelled: DataFrame, strength: float = 20.0) -> Model:
    """Fit on ``(url, label)``; rows with a null in either are left out."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label"))
    by = rows.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    whole = rows.agg(F.count("*"), F.sum("label")).first()
    rate = ((whole[1] or 0) + 0.5) / (whole[0] + 1)
    top = by.orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    rates = {r["suffix"]: (r["bad"] + strength * rate) / (r["n"] + strength) for r in top}
    sample = rows.orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE).toPandas()
    return Model(fit(features(sample["url"], rates, rate), sample["label"].to_numpy(float)), rates, rate)


def score(urls: DataFrame, model: Model) -> DataFrame:
    """All columns, and ``url_score``: how likely ``url`` is unwanted."""
    urls = urls.drop("url_score")
    out = StructType([*urls.schema.fields, StructField("url_score", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(url_score=model.trees.score(features(pdf["url"], model.rates, model.rate)))

    return urls.mapInPandas(run, out)


def judge(pages: DataFrame, model: Model, id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (the rule's, else block where the trees reach ``threshold``), url_score."""
    rows = score(pages.select(id_col, F.col("url").cast("string").alias("url")), model)
    rows = rows.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url_score")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("url_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "url_score",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = lambda host: held_out(host, 3, 1)
    judged = judge(pages, train(seeded(pages.where(~out(host_of(F.col("url")))))))
    return judged.withColumn("held_out", out(F.col("host")))
