"""What a crawl brought: pages, what failed, pages fetched in place of a site's missing ones, and the links to go on with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

#: Characters of a page that are kept.
MOST = 2 * 1024 * 1024


def _page(html: Column, kind: Column) -> Column:
    """Whether a body is a web page: by its kind, or by how it begins."""
    begins = F.lower(F.substring(F.ltrim(html), 1, 200))
    return F.lower(F.coalesce(kind, F.lit(""))).contains("html") | begins.startswith("<!doctype html") | begins.contains("<html")


def outcomes(fetches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pages, failed, others)`` of ``site, url, status, kind, html, error, retries`` and more columns: every fetch is in one of them.

    Fetches with an error, or without a body, failed; bodies that are no web pages are others; pages are cut at 2 MiB characters.
    """
    bad = F.col("error").isNotNull() | F.col("html").isNull()
    failed = fetches.where(bad).select(
        "site", "url", "status", F.coalesce("error", F.lit("no body")).alias("error"), F.coalesce("retries", F.lit(0)).alias("retries"),
    )
    good = fetches.where(~bad)
    page = F.coalesce(_page(F.col("html"), F.col("kind")), F.lit(False))
    return good.where(page).withColumn("html", F.substring("html", 1, MOST)), failed, good.where(~page).select(
        "site", "url", "status", "kind",
    )


def with_fallback(pages: DataFrame, targets: DataFrame, fallback: DataFrame) -> DataFrame:
    """The pages, and for each site of ``targets(site, url)`` that has none the page fetched in their place, from ``fallback``, which has the
    columns of the pages; ``fallback`` pages of other sites, and of other addresses than the target's, don't count."""
    empty = targets.join(pages.select("site").distinct(), "site", "left_anti")
    found = fallback.join(empty, ["site", "url"], "left_semi").where("html IS NOT NULL")
    return pages.withColumn("fallback", F.lit(False)).unionByName(found.withColumn("fallback", F.lit(True)))


def to_follow(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """``site, url, depth``: the next links of a crawl, each once and one step deeper than the nearest page that has it. ``edges(site, depth, target)``
    are links to the same site; files that are no pages, and what is in ``seen(site, url)``, are left out."""
    rows = edges.where(~urls.is_binary(F.col("target"))).groupBy(
        "site", F.col("target").alias("url"),
    ).agg((F.min("depth") + 1).alias("depth"))
    return rows.join(seen.select("site", "url"), ["site", "url"], "left_anti")
