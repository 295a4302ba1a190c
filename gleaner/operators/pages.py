"""Operators on pages: one wide row of features for each page, and checks as one aggregation over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import markup, scores, text, urls


def features(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` -> everything the page checks need, in one projection."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    path = urls.path_of(url)
    rows = pages.select(
        "page_id", "url", urls.domain_of(url).alias("site"), markup.tag_text(html, "title").alias("title"),
        markup.has_tag(html, "h1").alias("has_h1"), html.rlike(r"(?i)<meta[^>]+charset").alias("has_charset"),
        html.rlike(r"(?i)^\s*<!doctype").alias("has_doctype"), markup.body_text(html).alias("body"),
        F.octet_length(html).alias("html_bytes"), F.length(html).alias("html_chars"), markup.count_tag(html, "script").alias("scripts"),
        markup.declared_language(html).alias("lang"),
        reduce(lambda a, b: a + b, (F.lower(html).contains(t).cast("int") for t in catalog.SEMANTIC_TAGS)).alias("semantic"),
        F.size(F.regexp_extract_all(F.lower(html), F.lit("<div"), F.lit(0))).alias("divs"), url.startswith("https://").alias("https"),
        F.size(markup.links(html)).alias("n_links"),
        (
            path.contains("_") | (F.length(url) > 200) | (F.size(F.split(urls.query_of(url), "&")) > 3) | (path != F.lower(path))
        ).alias("odd_url"),
    )
    return rows.withColumn("words", text.word_count(F.col("body"))).withColumn(
        "good_semantics", (F.col("semantic") >= 3) | ((F.col("divs") > 0) & (F.col("semantic") >= 0.1 * F.col("divs"))),
    )


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*")


def page_checks(rows: DataFrame) -> DataFrame:
    """Ten checks of each site from one pass over its features: ``site, seq, name, category, score, status``, then severity."""
    titled = F.col("title") != ""
    sums = rows.groupBy("site").agg(
        F.count("*").alias("n"), _share(F.col("https")).alias("https"), _share(F.col("has_h1")).alias("h1"),
        F.count_if(~(F.col("has_charset") & F.col("has_doctype"))).alias("no_charset"), _share(F.col("words") > 50).alias("rendered"),
        _share(F.col("good_semantics")).alias("semantic"), F.count_if(F.octet_length("body") < 0.1 * F.col("html_bytes")).alias("thin"),
        F.count_if(F.col("html_bytes") > 2 * 1024 * 1024).alias("big"), F.count_if(F.col("odd_url")).alias("odd"),
        F.count_if(F.col("words") > 10000).alias("long"), _share(titled).alias("titled"),
        _share(titled & F.length("title").between(30, 70)).alias("fitting"),
    )
    by_title = rows.where(titled).groupBy("site", "title").agg(F.count("*").alias("k")).groupBy("site").agg(
        F.count_if(F.col("k") > 1).alias("repeated"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("in_repeated"),
        F.sum("k").alias("with_title"),
    )
    s = sums.join(by_title, "site", "left").fillna(0, ["repeated", "in_repeated", "with_title"])
    n, c = F.col("n"), F.col
    less = lambda count: scores.half_up((1 - c(count) / n) * 100)
    title = scores.half_up(
        c("titled") * 40
        + F.when(c("titled") > 0, c("fitting") / c("titled")).otherwise(0.0) * 30
        + F.when(n > 1, 1 - c("repeated") / n).otherwise(1.0) * 30
    )
    distinct = F.when(c("with_title") > 0, scores.half_up((1 - c("in_repeated") / c("with_title")) * 100)).otherwise(100)
    items = [
        ("Title Tags", title, scores.status(title, 70, 40)), ("Duplicate Titles", distinct, scores.few(c("in_repeated"), 2)),
        ("HTTPS Enforcement", scores.half_up(c("https") * 100), scores.status(c("https"), 1, 0.8)),
        ("Missing H1 Heading", scores.half_up(c("h1") * 100), scores.status(c("h1"), 1, 0.9)),
        ("Character Encoding & Doctype", less("no_charset"), scores.few(c("no_charset"), 2)),
        ("Server-side Rendering", scores.half_up(c("rendered") * 100), scores.status(c("rendered"), 0.8, 0.5)),
        ("Semantic HTML Usage", scores.half_up(c("semantic") * 100), scores.partly_if_any(c("semantic"), 0.6)),
        ("Text-to-HTML Ratio", less("thin"), scores.few(c("thin"), 3)), ("HTML Page Size", less("big"), scores.few(c("big"), 2)),
        ("URL Structure Quality", less("odd"), scores.few(c("odd"), 3)),
        ("Content Too Long for AI", less("long"), scores.few(c("long"), 2)),
    ]
    cells = F.array(
        *(
            F.struct(
                F.lit(i).alias("seq"), F.lit(name).alias("name"), F.lit(catalog.CATEGORY[name]).alias("category"), score.alias("score"),
                status.alias("status"), F.lit(catalog.SEVERITY[name]).alias("own"),
            )
            for i, (name, score, status) in enumerate(items)
        )
    )
    out = s.select("site", F.inline(cells))
    return out.select(
        "site", "seq", "name", "category", "score", F.lit(100).alias("max_score"), "status",
        F.when(c("status") == "pass", "info").otherwise(c("own")).alias("severity"),
    )


def affected(rows: DataFrame, condition: Column, most: int = 20) -> DataFrame:
    """The first failing pages of each site, in page order."""
    order = Window.partitionBy("site").orderBy("page_id")
    return rows.where(condition).select("site", "page_id", "url", F.row_number().over(order).alias("place")).where(F.col("place") <= most)


def link_edges(pages: DataFrame) -> DataFrame:
    """``site, page_id, url, place, target, internal``: a row for each distinct link of a page."""
    rows = pages.select(
        "page_id", "url", urls.domain_of(F.col("url")).alias("site"),
        F.posexplode(markup.links(F.coalesce("html", F.lit("")))).alias("place", "href"),
    )
    rows = urls.resolved(rows, F.col("href"), F.col("url"), "target")
    return rows.select("site", "page_id", "url", "place", "target", (urls.domain_of(F.col("target")) == F.col("site")).alias("internal"))


def internal_linking(pages: DataFrame) -> DataFrame:
    """Links and orphans of each site. Links and pages meet on the whole address; only counted targets are joined."""
    each = pages.select(urls.domain_of(F.col("url")).alias("site"), "url", urls.path_of(F.col("url")).alias("path"))
    edges = link_edges(pages).where("internal").groupBy("site", "page_id", "target").agg(F.count("*").alias("times"))  # a target once a page
    linked = edges.groupBy("site", "target").agg(F.count("*").alias("inbound"))
    found = each.select("site", "url", "path").distinct().join(
        linked.select("site", F.col("target").alias("url")), ["site", "url"], "left_anti",
    ).where("path <> '/'")
    sums = each.groupBy("site").agg(F.count("*").alias("pages")).join(linked.groupBy("site").agg(F.sum("inbound").alias("links")), "site", "left").join(found.groupBy("site").agg(F.count("*").alias("orphans")), "site", "left").fillna(0, ["links", "orphans"])
    mean = F.col("links") / F.col("pages")
    link = F.when(mean >= 5, 50).otherwise(scores.half_up(mean / 5 * 50))
    orphan = scores.half_up((1 - F.when(F.col("pages") > 1, F.col("orphans") / (F.col("pages") - 1)).otherwise(0.0)) * 50)
    score = F.least(F.lit(100), link + orphan)
    return sums.select("site", "pages", "links", "orphans", score.alias("score"), scores.status(score, 70, 40).alias("status"))


def sitemap_entries(pages: DataFrame) -> DataFrame:
    path = F.lower(urls.path_of(F.col("url")))
    freq, priority = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, f, p in reversed(catalog.SITEMAP):
        freq, priority = F.when(path.rlike(pattern), f).otherwise(freq), F.when(path.rlike(pattern), p).otherwise(priority)
    loc = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        loc = F.replace(loc, F.lit(a), F.lit(b))
    return pages.select("page_id", loc.alias("loc"), freq.alias("changefreq"), priority.alias("priority"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of an even number the upper one: an aggregate of how often each value occurs, combined before the shuffle."""
    return rows.groupBy(key).agg(
        F.count("*").alias("pages"), F.expr(f"percentile_disc(0.5000000001) WITHIN GROUP (ORDER BY {value})").alias("median"),
    )


def modal(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each key; of equally frequent ones the first seen."""
    counts = rows.where(F.col(value) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.min(F.struct(-F.col("n"), "first", value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value))
