"""The whole audit of a site: 68 items in their fixed order, from page records, well-known files and probes.

Nearly all items come from one aggregation over the records by site. Titles, descriptions, schema types, links and canonical
addresses are grouped by what they share first, so nothing but sums reaches a site's row. Columns of the records: ``site,
page_id, url, html, status, headers, response_ms, hops, depth, last_modified`` and :data:`extract.FIELDS`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores, text, urls
from ..sources.scratch import checkpointed
from . import extract, sites
from .files import as_items, column_of, file_items, texts_of_files
from .records import ordered

c = F.col


def _word(pattern: str) -> str:
    return "(?i)" + text.bounded(pattern)


def _starts(pattern: str) -> str:
    return rf"(?i)^\s*(?:{pattern})(?![A-Za-z0-9_])"


def _there(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def _header(name: str) -> Column:
    return F.coalesce(F.lower(c("headers")[name]), F.lit(""))


def _some(column: str) -> Column:
    return F.size(column) > 0


def page_facts(rows: DataFrame) -> DataFrame:
    """One wide row for each page: every predicate that the checks count."""
    path, body, html = F.lower(urls.path_of(c("url"))), c("body"), F.coalesce("html", F.lit(""))
    levels = F.transform("headings", lambda h: h.level)
    paragraphs = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 20)
    long_parts = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 30)
    mean = F.aggregate(paragraphs, F.lit(0.0), lambda s, p: s + text.tokens_split(p)) / F.size(paragraphs)
    lead = F.element_at(F.split(body, r"\n\s*\n"), 1)
    quotable = F.filter(
        long_parts,
        lambda p: text.tokens_split(F.trim(p)).between(20, 80) & ~p.rlike(
            _starts(catalog.LEANS_ON_CONTEXT)
        ) & p.rlike(_word(catalog.QUOTABLE)),
    )
    asking = F.filter("headings", lambda h: h.text.endswith("?") | h.text.rlike(rf"(?i)^(?:{catalog.ASKS_FIRST})(?![A-Za-z0-9_])"))
    short = F.exists(F.split(body, "[.!?]+"), lambda s: (F.length(F.trim(s)) > 10) & text.tokens_split(F.trim(s)).between(5, 30))
    directives = F.concat_ws(" ", F.lower("robots"), _header("x-robots-tag"))
    images = F.regexp_extract_all(html, F.lit("(?i)<img[^>]*>"), F.lit(0))
    responsive = F.size(F.filter(images, lambda t: t.rlike(r"srcset\s*=|sizes\s*="))) + F.size(
        F.regexp_extract_all(html, F.lit("(?i)<picture[^>]*>"), F.lit(0))
    )
    nofollow = F.array_union(
        F.regexp_extract_all(
            html, F.lit("(?i)<a\\s[^>]*rel\\s*=\\s*[\"'][^\"']*nofollow[^\"']*[\"'][^>]*href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1),
        ),
        F.regexp_extract_all(
            html, F.lit("(?i)<a\\s[^>]*href\\s*=\\s*[\"']([^\"']+)[\"'][^>]*rel\\s*=\\s*[\"'][^\"']*nofollow[^\"']*[\"']"), F.lit(1),
        ),
    )
    page_host = F.lower(urls.host_of(c("url")))
    inside = F.filter(
        nofollow,
        lambda h: F.when(
            h.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.lower(urls.host_of(h)) == page_host,
        ).otherwise(~h.rlike("^(?://|[A-Za-z][A-Za-z0-9+.-]*:)")),
    )
    semantic = reduce(lambda a, b: a + b, (F.lower(html).contains(t).cast("int") for t in catalog.SEMANTIC_TAGS))
    divs = F.size(F.regexp_extract_all(F.lower(html), F.lit("<div"), F.lit(0)))
    matches = lambda *ways: reduce(lambda a, b: a | b, ways)
    titled = lambda pattern: F.exists("headings", lambda h: h.text.rlike(pattern))
    told = {
        "path": path, "levels": levels, "multi": F.size("headings") >= 2, "one_way": ordered(levels), "head_count": F.size("headings"),
        "asking": F.size(asking), "short": short,
        "snippet": F.exists(
            F.filter(F.split(body, rf"\.{text.SPACE}+"), lambda s: F.trim(s) != ""), lambda s: text.tokens_split(s).between(30, 70),
        ),
        "defines": body.rlike(_word(catalog.DEFINES)), "steps": titled(r"(?i)^(?:step\s+[0-9]+|[0-9]+[.)]\s)"),
        "even": (F.size(paragraphs) > 0) & mean.between(40, 75), "parts": F.size(long_parts), "quotable": F.size(quotable),
        "answers": text.tokens_split(lead).between(20, 80) & ~lead.rlike(
            _starts(catalog.LEADS_BY_QUESTION)
        ) & lead.rlike(_word(catalog.ANSWERS)),
        "max_snippet": directives.contains("max-snippet"), "max_preview": directives.contains("max-image-preview"),
        "noindex": directives.contains("noindex"), "encoding": _header("content-encoding"),
        "semantic": (semantic >= 3) | ((divs > 0) & (semantic >= 0.1 * divs)), "bytes": F.octet_length(html),
        "body_bytes": F.octet_length(body), "scripts": F.size(F.regexp_extract_all(html, F.lit("(?i)<script[\\s>]"), F.lit(0))),
        "images_seen": F.size(images), "responsive": F.least(responsive, F.size(images)), "nofollowed": F.size(inside),
        "odd_url": path.contains("_") | (F.length("url") > 200) | (
            F.size(F.split(urls.query_of(c("url")), "&")) > 3
        ) | (urls.path_of(c("url")) != path),
        "first_person": body.rlike(_word(catalog.FIRST_PERSON)), "research": body.rlike(_word(catalog.RESEARCH)),
        "credentials": body.rlike(_word(catalog.CREDENTIALS)), "awards": body.rlike(_word(catalog.AWARDS)),
        "case_study": matches(
            c("url").rlike("(?i)case.?stud"), titled("(?i)case.?stud"), F.substring(body, 1, 500).rlike(_word(r"case\s+stud(?:y|ies)")),
        ),
        "testimonials": matches(
            c("url").rlike("(?i)testimon|reviews?|feedback"),
            titled("(?i)testimon|reviews?|feedback|what.*(clients?|customers?).*(say|think)"),
        ),
        "methodology": matches(
            path.rlike("methodology|process|how.?we.?work|our.?approach|our.?method"),
            titled("(?i)methodology|our process|how we work|our approach"),
        ),
        "press": matches(path.rlike("press|media|news|in.?the.?news|coverage"), titled("(?i)press|media|in the news|coverage|featured")),
        "flesch": text.flesch(c("words"), text.sentence_count(body), text.syllable_count(body)),
    }
    return rows.withColumns(told)


def kept_facts(rows: DataFrame) -> DataFrame:
    """:func:`page_facts` of page records, written once, without markup and, but for pages about the site, without texts: pages are read and parsed one
    time for :func:`site_facts` and :func:`affected_urls`."""
    facts = page_facts(rows).withColumn("body", F.when(extract.about_site(c("url")), c("body")))
    return checkpointed(facts.drop("html", "microdata", "rdfa", "navigation"))


def _date(column: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(column), F.try_to_timestamp(F.regexp_replace(column, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")),
    )


def _dated(as_of: str) -> Column:
    """What says when a page was last changed: its own word, or the server's if that is over an hour old."""
    own = F.coalesce(F.nullif("modified", F.lit("")), F.nullif("published", F.lit("")))
    served = F.when(
        _date(c("last_modified")) < F.to_timestamp(F.lit(as_of)) - F.expr("INTERVAL 1 HOUR"), F.nullif("last_modified", F.lit("")),
    )
    return F.coalesce(own, served)


def _failing(as_of: str) -> dict[str, Column]:
    """By check, the condition under which a page counts against it, over :func:`page_facts`."""
    content, longer, none = c("words") > 100, c("words") > 200, lambda x: F.size(x) == 0
    lacks = lambda *names: reduce(lambda a, b: a & b, (~_there(c(n)) for n in names))
    title = F.length(F.coalesce("title", F.lit("")))
    return {
        "AI Content Directives": ~(c("max_snippet") | c("max_preview")), "Structured Data (JSON-LD)": none("json_ld"),
        "Content Structure & Depth": c("words") < 300, "Heading Hierarchy": (c("head_count") > 0) & ~c("one_way"),
        "Meta Descriptions": F.length(F.coalesce("description", F.lit(""))) < 30, "Content Freshness": _dated(as_of).isNull(),
        "Featured Snippet Readiness": content & ~c("snippet"), "Voice Search Optimization": content & (c("asking") == 0),
        "Content Too Long for AI": c("words") > 10000, "Paragraph Length Optimization": content & ~c("even"),
        "Answer-First Content Structure": content & c("multi") & ~c("answers"), "Compression": ~c("encoding").rlike("gzip|br|deflate"),
        "Content Quotability Score": content & (c("parts") > 0) & (c("quotable") / c("parts") < 0.3),
        "Content Readability": content & (c("flesch") < 30), "Server-side Rendering": c("words") <= 50,
        "Open Graph Tags": ~(_there(c("og_title")) & _there(c("og_description"))), "Author & Expertise Signals": longer & lacks("author"),
        "Citation Quality": longer & none("statistics") & none("sources") & none("quotes"),
        "Twitter Card Tags": lacks("tw_card", "tw_title", "tw_description"),
        "Breadcrumb Schema": (c("path") != "/") & none("breadcrumbs") & ~F.array_contains("schema.types", "BreadcrumbList"),
        "hreflang Tags": none("hreflang"), "Title Tags": ~title.between(30, 70),
        "Image Alt Text": F.exists("images", lambda i: F.trim(i.alt) == ""), "Mobile Viewport": lacks("viewport"),
        "HTTPS Enforcement": ~c("url").startswith("https://"), "Broken Pages": (c("status") < 200) | (c("status") >= 400),
        "Nofollow on Internal Links": c("nofollowed") > 0, "URL Structure Quality": c("odd_url"), "Semantic HTML Usage": ~c("semantic"),
        "Page Response Time": c("response_ms") > 3000, "Redirect Chains": c("hops") > 1,
        "Character Encoding & Doctype": ~(_there(c("charset")) & c("doctype")), "HTML Page Size": c("bytes") > 2 * 1024 * 1024,
        "Crawl Depth": c("depth") > 3, "Missing H1 Heading": ~F.array_contains("levels", 1),
        "Responsive Images": (c("images_seen") > 0) & (c("responsive") / c("images_seen") < 0.5),
    }


def affected_urls(facts: DataFrame, as_of: str = "2024-06-01", most: int = 20) -> DataFrame:
    """``site, name, place, page_id, url``: of each check that looks at pages one by one, the first pages of a site that count against it; of shared
    titles and descriptions the pages that share them, those of the first one first. ``facts`` are :func:`kept_facts`."""
    checks = _failing(as_of)
    names = F.filter(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in checks.items())), lambda x: x.isNotNull())
    told = {
        "Duplicate Titles": (F.trim(F.coalesce("title", F.lit(""))), 1),
        "Duplicate Meta Descriptions": (F.trim(F.coalesce("description", F.lit(""))), 20),
    }
    shared = F.filter(
        F.array(*(F.when(F.length(x) >= least, F.struct(F.lit(n).alias("name"), x.alias("text"))) for n, (x, least) in told.items())),
        lambda x: x.isNotNull(),
    )
    pages = checkpointed(facts.select("site", "page_id", "url", names.alias("names"), shared.alias("shared")))
    single = pages.select("site", "page_id", "url", F.explode("names").alias("name"), F.lit(0).cast("long").alias("group"))
    each = pages.select("site", "page_id", "url", F.inline("shared"))
    groups = each.groupBy("site", "name", "text").agg(F.count("*").alias("k"), F.min("page_id").alias("group")).where("k > 1").drop("k")
    several = each.join(groups, ["site", "name", "text"]).select("site", "page_id", "url", "name", "group")
    order = Window.partitionBy("site", "name").orderBy("group", "page_id")
    return single.unionByName(several).withColumn("place", F.row_number().over(order)).where(c("place") <= most).select(
        "site", "name", "place", "page_id", "url",
    )


def summary(items: DataFrame, affected: DataFrame) -> DataFrame:
    """``site, items``: a site's items in their order, with the addresses that count against each: rows to be written as JSON."""
    listed = affected.groupBy("site", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("affected_urls")
    )
    rows = items.join(listed, ["site", "name"], "left")
    one = F.struct("seq", "name", "category", "score", "max_score", "status", "severity", "affected_urls")
    return rows.groupBy("site").agg(F.array_sort(F.collect_list(one)).alias("items"))


def _sums(rows: DataFrame, as_of: str) -> DataFrame:
    """The aggregation: counts and a few sums of each site."""
    now, year = F.to_timestamp(F.lit(as_of)), F.expr("INTERVAL 365 DAYS")
    date = _dated(as_of)
    content, longer = c("words") > 100, c("words") > 200
    some, total = F.count_if, F.sum
    return rows.groupBy("site").agg(
        F.count("*").alias("n"), some(_some("json_ld")).alias("with_ld"), total(F.size("faq")).alias("faqs"),
        F.bool_or("schema.faq_page").alias("faq_page"), some(c("words") < 300).alias("thin"), some(c("words") > 500).alias("deep"),
        some((c("words") > 500) & (c("head_count") >= 3)).alias("built"), some(c("head_count") > 0).alias("headed"),
        some((c("head_count") > 0) & c("one_way")).alias("ordered"),
        some(F.length(F.coalesce("description", F.lit(""))) >= 30).alias("described"), some(date.isNotNull()).alias("dated"),
        some(_date(date) > now - year).alias("recent"), some("schema.dated").alias("ld_dated"), some(content).alias("content"),
        some(content & c("snippet")).alias("ready"), some(content & c("defines")).alias("defining"), some(_some("tables")).alias("tabled"),
        some(_some("lists")).alias("listed"), some(_some("faq")).alias("asked"), some("steps").alias("stepped"),
        total(F.when(content, c("asking")).otherwise(0)).alias("asking"),
        total(F.when(content, c("head_count")).otherwise(0)).alias("head_total"), some(content & c("short")).alias("short"),
        some(c("words") > 10000).alias("long"), some(content & c("even")).alias("even"), some(content & c("multi")).alias("multi"),
        some(content & c("multi") & c("answers")).alias("answering"), total(F.when(content, c("parts")).otherwise(0)).alias("parts"),
        total(F.when(content, c("quotable")).otherwise(0)).alias("quotable"), F.bool_or("schema.org").alias("org"),
        F.bool_or("schema.logo").alias("org_logo"), F.bool_or("schema.contact").alias("org_contact"),
        F.bool_or("schema.same_as").alias("org_same"), F.bool_or("schema.org_named").alias("org_named"),
        F.bool_or("schema.org_complete").alias("org_complete"), F.min_by("headers", "page_id").alias("first_headers"),
        some(c("encoding").rlike("gzip|br|deflate")).alias("packed"), F.avg(F.when(content, c("flesch"))).alias("flesch"),
        total(F.when(content, c("words"))).alias("content_words"), some("max_snippet").alias("snippets"),
        some("max_preview").alias("previews"), some(c("words") > 50).alias("rendered"), F.bool_or(_there(c("google"))).alias("google"),
        F.bool_or(_there(c("bing"))).alias("bing"), some("noindex").alias("noindex"), some(_there(c("canonical"))).alias("canonical"),
        some(_there(c("og_title")) & _there(c("og_description"))).alias("og"),
        total(sum((_there(c(x)).cast("int") for x in ("tw_title", "tw_description")), _there(c("tw_card")).cast("int"))).alias("tw"),
        some(longer).alias("longer"), some(longer & _there(c("author"))).alias("authored"),
        some(longer & _there(c("author_bio"))).alias("bios"), some(longer & _some("statistics")).alias("figured"),
        some(longer & (_some("sources") | _some("quotes"))).alias("sourced"), some(longer & _some("external")).alias("linked_out"),
        some(_some("breadcrumbs")).alias("crumbs"), some(F.array_contains("schema.types", "BreadcrumbList")).alias("crumb_ld"),
        some(c("path") != "/").alias("inner"), some(_some("hreflang")).alias("tagged"),
        *(
            F.bool_or(c("path").rlike(p)).alias(a)
            for a, p in (
                ("about", "/(about|apie|about-us|company)"), ("privacy", "/(privacy|privatumas)"), ("terms", "/(terms|salygos|conditions)"),
                ("any_about", "about|apie"), ("any_privacy", "privacy|privat"), ("any_terms", "terms|conditions|tos|legal"),
            )
        ),
        total(F.size("images")).alias("images"), total(F.size(F.filter("images", lambda i: F.trim(i.alt) != ""))).alias("alts"),
        some(_there(c("viewport"))).alias("fitted"), some(c("url").startswith("https://")).alias("https"),
        some((c("status") < 200) | (c("status") >= 400)).alias("broken"), total("nofollowed").alias("nofollow"),
        total(F.size("internal")).alias("links"), some("odd_url").alias("odd"), some("semantic").alias("semantic"),
        some(c("body_bytes") < 0.1 * c("bytes")).alias("airy"), some(c("response_ms") > 3000).alias("slow"),
        some(c("hops") > 1).alias("chains"), some(~(_there(c("charset")) & c("doctype"))).alias("no_charset"),
        some(c("bytes") > 2 * 1024 * 1024).alias("big"), some(c("depth") > 3).alias("buried"),
        some(F.array_contains("levels", 1)).alias("h1"), total("images_seen").alias("images_seen"), total("responsive").alias("responsive"),
        some(_header("cache-control").rlike(r"max-age=[0-9]")).alias("cached"), some(_header("vary") != "").alias("varied"),
        *(
            F.bool_or(x).alias(f"any_{x}")
            for x in ("first_person", "case_study", "research", "testimonials", "methodology", "credentials", "awards", "press")
        ),
        some(F.trim(F.coalesce("author", F.lit(""))) != "").alias("all_authored"),
        F.bool_or(F.length(F.trim(F.coalesce("author_bio", F.lit("")))) > 20).alias("any_bio"),
        total(F.size("sources") + F.size("quotes")).alias("citations"),
        total(F.size(F.filter("headings", lambda h: F.trim(h.text).endswith("?")))).alias("questions"),
        total(F.size("tables")).alias("tables"), total(F.size("lists")).alias("lists"),
    )


def medians(rows: DataFrame, *columns: str) -> DataFrame:
    """``site`` and ``mid_`` of each column: the upper median of its whole numbers. Equal values are counted first, and a site's different values are
    summed up in order, on disk where needed; no site's values are held at once."""
    told = F.array(*(F.struct(F.lit(x).alias("name"), c(x).cast("long").alias("value")) for x in columns))
    counts = rows.select("site", F.inline(told)).where("value IS NOT NULL").groupBy("site", "name", "value").agg(F.count("*").alias("k"))
    whole = counts.groupBy("site", "name").agg(F.sum("k").alias("n"))
    up = Window.partitionBy("site", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = counts.withColumn("below", F.sum("k").over(up)).join(whole, ["site", "name"]).where(c("below") > F.floor(c("n") / 2))
    return above.groupBy("site").agg(*(F.min(F.when(c("name") == x, c("value"))).alias(f"mid_{x}") for x in columns))


def _shared(rows: DataFrame) -> list[DataFrame]:
    """What pages have in common: titles, descriptions, schema types, languages, links, canonical addresses; a row a site each."""
    by = lambda column, least, *more: rows.where(F.length(column) >= least).groupBy("site", column.alias("x")).agg(
        F.count("*").alias("k"), *more,
    )
    titles = by(F.coalesce("title", F.lit("")), 1).groupBy("site").agg(
        F.sum("k").alias("titled"), F.sum(F.when(F.length("x").between(30, 70), c("k")).otherwise(0)).alias("fitting"),
        F.count_if(c("k") > 1).alias("repeated_titles"),
    )
    same_titles = by(F.trim(F.coalesce("title", F.lit(""))), 1).groupBy("site").agg(
        F.sum("k").alias("with_title"), F.sum(F.when(c("k") > 1, c("k")).otherwise(0)).alias("in_repeated"),
    )
    told = by(F.trim(F.coalesce("description", F.lit(""))), 20).groupBy("site").agg(
        F.sum("k").alias("told"), F.sum(F.when(c("k") > 1, c("k")).otherwise(0)).alias("told_twice"),
    )
    types = rows.select("site", F.explode("schema.types").alias("t")).distinct().groupBy("site").agg(
        F.count("*").alias("types"), F.count_if(c("t").isin(*catalog.VALUABLE_TYPES)).alias("valuable"),
        F.bool_or(c("t") == "Organization").alias("has_org"), F.bool_or(c("t") == "WebSite").alias("has_site"),
    )
    spoken = F.concat(F.array(c("language")), F.transform("hreflang", lambda h: h.lang))
    languages = rows.select("site", F.explode(F.filter(spoken, lambda x: x != "")).alias("l")).select("site", F.element_at(F.split("l", "-"), 1).alias("l")).distinct().groupBy("site").agg(F.count("*").alias("languages"))
    edges = rows.select("site", F.explode("internal").alias("target"))
    addresses = rows.groupBy("site", "url").agg(
        F.count("*").alias("pages"), F.max("words").alias("words"), F.max(F.size("internal")).alias("out"), F.min("page_id").alias("first"),
    )
    inbound = edges.groupBy("site", "target").agg(F.count("*").alias("k"))
    orphans = addresses.join(inbound.select("site", c("target").alias("url")), ["site", "url"], "left_anti").where(
        urls.path_of(c("url")) != "/"
    ).groupBy("site").agg(F.count("*").alias("orphans"))
    canonical = urls.resolved(rows.where(_there(c("canonical"))).select("site", "url", "canonical"), c("canonical"), c("url"), "to")
    canonical = canonical.where((c("to") != c("url")) & (F.lower(urls.host_of(c("to"))) == F.lower(urls.host_of(c("url"))))).join(
        addresses.select("site", c("url").alias("to")), ["site", "to"], "left_anti",
    ).groupBy("site").agg(F.count("*").alias("astray"))
    return [
        titles, same_titles, told, types, languages, orphans, canonical, clusters(inbound, addresses),
        medians(rows, "response_ms", "bytes", "scripts"),
    ]


def clusters(inbound: DataFrame, addresses: DataFrame) -> DataFrame:
    """Pages that twice as many links lead to as to the mean one (three at least), and how many of those are rich themselves.

    Links and pages meet without fragments, queries and slashes at the end; of pages that are the same then, the first counts."""
    bare = lambda url: F.regexp_replace(url, "/$", "")
    keyed = inbound.groupBy("site", bare(F.regexp_replace("target", r"[#?].*$", "")).alias("key")).agg(F.sum("k").alias("k"))
    pages = addresses.groupBy("site", bare(c("url")).alias("key")).agg(F.min_by(F.struct("words", "out"), "first").alias("page"))
    linked = keyed.join(pages, ["site", "key"])
    means = linked.groupBy("site").agg(F.avg("k").alias("mean"), F.max("k").alias("most"))
    rows = linked.join(means, "site")
    pillar = c("k") >= F.greatest(F.lit(3.0), 2 * c("mean"))
    return rows.groupBy("site").agg(
        F.count_if(pillar).alias("pillars"), F.count_if(pillar & (c("page.words") > 500) & (c("page.out") >= 3)).alias("rich_pillars"),
        (F.max("most") > 1.5 * F.max("mean")).alias("varied_links"),
    )


def site_facts(
    facts: DataFrame, files: DataFrame, outbound: DataFrame | None = None, redirects: DataFrame | None = None,
    mobile: DataFrame | None = None, speed: DataFrame | None = None, brand: DataFrame | None = None, statuses: DataFrame | None = None,
    as_of: str = "2024-06-01", most: int | None = None,
) -> DataFrame:
    """One row for each site with pages: every number that items and scores are made of. ``facts`` are :func:`kept_facts`.

    ``files(site, name, content)``; ``statuses(url, status)``, what probes found at addresses, which are joined back to the sites' links (all,
    or the first ``most`` of a site), or
    ``outbound(site, url, status)`` and ``redirects(site, url, status)``, links already joined;
    ``mobile(site, accessible, has_viewport, viewport_content, content_ratio, images, responsive_ratio, other_issues)``;
    ``speed(site, performance)``; ``brand(site, brand)``. What isn't given was not looked at.
    """
    wide = _sums(facts, as_of).join(texts_of_files(files), "site", "left").join(extract.site_identity(facts), "site", "left")
    for part in _shared(facts):
        wide = wide.join(part, "site", "left")
    if statuses is not None:
        outbound = sites.probed_links(facts, "external", statuses, most)
        redirects = sites.probed_links(facts, "internal", statuses, most).where(c("status").isin(301, 302, 307, 308))
    checked = lambda df, bad, a, b: df.groupBy("site").agg(F.count("*").alias(a), F.count_if(bad).alias(b))
    given = [
        (
            outbound, lambda d: checked(d, (c("status") >= 400) | (c("status") == 0), "out_checked", "out_broken"),
            ("out_checked", "out_broken"),
        ),
        (redirects, lambda d: checked(d, c("status").isin(302, 307), "moved", "moved_away"), ("moved", "moved_away")),
        (mobile, lambda d: d.select("site", F.struct(*(x for x in d.columns if x != "site")).alias("mobile")), ()),
        (speed, lambda d: d.select("site", "performance"), ()), (brand, lambda d: d.select("site", "brand"), ()),
    ]
    for df, of, _ in given:
        if df is not None:
            wide = wide.join(of(df), "site", "left")
    for name in ("out_checked", "out_broken", "moved", "moved_away"):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(0))
    for name in ("performance", "brand"):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast("int"))
    if "mobile" not in wide.columns:
        wide = wide.withColumn(
            "mobile",
            F.lit(None).cast(
                "struct<accessible:boolean,has_viewport:boolean,viewport_content:string,content_ratio:double,images:int,responsive_ratio:double,other_issues:int>"
            ),
        )
    zero = [f.name for f in wide.schema.fields if f.dataType.simpleString() in ("bigint", "int") and f.name not in ("performance", "brand")]
    wide = wide.fillna(0, zero).fillna(False, [f.name for f in wide.schema.fields if f.dataType.simpleString() == "boolean"])
    return wide.fillna("", [column_of(n) for n in catalog.FILES])


def _mobile_score() -> Column:
    m = c("mobile")
    content = F.coalesce(m["viewport_content"], F.lit(""))
    view = F.when(~m["has_viewport"], 30).when(content == "", 0).otherwise(
        F.when(content.contains("width=device-width"), 0).otherwise(15)
        + F.when(content.rlike(r"(?i)user-scalable\s*=\s*no"), 10).otherwise(0)
    )
    parity = F.when(m["content_ratio"] < 0.5, 30).when(m["content_ratio"] < 0.85, 15).otherwise(0)
    images = F.when(m["images"] > 0, 20 - scores.half_up(m["responsive_ratio"] * 20)).otherwise(0)
    return F.when(~m["accessible"], 0).otherwise(
        F.greatest(F.lit(0), 100 - view - parity - images - F.least(F.lit(20), 10 * m["other_issues"]))
    )


def _vitals_score() -> Column:
    steps = lambda name, *limits: reduce(
        lambda a, b: a.when(c(name) < b[0], b[1]), limits[1:], F.when(c(name) < limits[0][0], limits[0][1]),
    ).otherwise(0)
    share = lambda name, least, points: F.when(c(name) / c("n") >= least, points).otherwise(0)
    load, weight, scripts = steps("mid_response_ms", (1000, 30), (2000, 20), (3000, 10)), steps(
        "mid_bytes", (200_000, 25), (500_000, 15), (1_000_000, 5),
    ), steps("mid_scripts", (5, 20), (10, 15), (20, 5))
    return F.coalesce(
        "performance", load + share("packed", 0.8, 10) + share("cached", 0.5, 10) + share("varied", 0.3, 5) + weight + scripts,
    )


def _directives() -> tuple[Column, Column]:
    """Whether pages let answer engines use whole texts and large images."""
    some = (c("snippets") > 0) | (c("previews") > 0)
    share = F.greatest(F.greatest("snippets", "previews") / c("n"), F.when(some, 0.5).otherwise(0.0))
    score = scores.half_up(50 * ((c("snippets") > 0).cast("int") + (c("previews") > 0).cast("int")) * share)
    return score, lambda s: scores.partly_if_any(s, 60)


def _page_items() -> dict[str, tuple[Column, Column]]:
    up, n = scores.half_up, c("n")
    share = lambda x, of="n": F.when(c(of) > 0, c(x) / c(of)).otherwise(0.0)
    percent = lambda x, of="n": up(share(x, of) * 100)
    less = lambda x, of="n": up((1 - share(x, of)) * 100)
    cap = lambda x: F.least(F.lit(100), x)
    any60 = lambda x: (x, lambda s: scores.partly_if_any(s, 60))
    graded = lambda x, a, b: (x, lambda s: scores.status(s, a, b))
    status_of = lambda status, s: status(s) if callable(status) else status
    unless = lambda empty, pair, score=0: (
        F.when(empty, score).otherwise(pair[0]), lambda s: F.when(empty, "not_applicable").otherwise(status_of(pair[1], s)),
    )
    points = lambda *rules: reduce(lambda a, b: a + b, (F.when(x, p).otherwise(0) for x, p in rules))
    schema = F.when(c("with_ld") == 0, 0).otherwise(
        cap(F.least(F.lit(50), up(share("with_ld") * 50)) + points((c("has_org"), 20), (c("has_site"), 15), (c("types") >= 3, 15)))
    )
    faq = F.when(c("faqs") == 0, 0).otherwise(cap(F.least(F.lit(60), c("faqs") * 15) + points((c("faq_page"), 40))))
    depth = cap(up((1 - share("thin")) * 30 + share("deep") * 40 + share("built") * 30))
    fresh = cap(up(share("dated") * 50 + share("recent", "dated") * 30 + share("ld_dated") * 20))
    diverse = cap(c("valuable") * 25)
    ready = cap(up(share("ready", "content") * 70 + share("defining", "content") * 30))
    kinds = ("tabled", "listed", "asked", "stepped")
    formats = cap(
        15 * sum(((c(k) > 0).cast("int") for k in kinds[1:]), (c(kinds[0]) > 0).cast("int"))
        + up(sum((c(k) for k in kinds[1:]), c(kinds[0])) / (n * 4) * 40)
    )
    voice = cap(up(share("asking", "head_total") * 50 + share("short", "content") * 50))
    complete = F.when(~c("org"), 0).otherwise(25 + points((c("org_logo"), 25), (c("org_contact"), 25), (c("org_same"), 25)))
    held = lambda name: _there(c("first_headers")[name])
    secure = points(
        (held("strict-transport-security"), 35), (held("content-security-policy"), 35), (held("x-frame-options"), 15),
        (held("x-content-type-options"), 15),
    )
    quotes = cap(up(share("quotable", "parts") * 150))
    cluster = cap(points((c("pillars") > 0, 40), (c("varied_links"), 30)) + up(share("rich_pillars", "pillars") * 30))
    reading = cap(up(F.coalesce("flesch", F.lit(0.0)) * 100 / 60))
    indexed = points((c("google"), 20), (c("bing") | (c(column_of("BingSiteAuth.xml")) != ""), 20), (c(column_of("robots.txt")).rlike("(?im)^Sitemap:"), 20), (c("noindex") == 0, 20)) + F.when(share("canonical") >= 0.8, 20).otherwise(up(20 * share("canonical")))
    expert = cap(up(share("authored", "longer") * 60 + share("bios", "longer") * 40))
    i = c("identity")
    trust = cap(
        points(
            (_there(i["email"]), 10), (_there(i["phone"]), 10), (_there(i["address"]), 10), (c("about"), 25), (c("privacy"), 15),
            (c("terms"), 10), (_there(i["name"]), 10), (_there(i["logo"]), 10),
        )
    )
    social = F.coalesce(i["social"], F.array().cast("array<struct<platform:string,url:string>>"))
    major = F.size(F.array_intersect(F.transform(social, lambda s: s["platform"]), F.array(*map(F.lit, catalog.MAJOR_PLATFORMS))))
    proof = cap(F.least(F.lit(60), F.size(social) * 15) + F.least(F.lit(40), major * 10))
    cited = cap(up(share("figured", "longer") * 35 + share("sourced", "longer") * 35 + share("linked_out", "longer") * 30))
    cards = up(c("tw") / (3 * n) * 100)
    crumbs = F.when(c("inner") == 0, 100).otherwise(up(F.greatest("crumbs", "crumb_ld") / c("inner") * 100))
    title = cap(
        up(share("titled") * 40 + share("fitting", "titled") * 30 + F.when(n > 1, 1 - c("repeated_titles") / n).otherwise(1.0) * 30)
    )
    alt = F.when(c("images") == 0, 100).otherwise(percent("alts", "images"))
    links = F.least(
        F.lit(100),
        F.when(c("links") / n >= 5, 50).otherwise(up(c("links") / n / 5 * 50)) + up(
            (1 - F.when(n > 1, c("orphans") / (n - 1)).otherwise(0.0)) * 50
        ),
    )
    nofollow = F.when(c("nofollow") == 0, 100).otherwise(
        up(F.greatest(F.lit(0.0), 1 - c("nofollow") / F.greatest("links", F.lit(1))) * 100)
    )
    astray = F.when(c("astray") == 0, 100).otherwise(up(F.greatest(F.lit(0.0), 1 - c("astray") / F.greatest("canonical", F.lit(1))) * 100))
    vitals, mobile = _vitals_score(), _mobile_score()
    few = lambda x, most: scores.few(c(x), most)
    tags_needless = (c("languages") <= 1) & (c("tagged") == 0)
    return {
        "Structured Data (JSON-LD)": (schema, lambda s: F.when(c("with_ld") == 0, "fail").when(s >= 60, "pass").otherwise("partial")),
        "FAQ Content": (faq, lambda s: F.when(c("faqs") == 0, "fail").when(s >= 60, "pass").otherwise("partial")),
        "Content Structure & Depth": any60(depth),
        "Heading Hierarchy": unless(c("headed") == 0, (percent("ordered", "headed"), scores.status(share("ordered", "headed"), 0.8, 0.5))),
        "Meta Descriptions": (percent("described"), scores.status(share("described"), 0.8, 0.5)), "Content Freshness": any60(fresh),
        "Schema Markup Diversity": any60(diverse), "Featured Snippet Readiness": unless(c("content") == 0, any60(ready)),
        "Answer Format Diversity": any60(formats), "Voice Search Optimization": unless(c("content") == 0, any60(voice)),
        "Duplicate Titles": (F.when(c("with_title") > 0, less("in_repeated", "with_title")).otherwise(100), few("in_repeated", 2)),
        "Duplicate Meta Descriptions": (F.when(c("told") > 0, less("told_twice", "told")).otherwise(100), few("told_twice", 2)),
        "Content Too Long for AI": (less("long"), few("long", 2)),
        "Paragraph Length Optimization": unless(
            c("content") == 0, (percent("even", "content"), scores.partly_if_any(share("even", "content"), 0.6)),
        ),
        "Answer-First Content Structure": unless(
            c("multi") == 0, (percent("answering", "multi"), scores.partly_if_any(share("answering", "multi"), 0.5)),
        ),
        "Organization Schema Completeness": graded(complete, 75, 50), "Security Headers": (secure, lambda s: scores.partly_if_any(s, 70)),
        "Compression": (percent("packed"), scores.partly_if_any(share("packed"), 0.8)),
        "Content Quotability Score": unless(c("content") == 0, any60(quotes)), "Topic Cluster Detection": unless(n < 3, any60(cluster)),
        "Content Readability": unless(c("content") == 0, (reading, scores.status(F.coalesce("flesch", F.lit(0.0)), 50, 30))),
        "Server-side Rendering": (percent("rendered"), scores.status(share("rendered"), 0.8, 0.5)),
        "Search Engine Indexing": graded(indexed, 100, 50), "Open Graph Tags": (percent("og"), scores.status(share("og"), 0.8, 0.5)),
        "Author & Expertise Signals": (
            F.when(c("longer") == 0, 50).otherwise(expert),
            lambda s: F.when(c("longer") == 0, "partial").otherwise(scores.partly_if_any(s, 60)),
        ),
        "Trust Signals": any60(trust), "Social Proof & Authority": any60(proof), "Citation Quality": unless(c("longer") == 0, any60(cited)),
        "Twitter Card Tags": any60(cards),
        "Breadcrumb Schema": (crumbs, lambda s: F.when(c("inner") == 0, "pass").otherwise(scores.partly_if_any(s, 60))),
        "hreflang Tags": unless(tags_needless, (percent("tagged"), scores.partly_if_any(share("tagged"), 0.6)), 100),
        "Brand Authority Score": unless(c("brand").isNull(), any60(c("brand"))), "Title Tags": graded(title, 70, 40),
        "Image Alt Text": graded(alt, 80, 50), "Internal Linking": graded(links, 70, 40),
        "Mobile Viewport": (percent("fitted"), scores.status(share("fitted"), 0.9, 0.5)),
        "HTTPS Enforcement": (percent("https"), scores.status(share("https"), 1, 0.8)),
        "Broken Pages": (less("broken"), F.when(c("broken") == 0, "pass").when(share("broken") <= 0.1, "partial").otherwise("fail")),
        "Nofollow on Internal Links": (nofollow, few("nofollow", 5)), "URL Structure Quality": (less("odd"), few("odd", 3)),
        "Canonical Link Issues": (astray, few("astray", 2)),
        "Semantic HTML Usage": (percent("semantic"), scores.partly_if_any(share("semantic"), 0.6)),
        "Text-to-HTML Ratio": (less("airy"), few("airy", 3)), "Page Response Time": (less("slow"), few("slow", 3)),
        "Redirect Chains": (less("chains"), few("chains", 3)), "Character Encoding & Doctype": (less("no_charset"), few("no_charset", 2)),
        "HTML Page Size": (less("big"), few("big", 2)), "Crawl Depth": (less("buried"), few("buried", 5)),
        "Broken External Links": unless(c("out_checked") == 0, (less("out_broken", "out_checked"), few("out_broken", 3))),
        "Temporary Redirects": (F.when(c("moved") == 0, 100).otherwise(less("moved_away", "moved")), few("moved_away", 5)),
        "Missing H1 Heading": (percent("h1"), scores.status(share("h1"), 1, 0.9)), "Core Web Vitals": graded(vitals, 70, 40),
        "Mobile Readiness": unless(
            c("mobile").isNull(), (mobile, lambda s: F.when(~c("mobile.accessible"), "fail").otherwise(scores.status(s, 80, 50))),
        ),
        "Responsive Images": (
            F.when(c("images_seen") == 0, 100).otherwise(percent("responsive", "images_seen")),
            F.when(c("images_seen") == 0, "pass").otherwise(scores.status(share("responsive", "images_seen"), 0.7, 0.3)),
        ),
    }


def items(facts: DataFrame) -> DataFrame:
    """``site, seq, name, category, score, max_score, status, severity``: all 68 items of each row of :func:`site_facts`."""
    return as_items(facts, file_items() | {"AI Content Directives": _directives()} | _page_items())


def expertise(facts: DataFrame) -> DataFrame:
    """Experience, expertise, authority and trust, 25 points each at most, and their sum."""
    yes = lambda name, points: F.when(c(name), points).otherwise(0)
    cap = lambda x: F.least(F.lit(25), x).cast("int")
    i = c("identity")
    social = F.coalesce(F.size(i["social"]), F.lit(0))
    authors = F.least(F.lit(8), scores.half_up(c("all_authored") / c("n") * 8))
    deep = F.when((c("content") > 0) & (c("content_words") / c("content") > 800), 4).otherwise(0)
    contact = F.when(_there(i["email"]), 3).otherwise(0) + F.when(_there(i["phone"]), 2).otherwise(0) + F.when(
        _there(i["address"]), 2,
    ).otherwise(0)
    brand = F.when(c("brand").isNull(), 0).otherwise(F.least(F.lit(4), scores.half_up(c("brand") / 25)))
    parts = {
        "experience": yes("any_first_person", 8) + yes("any_case_study", 7) + yes("any_research", 5) + yes("any_testimonials", 5),
        "expertise": authors + yes("any_bio", 5) + deep + yes("any_methodology", 4) + yes("any_credentials", 4),
        "authority": F.least(F.lit(6), social * 2) + F.least(
            F.lit(6), scores.half_up(c("citations") / 2),
        ) + yes("any_awards", 5) + yes("any_press", 4) + brand,
        "trust": contact + yes("any_privacy", 4) + yes("any_terms", 3) + yes("any_about", 4) + F.when(c("https") == c("n"), 3).otherwise(0) + F.when(c("org_complete"), 4).when(c("org_named"), 2).otherwise(0),
    }
    rows = facts.select("site", *(cap(x).alias(k) for k, x in parts.items()))
    return rows.withColumn("total", sum((c(k) for k in list(parts)[1:]), c("experience")))


def platforms(facts: DataFrame, audit: DataFrame) -> DataFrame:
    """``site, platform, score, grade`` of five answer engines: weighted items, with what each of them looks at besides."""
    names = sorted(
        {"Search Engine Indexing"}
        | {n for weights in catalog.PLATFORMS.values() for group, _ in weights for n in group if n in catalog.CATEGORY}
    )
    score = lambda n: F.coalesce(
        F.max(F.when((c("name") == n) & (c("status") != "not_applicable"), c("score") / c("max_score") * 100)), F.lit(0.0),
    )
    wide = audit.groupBy("site").agg(*(score(n).alias(f"i{k}") for k, n in enumerate(names)))
    value = {n: c(f"i{k}") for k, n in enumerate(names)}
    cap = lambda x: F.least(F.lit(100.0), x)
    i = c("identity")
    linked = lambda p: F.when(
        F.exists(
            F.coalesce(i["social"], F.array().cast("array<struct<platform:string,url:string>>")), lambda s: s["url"].contains(f"{p}.com"),
        ),
        30.0,
    ).otherwise(0.0)
    indexed = value["Search Engine Indexing"]
    value |= {
        "questions": cap(c("questions") * 10.0), "structure": cap(c("tables") * 15.0 + c("lists") * 5.0),
        "indexed and Bing 20": cap(indexed + F.when(c("bing"), 20).otherwise(0)),
        "indexed and Bing 25": cap(indexed + F.when(c("bing"), 25).otherwise(0)),
        "indexed and Google 15": cap(indexed + F.when(c("google"), 15).otherwise(0)),
        "reachable": F.when(_there(i["address"]), 50.0).otherwise(0.0) + F.when(_there(i["phone"]), 50.0).otherwise(0.0),
        **{f"linked {p}": linked(p) for p in ("reddit", "youtube", "linkedin")},
    }
    cells = []
    for platform, weights in catalog.PLATFORMS.items():
        terms = [reduce(lambda a, b: a + b, (value[n] for n in group)) / len(group) * w for group, w in weights]
        cells.append(F.struct(F.lit(platform).alias("platform"), scores.half_up(reduce(lambda a, b: a + b, terms)).alias("score")))
    rows = facts.join(wide, "site").select("site", F.inline(F.array(*cells)))
    return rows.withColumn("grade", scores.grade(c("score")))


def best_and_worst(rows: DataFrame) -> DataFrame:
    """``site, best, worst``: of platforms that tie, the first in their order is best and the last is worst."""
    place = F.element_at(F.create_map(*(F.lit(x) for k, p in enumerate(catalog.PLATFORMS) for x in (p, k))), c("platform"))
    return rows.groupBy("site").agg(
        F.max_by("platform", F.struct("score", -place)).alias("best"), F.min_by("platform", F.struct("score", -place)).alias("worst"),
    )
