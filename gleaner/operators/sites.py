"""Operators on page records by site: what is kept of doubles, what a site is about, files and queries made from its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls


def _there(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def one_of_each_canonical(pages: DataFrame) -> DataFrame:
    """Of pages that name one canonical address, the last one that stands at it, else the first; ``place`` is where the first of them was."""
    key = F.when(_there(F.col("canonical")), F.col("canonical")).otherwise(F.col("url"))
    own = F.col("url") == key
    rank = F.struct(own.cast("int"), F.when(own, F.col("page_id")).otherwise(-F.col("page_id")))
    best = pages.groupBy("site", key.alias("canonical_url")).agg(
        F.max_by("page_id", rank).alias("page_id"), F.max_by("url", rank).alias("url"), F.min("page_id").alias("first"),
        F.count("*").alias("pages"),
    )
    return best.select("site", "page_id", "url", "canonical_url", "pages", "first")


def link_sources(pages: DataFrame, links: str = "external", most: int | None = 250) -> DataFrame:
    """``site, target, sources, first_page``: the first targets of each site's links, which are the ones to probe, and how many pages have each; all of
    them, if ``most`` is None."""
    edges = pages.select("site", "page_id", F.posexplode(links).alias("place", "target"))
    grouped = edges.groupBy("site", "target").agg(
        F.countDistinct("page_id").alias("sources"), F.min(F.struct("page_id", "place")).alias("first"),
    )
    if most is not None:
        order = Window.partitionBy("site").orderBy("first")
        grouped = grouped.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return grouped.select("site", "target", "sources", F.col("first.page_id").alias("first_page"))


def probed_links(pages: DataFrame, links: str, statuses: DataFrame, most: int | None = None) -> DataFrame:
    """``site, url, status, sources, first_page``: the targets of :func:`link_sources` that a probe has looked at. ``statuses(url, status)``; 0 stands for
    no answer."""
    found = link_sources(pages, links, most).withColumnRenamed("target", "url")
    return found.join(
        statuses.select("url", "status").dropDuplicates(["url"]), "url",
    ).select("site", "url", "status", "sources", "first_page")


def compressed(pages: DataFrame, probed: DataFrame) -> DataFrame:
    """Headers with the content encoding that a probe of the site saw, on pages that tell none. ``probed(site, encoding)``."""
    known = F.col("headers")["content-encoding"].isNull() & F.col("encoding").isNotNull()
    filled = F.when(known, F.map_concat("headers", F.create_map(F.lit("content-encoding"), F.col("encoding")))).otherwise(F.col("headers"))
    return pages.join(probed, "site", "left").withColumn("headers", filled).drop("encoding")


def mobile_probe(pages: DataFrame) -> DataFrame:
    """What a phone gets of a home page against what a desktop gets: ``site, words, mobile_words, viewport, images, responsive`` in,
    ratio, whether contents differ, and how many issues of each kind out."""
    ratio = F.when(F.col("words") > 0, F.col("mobile_words") / F.col("words")).otherwise(1.0)
    view = F.coalesce("viewport", F.lit(""))
    told = lambda x: x.cast("int")
    viewport = F.when(view == "", 1).otherwise(
        told(~view.contains("width=device-width"))
        + told(view.rlike(r"(?i)user-scalable\s*=\s*no"))
        + told(view.rlike(r"(?i)maximum-scale\s*=\s*1"))
    )
    images = told((F.col("images") > 0) & (F.col("responsive") / F.col("images") < 0.5))
    return pages.select(
        "site", (F.floor(ratio * 100 + F.lit(0.5)) / 100).alias("content_ratio"), (F.abs(ratio - 1) > 0.15).alias("content_differs"),
        viewport.alias("viewport_issues"), told((ratio < 0.5) | (ratio > 1.5)).alias("content_issues"), images.alias("image_issues"),
        (
            F.floor(F.when(F.col("images") > 0, F.col("responsive") / F.col("images")).otherwise(1.0) * 100 + F.lit(0.5)) / 100
        ).alias("responsive_ratio"),
    )


def brand_scores(counts: DataFrame) -> DataFrame:
    """``site, mentions, channel, recent, total, community, article, entity, linked, verified, slug`` as probes counted them -> a score for
    each platform and the whole."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cap = lambda x: F.least(F.lit(100), x)
    plus = lambda c, p: F.when(F.coalesce(F.col(c), F.lit(False)), p).otherwise(0)
    youtube = cap(
        F.when(n("mentions") >= 5, 80).when(n("mentions") >= 2, 50).when(n("mentions") > 0, 25).otherwise(0) + plus("channel", 20)
    )
    reddit = cap(F.when(n("recent") >= 3, 85).when(n("total") >= 3, 55).when(n("total") > 0, 30).otherwise(0) + plus("community", 15))
    wikipedia = plus("article", 60) + plus("entity", 40)
    linkedin = F.when(
        F.coalesce(F.col("linked"), F.lit(False)), F.when(F.coalesce(F.col("verified"), F.lit(False)), 100).otherwise(70),
    ).otherwise(plus("slug", 60))
    rows = counts.select("site", youtube.alias("youtube"), reddit.alias("reddit"), wikipedia.alias("wikipedia"), linkedin.alias("linkedin"))
    weighed = sum((F.col(p) * w for p, w in catalog.BRAND_WEIGHTS[1:]), F.col(catalog.BRAND_WEIGHTS[0][0]) * catalog.BRAND_WEIGHTS[0][1])
    return rows.withColumn("brand", F.floor(weighed / 100 + F.lit(0.5)).cast("int"))


# --- files


def _joined(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The lines of each key as one text, in order."""
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n").alias("content")
    )


def sitemap_xml(entries: DataFrame, most: int = 50_000) -> DataFrame:
    """``site, file, content`` from ``site, page_id, loc, changefreq, priority``: documents of up to ``most`` entries, as many as a sitemap may have,
    numbered from 0."""
    line = F.concat(
        F.lit("  <url><loc>"), F.col("loc"), F.lit("</loc><changefreq>"), F.col("changefreq"), F.lit("</changefreq><priority>"),
        F.col("priority"), F.lit("</priority></url>"),
    )
    place = F.row_number().over(Window.partitionBy("site").orderBy("page_id"))
    rows = entries.select("site", "page_id", line.alias("line")).withColumn("file", F.floor((place - 1) / most).cast("int"))
    body = _joined(rows, ("site", "file"), "page_id")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return body.select("site", "file", F.concat(F.lit(head), F.col("content"), F.lit("\n</urlset>\n")).alias("content"))


def llms_txt(pages: DataFrame, names: DataFrame) -> DataFrame:
    """``site, content``: pages by section, main sections first, others as optional. ``names(site, name, tagline)``. A line a page: a file of a
    million pages is some 100 MB and one row."""
    section = urls.section_of(F.col("url"))
    orders = F.create_map(*(F.lit(x) for k, s in enumerate(catalog.LLMS_SECTIONS) for x in (s, k)))
    rows = pages.select(
        "site", "page_id", F.when(section.isin(*catalog.LLMS_SECTIONS[:7]), section).otherwise("Optional").alias("head"),
        orders[section].alias("rank"), "title", "url", "description",
    )
    title = F.when(_there(F.col("title")), F.col("title")).otherwise(urls.path_of(F.col("url")))
    line = F.concat(
        F.lit("- ["), title, F.lit("]("), F.col("url"), F.lit(")"),
        F.when(_there(F.col("description")), F.concat(F.lit(": "), F.col("description"))).otherwise(""),
    )
    lines = rows.select("site", "head", "rank", "page_id", line.alias("line"))
    heads = lines.groupBy("site", "head").agg(F.min("rank").alias("rank")).select(
        "site", "rank", F.lit(-1).cast("long").alias("page_id"), F.concat(F.lit("\n## "), F.col("head"), F.lit("\n")).alias("line"),
    )
    body = _joined(
        lines.select("site", "rank", F.col("page_id").cast("long").alias("page_id"), "line").unionByName(heads), ("site",), "rank",
        "page_id",
    )
    quote = F.when(_there(F.col("tagline")), F.concat(F.lit("\n> "), F.col("tagline"), F.lit("\n"))).otherwise("")
    return body.join(names, "site").select(
        "site", F.concat(F.lit("# "), F.col("name"), F.lit("\n"), quote, F.col("content"), F.lit("\n")).alias("content"),
    )


def robots_txt(sites: DataFrame, kept: DataFrame, now: str, training: bool = True) -> DataFrame:
    """``site, content``: rules for every known crawler and all others, with what ``kept(site, agent, path, line)`` keeps of the old file, in the
    order in which it stood there."""
    disallowed = F.transform(F.array_sort(F.collect_list(F.struct("line", "path"))), lambda r: F.concat(F.lit("Disallow: "), r["path"]))
    old = kept.where(F.col("agent").isin("*", "googlebot", "bingbot", "applebot")).groupBy("site", "agent").agg(disallowed.alias("rules"))
    held = old.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("agent", "rules"))).alias("old"))
    rows = sites.join(held, "site", "left")
    rules = lambda agent: F.coalesce(F.element_at("old", agent), F.array().cast("array<string>"))
    lines = lambda *told: F.array(*(F.lit(t) if isinstance(t, str) else t for t in told))
    home, everyone = F.concat(F.lit("https://"), F.col("site")), rules("*")
    noted = F.when(
        F.size(everyone) > 0, lines("# NOTE: Existing Disallow rules from original robots.txt have been preserved"),
    ).otherwise(F.array().cast("array<string>"))
    note = lambda b: f"# {catalog.CRAWLER_OWNERS[b][0]} — {catalog.CRAWLER_OWNERS[b][1]}"
    # fixed values: wording and order of the file
    parts = [
        lines(
            "# robots.txt", F.concat(F.lit("# Site: "), home), f"# Generated: {now[:10]}", "#", "# AI Crawler Directives",
            f"# Training data access: {'ALLOWED' if training else 'DENIED'}",
        ),
        noted, lines("", "# Standard Search Engines"),
    ]
    for agent in ("Googlebot", "Bingbot", "Applebot"):
        parts += [lines(f"User-agent: {agent}", "Allow: /"), rules(agent.lower()), lines("")]
    rule = "# " + "=" * 36
    parts.append(lines(rule, "# AI / LLM Crawler Directives", rule, "", "# AI Search & Retrieval (recommended: allow for visibility)"))
    for bot in (b for b, use in catalog.CRAWLER_USE if use == "search"):
        parts += [lines(note(bot), f"User-agent: {bot}", "Allow: /"), everyone, lines("")]
    parts.append(lines(f"# AI Training Crawlers ({'allowed' if training else 'denied'})"))
    for bot in (b for b, use in catalog.CRAWLER_USE if use == "training"):
        parts += [
            lines(note(bot), f"User-agent: {bot}", "Allow: /" if training else "Disallow: /"), *([everyone] if training else []),
            lines("Crawl-delay: 10", ""),
        ]
    parts += [lines("# Default: allow all other crawlers", "User-agent: *", "Allow: /"), everyone]
    parts.append(
        lines(
            "", F.concat(F.lit("Sitemap: "), home, F.lit("/sitemap.xml")), "", F.concat(F.lit("# LLMs.txt: "), home, F.lit("/llms.txt")),
            "",
        )
    )
    return rows.select("site", F.array_join(F.concat(*parts), "\n").alias("content"))


def policy_files(sites: DataFrame, now: str, training: bool = True, contact: str | None = None) -> DataFrame:
    """``site, file, content`` of ai.txt, ai.json, security.txt, tdmrep.json, humans.txt and manifest.json. ``sites`` has ``site, language, identity``
    as the extractor gives it; JSON is written without blanks, and without what isn't known."""
    i, site = F.col("identity"), F.col("site")
    day, home = now[:10], F.concat(F.lit("https://"), site)
    name = F.when(_there(i["name"]), i["name"]).otherwise(site)
    own = F.lit(contact) if contact else F.when(_there(i["email"]), i["email"])
    mail = lambda box: F.coalesce(own, F.concat(F.lit(f"{box}@"), site))
    known = own.isNotNull()
    expires = F.concat(F.date_format(F.add_months(F.to_date(F.lit(now)), 12), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    text = lambda *parts: F.array_join(
        F.concat(*(p if isinstance(p, Column) else F.array(*(F.lit(x) if isinstance(x, str) else x for x in p)) for p in parts)), "\n",
    )
    say = lambda label, x: F.concat(F.lit(label), x)
    no = F.array().cast("array<string>")
    only = lambda when, *told: F.when(when, F.array(*(F.lit(t) if isinstance(t, str) else t for t in told))).otherwise(no)
    copied = _there(i["copyright"])
    # fixed values: wording, order and fields of the files
    listed = lambda names: F.array(*map(F.lit, names))
    restrictions = ["Content must be attributed when cited", "Do not misrepresent or fabricate content"] + (
        [] if training else ["Content may NOT be used for AI model training"]
    )
    organization = F.struct(
        name.alias("name"), home.alias("url"), mail("ai").alias("contact"), F.when(~known, F.lit(True)).alias("contact_placeholder"),
        F.when(copied, i["copyright"]).alias("copyright"),
    )
    uses = F.struct(
        F.lit(training).alias("training"),
        *(F.lit(True).alias(u) for u in ("inference", "search", "summarization", "citation", "embedding")),
    )
    resources = F.struct(
        *(
            F.concat(home, F.lit(p)).alias(k)
            for k, p in (("llmsTxt", "/llms.txt"), ("sitemap", "/sitemap.xml"), ("robotsTxt", "/robots.txt"))
        )
    )
    crawlers = F.struct(
        listed(catalog.SEARCH_LISTED).alias("allowed_search"),
        listed(catalog.TRAINING_LISTED).alias("allowed_training" if training else "denied_training"),
    )
    icon = lambda at, sizes: F.struct(at.alias("src"), F.lit(sizes).alias("sizes"), _image_type(at).alias("type"))
    favicon, logo = (F.when(_there(i[c]), _seen_from(i[c], home)) for c in ("favicon", "logo"))
    icons = F.filter(
        F.array(
            F.when(favicon.isNotNull(), icon(favicon, "48x48")), F.when(logo.isNotNull(), icon(logo, "192x192")),
            F.when(logo.isNotNull(), icon(logo, "512x512")),
        ),
        lambda x: x.isNotNull(),
    )
    types = ("text/html", "application/json", "text/plain", "text/markdown", "application/xml")
    assurance = f"https://www.w3.org/2022/tdmrep/assurance#{'non-exclusive' if training else 'reserved'}"
    denied = [] if training else ["- Content may NOT be used for AI model training", "- Content may NOT be included in training datasets"]
    made = {
        "ai.txt": text(
            (
                "# AI Policy", say("# Organization: ", name), say("# URL: ", home), f"# Generated: {day}", "",
                "# Purpose: Define how AI systems may interact with this website's content",
            ),
            only(~known, "# TODO: Replace placeholder email below with your actual AI policy contact"),
            (
                "", "## Permissions", "", f"Training: {'yes' if training else 'no'}",
                *(f"{u}: yes" for u in ("Inference", "Search", "Summarization", "Citation", "Embedding")), "", "## Restrictions", "",
                *denied,
            ),
            (
                "- Content must be attributed when cited", "- Do not misrepresent or fabricate content from this site",
                "- Do not generate misleading summaries", "", "## Attribution", "",
            ),
            (say("Organization: ", name), say("URL: ", home), say("Contact: ", mail("ai"))),
            only(copied, say("Copyright: ", i["copyright"])),
            (
                "", "## Resources", "", say("LLMs.txt: ", F.concat(home, F.lit("/llms.txt"))),
                say("Sitemap: ", F.concat(home, F.lit("/sitemap.xml"))), say("Robots.txt: ", F.concat(home, F.lit("/robots.txt"))), "",
            ),
        ),
        "ai.json": F.to_json(
            F.struct(
                F.lit("1.0").alias("version"), F.lit(f"{day}T00:00:00.000Z").alias("generated"), organization.alias("organization"),
                uses.alias("permissions"), listed(restrictions).alias("restrictions"), resources.alias("resources"),
                crawlers.alias("crawlers"),
            )
        ),
        "security.txt": text(
            ("# Security Policy", say("# ", name), "#", "# This file follows RFC 9116 (https://www.rfc-editor.org/rfc/rfc9116)"),
            only(~known, "#", "# TODO: Replace the placeholder email below with your actual security contact"),
            (
                "", say("Contact: mailto:", mail("security")), say("Expires: ", expires), "Preferred-Languages: en",
                say("Canonical: ", F.concat(home, F.lit("/.well-known/security.txt"))), "",
            ),
        ),
        "tdmrep.json": F.to_json(
            F.struct(
                F.lit(1).alias("version"),
                F.array(
                    F.struct(F.lit("/").alias("location"), F.lit(assurance).alias("assurance"), listed(types).alias("type"))
                ).alias("policies"),
            )
        ),
        "humans.txt": text(
            (
                "/* TEAM */", say("  Name: ", name),
                F.concat(F.lit("  Contact: "), mail("hello"), F.when(known, "").otherwise("  # TODO: replace placeholder")),
            ),
            only(_there(i["address"]), say("  Location: ", i["address"])), ("", "/* TECHNOLOGY */"),
            F.when(
                F.size(i["tech"]) > 0, F.transform(i["tech"], lambda t: F.concat(F.lit("  "), t)),
            ).otherwise(F.array(F.lit("  HTML, CSS, JavaScript"))),
            (
                "", "/* SITE */", f"  Last update: {day}", say("  Language: ", F.coalesce(F.nullif("language", F.lit("")), F.lit("en"))),
                "  Standards: HTML5, CSS3, JavaScript ES2022", "",
            ),
        ),
        "manifest.json": F.to_json(
            F.struct(
                name.alias("name"), F.substring(name, 1, 12).alias("short_name"), F.lit("/").alias("start_url"),
                F.lit("standalone").alias("display"), F.lit("#ffffff").alias("background_color"), F.lit("#000000").alias("theme_color"),
                F.when(_there(i["tagline"]), i["tagline"]).alias("description"), F.when(F.size(icons) > 0, icons).alias("icons"),
            )
        ),
    }
    return sites.select("site", F.inline(F.array(*(F.struct(F.lit(n).alias("file"), t.alias("content")) for n, t in made.items()))))


def _seen_from(link: Column, home: Column) -> Column:
    return F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(
        link.startswith("/"), F.concat(home, link),
    ).otherwise(F.concat(home, F.lit("/"), link))


def _image_type(at: Column) -> Column:
    return F.when(at.endswith(".svg"), "image/svg+xml").when(at.endswith(".ico"), "image/x-icon").when(
        at.endswith(".webp"), "image/webp",
    ).otherwise("image/png")


def llms_full(pages: DataFrame, names: DataFrame) -> DataFrame:
    """``site, place, content``: the parts of each site's llms-full.txt in order: a head, then every page's title, address and Markdown, which is cut
    at 100 KiB characters; pages with less than 20 of them have no part. Joined by line ends they are the file; a site's pages never meet in one
    row, so a file may be of any size. ``pages`` have ``title, description, markdown``; ``names(site, name)``."""
    heads = pages.groupBy("site").agg(F.count("*").alias("n")).join(names, "site", "left")
    name = F.when(_there(F.col("name")), F.col("name")).otherwise(F.col("site"))
    # fixed values: wording of the file
    head = F.concat(
        F.lit("# "), name, F.lit(" — Complete Content\n\n> Full content of "), F.col("n").cast("string"), F.lit(" pages from "),
        F.col("site"), F.lit("\n\n---\n"),
    )
    most = 100 * 1024
    body = F.when(
        F.length("markdown") > most, F.concat(F.substring("markdown", 1, most), F.lit("\n\n[Content truncated]")),
    ).otherwise(F.col("markdown"))
    title = F.when(_there(F.col("title")), F.col("title")).otherwise(F.col("url"))
    told = F.when(_there(F.col("description")), F.concat(F.lit("\n**Description:** "), F.col("description"))).otherwise("")
    part = F.concat(F.lit("## "), title, F.lit("\n\n**Source:** "), F.col("url"), told, F.lit("\n\n"), body, F.lit("\n\n---\n"))
    rows = pages.where(F.length(F.trim("markdown")) >= 20).select(
        "site", F.col("page_id").cast("long").alias("place"), part.alias("content"),
    )
    return heads.select("site", F.lit(-1).cast("long").alias("place"), head.alias("content")).unionByName(rows)
