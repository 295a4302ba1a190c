"""Pages with rich markup, made from ``documents``: Spark builds their HTML and reads it back through the extractor, DuckDB works on the
fields that the HTML was built of. So extraction is held against a round trip, and every check on its fields against SQL.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls
from ..operators import audit, composite, extract, files, robots
from ..sources.scratch import checkpointed
from ..sources.tables import table
from .sql import NOT_WS, WS, grade_sql, half_up_sql, quoted, status_sql

AS_OF = "2024-06-01"
SECTIONS = ("blog", "about", "privacy", "terms", "products", "Docs_x", "press", "pages")
INTRO = "This page is about many things that people may want to know well."
ARTICLE = '{"@type":"Article","datePublished":"2024-01-05"}'
GRAPH = '{"@graph":[{"@type":"Organization","name":"Org","url":"https://org.example","logo":{"url":"/l.png"},"sameAs":["https://x.example"]},{"@type":"WebSite"}]}'
PLACE = '[{"@type":"Place","address":{"addressLocality":"Vilnius","addressCountry":"LT"}},{"@type":"Service","name":"Repair"},{"@type":"Product","name":"Widget"}]'
LISTED = '[{"@type":["HowTo","FAQPage"]},{"@type":"FAQPage"},{"@type":"BreadcrumbList"}]'
#: Fields by name, in SQL that both engines read; ``d`` is the number of the page and ``t`` its text in plain characters.
FIELDS = {
    "h1": "CASE WHEN d % 6 <> 0 THEN concat('Heading ', d) END", "question": "CASE WHEN d % 4 = 1 THEN 'What is this about?' END",
    "reply": "CASE WHEN d % 4 = 1 THEN 'It is a short answer to that very question.' END",
    "h4": "CASE WHEN d % 4 = 2 THEN 'Step 1 begin here' END", "h5": "CASE WHEN d % 8 = 2 THEN '2. Go on from there' END",
    "stat": "CASE WHEN d % 5 = 1 THEN 'Sales grew 45% and 3 out of 4 agree, according to Nature Group.' END",
    "told": "CASE WHEN d % 13 = 3 THEN 'In my experience this case study won an award, our research by certified staff.' END",
    "li1": "CASE WHEN d % 4 = 0 THEN 'First item' END", "li2": "CASE WHEN d % 4 = 0 THEN 'Second item' END",
    "cells": "CASE WHEN d % 6 = 2 THEN 'A1 B1 A2 B2' END",
    "quote": "CASE WHEN d % 7 = 0 THEN 'Quoted words that are long enough to count.' END",
    "dq": "CASE WHEN d % 5 = 0 THEN 'How long does it take?' END", "da": "CASE WHEN d % 5 = 0 THEN 'About three days.' END",
    "raw_title": "trim(CASE WHEN d % 10 = 1 THEN 'Shared title of all those pages here' WHEN d % 9 = 4 THEN '' ELSE concat('Page ', d, ' on ', substr(t, 1, d % 60)) END)",
    "raw_description": "CASE WHEN d % 3 = 0 THEN '' ELSE trim(substr(t, 1, 20 + d % 40)) END",
    "og_title": "CASE WHEN d % 2 = 0 THEN concat('Og ', d) END",
    "og_description": "CASE WHEN d % 5 <> 0 THEN 'A described page & more' END", "tw_card": "CASE WHEN d % 4 = 0 THEN 'summary' END",
    "tw_title": "CASE WHEN d % 4 < 2 THEN 't' END", "tw_description": "CASE WHEN d % 6 = 0 THEN 'd' END",
    "viewport": "CASE WHEN d % 11 <> 0 THEN 'width=device-width' END",
    "robots": "CASE WHEN d % 8 = 0 THEN 'max-snippet:-1, max-image-preview:large' WHEN d % 31 = 5 THEN 'NOINDEX' END",
    "google": "CASE WHEN d % 97 = 3 THEN 'g' END", "bing": "CASE WHEN d % 89 = 7 THEN 'b' END",
    "canonical": "CASE WHEN d % 3 = 1 THEN url WHEN d % 6 = 2 THEN concat('https://', source, '.example/gone/', d) END",
    "charset": "CASE WHEN d % 12 <> 0 THEN 'utf-8' END", "author": "CASE WHEN d % 2 = 1 THEN 'Ann Author' END",
    "author_bio": "CASE WHEN d % 8 = 1 THEN 'Writes about things since long ago.' END",
    "published": "CASE WHEN d % 6 = 1 THEN '2024-01-05T00:00:00Z' END", "modified": "CASE WHEN d % 12 = 1 THEN '2022-03-01' END",
    "last_modified": "CASE WHEN d % 5 = 3 THEN 'Mon, 01 Apr 2024 10:00:00 GMT' END", "x_robots": "CASE WHEN d % 53 = 9 THEN 'noindex' END",
    "og_image": "CASE WHEN d % 4 = 2 THEN '/og.png' END", "generator": "CASE WHEN d % 6 = 4 THEN 'Hugo 1' END",
    "favicon": "CASE WHEN d % 3 = 0 THEN '/f.ico' END", "copyright": "CASE WHEN d % 5 = 3 THEN concat('© 2024 ', source, ' Co.') END",
}
BODY = ("h1", "question", "reply", "h4", "h5", "t", "stat", "told", "li1", "li2", "cells", "quote", "dq", "da")


def _pages_sql(g: str) -> str:
    section = "CASE d % 8 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SECTIONS)) + " END"
    text = f"trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,!?]+', ' '{g}))"
    base = f"SELECT coalesce(doc_id, -1) AS d, coalesce(source, 'none') AS source, lang, {text} AS t FROM documents"
    at = f"SELECT *, concat(CASE WHEN d % 9 = 0 THEN 'http' ELSE 'https' END, '://', source, '.example/', {section}, '/', d) AS url FROM ({base}) AS b"
    # neighbours are found among numbers and addresses alone
    links = f"""SELECT d AS k, source AS s, lag(url) OVER (PARTITION BY source ORDER BY d) AS prev, min(concat(lpad(CAST(d AS VARCHAR(20)), 12, '0'), url)) OVER (PARTITION BY source) AS hub_key
 FROM (SELECT DISTINCT d, source, url FROM ({at}) AS a) AS x"""
    near = f"SELECT a.*, prev, hub_key FROM ({at}) AS a JOIN ({links}) AS l ON l.k = a.d AND l.s = a.source"
    return f"SELECT *, substr(hub_key, 13) AS hub, {', '.join(f'{x} AS {n}' for n, x in FIELDS.items())} FROM ({near}) AS n"


def rich_pages(spark, sf_dir: str) -> DataFrame:
    """``page_id, site, url, html, status, headers, response_ms, hops, depth, last_modified``: untidy pages of many sites."""
    # the same class letter by letter: Java looks such a class up in a table, but asks ranges one after the other
    sql = _pages_sql("").replace("[^A-Za-z0-9.,!?]", f"[^{ascii_letters}{digits}.,!?]")
    rows = spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    d = F.col("d")
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def tag(template: str, name: str):
        before, after = template.split("{}")
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(before), escaped(F.col(name)), F.lit(after))).otherwise("")

    plain = lambda condition, markup: F.when(condition, markup).otherwise("")
    image = lambda k: plain(
        d % 4 > k,
        F.concat(
            F.lit(f'<img src="/i{k}.png"'), plain(d % 3 > k, ' alt="An image"'),
            plain((d % 2 == 0) & F.lit(k == 0), ' srcset="/i0.png 2x"'), F.lit(">"),
        ),
    )
    block = lambda condition, json: plain(condition, f'<script type="application/ld+json">{json}</script>')
    section = F.regexp_extract("url", "example/([^/]*)/", 1)
    head = [
        plain(d % 14 != 0, "<!DOCTYPE html>\n"), F.concat(F.lit('<html lang="'), F.col("lang"), F.lit('"><head>')),
        tag('<meta charset="{}">', "charset"), tag("<title> {} </title>", "raw_title"),
        tag('<meta name="description" content="{}">', "raw_description"), tag('<meta property="og:title" content="{}">', "og_title"),
        tag('<meta property="og:description" content="{}">', "og_description"), tag('<meta name="twitter:card" content="{}">', "tw_card"),
        tag("<META property='twitter:title' CONTENT='{}'/>", "tw_title"),
        tag('<meta name="twitter:description" content="{}">', "tw_description"), tag('<meta name="viewport" content="{}">', "viewport"),
        tag('<meta name="robots" content="{}">', "robots"), tag('<meta name="google-site-verification" content="{}">', "google"),
        tag('<meta name="msvalidate.01" content="{}">', "bing"), tag('<link rel="canonical" href="{}">', "canonical"),
        tag('<meta name="author" content="{}">', "author"), tag('<meta property="og:image" content="{}">', "og_image"),
        tag('<meta name="generator" content="{}">', "generator"), tag('<link rel="icon" href="{}">', "favicon"),
        tag('<meta property="article:published_time" content="{}">', "published"),
        tag('<meta name="dateModified" content="{}">', "modified"),
        plain(d % 5 == 2, '<link rel="alternate" hreflang="en" href="/en"><link rel="alternate" hreflang="de-AT" href="/de">'),
        block(d % 6 == 1, ARTICLE), block(d % 50 == 2, GRAPH), block(d % 7 == 3, LISTED), block(d % 11 == 4, "{broken"),
        block(d % 31 == 7, PLACE), F.lit("<style>main { color: red }</style></head>\n<body>"),
    ]
    around = [
        F.lit('<nav><a href="#main">Skip</a>'),
        F.when(F.col("prev").isNotNull(), F.concat(F.lit('<a href="'), F.col("prev"), F.lit('">Previous</a>'))).otherwise(""),
        F.concat(F.lit('<a href="'), F.col("hub"), F.lit('#top">Hub</a>')),
        F.concat(F.lit('<a href="../'), section, F.lit("/./"), d.cast("string"), F.lit('/">This</a>')),
        F.lit('<a href="//Other.example/a/">Other</a>'),
        plain(d % 2 == 1, F.concat(F.lit('<a href="https://out.example/p'), (d % 40).cast("string"), F.lit('">Out</a>'))),
        plain(d % 4 == 1, '<a href="https://www.youtube.com/us">Y</a>'), plain(d % 10 == 0, '<a rel="nofollow" href="/login">Log in</a>'),
        plain(d % 3 == 0, '<a href="https://twitter.com/us">T</a>'),
        plain(d % 6 == 0, '<a href="https://www.linkedin.com/company/us">L</a>'), F.lit("</nav>"),
        plain(d % 3 == 1, '<div class="breadcrumbs"><a href="/">Home</a> <span>Here</span></div>'),
    ]
    main = [
        F.lit(f"<main>\n<p>{INTRO}\n"), tag("<h1> {} </h1>\n", "h1"), tag("<h2>{}</h2>\n", "question"), tag("<p>{}</p>\n", "reply"),
        tag("<h4>{}</h4>\n", "h4"), tag("<h5>{}</h5>\n", "h5"), tag("<p>{}</p>\n", "t"), tag("<p>{}\n", "stat"), tag("<p>{}</p>\n", "told"),
        plain(d % 4 == 0, "<ul>\n<li>First item\n<li>Second item</ul>\n"),
        plain(d % 6 == 2, "<table><tr><td>A1 <td>B1\n<tr><td>A2 <td>B2</table>\n"),
        tag('<blockquote cite="https://cite.example/x">{}</blockquote>\n', "quote"),
        plain(d % 5 == 0, "<details>\n<summary>How long does it take?</summary>\nAbout three days.\n</details>\n"), image(0), image(1),
        image(2), F.lit("<script>var a = '<h1>none</h1>'</script></main>"),
    ]
    foot = [
        F.lit("<footer>"), tag('<div class="author-bio">{}</div>', "author_bio"),
        plain(d % 4 == 0, '<address>1 Main\n St, Town</address><a href="mailto:us@x.example?subject=a">Mail</a>'),
        plain(d % 6 == 0, '<a href="tel:+1 555">Call</a>'), tag("<p>{} All rights reserved.</p>", "copyright"),
        plain(
            d % 9 == 2,
            F.concat(
                F.lit('<div itemscope itemtype="https://schema.org/Offer"><b itemprop="price">'), d.cast("string"),
                F.lit('</b><link itemprop="url" href="/buy"></div>'),
            ),
        ),
        plain(d % 9 == 5, '<div typeof="Person"><i property="name"> Ann </i></div>'), F.lit("</footer></body></html>"),
    ]
    header = lambda name, condition, value: (F.lit(name), F.when(condition, value))
    headers = F.map_filter(
        F.create_map(
            *(
                x
                for pair in (
                    header("content-encoding", d % 7 != 0, "GZIP"), header("strict-transport-security", d % 5 == 0, "max-age=1"),
                    header("x-frame-options", d % 2 == 0, "DENY"), header("cache-control", d % 3 != 0, "max-age=60"),
                    header("vary", d % 4 == 0, "Accept"), header("x-robots-tag", F.col("x_robots").isNotNull(), "noindex"),
                )
                for x in pair
            )
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        d.alias("page_id"), urls.domain_of(F.col("url")).alias("site"), "url", F.concat(*head, *around, *main, *foot).alias("html"),
        F.when(d % 17 == 0, 404).otherwise(200).alias("status"), headers.alias("headers"), (d * 37 % 4000).cast("int").alias("response_ms"),
        (d % 3).cast("int").alias("hops"), (d % 6).cast("int").alias("depth"), "last_modified",
    )


def rich_records(spark, sf_dir: str, *fields: str) -> DataFrame:
    return extract.records(rich_pages(spark, sf_dir), *fields)


#: What probes found, told by the numbers of pages: statuses of addresses, and of each site by its first page a phone's view, speed and fame.
_NUMBERS = "SELECT coalesce(doc_id, -1) AS d, coalesce(source, 'none') AS source, concat(CASE WHEN coalesce(doc_id, -1) % 9 = 0 THEN 'http' ELSE 'https' END, '://', coalesce(source, 'none'), '.example/') AS home FROM documents"
_STATUSES = f"""SELECT DISTINCT concat('https://out.example/p', d % 40) AS url, CASE d % 40 % 7 WHEN 3 THEN 404 WHEN 5 THEN 0 ELSE 200 END AS status FROM ({_NUMBERS}) AS a WHERE d % 2 = 1
 UNION SELECT DISTINCT 'https://www.youtube.com/us', 404 FROM documents UNION SELECT DISTINCT 'https://twitter.com/us', 200 FROM documents
 UNION SELECT concat(home, 'login'), 302 FROM ({_NUMBERS}) AS b WHERE d % 10 = 0 UNION SELECT home, 301 FROM ({_NUMBERS}) AS c WHERE d % 3 = 1"""
_MOBILE = (
    "d % 9 <> 1 AS accessible", "d % 11 <> 0 AS has_viewport",
    "CASE d % 3 WHEN 0 THEN 'width=device-width' WHEN 1 THEN 'width=device-width, user-scalable = no' ELSE 'initial-scale=1' END AS viewport_content",
    "CAST(d % 12 AS DOUBLE) / 10 AS content_ratio", "CAST(d % 4 AS INT) AS images", "CAST(d % 3 AS DOUBLE) / 2 AS responsive_ratio",
    "CAST(d % 3 AS INT) AS other_issues",
)


def statuses(spark, sf_dir: str) -> DataFrame:
    """``url, status`` of addresses that were looked at."""
    return spark.sql(
        _STATUSES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents").select("doc_id", "source"),
    )


def probes(spark, sf_dir: str) -> dict[str, DataFrame]:
    numbers = spark.sql(
        _NUMBERS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents").select("doc_id", "source"),
    )
    homes = numbers.groupBy(F.concat("source", F.lit(".example")).alias("site")).agg(F.min("d").alias("d"))
    return {
        "statuses": statuses(spark, sf_dir),
        "mobile": homes.where("d % 5 <> 0").selectExpr("site", *_MOBILE),
        "speed": homes.where("d % 3 = 0").selectExpr("site", "CAST(d * 7 % 101 AS INT) AS performance"),
        "brand": homes.where("d % 2 = 1").selectExpr("site", "CAST(d * 13 % 101 AS INT) AS brand"),
    }


# --- what DuckDB makes of the fields

_JSON = ((ARTICLE, "d % 6 = 1", 1), (GRAPH, "d % 50 = 2", 2), (LISTED, "d % 7 = 3", 3), (PLACE, "d % 31 = 7", 3))
_R = f"""r AS MATERIALIZED (SELECT *, concat(source, '.example') AS site, trim(regexp_replace(concat_ws(' ', {quoted(INTRO)}, {', '.join(BODY)}), '\\s+', ' ', 'g')) AS body, coalesce(nullif(raw_title, ''), og_title, h1, '') AS title, coalesce(nullif(raw_description, ''), og_description, '') AS description,
  list_filter(list_distinct([prev, hub, url, CASE WHEN d % 3 = 1 THEN regexp_replace(url, 'example/.*', 'example/') END, CASE WHEN d % 10 = 0 THEN regexp_replace(url, 'example/.*', 'example/login') END]), lambda x: x IS NOT NULL) AS internal, list_filter([regexp_replace(url, '://.*', '://other.example/a'), CASE WHEN d % 2 = 1 THEN concat('https://out.example/p', d % 40) END, CASE WHEN d % 4 = 1 THEN 'https://www.youtube.com/us' END, CASE WHEN d % 3 = 0 THEN 'https://twitter.com/us' END, CASE WHEN d % 6 = 0 THEN 'https://www.linkedin.com/company/us' END], lambda x: x IS NOT NULL) AS external,
  list_filter([CASE WHEN question IS NOT NULL THEN question END, CASE WHEN dq IS NOT NULL THEN dq END], lambda x: x IS NOT NULL) AS questions, {' + '.join(f'CASE WHEN {when} THEN {k} ELSE 0 END' for _, when, k in _JSON)} AS ld,
  list_concat(CASE WHEN d % 6 = 1 THEN ['Article'] ELSE [] END, list_concat(CASE WHEN d % 50 = 2 THEN ['Organization', 'WebSite'] ELSE [] END, list_concat(CASE WHEN d % 7 = 3 THEN ['HowTo', 'FAQPage', 'BreadcrumbList'] ELSE [] END, CASE WHEN d % 31 = 7 THEN ['Place', 'Service', 'Product'] ELSE [] END))) AS types,
  list_filter([CASE WHEN h1 IS NOT NULL THEN 1 END, CASE WHEN question IS NOT NULL THEN 2 END, CASE WHEN h4 IS NOT NULL THEN 4 END, CASE WHEN h5 IS NOT NULL THEN 5 END], lambda x: x IS NOT NULL) AS levels,
  list_filter([h1, question, h4, h5], lambda x: x IS NOT NULL) AS heads, CASE WHEN quote IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN stat IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN told IS NOT NULL THEN 1 ELSE 0 END AS sources FROM ({_pages_sql(", 'g'")}))"""
#: Words of a page's body.
_WORD_COUNT = f"len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> ''))"
_RICH: dict[str, tuple] = {}


def _query(sql: str):
    def add(f):
        _RICH[f.__name__] = (f, sql)
        return f

    return add


@_query(
    f"WITH {_R}, e AS (SELECT d AS page_id, heads, levels, unnest(range(1, len(heads) + 1)) AS i FROM r) SELECT page_id, (i - 1)::INTEGER AS place, levels[i]::INTEGER AS level, heads[i] AS text FROM e"
)
def page_headings(spark, sf_dir):
    return rich_records(spark, sf_dir, "headings").select(
        "page_id", F.posexplode("headings").alias("place", "h"),
    ).select("page_id", "place", "h.level", "h.text")


_META = (
    "title", "description", "canonical", "og_title", "og_description", "tw_card", "tw_title", "tw_description", "author", "author_bio",
    "published", "modified", "robots", "google", "bing", "viewport", "charset",
)


@_query(
    f"WITH {_R} SELECT d AS page_id, lang AS language, {', '.join(_META)}, d % 14 <> 0 AS doctype, CASE WHEN d % 5 = 2 THEN 'en,de-AT' ELSE '' END AS hreflang FROM r"
)
def page_meta(spark, sf_dir):
    return rich_records(spark, sf_dir, "language", *_META, "doctype", "hreflang").select(
        "page_id", "language", *_META, "doctype", F.array_join(F.transform("hreflang", lambda h: h.lang), ",").alias("hreflang"),
    )


@_query(
    f"WITH {_R} SELECT d AS page_id, body, len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> ''))::INTEGER AS words FROM r"
)
def page_body(spark, sf_dir):
    return rich_records(spark, sf_dir, "body", "words").select("page_id", "body", "words")


@_query(
    f"WITH {_R} SELECT d AS page_id, unnest(internal) AS target, true AS internal FROM r UNION ALL SELECT d, unnest(external), false FROM r"
)
def page_links(spark, sf_dir):
    kind = lambda c, inside: F.transform(c, lambda x: F.struct(x.alias("target"), F.lit(inside).alias("internal")))
    rows = rich_records(spark, sf_dir, "internal", "external")
    return rows.select("page_id", F.inline(F.concat(kind("internal", True), kind("external", False))))


@_query(
    f"WITH {_R}, k AS (SELECT d, unnest(range(0, d % 4)) AS k FROM r) SELECT d AS page_id, concat('/i', k, '.png') AS src, CASE WHEN d % 3 > k THEN 'An image' ELSE '' END AS alt FROM k"
)
def page_images(spark, sf_dir):
    return rich_records(spark, sf_dir, "images").select("page_id", F.inline("images"))


@_query(
    f"WITH {_R} SELECT d AS page_id, question, reply AS answer FROM r WHERE question IS NOT NULL UNION ALL SELECT d, dq, da FROM r WHERE dq IS NOT NULL"
)
def page_faq(spark, sf_dir):
    return rich_records(spark, sf_dir, "faq").select("page_id", F.inline("faq"))


@_query(
    f"WITH {_R} SELECT d AS page_id, ld::INTEGER AS items, array_to_string(types, ',') AS types, d % 50 = 2 AS organization, d % 6 = 1 AS dated FROM r"
)
def page_schema(spark, sf_dir):
    return rich_records(spark, sf_dir, "json_ld", "schema").select(
        "page_id", F.size("json_ld").alias("items"), F.array_join("schema.types", ",").alias("types"),
        F.col("schema.org").alias("organization"), F.col("schema.dated").alias("dated"),
    )


@_query(
    f"WITH {_R} SELECT d AS page_id, CASE WHEN d % 4 = 0 THEN 'First item,Second item' ELSE '' END AS lists, CASE WHEN d % 6 = 2 THEN 'A1,B1;A2,B2' ELSE '' END AS tables, CASE WHEN d % 3 = 1 THEN 'Home,Here' ELSE '' END AS crumbs FROM r"
)
def page_structure(spark, sf_dir):
    joined = lambda rows, sep: F.array_join(rows, sep)
    rows = rich_records(spark, sf_dir, "lists", "tables", "breadcrumbs")
    return rows.select(
        "page_id", joined(F.flatten("lists"), ",").alias("lists"),
        joined(F.transform(F.flatten("tables"), lambda r: F.array_join(r, ",")), ";").alias("tables"),
        joined(F.transform("breadcrumbs", lambda b: b["name"]), ",").alias("crumbs"),
    )


_STATS = "list_distinct(list_concat(regexp_extract_all(body, '\\d+(?:\\.\\d+)?%'), list_concat(regexp_extract_all(body, '(?i)\\d+x\\b'), regexp_extract_all(body, '(?i)\\d+\\s+out\\s+of\\s+\\d+'))))"


@_query(
    f"WITH {_R} SELECT d AS page_id, len({_STATS})::INTEGER AS statistics, sources::INTEGER AS sources, (quote IS NOT NULL)::INTEGER AS quotes FROM r"
)
def page_citations(spark, sf_dir):
    return rich_records(spark, sf_dir, "statistics", "sources", "quotes").select(
        "page_id", *(F.size(x).alias(x) for x in ("statistics", "sources", "quotes")),
    )


_FIRST = "h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site ORDER BY d) = 1)"
_IDENTITY = f"""{_FIRST}, y AS (SELECT site, CASE WHEN d % 50 = 2 THEN 'Org' WHEN raw_title <> '' THEN raw_title ELSE site END AS name, og_image AS logo, favicon, copyright, generator, nullif(description, '') AS tagline, CASE WHEN d % 4 = 0 THEN 'us@x.example' END AS email, CASE WHEN d % 6 = 0 THEN '+1 555' END AS phone,
 CASE WHEN d % 4 = 0 THEN '1 Main St, Town' END AS address, list_filter([CASE WHEN d % 4 = 1 THEN 'youtube' END, CASE WHEN d % 3 = 0 THEN 'twitter' END, CASE WHEN d % 6 = 0 THEN 'linkedin' END], lambda x: x IS NOT NULL) AS social FROM h)"""


_NAV = """list_filter(['Skip', CASE WHEN prev <> url THEN 'Previous' END, CASE WHEN hub <> url AND hub IS DISTINCT FROM prev THEN 'Hub' END, 'Other', CASE WHEN d % 2 = 1 THEN 'Out' END, CASE WHEN d % 4 = 1 THEN 'Y' END,
 CASE WHEN d % 10 = 0 THEN 'Log in' END, CASE WHEN d % 3 = 0 THEN 'T' END, CASE WHEN d % 6 = 0 THEN 'L' END], lambda x: x IS NOT NULL)"""


@_query(f"""WITH {_R} SELECT d AS page_id, array_to_string({_NAV}, ',') AS navigation, CASE WHEN d % 9 = 2 THEN concat('{{"@type": "Offer", "itemtype": "https://schema.org/Offer", "price": "', d, '", "url": "/buy"}}') ELSE '' END AS microdata,
 CASE WHEN d % 9 = 5 THEN '{{"@type": "Person", "name": "Ann"}}' ELSE '' END AS rdfa, copyright, favicon, coalesce(generator, '') AS tech, og_image FROM r""")
def page_extras(spark, sf_dir):
    rows = rich_records(spark, sf_dir, "navigation", "microdata", "rdfa", "identity", "og_image")
    listed = lambda c: F.array_join(c, ",").alias(c)
    told = ("copyright", "favicon")
    return rows.select(
        "page_id", F.array_join(F.transform("navigation", lambda n: n["text"]), ",").alias("navigation"), listed("microdata"),
        listed("rdfa"), *(F.col(f"identity.{c}") for c in told), F.array_join("identity.tech", ",").alias("tech"), "og_image",
    )


@_query(f"WITH {_R}, {_IDENTITY} SELECT * EXCLUDE (social, generator, favicon, copyright), array_to_string(social, ',') AS social FROM y")
def site_identity(spark, sf_dir):
    rows = extract.site_identity(rich_records(spark, sf_dir, "body", "identity"))
    return rows.select(
        "site", *(F.col(f"identity.{x}") for x in ("name", "tagline", "logo", "email", "phone", "address")),
        F.array_join(F.transform("identity.social", lambda s: s.platform), ",").alias("social"),
    )


# --- the audit

#: Contents of well-known files by the last character of a source.
FILES = (
    ("1", "robots.txt", "User-agent: *\nAllow: /\nSitemap: https://{site}/sitemap.xml"),
    (
        "2", "robots.txt",
        "User-agent: GPTBot\nUser-agent: ClaudeBot\n# both\n\nDisallow: /\nUser-agent: CCBot\nAllow: /\nDisallow: /admin\nDisallow: /x\n",
    ),
    ("3", "robots.txt", "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nAllow: /\nUser-agent: CCBot\nUser-agent: PerplexityBot\nAllow: /"),
    (
        "4", "robots.txt",
        "user-agent: CCBot\nDisallow: /\nUser-agent: Other\nDisallow: /a\nCrawl-delay: 5\nDisallow: /b\nHost: x\nDisallow: /c\nUser-agent: OAI-SearchBot\nAllow: /",
    ),
    ("1", "sitemap.xml", "<urlset><url><loc>https://{site}/</loc><lastmod>2024-01-01</lastmod></url></urlset>"),
    ("2", "sitemap.xml", "<urlset></urlset>"), ("1", "llms.txt", "# Open\n> An example\n## Pages\n[Home](https://{site}/)"),
    ("2", "llms.txt", "# Closed"), ("1", "ai.txt", "allow"), ("3", "ai.txt", "allow"), ("3", "ai.json", "{}"),
    ("1", "agent-card.json", '{"name": "x", "description": "y", "url": "", "capabilities": {"a": 1}}'), ("2", "agent-card.json", "{broken"),
    ("1", "agents.json", '[{"name": "a", "endpoint": "/e"}]'), ("2", "agents.json", '{"agents": [{"name": ""}]}'),
    ("3", "agents.json", '{"agents": []}'), ("4", "agents.json", "no"), ("1", "humans.txt", "us"), ("2", "BingSiteAuth.xml", "<users/>"),
)
_VARIANTS = ", ".join(f"({', '.join(map(quoted, row))})" for row in FILES)
_FILES = f"""files AS MATERIALIZED (SELECT concat(source, '.example') AS site, name, replace(content, '{{site}}', concat(source, '.example')) AS content
 FROM (SELECT DISTINCT coalesce(source, 'none') AS source FROM documents) JOIN (VALUES {_VARIANTS}) AS v(k, name, content) ON right(source, 1) = k)"""
#: Lines of the robots.txt of each customer's site, by its orders.
_ROBOT_LINES = (
    "User-agent: *", "User-agent: GPTBot", "Disallow: /", "Disallow: /admin", "# a comment", "", "User-agent: CCBot", "Allow: /",
    "Crawl-delay: 5", "Host: x", "User-agent: Googlebot", "Disallow: /x", "Disallow:", "user-agent: OAI-SearchBot", " Disallow: /tmp ",
    "User-agent: PerplexityBot",
)
_ROBOT_LINE = "CASE o_orderkey * 7 % 16 " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(_ROBOT_LINES)) + " END"
_CUSTOMER_FILES = f"""files AS MATERIALIZED (SELECT concat('c', o_custkey, '.example') AS site, 'robots.txt' AS name, string_agg({_ROBOT_LINE}, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey
 UNION ALL SELECT concat('c', c_custkey, '.example'), name, replace(content, '{{site}}', concat('c', c_custkey, '.example')) FROM customer JOIN (VALUES {_VARIANTS}) AS v(k, name, content) ON name <> 'robots.txt' AND c_custkey % 9 = CAST(k AS INTEGER))"""
_LINE = "trim(line, ' ' || chr(9) || chr(13))"
#: robots.txt line by line: rules belong to the agents since the last line that ended a group.
_ROBOTS = f"""rl AS (SELECT site, i, trim(string_split(content, chr(10))[i]) AS line FROM (SELECT site, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files WHERE name = 'robots.txt')),
rk AS (SELECT *, lower(trim(regexp_extract(line, '(?i)^User-agent:\\s*(.+)$', 1))) AS agent, line = '' OR starts_with(line, '#') AS idle, regexp_matches(line, '(?i)^Disallow:\\s*/\\s*$') AS shut, regexp_matches(line, '(?i)^Allow:\\s*/\\s*$') AS opened FROM rl),
rg AS (SELECT *, sum((agent = '' AND NOT idle)::INT) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (agent = '' AND NOT idle)::INT AS grp FROM rk),
ru AS (SELECT a.site, a.agent, b.shut, b.opened, a.i = max(a.i) OVER (PARTITION BY a.site, a.grp) AS last FROM rg a JOIN rg b ON a.site = b.site AND a.grp = b.grp AND a.agent <> '' AND b.agent = '' AND NOT b.idle),
bots AS (SELECT unnest([{', '.join(quoted(b.lower()) for b in catalog.AI_CRAWLERS)}]) AS bot),
rb AS (SELECT f.site, count(DISTINCT bot)::INTEGER AS blocked FROM (SELECT DISTINCT site FROM files) f, bots WHERE EXISTS (SELECT 1 FROM ru WHERE ru.site = f.site AND shut AND agent = bot) OR (EXISTS (SELECT 1 FROM ru WHERE ru.site = f.site AND shut AND agent = '*') AND NOT EXISTS (SELECT 1 FROM ru WHERE ru.site = f.site AND opened AND last AND agent = bot)) GROUP BY f.site),
rs AS (SELECT f.site, f.content, list_filter([{', '.join(quoted(b.lower()) for b in catalog.TRAINING_BOTS)}], lambda b: list_contains(coalesce(shutting, []), b)) AS training, list_filter([{', '.join(quoted(b.lower()) for b in catalog.RETRIEVAL_BOTS)}], lambda b: list_contains(coalesce(opening, []), b) OR (NOT list_contains(coalesce(shutting, []), b) AND contains(lower(f.content), b))) AS retrieval,
  len(list_filter([{', '.join(quoted(b.lower()) for b in catalog.TRAINING_BOTS + catalog.RETRIEVAL_BOTS)}], lambda b: contains(lower(f.content), b))) AS named FROM (SELECT site, content FROM files WHERE name = 'robots.txt') f
  LEFT JOIN (SELECT site, coalesce(list(agent) FILTER (WHERE shut AND last), []) AS shutting, coalesce(list(agent) FILTER (WHERE opened AND last), []) AS opening FROM ru GROUP BY site) USING (site)),
rt AS (SELECT site, CASE WHEN named = 0 THEN 0 WHEN len(training) > 0 AND len(retrieval) > 0 THEN least(100, 40 + len(training) / 4 * 30 + len(retrieval) / 4 * 30) WHEN len(retrieval) > 0 THEN floor(len(retrieval) / 4 * 50 + 0.5) ELSE 20 END AS strategy FROM rs)"""


def site_files(spark, sf_dir: str) -> DataFrame:
    """``site, name, content``: files of the sites that documents come from."""
    of = spark.createDataFrame(FILES, "k string, name string, content string")
    sites = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source")).distinct()
    site = F.concat("source", F.lit(".example"))
    return sites.join(of, F.right("source", F.lit(1)) == F.col("k")).select(
        site.alias("site"), "name", F.replace("content", F.lit("{site}"), site).alias("content"),
    )


def customer_files(spark, sf_dir: str) -> DataFrame:
    """``site, name, content``: a site for each customer, the lines of its robots.txt told by its orders."""
    orders = table(spark, sf_dir, "orders")
    line = F.element_at(F.array(*map(F.lit, _ROBOT_LINES)), (F.col("o_orderkey") * 7 % 16 + 1).cast("int"))
    site = lambda key: F.concat(F.lit("c"), F.col(key).cast("string"), F.lit(".example"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])
    robots_ = orders.groupBy("o_custkey").agg(F.array_join(lines, "\n").alias("content")).select(
        site("o_custkey").alias("site"), F.lit("robots.txt").alias("name"), "content",
    )
    of = spark.createDataFrame([f for f in FILES if f[1] != "robots.txt"], "k string, name string, content string")
    customers = table(spark, sf_dir, "customer").select(site("c_custkey").alias("site"), (F.col("c_custkey") % 9).cast("string").alias("k"))
    others = customers.join(of, "k").select("site", "name", F.replace("content", F.lit("{site}"), F.col("site")).alias("content"))
    return robots_.unionByName(others)


@_query(f"""WITH {_CUSTOMER_FILES}, {_ROBOTS}, f AS (SELECT DISTINCT site FROM files) SELECT site, coalesce(blocked, 0)::INTEGER AS blocked, CASE WHEN robots THEN {half_up_sql('(1 - coalesce(blocked, 0) / 13) * 100')} ELSE 100 END AS score, CASE WHEN coalesce(blocked, 0) = 0 THEN 'pass' WHEN blocked / 13 > 0.5 THEN 'fail' ELSE 'partial' END AS status,
 CASE WHEN robots THEN {half_up_sql('strategy')} ELSE 0 END AS strategy, CASE WHEN NOT robots THEN 'not_applicable' WHEN strategy >= 60 THEN 'pass' WHEN strategy > 0 THEN 'partial' ELSE 'fail' END AS strategy_status FROM f LEFT JOIN rb USING (site) LEFT JOIN rt USING (site) JOIN (SELECT site, bool_or(name = 'robots.txt') AS robots FROM files GROUP BY site) USING (site)""")
def bot_blocking(spark, sf_dir):
    return robots.bot_blocking(customer_files(spark, sf_dir))


@_query(f"""WITH {_CUSTOMER_FILES}, {_ROBOTS}, k AS (SELECT *, (agent = '' AND NOT idle AND NOT regexp_matches(line, '(?i)^(Allow|Disallow|Crawl-delay|Sitemap):'))::INT AS ends FROM rk), m AS (SELECT *, sum(ends) OVER (PARTITION BY site ORDER BY i) AS grp FROM k)
SELECT b.site, (b.i - 1)::INTEGER AS line, a.agent, lower(regexp_extract(b.line, '(?i)^(Allow|Disallow):', 1)) AS directive, regexp_extract(b.line, '(?i)^(?:Allow|Disallow):\\s*(.*)$', 1) AS path FROM m a JOIN m b ON a.site = b.site AND a.grp = b.grp AND a.i < b.i AND a.agent <> '' AND regexp_matches(b.line, '(?i)^(?:Allow|Disallow):\\s*\\S')""")
def robots_parse(spark, sf_dir):
    return robots.robots_rules(customer_files(spark, sf_dir))


_W = lambda c: f"len(regexp_split_to_array({c}, '{WS}+'))"
_LETTERS = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
_SYLLABLES = f"coalesce(list_sum(list_transform(w, lambda w: CASE WHEN length({_LETTERS}) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace({_LETTERS}, 'e$', ''), '[aeiouy]+'))) END)), 0)"
_WORDY = lambda p: f"regexp_matches(body, {quoted('(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')})"
_OPENS = lambda p: f"regexp_matches(body, {quoted('(?i)^' + chr(92) + 's*(?:' + p + ')' + chr(92) + 'b')})"
_DATE = lambda c: f"CASE WHEN {c} LIKE '20%' THEN strptime(substr({c}, 1, 10), '%Y-%m-%d') WHEN {c} IS NOT NULL THEN TIMESTAMP '2024-04-01 10:00:00' END"


#: The first 250 different targets of each site's links, in the order of pages and of links on them.
_TARGETS = lambda c: f"SELECT site, target FROM (SELECT site, target, row_number() OVER (PARTITION BY site ORDER BY min(row(d, i))) AS p FROM (SELECT site, d, i, {c}[i] AS target FROM (SELECT site, d, {c}, unnest(range(1, len({c}) + 1)) AS i FROM r)) GROUP BY site, target) WHERE p <= 250"
_MOBILE_SCORE = f"""CASE WHEN first_d % 9 = 1 THEN 0 ELSE greatest(0, 100 - CASE WHEN first_d % 11 = 0 THEN 30 WHEN first_d % 3 = 0 THEN 0 WHEN first_d % 3 = 1 THEN 10 ELSE 15 END
 - CASE WHEN first_d % 12 < 5 THEN 30 WHEN first_d % 12 / 10 < 0.85 THEN 15 ELSE 0 END - CASE WHEN first_d % 4 > 0 THEN 20 - {half_up_sql('first_d % 3 / 2 * 20')} ELSE 0 END - least(20, 10 * (first_d % 3))) END"""


#: All of them.
_ALL_TARGETS = lambda c: f"SELECT DISTINCT site, unnest({c}) AS target FROM r"


def _audit_sql(targets=_TARGETS) -> str:
    some = lambda name, x: f"count_if({x}) AS {name}"
    facts = f"""f AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> '') AS w, list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: regexp_matches(s, '{NOT_WS}')) AS sentences, coalesce(modified, published, last_modified) AS stamp, regexp_replace(url, '^[a-z]*://[^/]*', '') AS path,
 concat_ws(' ', robots, x_robots) AS directives, list_concat(list_filter(heads, lambda h: ends_with(h, '?') OR regexp_matches(h, '(?i)^(?:{catalog.ASKS_FIRST})\\b')), []) AS asks FROM r),
p AS MATERIALIZED (SELECT *, len(w) AS words, {_SYLLABLES} AS syl, len(list_filter(regexp_split_to_array(body, '\\.{WS}+'), lambda s: regexp_matches(s, '{NOT_WS}') AND {_W('s')} BETWEEN 30 AND 70)) > 0 AS snippet, len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: length(trim(s)) > 10 AND {_W('trim(s)')} BETWEEN 5 AND 30)) > 0 AS short FROM f)"""
    sums = [
        "count(*) AS n", some("with_ld", "ld > 0"), "sum(len(questions)) AS faqs", "bool_or(d % 7 = 3) AS faq_page",
        some("thin", "words < 300"), some("deep", "words > 500"), some("built", "words > 500 AND len(heads) >= 3"),
        some("headed", "len(heads) > 0"), some("ordered", "h1 IS NOT NULL AND h4 IS NULL AND len(heads) > 0"),
        some("described", "length(description) >= 30"), some("dated", "stamp IS NOT NULL"),
        some("recent", f"({_DATE('stamp')}) > TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 365 DAY"), some("ld_dated", "d % 6 = 1"),
        some("content", "words > 100"), some("ready", "words > 100 AND snippet"),
        some("defining", f"words > 100 AND {_WORDY(catalog.DEFINES)}"), some("tabled", "cells IS NOT NULL"),
        some("listed", "li1 IS NOT NULL"), some("asked", "len(questions) > 0"), some("stepped", "h4 IS NOT NULL"),
        "sum(CASE WHEN words > 100 THEN len(asks) ELSE 0 END) AS asking",
        "sum(CASE WHEN words > 100 THEN len(heads) ELSE 0 END) AS head_total", some("short", "words > 100 AND short"),
        some("long", "words > 10000"), some("even", "words > 100 AND words BETWEEN 40 AND 75"),
        some("multi", "words > 100 AND len(heads) >= 2"),
        some(
            "answering",
            f"words > 100 AND len(heads) >= 2 AND words BETWEEN 20 AND 80 AND NOT {_OPENS(catalog.LEADS_BY_QUESTION)} AND {_WORDY(catalog.ANSWERS)}",
        ),
        some("parts", "words > 100"),
        some(
            "quotable",
            f"words > 100 AND words BETWEEN 20 AND 80 AND NOT {_OPENS(catalog.LEANS_ON_CONTEXT)} AND {_WORDY(catalog.QUOTABLE)}",
        ),
        "bool_or(d % 50 = 2) AS org", some("packed", "d % 7 <> 0"), "arg_min(d, d) AS first_d",
        "avg(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (words / len(sentences)) - 84.6::DOUBLE * (syl / words)))) FILTER (WHERE words > 100) AS flesch",
        "sum(words) FILTER (WHERE words > 100) AS content_words", some("snippets", "contains(lower(directives), 'max-snippet')"),
        some("rendered", "words > 50"), "bool_or(google IS NOT NULL) AS google", "bool_or(bing IS NOT NULL) AS bing",
        some("noindex", "contains(lower(directives), 'noindex')"), some("canon", "canonical IS NOT NULL"),
        some("og", "og_title IS NOT NULL AND og_description IS NOT NULL"),
        "sum((tw_card IS NOT NULL)::INT + (tw_title IS NOT NULL)::INT + (tw_description IS NOT NULL)::INT) AS tw",
        some("longer", "words > 200"), some("authored", "words > 200 AND author IS NOT NULL"),
        some("bios", "words > 200 AND author_bio IS NOT NULL"), some("figured", f"words > 200 AND len({_STATS}) > 0"),
        some("sourced", "words > 200 AND sources > 0"), some("linked_out", "words > 200"), some("crumbs", "d % 3 = 1"),
        some("crumb_ld", "d % 7 = 3"), some("tagged", "d % 5 = 2"),
        *(f"bool_or(d % 8 = {k}) AS {a}" for a, k in (("about", 1), ("privacy", 2), ("terms", 3), ("pressed", 6))), "sum(d % 4) AS images",
        "sum(least(d % 4, d % 3)) AS alts", some("fitted", "viewport IS NOT NULL"), some("https", "d % 9 <> 0"),
        some("broken", "d % 17 = 0"), some("nofollow", "d % 10 = 0"), "sum(len(internal)) AS links", some("odd", "d % 8 = 5"),
        some("slow", "d * 37 % 4000 > 3000"), some("chains", "d % 3 > 1"), some("no_charset", "charset IS NULL OR d % 14 = 0"),
        some("buried", "d % 6 > 3"), some("h1s", "h1 IS NOT NULL"), some("responsive", "d % 2 = 0 AND d % 4 > 0"),
        "list_sort(list(d * 37 % 4000))[count(*) // 2 + 1] AS mid_ms",
        "list_sort(list(3 - 1 + (d % 6 = 1)::INT + (d % 50 = 2)::INT + (d % 7 = 3)::INT + (d % 11 = 4)::INT + (d % 31 = 7)::INT - 1))[count(*) // 2 + 1] AS mid_scripts",
        some("cached", "d % 3 <> 0"), some("varied", "d % 4 = 0"),
        *(
            f"bool_or({x}) AS any_{a}"
            for a, x in (
                ("first", _WORDY(catalog.FIRST_PERSON)), ("research", _WORDY(catalog.RESEARCH)),
                ("credentials", _WORDY(catalog.CREDENTIALS)), ("awards", _WORDY(catalog.AWARDS)),
            )
        ),
        "bool_or(regexp_matches(substr(body, 1, 500), '(?i)\\bcase\\s+stud(?:y|ies)\\b')) AS any_case",
        some("all_authored", "author IS NOT NULL"), "bool_or(author_bio IS NOT NULL) AS any_bio",
        "sum(sources + (quote IS NOT NULL)::INT) AS citations", some("questioned", "question IS NOT NULL"),
    ]
    grouped = lambda name, x, least, more: f"{name} AS (SELECT site, {more} FROM (SELECT site, {x} AS x, count(*) AS k FROM r WHERE length({x}) >= {least} GROUP BY site, x) GROUP BY site)"
    return f"""{_R}, {facts}, s AS (SELECT site, {', '.join(sums)} FROM p GROUP BY site), {_IDENTITY}, {_FILES}, {_ROBOTS},
{grouped('ti', 'title', 1, 'sum(k) AS titled, sum(CASE WHEN length(x) BETWEEN 30 AND 70 THEN k ELSE 0 END) AS fitting, count_if(k > 1) AS repeated, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS in_repeated')}, {grouped('de', 'trim(description)', 20, 'sum(k) AS told, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS told_twice')},
ty AS (SELECT site, count(*) AS types, count_if(t IN ({', '.join(map(quoted, catalog.VALUABLE_TYPES))})) AS valuable FROM (SELECT DISTINCT site, unnest(types) AS t FROM r) GROUP BY site), la AS (SELECT site, count(*) AS languages FROM (SELECT DISTINCT site, lang AS l FROM r WHERE lang <> '' UNION SELECT site, unnest(['en', 'de']) FROM r WHERE d % 5 = 2) GROUP BY site),
ed AS (SELECT site, target, count(*) AS k FROM (SELECT site, unnest(internal) AS target FROM r) GROUP BY site, target), ne AS (SELECT ed.site, ed.target, k, len(w) AS words, len(internal) AS out FROM ed JOIN f ON f.site = ed.site AND f.url = ed.target), nm AS (SELECT site, avg(k) AS mean, max(k) AS most FROM ne GROUP BY site),
cl AS (SELECT site, count_if(k >= greatest(3, 2 * mean)) AS pillars, count_if(k >= greatest(3, 2 * mean) AND words > 500 AND out >= 3) AS rich, max(most) > 1.5 * max(mean) AS varied_links FROM ne JOIN nm USING (site) GROUP BY site), orp AS (SELECT r.site, count(*) AS orphans FROM r WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.site = r.site AND ed.target = r.url) GROUP BY r.site),
st AS ({_STATUSES}), oc AS (SELECT site, count(*) AS out_checked, count_if(status >= 400 OR status = 0) AS out_broken FROM ({targets('external')}) JOIN st ON url = target GROUP BY site),
mv AS (SELECT site, count(*) AS moved, count_if(status IN (302, 307)) AS moved_away FROM ({targets('internal')}) JOIN st ON url = target WHERE status IN (301, 302, 307, 308) GROUP BY site),
ca AS (SELECT site, count_if(contains(canonical, '/gone/')) AS astray FROM r GROUP BY site), fw AS (SELECT site, {', '.join(f"coalesce(max(content) FILTER (WHERE name = {quoted(n)}), '') AS f{k}" for k, n in enumerate(catalog.FILES))} FROM files GROUP BY site),
j AS (SELECT * REPLACE ({', '.join(f"coalesce(f{k}, '') AS f{k}" for k in range(len(catalog.FILES)))}, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('titled', 'fitting', 'repeated', 'in_repeated', 'told', 'told_twice', 'types', 'valuable', 'languages', 'orphans', 'pillars', 'rich', 'astray', 'out_checked', 'out_broken', 'moved', 'moved_away'))}, coalesce(varied_links, false) AS varied_links),
  CASE WHEN first_d % 2 = 1 THEN first_d * 13 % 101 END AS brand, CASE WHEN first_d % 3 = 0 THEN first_d * 7 % 101 END AS performance, CASE WHEN first_d % 5 <> 0 THEN {_MOBILE_SCORE} END AS mobile
 FROM s LEFT JOIN y USING (site) LEFT JOIN ti USING (site) LEFT JOIN de USING (site) LEFT JOIN ty USING (site) LEFT JOIN la USING (site) LEFT JOIN orp USING (site) LEFT JOIN cl USING (site) LEFT JOIN oc USING (site) LEFT JOIN mv USING (site) LEFT JOIN ca USING (site) LEFT JOIN fw USING (site) LEFT JOIN rb USING (site) LEFT JOIN rt USING (site))"""


def _items_sql(facts: str, names: tuple[str, ...] = ()) -> str:
    """Items, or those of some names, over ``facts``, whose last table is ``j``."""
    up, F_ = half_up_sql, {n: f"f{k}" for k, n in enumerate(catalog.FILES)}
    share = lambda x, of="n": f"(CASE WHEN {of} > 0 THEN {x} / {of} ELSE 0.0 END)"
    percent = lambda x, of="n": up(f"{share(x, of)} * 100")
    less = lambda x, of="n": up(f"(1 - {share(x, of)}) * 100")
    some = lambda x, a: f"CASE WHEN {x} >= {a} THEN 'pass' WHEN {x} > 0 THEN 'partial' ELSE 'fail' END"
    few = lambda x, k: f"CASE WHEN {x} = 0 THEN 'pass' WHEN {x} <= {k} THEN 'partial' ELSE 'fail' END"
    by60 = lambda x: (x, some(f"({x})", 60))
    there = lambda n: (f"CASE WHEN {F_[n]} <> '' THEN 100 ELSE 0 END", f"CASE WHEN {F_[n]} <> '' THEN 'pass' ELSE 'fail' END")
    unless = lambda empty, pair, zero=0: (
        f"CASE WHEN {empty} THEN {zero} ELSE {pair[0]} END", f"CASE WHEN {empty} THEN 'not_applicable' ELSE {pair[1]} END",
    )
    points = lambda *rules: " + ".join(f"CASE WHEN {x} THEN {p} ELSE 0 END" for x, p in rules)
    robots_, llms, card, agents = F_["robots.txt"], F_["llms.txt"], F_["agent-card.json"], F_["agents.json"]
    major = " + ".join(f"contains({robots_}, {quoted(b)})::INT" for b in catalog.MAJOR_CRAWLERS)
    json = lambda x, path: f"coalesce(json_extract_string(CASE WHEN json_valid({x}) THEN {x} END, {quoted(path)}), '') NOT IN ('', 'false', '0', 'null')"
    card_score = f"CASE WHEN {card} = '' THEN 0 WHEN NOT json_valid({card}) THEN 10 ELSE 30 + {points(*((json(card, f'$.{k}'), p) for k, p in catalog.AGENT_CARD))} END"
    one = f"json_extract(CASE WHEN json_valid({agents}) THEN {agents} END, CASE WHEN starts_with({agents}, '[') THEN '$[0]' ELSE '$.agents[0]' END)"
    agent_score = f"CASE WHEN {agents} = '' THEN 0 WHEN NOT json_valid({agents}) THEN 10 WHEN {one} IS NULL THEN 40 ELSE 70 + {points((json(f'{one}::VARCHAR', '$.name'), 15), (' OR '.join(json(f'{one}::VARCHAR', f'$.{k}') for k in ('description', 'endpoint', 'url')), 15))} END"
    schema = f"CASE WHEN with_ld = 0 THEN 0 ELSE least(100, least(50, {up(share('with_ld') + ' * 50')}) + {points(('org', 35), ('types >= 3', 15))}) END"
    faq = f"CASE WHEN faqs = 0 THEN 0 ELSE least(100, least(60, faqs * 15) + {points(('faq_page', 40))}) END"
    formats = f"least(100, 15 * ((tabled > 0)::INT + (listed > 0)::INT + (asked > 0)::INT + (stepped > 0)::INT) + {up('(tabled + listed + asked + stepped) / (n * 4) * 40')})"
    indexed = f"{points(('google', 20), ('bing OR ' + F_['BingSiteAuth.xml'] + chr(32) + chr(60) + chr(62) + chr(32) + chr(39) * 2, 20), (f'''regexp_matches({robots_}, '(?im)^Sitemap:')''', 20), ('noindex = 0', 20))} + CASE WHEN {share('canon')} >= 0.8 THEN 20 ELSE {up('20 * ' + share('canon'))} END"
    trust = f"least(100, {points(('email IS NOT NULL', 10), ('phone IS NOT NULL', 10), ('address IS NOT NULL', 10), ('about', 25), ('privacy', 15), ('terms', 10), ('coalesce(name, ' + chr(39) * 2 + ') <> ' + chr(39) * 2, 10), ('logo IS NOT NULL', 10))})"
    title = up(f"{share('titled')} * 40 + {share('fitting', 'titled')} * 30 + CASE WHEN n > 1 THEN 1 - repeated / n ELSE 1.0 END * 30")
    links = f"least(100, CASE WHEN links / n >= 5 THEN 50 ELSE {up('links / n / 5 * 50')} END + {up('(1 - CASE WHEN n > 1 THEN orphans / (n - 1) ELSE 0.0 END) * 50')})"
    vitals = f"coalesce(performance, CASE WHEN mid_ms < 1000 THEN 30 WHEN mid_ms < 2000 THEN 20 WHEN mid_ms < 3000 THEN 10 ELSE 0 END + {points(('packed / n >= 0.8', 10), ('cached / n >= 0.5', 10), ('varied / n >= 0.3', 5))} + 25 + 20)"
    secure = points(("first_d % 5 = 0", 35), ("first_d % 2 = 0", 15))
    cluster = f"least(100, {points(('pillars > 0', 40), ('varied_links', 30))} + {up(share('rich', 'pillars') + ' * 30')})"
    strategy = "coalesce(strategy, 0)"
    half = up("50 * 2 * greatest(snippets / n, CASE WHEN snippets > 0 THEN 0.5 ELSE 0.0 END)") if True else ""
    half = f"CASE WHEN snippets > 0 THEN {half} ELSE 0 END"
    pair = f"(({F_['ai.txt']} <> '')::INT + ({F_['ai.json']} <> '')::INT)"
    llms_score = f"CASE WHEN {llms} = '' THEN 0 ELSE 40 + 15 * (" + " + ".join(
        f"regexp_matches({llms}, {quoted(p)})::INT" for p in (r"(?m)^# .+", r"(?m)^> .+", r"(?m)^## .+", r"\[[^\]]+\]\([^)]+\)")
    ) + ") END"
    sitemap = f"CASE WHEN {F_['sitemap.xml']} = '' THEN 0 ELSE 50 + 25 * contains({F_['sitemap.xml']}, '<loc>')::INT + 25 * contains({F_['sitemap.xml']}, '<lastmod>')::INT END"
    blocked = "coalesce(blocked, 0)"
    made = {
        "robots.txt": (
            f"CASE WHEN {robots_} = '' THEN 0 WHEN {major} = 0 THEN 30 ELSE {up(f'least(100, 30 + ({major}) / 5 * 70)')} END",
            f"CASE WHEN {robots_} = '' THEN 'fail' WHEN {major} >= 3 THEN 'pass' ELSE 'partial' END",
        ),
        "sitemap.xml": (sitemap, some(f"({sitemap})", 75)), "llms.txt": (llms_score, some(f"({llms_score})", 70)),
        "llms-full.txt": there("llms-full.txt"),
        "AI Policy (ai.txt / ai.json)": (f"50 * {pair}", f"CASE {pair} WHEN 2 THEN 'pass' WHEN 1 THEN 'partial' ELSE 'fail' END"),
        "AI Bot Blocking": (
            up(f"(1 - {blocked} / 13) * 100"),
            f"CASE WHEN {blocked} = 0 THEN 'pass' WHEN {blocked} / 13 > 0.5 THEN 'fail' ELSE 'partial' END",
        ),
        "AI Content Directives": by60(half),
        "Training vs Retrieval Bot Strategy": (
            up(strategy), f"CASE WHEN {robots_} = '' THEN 'not_applicable' ELSE {some(strategy, 60)} END",
        ),
        "agent-card.json": (
            card_score, f"CASE WHEN ({card_score}) >= 70 THEN 'pass' WHEN ({card_score}) > 10 THEN 'partial' ELSE 'fail' END",
        ),
        "agents.json": (agent_score, status_sql(f"({agent_score})", 70, 40)),
        "Structured Data (JSON-LD)": (schema, f"CASE WHEN with_ld = 0 THEN 'fail' WHEN ({schema}) >= 60 THEN 'pass' ELSE 'partial' END"),
        "FAQ Content": (faq, f"CASE WHEN faqs = 0 THEN 'fail' WHEN ({faq}) >= 60 THEN 'pass' ELSE 'partial' END"),
        "Content Structure & Depth": by60(
            f"least(100, {up('(1 - ' + share('thin') + ') * 30 + ' + share('deep') + ' * 40 + ' + share('built') + ' * 30')})"
        ),
        "Heading Hierarchy": unless("headed = 0", (percent("ordered", "headed"), status_sql(share("ordered", "headed"), 0.8, 0.5))),
        "Meta Descriptions": (percent("described"), status_sql(share("described"), 0.8, 0.5)),
        "Content Freshness": by60(
            f"least(100, {up(share('dated') + ' * 50 + ' + share('recent', 'dated') + ' * 30 + ' + share('ld_dated') + ' * 20')})"
        ),
        "Schema Markup Diversity": by60("least(100, valuable * 25)"),
        "Featured Snippet Readiness": unless(
            "content = 0", by60(up(share("ready", "content") + " * 70 + " + share("defining", "content") + " * 30")),
        ),
        "Answer Format Diversity": by60(formats),
        "Voice Search Optimization": unless(
            "content = 0", by60(f"least(100, {up(share('asking', 'head_total') + ' * 50 + ' + share('short', 'content') + ' * 50')})"),
        ),
        "Duplicate Titles": (f"CASE WHEN titled > 0 THEN {less('in_repeated', 'titled')} ELSE 100 END", few("in_repeated", 2)),
        "Duplicate Meta Descriptions": (f"CASE WHEN told > 0 THEN {less('told_twice', 'told')} ELSE 100 END", few("told_twice", 2)),
        "Content Too Long for AI": (less("long"), few("long", 2)),
        "Paragraph Length Optimization": unless("content = 0", (percent("even", "content"), some(share("even", "content"), 0.6))),
        "Answer-First Content Structure": unless("multi = 0", (percent("answering", "multi"), some(share("answering", "multi"), 0.5))),
        "Organization Schema Completeness": ("CASE WHEN org THEN 75 ELSE 0 END", "CASE WHEN org THEN 'pass' ELSE 'fail' END"),
        "Security Headers": (secure, some(f"({secure})", 70)), "Compression": (percent("packed"), some(share("packed"), 0.8)),
        "Content Quotability Score": unless("content = 0", by60(f"least(100, {up(share('quotable', 'parts') + ' * 150')})")),
        "Topic Cluster Detection": unless("n < 3", by60(cluster)),
        "Content Readability": unless(
            "content = 0", (f"least(100, {up('coalesce(flesch, 0) * 100 / 60')})", status_sql("coalesce(flesch, 0)", 50, 30)),
        ),
        "Server-side Rendering": (percent("rendered"), status_sql(share("rendered"), 0.8, 0.5)),
        "Search Engine Indexing": (indexed, status_sql(f"({indexed})", 100, 50)),
        "Open Graph Tags": (percent("og"), status_sql(share("og"), 0.8, 0.5)),
        "Author & Expertise Signals": (
            f"CASE WHEN longer = 0 THEN 50 ELSE {up(share('authored', 'longer') + ' * 60 + ' + share('bios', 'longer') + ' * 40')} END",
            f"CASE WHEN longer = 0 THEN 'partial' ELSE {some(up(share('authored', 'longer') + ' * 60 + ' + share('bios', 'longer') + ' * 40'), 60)} END",
        ),
        "Trust Signals": by60(trust), "Social Proof & Authority": by60("25 * coalesce(len(social), 0)"),
        "Citation Quality": unless(
            "longer = 0",
            by60(
                f"least(100, {up(share('figured', 'longer') + ' * 35 + ' + share('sourced', 'longer') + ' * 35 + ' + share('linked_out', 'longer') + ' * 30')})"
            ),
        ),
        "Twitter Card Tags": by60(up("tw / (3 * n) * 100")), "Breadcrumb Schema": by60(up("greatest(crumbs, crumb_ld) / n * 100")),
        "hreflang Tags": unless("languages <= 1 AND tagged = 0", (percent("tagged"), some(share("tagged"), 0.6)), 100),
        "Brand Authority Score": unless("brand IS NULL", by60("brand")), "Title Tags": (title, status_sql(title, 70, 40)),
        "Image Alt Text": (
            f"CASE WHEN images = 0 THEN 100 ELSE {percent('alts', 'images')} END",
            status_sql(f"(CASE WHEN images = 0 THEN 100 ELSE {percent('alts', 'images')} END)", 80, 50),
        ),
        "Internal Linking": (links, status_sql(links, 70, 40)),
        "Mobile Viewport": (percent("fitted"), status_sql(share("fitted"), 0.9, 0.5)),
        "HTTPS Enforcement": (percent("https"), status_sql(share("https"), 1, 0.8)),
        "Broken Pages": (less("broken"), f"CASE WHEN broken = 0 THEN 'pass' WHEN {share('broken')} <= 0.1 THEN 'partial' ELSE 'fail' END"),
        "Nofollow on Internal Links": (up("(1 - nofollow / links) * 100"), few("nofollow", 5)),
        "URL Structure Quality": (less("odd"), few("odd", 3)),
        "Canonical Link Issues": (f"CASE WHEN astray = 0 THEN 100 ELSE {up('(1 - astray / canon) * 100')} END", few("astray", 2)),
        "Semantic HTML Usage": ("100", "'pass'"), "Text-to-HTML Ratio": None, "Page Response Time": (less("slow"), few("slow", 3)),
        "Redirect Chains": (less("chains"), few("chains", 3)), "Character Encoding & Doctype": (less("no_charset"), few("no_charset", 2)),
        "HTML Page Size": ("100", "'pass'"), "Crawl Depth": (less("buried"), few("buried", 5)),
        "Broken External Links": unless("out_checked = 0", (less("out_broken", "out_checked"), few("out_broken", 3))),
        "Temporary Redirects": (f"CASE WHEN moved = 0 THEN 100 ELSE {less('moved_away', 'moved')} END", few("moved_away", 5)),
        "Missing H1 Heading": (percent("h1s"), status_sql(share("h1s"), 1, 0.9)),
        "Core Web Vitals": (vitals, status_sql(f"({vitals})", 70, 40)),
        "Mobile Readiness": unless(
            "mobile IS NULL", ("mobile", f"CASE WHEN first_d % 9 = 1 THEN 'fail' ELSE {status_sql('mobile', 80, 50)} END"),
        ),
        "Responsive Images": (
            f"CASE WHEN images = 0 THEN 100 ELSE {percent('responsive', 'images')} END",
            f"CASE WHEN images = 0 THEN 'pass' ELSE {status_sql(share('responsive', 'images'), 0.7, 0.3)} END",
        ),
        **{n: there(n) for n in ("security.txt", "tdmrep.json", "manifest.json", "humans.txt")},
    }
    rows = []
    for seq, name in enumerate(name for checks in catalog.CHECKS.values() for name, _ in checks):
        if made[name] is not None and (not names or name in names):  # the ratio of text to markup depends on how the markup is written
            score, status = made[name]
            category = f"CASE WHEN {pair} > 0 THEN 'content_quality' ELSE 'ai_infrastructure' END" if name.startswith("AI Policy") else quoted(catalog.CATEGORY[name])
            rows.append(
                f"SELECT site, {seq} AS seq, {quoted(name)} AS name, {category} AS category, ({score})::INTEGER AS score, {status} AS status, {quoted(catalog.SEVERITY[name])} AS own FROM j"
            )
    return f"{facts}, i AS ({' UNION ALL '.join(rows)}), items AS (SELECT site, seq, name, category, score, 100 AS max_score, status, CASE WHEN status IN ('pass', 'not_applicable') THEN 'info' ELSE own END AS severity FROM i)"


_ITEMS = _items_sql(_audit_sql())
_UNCHECKED = "Text-to-HTML Ratio"


#: Pages, facts and items of the tables that were audited last, a row a page, a site and an item: many queries start from the same ones.
_last: dict[tuple, DataFrame] = {}


def _kept(spark, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make`` gives, written to the shared folder once for the tables as they are now. Only those of one folder and one state of its tables
    are kept; what they replace is Spark's to clean up."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    now = (
        spark.sparkContext.applicationId, sf_dir, system.getFileStatus(path).getModificationTime(),
        system.getContentSummary(path).getLength(),
    )
    for key in [k for k in _last if k[:-1] != now]:
        del _last[key]
    if (*now, name) not in _last:
        _last[*now, name] = checkpointed(make())
    return _last[*now, name]


def _pages(spark, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "pages", lambda: audit.kept_facts(rich_records(spark, sf_dir)))


def _facts(spark, sf_dir: str, most: int | None = 250) -> DataFrame:
    """Facts as the SQL of scores and lists on them has them, with statuses of a site's first 250 links of a kind, or of all."""
    return _kept(
        spark, sf_dir, f"facts {most}",
        lambda: audit.site_facts(_pages(spark, sf_dir), site_files(spark, sf_dir), **probes(spark, sf_dir), as_of=AS_OF, most=most),
    )


def _items(spark, sf_dir: str, most: int | None = 250) -> DataFrame:
    return _kept(spark, sf_dir, f"items {most}", lambda: audit.items(_facts(spark, sf_dir, most))).where(F.col("name") != _UNCHECKED)


@_query(f"WITH {_items_sql(_audit_sql(_ALL_TARGETS))} SELECT * FROM items")
def audit_items(spark, sf_dir):
    return _items(spark, sf_dir, None)


_OF_FILES = tuple(n for checks in ("ai_infrastructure", "non_scored") for n, _ in catalog.CHECKS[checks] if n != "AI Content Directives")
_WIDE = ", ".join(f"coalesce(max(content) FILTER (WHERE name = {quoted(n)}), '') AS f{k}" for k, n in enumerate(catalog.FILES))
_FILE_ITEMS = _items_sql(
    f"{_CUSTOMER_FILES}, {_ROBOTS}, fw AS (SELECT site, {_WIDE} FROM files GROUP BY site), j AS (SELECT * FROM fw LEFT JOIN rb USING (site) LEFT JOIN rt USING (site))",
    _OF_FILES,
)


@_query(f"WITH {_FILE_ITEMS} SELECT * FROM items WHERE name IN ({', '.join(map(quoted, _OF_FILES))})")
def file_checks(spark, sf_dir):
    return files.file_checks(customer_files(spark, sf_dir))


_W2 = lambda weights, by: f"CASE {by} " + " ".join(f"WHEN {quoted(n)} THEN {int(2 * w)}" for n, w in weights.items()) + " ELSE 0 END"
_CATEGORY_W = _W2(catalog.CATEGORY_WEIGHTS, "category")


def _weighted_sql(weights: dict[str, float], name: str) -> str:
    w = _W2(weights, "name")
    return f"WITH {_ITEMS} SELECT site, CASE WHEN sum(max_score * {w}) > 0 THEN {half_up_sql(f'sum(score * {w}) / sum(max_score * {w}) * 100')} ELSE 0 END AS {name} FROM items WHERE status <> 'not_applicable' GROUP BY site"


@_query(
    f"WITH {_ITEMS}, o AS (SELECT site, {half_up_sql(f'sum(score * {_CATEGORY_W}) / sum(max_score * {_CATEGORY_W}) * 100')} AS overall FROM items WHERE status <> 'not_applicable' GROUP BY site) SELECT site, overall, {grade_sql('overall')} AS grade FROM o"
)
def audit_overall(spark, sf_dir):
    return composite.overall(_items(spark, sf_dir))


@_query(_weighted_sql(catalog.SEARCH_HEALTH, "search_health"))
def search_health(spark, sf_dir):
    return composite.search_health(_items(spark, sf_dir))


@_query(_weighted_sql(catalog.SERVICE_SCORE, "service_score"))
def service_score(spark, sf_dir):
    return composite.service_score(_items(spark, sf_dir))


@_query(
    f"WITH {_ITEMS} SELECT site, category, count_if(status IN ('pass', 'partial'))::BIGINT AS passed, count(*) AS total, {half_up_sql('sum(score) / sum(max_score) * 100')} AS score FROM items WHERE status <> 'not_applicable' GROUP BY site, category"
)
def audit_summary(spark, sf_dir):
    return composite.category_summary(_items(spark, sf_dir))


@_query(
    f"WITH {_ITEMS} SELECT site, severity, count(*) AS issues FROM items WHERE status NOT IN ('pass', 'not_applicable') AND severity <> 'info' GROUP BY site, severity"
)
def audit_issues(spark, sf_dir):
    return composite.issue_counts(_items(spark, sf_dir))


_LOOK = lambda table, default: f"coalesce(CASE name {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in table.items())} END, {quoted(default)})"


@_query(f"""WITH {_ITEMS}, wi AS (SELECT *, {_CATEGORY_W} AS w FROM items), wt AS (SELECT site, sum(max_score * w) AS whole FROM wi WHERE status <> 'not_applicable' GROUP BY site),
pr AS (SELECT site, name, seq, floor((max_score - score) * w / whole * 1000 + 0.5) / 10 AS impact, CASE WHEN name = 'Meta Descriptions' AND score < 50 THEN 'hard' ELSE {_LOOK(catalog.EFFORT, 'medium')} END AS effort, {_LOOK(catalog.SEARCH_IMPACT, 'low')} AS search_impact, {_LOOK(catalog.TIME_TO_IMPACT, '2-6 months')} AS time_to_impact
 FROM wi JOIN wt USING (site) WHERE status NOT IN ('pass', 'not_applicable') AND score < 100 AND name NOT IN ({', '.join(map(quoted, catalog.PROJECTED))})), pn AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY impact DESC, seq)::INTEGER AS place FROM pr) SELECT site, place, name, impact, effort, search_impact, time_to_impact FROM pn WHERE place <= 5""")
def audit_priorities(spark, sf_dir):
    return composite.priorities(_items(spark, sf_dir))


_BETTER = "CASE name " + " ".join(f"WHEN {quoted(n)} THEN {x}" for n, x in catalog.PROJECTED.items()) + " END"


@_query(
    f"WITH {_ITEMS}, b AS (SELECT *, {_BETTER} AS better FROM items) SELECT site, name, greatest(score, coalesce(better, score)) AS score, CASE WHEN better IS NOT NULL AND score < better THEN CASE WHEN better >= 70 THEN 'pass' ELSE 'partial' END ELSE status END AS status FROM b"
)
def audit_projected(spark, sf_dir):
    return composite.projected(_items(spark, sf_dir)).select("site", "name", "score", "status")


_YES = lambda x, p: f"CASE WHEN {x} THEN {p} ELSE 0 END"
_EXPERTISE = f"""ex AS (SELECT site, least(25, {_YES('any_first', 8)} + {_YES('any_case', 7)} + {_YES('any_research', 5)})::INTEGER AS experience,
 least(25, least(8, {half_up_sql('all_authored / n * 8')}) + {_YES('any_bio', 5)} + {_YES('content > 0 AND content_words / content > 800', 4)} + {_YES('any_credentials', 4)})::INTEGER AS expertise,
 least(25, least(6, 2 * len(social)) + least(6, {half_up_sql('citations / 2')}) + {_YES('any_awards', 5)} + {_YES('pressed', 4)} + CASE WHEN brand IS NULL THEN 0 ELSE least(4, {half_up_sql('brand / 25')}) END)::INTEGER AS authority,
 least(25, {_YES('email IS NOT NULL', 3)} + {_YES('phone IS NOT NULL', 2)} + {_YES('address IS NOT NULL', 2)} + {_YES('privacy', 4)} + {_YES('terms', 3)} + {_YES('about', 4)} + {_YES('https = n', 3)} + {_YES('org', 4)})::INTEGER AS trust FROM j)"""


@_query(f"WITH {_audit_sql()}, {_EXPERTISE} SELECT *, experience + expertise + authority + trust AS total FROM ex")
def expertise(spark, sf_dir):
    return audit.expertise(_facts(spark, sf_dir))


def _platforms_sql() -> str:
    pick = lambda n: f"coalesce(max(score) FILTER (WHERE name = {quoted(n)} AND status <> 'not_applicable'), 0)"
    index = pick("Search Engine Indexing")
    flag = lambda x: f"bool_or({x})"
    extra = {
        "questions": "least(100, 10 * max(questioned + asked_twice))", "structure": "least(100, 15 * max(tabled) + 5 * max(listed))",
        "indexed and Bing 20": f"least(100, {index} + {_YES(flag('bing'), 20)})",
        "indexed and Bing 25": f"least(100, {index} + {_YES(flag('bing'), 25)})",
        "indexed and Google 15": f"least(100, {index} + {_YES(flag('google'), 15)})",
        "reachable": f"{_YES(flag('address IS NOT NULL'), 50)} + {_YES(flag('phone IS NOT NULL'), 50)}", "linked reddit": "0",
        "linked youtube": _YES(flag("list_contains(social, 'youtube')"), 30),
        "linked linkedin": _YES(flag("list_contains(social, 'linkedin')"), 30),
    }
    rows = []
    for place, (platform, weights) in enumerate(catalog.PLATFORMS.items()):
        terms = " + ".join(f"({' + '.join(extra.get(n) or pick(n) for n in group)}) / {len(group)} * {w}::DOUBLE" for group, w in weights)
        rows.append(f"SELECT site, {place} AS place, {quoted(platform)} AS platform, {half_up_sql(terms)} AS score FROM g GROUP BY site")
    return f"{_ITEMS}, g AS (SELECT items.*, questioned, 0 AS asked_twice, tabled, listed, bing, google, address, phone, social FROM items JOIN j USING (site)), pl AS ({' UNION ALL '.join(rows)})"


_PLATFORMS = _platforms_sql()


@_query(f"WITH {_PLATFORMS} SELECT site, platform, score, {grade_sql('score')} AS grade FROM pl")
def platform_readiness(spark, sf_dir):
    return audit.platforms(_facts(spark, sf_dir), _items(spark, sf_dir))


@_query(
    f"WITH {_PLATFORMS} SELECT site, arg_max(platform, row(score, -place)) AS best, arg_min(platform, row(score, -place)) AS worst FROM pl GROUP BY site"
)
def platform_extremes(spark, sf_dir):
    return audit.best_and_worst(audit.platforms(_facts(spark, sf_dir), _items(spark, sf_dir)))


@_query(f"""WITH {_R}, ed AS (SELECT site, target, count(*) AS k FROM (SELECT site, unnest(internal) AS target FROM r) GROUP BY site, target), ne AS (SELECT ed.site, k, len(list_filter(regexp_split_to_array(body, '{WS}+'), lambda w: w <> '')) AS words, len(internal) AS out FROM ed JOIN r ON r.site = ed.site AND r.url = ed.target),
nm AS (SELECT site, avg(k) AS mean, max(k) AS most FROM ne GROUP BY site) SELECT site, count_if(k >= greatest(3, 2 * mean))::BIGINT AS pillars, count_if(k >= greatest(3, 2 * mean) AND words > 500 AND out >= 3)::BIGINT AS rich_pillars, max(most) > 1.5 * max(mean) AS varied_links FROM ne JOIN nm USING (site) GROUP BY site""")
def topic_clusters(spark, sf_dir):
    rows = rich_records(spark, sf_dir, "words", "internal")
    # links and pages from one run over the pages
    kinds = F.array(
        F.struct(
            F.col("url").alias("url"), F.lit(1).alias("pages"), F.lit(0).alias("k"), "words", F.size("internal").alias("out"),
            F.col("page_id").alias("first"),
        )
    )
    edges = F.transform(
        "internal",
        lambda t: F.struct(
            t.alias("url"), F.lit(0).alias("pages"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("words"),
            F.lit(None).cast("int").alias("out"), F.lit(None).cast("long").alias("first"),
        ),
    )
    both = rows.select("site", F.inline(F.concat(kinds, edges))).groupBy("site", "url").agg(
        F.sum("pages").alias("pages"), F.sum("k").alias("k"), F.max("words").alias("words"), F.max("out").alias("out"),
        F.min("first").alias("first"),
    )
    both = checkpointed(both)
    return audit.clusters(
        both.where("k > 0").select("site", F.col("url").alias("target"), "k"),
        both.where("pages > 0").select("site", "url", "pages", "words", "out", "first"),
    )


QUERIES = {name: f for name, (f, _) in _RICH.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _RICH.items()}
