"""Queries of what is made from page records, audits and run tables, with DuckDB SQL over the same fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import context, playbooks, robots, service, sites
from ..sources.tables import table
from . import rich
from .sql import half_up_sql, quoted

_MORE: dict[str, tuple] = {}


def _query(sql: str):
    def add(f):
        _MORE[f.__name__] = (f, sql)
        return f

    return add


_R, _ITEMS = rich._R, rich._ITEMS
_SECTION = "CASE d % 8 " + " ".join(
    f"WHEN {k} THEN {quoted(s)}" for k, s in enumerate(("Blog", "About", "Legal", "Legal", "Products", "Documentation", "Pages", "Pages"))
) + " END"
_WORDS = f"len(list_filter(regexp_split_to_array(body, '{rich.WS}+'), lambda w: w <> ''))"


@_query(f"""WITH {_R}, k AS (SELECT site, d, url, coalesce(canonical, url) AS c FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY site, c ORDER BY (url = c) DESC, CASE WHEN url = c THEN -d ELSE d END) AS place, min(d) OVER (PARTITION BY site, c) AS first, count(*) OVER (PARTITION BY site, c) AS pages FROM k)
SELECT site, d AS page_id, url, c AS canonical_url, pages, first FROM o WHERE place = 1""")
def canonical_dedup(spark, sf_dir):
    return sites.one_of_each_canonical(rich.rich_records(spark, sf_dir, "canonical"))


@_query(
    f"WITH {_R}, e AS (SELECT site, d, unnest(range(1, len(external) + 1)) AS i, external FROM r), g AS (SELECT site, external[i] AS target, count(DISTINCT d) AS sources, min(row(d, i)) AS first FROM e GROUP BY site, external[i]), o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first) AS place FROM g) SELECT site, target, sources, first[1] AS first_page FROM o WHERE place <= 250"
)
def link_sources(spark, sf_dir):
    return sites.link_sources(rich.rich_records(spark, sf_dir, "external"))


#: What each site's pages say of it; ``h`` are home pages and ``y`` identities.
_CONTEXT = f"""hd AS (SELECT site, d, unnest(range(1, len(heads) + 1)) AS i, heads, levels FROM r), kw AS (SELECT site, lower(heads[i]) AS x, min(row(d, i)) AS first FROM hd WHERE levels[i] <= 2 AND length(heads[i]) BETWEEN 4 AND 59 GROUP BY site, lower(heads[i])),
ko AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first) AS place FROM kw), w AS (SELECT site, list(x ORDER BY place) AS keywords FROM ko WHERE place <= 20 GROUP BY site),
f AS (SELECT site, arg_min(lang, d) AS language, coalesce(arg_min(description, d) FILTER (WHERE length(description) > 20), arg_min(substr(body, 1, 200), d)) AS description,
 arg_min(CASE WHEN d % 6 = 1 THEN 'Article' WHEN d % 7 = 3 THEN 'HowTo,FAQPage' WHEN d % 31 = 7 THEN 'Place' END, d) FILTER (WHERE d % 6 = 1 OR d % 7 = 3 OR d % 31 = 7) AS told, bool_or(d % 31 = 7) AS placed, bool_or(d % 5 = 2) AS alternates FROM r GROUP BY site),
cx AS (SELECT site, y.name, language, f.description, coalesce(keywords, []) AS keywords, coalesce(told, keywords[1], 'general') AS industry, coalesce(address, CASE WHEN placed THEN 'Vilnius, LT' WHEN alternates THEN 'Austria' END) AS location,
 CASE WHEN placed THEN ['Repair'] ELSE [] END AS services, CASE WHEN placed THEN ['Widget'] ELSE [] END AS products FROM f LEFT JOIN w USING (site) LEFT JOIN y USING (site))"""


def _contexts(spark, sf_dir):
    return context.business_context(rich.rich_records(spark, sf_dir, *context.FIELDS))


@_query(
    f"WITH {_R}, {rich._IDENTITY}, {_CONTEXT} SELECT * REPLACE (array_to_string(keywords, '|') AS keywords, array_to_string(services, '|') AS services, array_to_string(products, '|') AS products) FROM cx"
)
def business_context(spark, sf_dir):
    return _contexts(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in ("keywords", "services", "products")})


@_query(f"""WITH {_R}, e AS (SELECT site, bool_or(d % 31 = 7) AS placed, bool_or(d % 5 = 2) AS alternates FROM r GROUP BY site)
SELECT site, CASE WHEN placed THEN 1 ELSE 3 END AS rank, CASE WHEN placed THEN 'Vilnius, LT' ELSE 'Austria' END AS location FROM e WHERE placed OR alternates""")
def locations(spark, sf_dir):
    return context.locations(rich.rich_records(spark, sf_dir, "json_ld", "hreflang", "language"))


def _templates_sql() -> str:
    """Each template as a concatenation; ``{in}`` and ``{at}`` have a place behind them."""
    import re

    place = "coalesce(location, '')"
    values = {
        "name": "name", "industry": "industry", "service0": "coalesce(nullif(services[1], ''), industry)",
        "service1": "coalesce(nullif(services[2], ''), nullif(keywords[1], ''), industry)", "keyword0": "nullif(keywords[1], '')",
        "keyword1": "nullif(keywords[2], '')", "in": f"CASE WHEN {place} <> '' THEN ' in ' || {place} ELSE '' END",
        "at": f"CASE WHEN {place} <> '' THEN ' ' || {place} ELSE '' END",
        "where": f"CASE WHEN {place} = '' THEN 'Lietuvoje' " + " ".join(
            f"WHEN regexp_matches({place}, {quoted('(?i)' + p.removeprefix('(?iu)'))}) THEN {quoted(x)}" for p, x in catalog.LOCATIVE
        ) + f" ELSE {place} END",
    }
    rows = []
    for language, templates in catalog.QUERY_TEMPLATES.items():
        for k, (query, category, intent, spoken) in enumerate(templates):
            parts = [f"({values[p]})" if n % 2 else quoted(p) for n, p in enumerate(re.split(r"\{(\w+)\}", query)) if p]
            when = "language = 'lt'" if language == "lt" else "language IS DISTINCT FROM 'lt'"
            rows.append(
                f"SELECT site, {k} AS k, {' || '.join(parts)} AS query, {quoted(category)} AS category, {quoted(intent)} AS intent, {quoted(spoken)} AS language FROM cl WHERE {when}"
            )
    return f"tq AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY k)::INTEGER AS place FROM ({' UNION ALL '.join(rows)}) WHERE query IS NOT NULL)"


#: A third of the sites are taken for Lithuanian ones, and have a town's name, so that both kinds of templates are met.
_SPOKEN = "cl AS (SELECT * REPLACE (CASE WHEN right(site, 9) IN ('1.example', '4.example', '7.example') THEN 'lt' ELSE language END AS language, CASE WHEN right(site, 9) = '4.example' THEN 'KAUNAS, Lithuania' WHEN right(site, 9) = '5.example' THEN NULL ELSE location END AS location) FROM cx)"


def _spoken(rows):
    end = F.right("site", F.lit(9))
    place = F.when(end == "4.example", "KAUNAS, Lithuania").when(end != "5.example", F.col("location"))
    return rows.withColumns(
        {"language": F.when(end.isin("1.example", "4.example", "7.example"), "lt").otherwise(F.col("language")), "location": place}
    )


@_query(
    f"WITH {_R}, {rich._IDENTITY}, {_CONTEXT}, {_SPOKEN}, {_templates_sql()} SELECT site, place, query, category, intent, language FROM tq WHERE place <= 20"
)
def template_queries(spark, sf_dir):
    return context.template_queries(_spoken(_contexts(spark, sf_dir)))


@_query(
    f"WITH {_R}, {rich._IDENTITY}, {_CONTEXT}, {_SPOKEN}, {_templates_sql()} SELECT site, place, query, category, intent, language FROM tq WHERE place <= 7"
)
def first_queries(spark, sf_dir):
    return context.template_queries(_spoken(_contexts(spark, sf_dir)), 7)


_IMPORTANT = f"im AS (SELECT site, d, url, title, {_SECTION} AS section, list_filter(list_zip(heads, levels), lambda h: h[2] <= 2)[1][1] AS heading, row_number() OVER (PARTITION BY site ORDER BY d)::INTEGER AS place FROM r WHERE {_SECTION} <> 'Legal' AND {_WORDS} >= 100 AND length(title) >= 5 QUALIFY place <= 10)"


_TITLED = ("title", "words", "headings")


@_query(f"WITH {_R}, {_IMPORTANT} SELECT site, place, d AS page_id, url, section, title, heading FROM im")
def important_pages(spark, sf_dir):
    return context.important_pages(rich.rich_records(spark, sf_dir, *_TITLED))


_ASKED = f"""pq AS (SELECT site, place, url, CASE WHEN section = 'Products' THEN title || ' by ' || site || ' review and alternatives' WHEN section = 'Blog' AND heading <> '' THEN 'explain ' || lower(heading) || ' in detail' WHEN section = 'Blog' THEN lower(title) || ' guide and best practices'
 WHEN section = 'Documentation' AND heading <> '' THEN 'how to ' || lower(heading) || ' with ' || site WHEN section = 'Documentation' THEN site || ' ' || lower(title) || ' documentation and examples' WHEN section = 'About' THEN 'who is ' || site || ' and what is their background in things' ELSE site || ' ' || lower(title) || ' detailed information' END AS query,
 'Page-specific: ' || section || ' — ' || title AS intent FROM im)"""


def _page_queries(rows, sites_):
    names = sites_.select("site").distinct().select(
        "site", F.col("site").alias("name"), F.lit("things").alias("industry"), F.lit("Town").alias("location"),
    )
    return context.page_queries(rows, names)


@_query(f"WITH {_R}, {_IMPORTANT}, {_ASKED} SELECT * FROM pq")
def page_queries(spark, sf_dir):
    return _page_queries(rich.rich_records(spark, sf_dir, *_TITLED), rich.rich_pages(spark, sf_dir))


@_query(f"""WITH {_R}, {rich._IDENTITY}, {_CONTEXT}, {_SPOKEN}, {_templates_sql()}, {_IMPORTANT}, {_ASKED}, al AS (SELECT site, 0 AS part, place, query, category, NULL::VARCHAR AS target FROM tq WHERE place <= 20 UNION ALL SELECT site, 1, place, query, 'page_specific', url FROM pq)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY part, place)::INTEGER AS place, query, category, target FROM al""")
def all_queries(spark, sf_dir):
    kept = context.kept_pages(rich.rich_records(spark, sf_dir, *dict.fromkeys((*context.FIELDS, *_TITLED))))
    return context.all_queries(context.template_queries(_spoken(context.context_of(kept))), _page_queries(kept, kept))


_ENTRY = " ".join(
    f"WHEN {p} THEN {quoted(v)}"
    for p, v in (("d % 8 = 0", "weekly"), ("d % 8 IN (1, 4)", "monthly"), ("d % 8 IN (2, 3)", "yearly"), ("d % 8 = 5", "weekly"))
)
_PRIO = " ".join(
    f"WHEN {p} THEN {quoted(v)}"
    for p, v in (("d % 8 = 0", "0.7"), ("d % 8 IN (1, 4)", "0.6"), ("d % 8 IN (2, 3)", "0.3"), ("d % 8 = 5", "0.8"))
)


@_query(f"""WITH {_R} SELECT site, 0 AS file, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg('  <url><loc>' || url || '</loc><changefreq>' || CASE {_ENTRY} ELSE 'monthly' END || '</changefreq><priority>' || CASE {_PRIO} ELSE '0.5' END || '</priority></url>', chr(10) ORDER BY d) || chr(10) || '</urlset>' || chr(10) AS content FROM r WHERE d % 17 <> 0 GROUP BY site""")
def sitemap_xml(spark, sf_dir):
    from ..operators import pages

    rows = rich.rich_pages(spark, sf_dir).where("status < 400")
    return sites.sitemap_xml(pages.sitemap_entries(rows).join(rows.select("page_id", "site"), "page_id"))


_LLMS_RANK = "CASE " + " ".join(f"WHEN {_SECTION} = {quoted(s)} THEN {k}" for k, s in enumerate(catalog.LLMS_SECTIONS)) + " END"


@_query(f"""WITH {_R}, l AS (SELECT site, {_LLMS_RANK} AS rank, CASE WHEN {_LLMS_RANK} < 7 THEN {_SECTION} ELSE 'Optional' END AS head, d, '- [' || CASE WHEN title <> '' THEN title ELSE regexp_replace(url, '^[a-z]*://[^/]*', '') END || '](' || url || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS line FROM r),
s AS (SELECT site, min(rank) AS rank, chr(10) || '## ' || head || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank, d) AS part FROM l GROUP BY site, head) SELECT site, '# ' || site || chr(10) || chr(10) || '> About ' || site || chr(10) || string_agg(part, chr(10) ORDER BY rank) || chr(10) AS content FROM s GROUP BY site""")
def llms_txt(spark, sf_dir):
    names = rich.rich_pages(spark, sf_dir).select("site").distinct().select(
        "site", F.col("site").alias("name"), F.concat(F.lit("About "), F.col("site")).alias("tagline"),
    )
    return sites.llms_txt(rich.rich_records(spark, sf_dir, "title", "description"), names)


_ACCUMULATED = "ac AS (SELECT *, (agent = '' AND NOT idle AND NOT regexp_matches(line, '(?i)^(Allow|Disallow|Crawl-delay|Sitemap):'))::INT AS ends FROM rk), am AS (SELECT *, sum(ends) OVER (PARTITION BY site ORDER BY i) AS grp FROM ac), kd AS (SELECT b.site, a.agent, trim(regexp_extract(b.line, '(?i)^Disallow:\\s*(.*)$', 1)) AS path, (min(b.i) - 1)::INTEGER AS line FROM am a JOIN am b ON a.site = b.site AND a.grp = b.grp AND a.i < b.i AND a.agent <> '' AND regexp_matches(b.line, '(?i)^Disallow:\\s*\\S') WHERE a.agent NOT IN (" + ", ".join(quoted(b.lower()) for b in catalog.AI_CRAWLERS) + ") GROUP BY ALL)"


@_query(f"WITH {rich._CUSTOMER_FILES}, {rich._ROBOTS}, {_ACCUMULATED} SELECT * FROM kd")
def robots_kept(spark, sf_dir):
    return robots.kept_disallows(robots.robots_rules(rich.customer_files(spark, sf_dir)))


def _robots_sql() -> str:
    lines = []
    say = lambda *told: lines.extend(quoted(t) for t in told)
    kept = lambda agent: lines.append(f"coalesce(list_transform(old[{quoted(agent)}], lambda p: 'Disallow: ' || p), [])")
    say("# robots.txt")
    lines.append("'# Site: https://' || site")
    say(f"# Generated: {rich.AS_OF}", "#", "# AI Crawler Directives", "# Training data access: ALLOWED")
    lines.append(
        "CASE WHEN len(coalesce(old['*'], [])) > 0 THEN ['# NOTE: Existing Disallow rules from original robots.txt have been preserved'] ELSE [] END"
    )
    say("", "# Standard Search Engines")
    for agent in ("Googlebot", "Bingbot", "Applebot"):
        say(f"User-agent: {agent}", "Allow: /")
        kept(agent.lower())
        say("")
    rule = "# ===================================="
    say(rule, "# AI / LLM Crawler Directives", rule, "")
    for head, use in (
        ("# AI Search & Retrieval (recommended: allow for visibility)", "search"), ("# AI Training Crawlers (allowed)", "training"),
    ):
        say(head)
        for bot, owner in catalog.CRAWLER_OWNERS.items():
            if (bot in ("OAI-SearchBot", "ChatGPT-User", "Claude-SearchBot", "PerplexityBot")) == (use == "search"):
                say(f"# {owner[0]} — {owner[1]}", f"User-agent: {bot}", "Allow: /")
                kept("*")
                say(*(["Crawl-delay: 10"] if use == "training" else []), "")
    say("# Default: allow all other crawlers", "User-agent: *", "Allow: /")
    kept("*")
    say("")
    lines.append("'Sitemap: https://' || site || '/sitemap.xml'")
    say("")
    lines.append("'# LLMs.txt: https://' || site || '/llms.txt'")
    say("")
    listed = ", ".join(x if x.startswith(("coalesce(", "CASE")) else f"[{x}]" for x in lines)
    grouped = "ka AS (SELECT site, agent, list(path ORDER BY line, path) AS paths FROM kd GROUP BY site, agent), km AS (SELECT site, map_from_entries(list(row(agent, paths))) AS old FROM ka GROUP BY site)"
    return f"WITH {rich._CUSTOMER_FILES}, {rich._ROBOTS}, {_ACCUMULATED}, {grouped}, f AS (SELECT DISTINCT site FROM files) SELECT site, array_to_string(flatten([{listed}]), chr(10)) AS content FROM f LEFT JOIN km USING (site)"


@_query(_robots_sql())
def robots_txt(spark, sf_dir):
    files = rich.customer_files(spark, sf_dir)
    return sites.robots_txt(files.select("site").distinct(), robots.kept_disallows(robots.robots_rules(files)), rich.AS_OF)


def _policies_sql() -> str:
    """Files of each site from its identity, written out in full."""
    home, mail = "('https://' || site)", lambda box: f"coalesce(email, '{box}@' || site)"
    json = lambda x: f"to_json({x})::VARCHAR"
    nl = " || chr(10) || "
    todo = "CASE WHEN email IS NULL THEN {} || chr(10) ELSE '' END"
    uses = '"inference":true,"search":true,"summarization":true,"citation":true,"embedding":true'
    search, training = (", ".join(f'"{b}"' for b in x).replace(", ", ",") for x in (catalog.SEARCH_LISTED, catalog.TRAINING_LISTED))
    texts = {
        "ai.txt": nl.join(["'# AI Policy'", "'# Organization: ' || name", f"'# URL: ' || {home}", f"'# Generated: {rich.AS_OF}'", "''", "'# Purpose: Define how AI systems may interact with this website''s content'", todo.format("'# TODO: Replace placeholder email below with your actual AI policy contact'") + " || ''"])
        + nl + nl.join(map(quoted, ("## Permissions", "", "Training: yes", "Inference: yes", "Search: yes", "Summarization: yes", "Citation: yes", "Embedding: yes", "", "## Restrictions", "", "- Content must be attributed when cited", "- Do not misrepresent or fabricate content from this site", "- Do not generate misleading summaries", "", "## Attribution", "")))
        + nl + nl.join(["'Organization: ' || name", f"'URL: ' || {home}", f"'Contact: ' || {mail('ai')}", "CASE WHEN copyright IS NOT NULL THEN 'Copyright: ' || copyright || chr(10) ELSE '' END || ''", "'## Resources'", "''", f"'LLMs.txt: ' || {home} || '/llms.txt'", f"'Sitemap: ' || {home} || '/sitemap.xml'", f"'Robots.txt: ' || {home} || '/robots.txt'", "''"]),
        "ai.json": f"""'{{"version":"1.0","generated":"{rich.AS_OF}T00:00:00.000Z","organization":{{"name":' || {json('name')} || ',"url":"' || {home} || '","contact":"' || {mail('ai')} || '"' || CASE WHEN email IS NULL THEN ',"contact_placeholder":true' ELSE '' END || CASE WHEN copyright IS NOT NULL THEN ',"copyright":' || {json('copyright')} ELSE '' END || '}},"permissions":{{"training":true,{uses}}},"restrictions":["Content must be attributed when cited","Do not misrepresent or fabricate content"],"resources":{{"llmsTxt":"' || {home} || '/llms.txt","sitemap":"' || {home} || '/sitemap.xml","robotsTxt":"' || {home} || '/robots.txt"}},"crawlers":{{"allowed_search":[{search}],"allowed_training":[{training}]}}}}'""",
        "security.txt": nl.join(["'# Security Policy'", "'# ' || name", "'#'", "'# This file follows RFC 9116 (https://www.rfc-editor.org/rfc/rfc9116)'", todo.format("'#' || chr(10) || '# TODO: Replace the placeholder email below with your actual security contact'") + " || ''", f"'Contact: mailto:' || {mail('security')}", "'Expires: 2025-06-01T00:00:00.000Z'", "'Preferred-Languages: en'", f"'Canonical: ' || {home} || '/.well-known/security.txt'", "''"]),
        "tdmrep.json": quoted('{"version":1,"policies":[{"location":"/","assurance":"https://www.w3.org/2022/tdmrep/assurance#non-exclusive","type":["text/html","application/json","text/plain","text/markdown","application/xml"]}]}'),
        "humans.txt": nl.join(["'/* TEAM */'", "'  Name: ' || name", f"'  Contact: ' || {mail('hello')} || CASE WHEN email IS NULL THEN '  # TODO: replace placeholder' ELSE '' END", "CASE WHEN address IS NOT NULL THEN '  Location: ' || address || chr(10) ELSE '' END || ''", "'/* TECHNOLOGY */'", "'  ' || coalesce(generator, 'HTML, CSS, JavaScript')", "''", "'/* SITE */'", f"'  Last update: {rich.AS_OF}'", "'  Language: ' || language", "'  Standards: HTML5, CSS3, JavaScript ES2022'", "''"]),
        "manifest.json": f"""'{{"name":' || {json('name')} || ',"short_name":' || {json('substr(name, 1, 12)')} || ',"start_url":"/","display":"standalone","background_color":"#ffffff","theme_color":"#000000"' || CASE WHEN tagline IS NOT NULL THEN ',"description":' || {json('tagline')} ELSE '' END || CASE WHEN favicon IS NOT NULL OR logo IS NOT NULL THEN ',"icons":[' || concat_ws(',', CASE WHEN favicon IS NOT NULL THEN '{{"src":"' || {home} || '/f.ico","sizes":"48x48","type":"image/x-icon"}}' END,
 CASE WHEN logo IS NOT NULL THEN '{{"src":"' || {home} || '/og.png","sizes":"192x192","type":"image/png"}},{{"src":"' || {home} || '/og.png","sizes":"512x512","type":"image/png"}}' END) || ']' ELSE '' END || '}}'""",
    }
    rows = " UNION ALL ".join(f"SELECT site, {quoted(n)} AS file, {x} AS content FROM z" for n, x in texts.items())
    return f"WITH {_R}, {rich._IDENTITY}, l AS (SELECT site, arg_min(lang, d) AS language FROM r GROUP BY site), z AS (SELECT * FROM y JOIN l USING (site)) {rows}"


@_query(_policies_sql())
def policy_files(spark, sf_dir):
    from ..operators import extract

    rows = rich.rich_records(spark, sf_dir, "language", "body", "identity")
    told = rows.groupBy("site").agg(F.min_by("language", "page_id").alias("language"))
    return sites.policy_files(extract.site_identity(rows).join(told, "site"), rich.AS_OF)


# --- captured probes, from orders and parts on both sides

_PROBE = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS site, CAST(o_orderkey % 900 AS INT) AS words, CAST(o_custkey % 1100 AS INT) AS mobile_words, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'width=device-width' WHEN 2 THEN 'width=320, maximum-scale=1' WHEN 3 THEN 'width=device-width, user-scalable = no' ELSE 'initial-scale=1' END AS viewport, CAST(o_custkey % 6 AS INT) AS images, CAST(o_custkey % 6 % 4 AS INT) AS responsive FROM orders"


@_query(f"""WITH p AS ({_PROBE}), q AS (SELECT *, CASE WHEN words > 0 THEN mobile_words / words ELSE 1.0 END AS ratio FROM p) SELECT site, floor(ratio * 100 + 0.5) / 100 AS content_ratio, abs(ratio - 1) > 0.15 AS content_differs, CASE WHEN viewport = '' THEN 1 ELSE (NOT contains(viewport, 'width=device-width'))::INT + regexp_matches(viewport, '(?i)user-scalable\\s*=\\s*no')::INT + regexp_matches(viewport, '(?i)maximum-scale\\s*=\\s*1')::INT END AS viewport_issues,
 (ratio < 0.5 OR ratio > 1.5)::INT AS content_issues, (images > 0 AND responsive / images < 0.5)::INT AS image_issues, floor(CASE WHEN images > 0 THEN responsive / images ELSE 1.0 END * 100 + 0.5) / 100 AS responsive_ratio FROM q""")
def mobile_probe(spark, sf_dir):
    return sites.mobile_probe(
        spark.sql(_PROBE.replace("FROM orders", "FROM {orders}").replace("VARCHAR(20)", "STRING"), orders=table(spark, sf_dir, "orders"))
    )


_BRAND = "SELECT CAST(c_custkey AS VARCHAR(20)) AS site, CAST(c_custkey % 7 AS INT) AS mentions, c_custkey % 2 = 0 AS channel, CAST(c_custkey % 5 AS INT) AS recent, CAST(c_custkey % 9 AS INT) AS total, c_custkey % 3 = 0 AS community, c_custkey % 4 < 2 AS article, c_custkey % 6 = 1 AS entity, c_custkey % 5 = 2 AS linked, c_custkey % 10 = 2 AS verified, c_custkey % 5 = 3 AS slug FROM customer"


@_query(f"""WITH p AS ({_BRAND}), q AS (SELECT site, least(100, CASE WHEN mentions >= 5 THEN 80 WHEN mentions >= 2 THEN 50 WHEN mentions > 0 THEN 25 ELSE 0 END + 20 * channel::INT) AS youtube, least(100, CASE WHEN recent >= 3 THEN 85 WHEN total >= 3 THEN 55 WHEN total > 0 THEN 30 ELSE 0 END + 15 * community::INT) AS reddit, 60 * article::INT + 40 * entity::INT AS wikipedia,
 CASE WHEN linked THEN CASE WHEN verified THEN 100 ELSE 70 END WHEN slug THEN 60 ELSE 0 END AS linkedin FROM p) SELECT *, {half_up_sql('(youtube * 35 + reddit * 25 + wikipedia * 25 + linkedin * 15) / 100')} AS brand FROM q""")
def brand_scores(spark, sf_dir):
    return sites.brand_scores(
        spark.sql(
            _BRAND.replace("FROM customer", "FROM {customer}").replace("VARCHAR(20)", "STRING"), customer=table(spark, sf_dir, "customer"),
        )
    )


# --- from audits

_ORDER = "CASE category " + " ".join(f"WHEN {quoted(c)} THEN {k}" for k, c in enumerate(catalog.CHECKS)) + " END"
_DONE = ", ".join(map(quoted, catalog.PROJECTED))


@_query(
    f"WITH {_ITEMS} SELECT site, row_number() OVER (PARTITION BY site ORDER BY {_ORDER}, seq)::INTEGER AS place, name, category, score FROM items WHERE status NOT IN ('pass', 'not_applicable') AND score < 100 AND name NOT IN ({_DONE})"
)
def client_actions(spark, sf_dir):
    return service.client_actions(rich._items(spark, sf_dir))


@_query(
    f"WITH {_ITEMS} SELECT site, name, CASE WHEN name IN ({', '.join(map(quoted, catalog.QUICK))}) THEN 'quick' WHEN name IN ({', '.join(map(quoted, catalog.STRATEGIC))}) THEN 'strategic' ELSE 'medium' END AS kind FROM items WHERE status NOT IN ('pass', 'not_applicable') AND category <> 'non_scored'"
)
def action_triage(spark, sf_dir):
    return service.triage(rich._items(spark, sf_dir))


_PARTS = " UNION ALL ".join(
    [f"SELECT {k} AS place, {quoted(n)} AS name, true AS is_file" for k, n in enumerate(catalog.GAP_FILES)]
    + [f"SELECT {100 + k}, {quoted(n)}, false" for k, n in enumerate(catalog.GAP_SETTINGS)]
)


_GAPS = f"""pt AS ({_PARTS}), m AS MATERIALIZED (SELECT * FROM items), pf AS (SELECT site, count(DISTINCT name) AS there, min(name) AS one FROM files WHERE name IN ('ai.txt', 'ai.json') GROUP BY site),
gk AS (SELECT s.site, pt.place, pt.name AS component, CASE WHEN is_file AND (status IS NULL OR (status <> 'pass' AND (score = 0 OR pt.name LIKE 'AI Policy%'))) THEN 'missing' WHEN status <> 'pass' THEN 'incomplete' END AS kind,
 CASE WHEN NOT is_file OR coalesce(status = 'pass', false) OR (score > 0 AND pt.name NOT LIKE 'AI Policy%') THEN '' WHEN pt.name LIKE 'AI Policy%' THEN CASE WHEN coalesce(there, 0) = 0 THEN 'ai.txt,ai.json' WHEN one = 'ai.txt' THEN 'ai.json' ELSE 'ai.txt' END
 WHEN pt.name IN ('security.txt', 'tdmrep.json', 'agent-card.json') THEN '.well-known/' || pt.name ELSE pt.name END AS files FROM (SELECT DISTINCT site FROM m) s CROSS JOIN pt LEFT JOIN m ON m.site = s.site AND m.name = pt.name LEFT JOIN pf ON pf.site = s.site)"""


@_query(f"WITH {_ITEMS}, {_GAPS} SELECT * FROM gk WHERE kind IS NOT NULL")
def gap_analysis(spark, sf_dir):
    found = playbooks.gaps(rich._items(spark, sf_dir), rich.site_files(spark, sf_dir))
    return found.withColumn("files", F.array_join("files", ","))


@_query(
    f"WITH {_ITEMS}, b AS (SELECT *, CASE name {' '.join(f'WHEN {quoted(n)} THEN {x}' for n, x in catalog.PROJECTED.items())} END AS better FROM items) SELECT site, seq, name, score AS before, greatest(score, coalesce(better, score)) AS after, CASE WHEN score >= 70 THEN 'good' WHEN better > score THEN 'engine' ELSE 'client' END AS part FROM b"
)
def audits_side_by_side(spark, sf_dir):
    from ..operators import composite

    items = rich._items(spark, sf_dir)
    return service.side_by_side(items, composite.projected(items))


# --- run tables, from events, conversations, customers and orders on both sides


@_query(
    "WITH q AS (SELECT turn, text AS query, conv_id * 100 + turn AS seq, role AS category FROM conversations WHERE text IS NOT NULL), f AS (SELECT query, arg_min(category, seq) AS category FROM q GROUP BY query) SELECT conv_id * 100 + turn AS id, category FROM conversations c LEFT JOIN f ON f.query = c.text"
)
def answers_with_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    seq = (F.col("conv_id") * 100 + F.col("turn")).cast("long")
    queries = rows.where("text IS NOT NULL").select(seq.alias("seq"), F.col("text").alias("query"), F.col("role").alias("category"))
    return service.answers_with_queries(rows.select(seq.alias("id"), F.col("text").alias("query")), queries).select("id", "category")


@_query("SELECT p_partkey AS query_id, r_name AS engine FROM part CROSS JOIN region")
def asked_everywhere(spark, sf_dir):
    return service.asked_everywhere(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id")),
        table(spark, sf_dir, "region").select(F.col("r_name").alias("engine")),
    )


_EVENTS = "SELECT user_id AS job_id, event_id AS tm, CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'purchase' THEN 'completed' END AS status, CASE WHEN event_id % 3 = 0 THEN value END AS score, event_type = 'error' AS deleted FROM events"


@_query(
    f"WITH e AS ({_EVENTS}) SELECT job_id, arg_max(status, tm) FILTER (WHERE status IS NOT NULL) AS status, arg_max(score, tm) FILTER (WHERE score IS NOT NULL) AS score FROM e GROUP BY job_id HAVING NOT arg_max(deleted, tm)"
)
def job_states(spark, sf_dir):
    return service.state_of(
        spark.sql(_EVENTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")), "job_id", "tm", "status",
        "score",
    )


_USERS = "SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AS active, c_nationkey AS last_login FROM customer"
_SESSIONS = "SELECT o_orderkey AS session_id, o_custkey AS user_id, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS revoked_at, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' ELSE TIMESTAMP '2024-07-01 00:00:00' END AS expires_at FROM orders"


def _run_tables(spark, sf_dir):
    users = spark.sql(_USERS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return users, spark.sql(_SESSIONS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@_query(
    f"WITH u AS ({_USERS}), s AS ({_SESSIONS}) SELECT session_id, user_id, last_login FROM s JOIN u USING (user_id) WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-06-01 00:00:00' AND active"
)
def live_sessions(spark, sf_dir):
    users, sessions = _run_tables(spark, sf_dir)
    return service.live_sessions(sessions, users, "2024-06-01 00:00:00").select("session_id", "user_id", "last_login")


@_query(f"WITH u AS ({_USERS}) SELECT count(*) AS users, count_if(active)::BIGINT AS active, max(last_login) AS last_login FROM u")
def admin_overview(spark, sf_dir):
    return service.overview(_run_tables(spark, sf_dir)[0])


@_query(
    "SELECT o_orderkey AS job_id FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
)
def visible_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("domain"), F.col("o_orderpriority").alias("created_by"),
    )
    access = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.lit("1-URGENT").alias("user_id"), F.col("c_custkey").alias("domain"),
    )
    return service.visible_to(jobs, access, "1-URGENT").select("job_id")


_RATES = "SELECT o_custkey AS domain, count(*) AS scans, avg(CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate, max(o_orderkey % 40) AS pages, avg(CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END) AS failure_rate, max(o_orderkey % 20) AS weeks FROM orders GROUP BY o_custkey"
_STEP = lambda x, sign, *steps: "CASE " + " ".join(f"WHEN {x} {sign} {a} THEN {p}" for a, p in steps) + " ELSE 0 END"


@_query(f"""WITH t AS ({_RATES}), k AS (SELECT domain, least(100, 20 + {_STEP('scans', '>=', (4, 30), (2, 15))} + {_STEP('zero_rate', '<=', (0, 20), (0.25, 10))} + {_STEP('pages', '>=', (20, 15), (5, 8))} + {_STEP('failure_rate', '<=', (0.1, 15), (0.25, 8))} + {_STEP('weeks', '>=', (8, 10))}) AS reliability FROM t)
SELECT *, CASE WHEN reliability >= 75 THEN 'high' WHEN reliability >= 45 THEN 'medium' ELSE 'low' END AS level FROM k""")
def crawler_reliability(spark, sf_dir):
    return service.reliability(spark.sql(_RATES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")))


@_query("""WITH t AS (SELECT o_custkey AS site, o_orderkey AS seq, trim(CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' Add it' WHEN 2 THEN 'ADD IT' ELSE o_orderpriority END) AS text FROM orders), f AS (SELECT site, lower(text) AS low, min(row(seq, text)) AS f FROM t WHERE text <> '' GROUP BY site, lower(text)),
o AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY f[1], low)::INTEGER AS place, f[2] AS recommendation FROM f) SELECT * FROM o WHERE place <= 4""")
def distinct_recommendations(spark, sf_dir):
    key = F.col("o_orderkey") % 6
    text = F.when(key == 0, "").when(key == 1, " Add it").when(key == 2, "ADD IT").otherwise(F.col("o_orderpriority"))
    return service.distinct_recommendations(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("seq"), text.alias("recommendation"),
        )
    )


QUERIES = {name: f for name, (f, _) in _MORE.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _MORE.items()}
