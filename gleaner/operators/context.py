"""What a site is about, and the questions that people may ask answer engines about it.

Evidence is a row of its own with a rank, a page and a place; the least of a site's wins. Lists are first-seen distinct values, cut before they
are gathered, so that no site's pages meet in one buffer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls
from ..functions.variants import parsed
from ..sources.scratch import checkpointed
from . import extract

#: Fields of page records that a context is made of.
FIELDS = ("language", "description", "body", "keywords", "headings", "json_ld", "hreflang", "identity")


def _there(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _json(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def type_of(item: Column) -> Column:
    """``@type`` of a JSON-LD item as text; several are joined."""
    kind = _json(item, "$['@type']")
    return F.when(kind.startswith("["), F.array_join(F.from_json(kind, "array<string>"), ",")).otherwise(kind)


def firsts(pages: DataFrame, values: Column, most: int, name: str) -> DataFrame:
    """``site`` and its first distinct values, in order of pages and then of places."""
    seen = pages.select("site", "page_id", F.posexplode(values).alias("place", "x")).groupBy("site", "x").agg(
        F.min(F.struct("page_id", "place")).alias("first")
    )
    few = seen.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("first"))).where(F.col("r") <= most)
    return few.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias(name))


def _country(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in catalog.COUNTRIES.items() for x in pair)), code)


def _industry() -> Column:
    """Of a page's JSON-LD the first item that tells an industry: its place and the value."""
    kind, told = lambda x: type_of(x), lambda x: _json(x, "$.industry")
    value = lambda x: F.when(_there(kind(x)) & ~kind(x).isin(*catalog.GENERIC_TYPES), kind(x)).when(
        _there(told(x)) & ~told(x).isin("false", "0", "null"), told(x),
    )
    told_by = F.transform("json_ld", lambda x, i: F.struct(i.cast("int").alias("place"), value(x).alias("value")))
    return F.get(F.filter(told_by, lambda e: e["value"].isNotNull()), F.lit(0))


def _located() -> Column:
    """What tells best where the site of a page works: rank, place and value."""
    parts = lambda item: F.array(*(_json(item, f"$.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")))
    address = lambda item: F.array_join(F.filter(parts(item), lambda x: _there(x) & ~x.isin("false", "0", "null")), ", ")
    code = lambda h, k: F.lower(F.get(F.split(h["lang"], "-"), F.lit(k)))
    evidence = lambda rank, place, value: F.struct(F.lit(rank).alias("rank"), place.cast("int").alias("place"), value.alias("value"))
    spoken = F.lower(F.get(F.split("language", "-"), F.lit(0)))
    told = F.concat(
        F.transform("json_ld", lambda x, i: evidence(1, i, F.nullif(address(x), F.lit("")))),
        F.transform("hreflang", lambda h, i: evidence(3, i, _country(code(h, 1)))),
        F.when(
            F.size("hreflang") > 0, F.array(evidence(3, F.size("hreflang"), _country(code(F.get("hreflang", F.lit(0)), 0)))),
        ).otherwise(F.array()),
        F.array(evidence(4, F.lit(0), F.when(spoken.isin(*catalog.TELLING_LANGUAGES), _country(spoken)))),
    )
    return F.array_min(F.filter(told, lambda e: e["value"].isNotNull()))


def _placed(rows: DataFrame) -> DataFrame:
    """``site, best`` from pages with ``located``; the domain is evidence too."""
    l, label = F.col("located"), F.element_at(F.split("site", r"\."), -1)
    domain = F.when(F.col("site").contains(".") & ~label.isin(*catalog.GENERIC_DOMAINS), _country(F.lower(label)))
    best = lambda rank, page, place, value: F.struct(
        rank.alias("rank"), page.cast("long").alias("page_id"), place.alias("place"), value.alias("value")
    )
    told = F.when(l.isNotNull(), best(l["rank"], F.col("page_id"), l["place"], l["value"]))
    sums = rows.groupBy("site").agg(F.min(told).alias("best"))
    return sums.select("site", F.least("best", F.when(domain.isNotNull(), best(F.lit(2), F.lit(0), F.lit(0), domain))).alias("best"))


def locations(pages: DataFrame) -> DataFrame:
    """``site, rank, location``: where a site works, by the first that tells: an address in JSON-LD (1), its domain (2), a region or else the
    first language of its alternates (3), a language that names one country (4). Sites of which nothing tells are left out."""
    best = _placed(pages.select("site", "page_id", _located().alias("located"))).where("best IS NOT NULL")
    return best.select("site", "best.rank", F.col("best.value").alias("location"))


def kept_pages(pages: DataFrame) -> DataFrame:
    """What :func:`context_of` and :func:`important_pages` read of page records with :data:`FIELDS`, written once: pages are read and parsed one
    time only, and their texts are kept only where they are about the site."""
    heads = F.transform(
        F.filter("headings", lambda h: (h["level"] <= 2) & F.length(h["text"]).between(4, 59)), lambda h: F.lower(h["text"]),
    )

    def offered(kind: str, *parts: str) -> Column:
        marked = F.filter("json_ld", lambda x: (_json(x, "$['@type']") == kind) & _there(_json(x, "$.name")))
        second = F.transform(F.filter("headings", lambda h: (h["level"] == 2) & F.length(h["text"]).between(4, 79)), lambda h: h["text"])
        there = F.lower("url").contains(parts[0]) | F.lower("url").contains(parts[1])
        return F.concat(F.transform(marked, lambda x: _json(x, "$.name")), F.when(there, second).otherwise(F.array().cast("array<string>")))

    return checkpointed(
        pages.select(
            "site", "page_id", "url", "language", F.when(F.length("description") > 20, F.col("description")).alias("description"),
            F.substring("body", 1, 200).alias("start"), F.when(extract.about_site(F.col("url")), F.col("body")).alias("body"),
            F.concat(F.transform("keywords", lambda k: F.lower(F.trim(k))), heads).alias("words_told"),
            offered("Service", "service", "paslaug").alias("services"), offered("Product", "product", "produ").alias("products"),
            _industry().alias("industry"), _located().alias("located"), "identity",
            F.slice(F.filter("headings", lambda h: h["level"] <= 2), 1, 1).alias("headings"),
            *(x for x in ("title", "words") if x in pages.columns),
        )
    )


def business_context(pages: DataFrame) -> DataFrame:
    """``site, name, language, description, keywords, industry, location, services, products`` from page records with :data:`FIELDS`."""
    return context_of(kept_pages(pages))


def context_of(pages: DataFrame) -> DataFrame:
    """:func:`business_context` from :func:`kept_pages`."""
    first = lambda c, when: F.min_by(c, F.when(when, F.col("page_id")))
    i = F.col("industry")
    told = pages.groupBy("site").agg(
        F.coalesce(first(F.col("language"), _there(F.col("language"))), F.lit("en")).alias("language"),
        F.coalesce(
            first(F.col("description"), F.col("description").isNotNull()), F.min_by("start", "page_id"), F.lit(""),
        ).alias("description"),
        F.min_by(i["value"], F.when(i.isNotNull(), F.struct("page_id", i["place"]))).alias("told"),
    )
    rows = told.join(firsts(pages, F.col("words_told"), 20, "keywords"), "site", "left").join(
        _placed(pages).select("site", F.col("best.value").alias("location")), "site", "left",
    )
    for name in ("services", "products"):
        rows = rows.join(firsts(pages, F.col(name), 10, name), "site", "left")
    rows = rows.join(extract.site_identity(pages), "site", "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    name = F.when(_there(F.col("identity.name")), F.col("identity.name")).otherwise(F.col("site"))
    place = F.when(_there(F.col("identity.address")), F.col("identity.address")).otherwise(F.col("location"))
    industry = F.coalesce("told", F.get("keywords", F.lit(0)), F.lit("general"))
    return rows.select(
        "site", name.alias("name"), "language", "description", listed("keywords"), industry.alias("industry"), place.alias("location"),
        listed("services"), listed("products"),
    )


# --- questions


def _written(template: str, values: dict[str, Column]) -> Column:
    """The template's text with its fields, put together part by part, so that what a field holds isn't read again."""
    parts = [values[p] if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return F.concat(*parts)


def template_queries(contexts: DataFrame, count: int = 20) -> DataFrame:
    """``site, place, query, category, intent, language``: the first ``count`` templates of the site's language whose fields are there.

    Sites in Lithuanian have templates of their own, all others the English ones.
    """
    place = F.coalesce("location", F.lit(""))
    locative = place
    for pattern, named in reversed(catalog.LOCATIVE):
        locative = F.when(place.rlike(pattern), named).otherwise(locative)
    item = lambda c, k: F.nullif(F.get(c, F.lit(k)), F.lit(""))
    before = lambda text: F.when(place != "", F.concat(F.lit(text), place)).otherwise("")
    values = {
        "name": F.col("name"), "industry": F.col("industry"), "service0": F.coalesce(item("services", 0), "industry"),
        "service1": F.coalesce(item("services", 1), item("keywords", 0), "industry"), "keyword0": item("keywords", 0),
        "keyword1": item("keywords", 1), "in": before(" in "), "at": before(" "),
        "where": F.when(place == "", "Lietuvoje").otherwise(locative),
    }
    rows = contexts.select("site", "language", F.struct(*(x.alias(k) for k, x in values.items())).alias("v"))
    held = {k: F.col(f"v.{k}") for k in values}

    def of(language: str) -> Column:
        made = [
            F.struct(_written(q, held).alias("query"), F.lit(c).alias("category"), F.lit(i).alias("intent"), F.lit(x).alias("language"))
            for q, c, i, x in catalog.QUERY_TEMPLATES[language]
        ]
        return F.slice(F.filter(F.array(*made), lambda t: t["query"].isNotNull()), 1, count)

    chosen = F.when(F.col("language") == "lt", of("lt")).otherwise(of("en"))
    return rows.select("site", F.posexplode(chosen).alias("place", "t")).select(
        "site", (F.col("place") + 1).alias("place"), "t.query", "t.category", "t.intent", "t.language",
    )


def important_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """The first pages of each site that are worth a query of their own."""
    rows = pages.withColumn("section", urls.section_of(F.col("url"))).where(
        ~F.col("section").isin("Main", "Legal", "Careers", "Changelog") & (F.col("words") >= 100) & (F.length("title") >= 5)
    )
    heading = F.get(F.filter("headings", lambda h: h["level"] <= 2), F.lit(0))["text"]
    rows = rows.select("site", "page_id", "url", "section", "title", heading.alias("heading"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).where(F.col("place") <= most).select("site", "place", "page_id", "url", "section", "title", "heading")


def page_queries(pages: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """``site, place, url, query, intent``: what people may ask about each important page, 20 of a site at most. ``names(site, name, industry,
    location)``."""
    rows = important_pages(pages, min(most, 20)).join(names, "site")
    low, name = F.lower("title"), F.col("name")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    headed, section = _there(F.col("heading")), F.col("section")
    # fixed values: wordings
    query = (
        F.when((section == "Services") & _there(F.col("location")), say("how does ", name, " ", low, " compare to other providers in ", F.col("location"))) .when(section == "Services", say("what does ", name, " offer for ", low, " and is it worth it")) .when(section == "Products", say(F.col("title"), " by ", name, " review and alternatives")) .when((section == "Blog") & headed, say("explain ", F.lower("heading"), " in detail")) .when(section == "Blog", say(low, " guide and best practices")) .when((section == "Documentation") & headed, say("how to ", F.lower("heading"), " with ", name)) .when(section == "Documentation", say(name, " ", low, " documentation and examples")) .when(section == "Examples", say(name, " ", low, " examples and use cases")) .when(section == "About", say("who is ", name, " and what is their background in ", F.col("industry"))) .otherwise(say(name, " ", low, " detailed information"))
    )
    return rows.select("site", "place", "url", query.alias("query"), say("Page-specific: ", section, " — ", F.col("title")).alias("intent"))


def replayed_queries(answers: DataFrame, count: int = 20) -> DataFrame:
    """``id, place, query, category, intent, language`` from what a language model answered (``id, text``), whose JSON holds a list of queries.

    The list is what lies between the first ``[`` and the last ``]``; an entry counts if it has a query and a category of the known ones, and
    the first ``count`` of an answer's are kept. Text that isn't JSON gives no rows; :func:`unreadable_answers` has it.
    """
    found = answers.select("id", parsed(json_list(F.col("text"))).alias("list"))
    spark = answers.sparkSession
    items = spark.sql(
        "SELECT id, pos, value FROM {found}, LATERAL variant_explode(list) WHERE schema_of_variant(list) LIKE 'ARRAY%'", found=found,
    )
    field = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    rows = items.select(
        "id", "pos", field("query").alias("query"), field("category").alias("category"),
        F.coalesce(field("intent"), F.lit("")).alias("intent"),
        F.coalesce(F.nullif(field("language"), F.lit("")), F.lit("en")).alias("language"),
    )
    rows = rows.where(_there(F.col("query")) & F.col("category").isin(*catalog.QUERY_CATEGORIES))
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return rows.withColumn("place", place).where(F.col("place") <= count).select("id", "place", "query", "category", "intent", "language")


def json_list(text: Column) -> Column:
    """The JSON list in a text: from the first ``[`` to the last ``]``. A list that is an object's field lies there too."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def unreadable_answers(answers: DataFrame) -> DataFrame:
    """``id, text`` of answers without a list that can be read."""
    return answers.where(parsed(json_list(F.col("text"))).isNull()).select("id", "text")


def all_queries(of_site: DataFrame, of_pages: DataFrame) -> DataFrame:
    """Queries of the site first, then those of its pages: ``site, place, query, category, target``."""
    first = of_site.select(
        "site", F.struct(F.lit(0).alias("part"), "place").alias("at"), "query", "category", F.lit(None).cast("string").alias("target"),
    )
    then = of_pages.select(
        "site", F.struct(F.lit(1).alias("part"), "place").alias("at"), "query", F.lit("page_specific").alias("category"),
        F.col("url").alias("target"),
    )
    return first.unionByName(then).withColumn(
        "place", F.row_number().over(Window.partitionBy("site").orderBy("at")),
    ).select("site", "place", "query", "category", "target")
