"""JSON-LD for pages and sites that have none of a kind, and templates of schemas that a site should have.

Objects are built in columns and written with ``to_json``, which leaves out what is null; their order of fields is that of the columns. What is
there already is told by the items' own ``@type``: an item with a list of types names none of them here, but does for templates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import urls
from ..sources.scratch import checkpointed
from . import extract
from .context import type_of

#: Fields of page records that pages' objects are made of.
PAGE_FIELDS = (
    "title", "description", "author", "published", "modified", "og_type", "og_image", "words", "body", "headings", "faq", "breadcrumbs",
    "navigation", "json_ld",
)
CONTEXT = "https://schema.org"


def _there(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _if_there(c: Column) -> Column:
    return F.when(_there(c), c)


def _object(kind: str, *fields: tuple[str, Column], context: bool = True) -> Column:
    head = [F.lit(CONTEXT).alias("@context")] if context else []
    return F.struct(*head, F.lit(kind).alias("@type"), *(x.alias(k) for k, x in fields))


def _absolute(link: Column, home: Column) -> Column:
    """An address as seen from a site's home page."""
    return F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(
        link.startswith("/"), F.concat(home, link),
    ).otherwise(F.concat(home, F.lit("/"), link))


def how_to_steps(rows: DataFrame) -> DataFrame:
    """The rows with ``steps``, ``name`` and ``text`` of each: headings that are numbered, else, if the title says how to do something, those of
    the second and third level. A step's text follows its heading's first place in the body: up to the end of a sentence that ends after the
    20th and before the 300th character, else 200 characters; the heading itself, where nothing follows or it isn't there."""
    numbered = F.filter("headings", lambda h: h["text"].rlike(catalog.STEP_HEADING))
    below = F.filter("headings", lambda h: h["level"].isin(2, 3))
    chosen = F.when(F.size(numbered) > 0, numbered).when(F.col("title").rlike(r"(?i)how\s+to"), below).otherwise(F.slice("headings", 1, 0))

    def told(h: Column) -> Column:
        at = F.instr(F.col("body"), h["text"])
        after = F.substring(F.trim(F.substr(F.col("body"), at + F.length(h["text"]))), 1, 300)
        end = F.regexp_instr(after, F.lit(r"\.\s")) - 1  # of the point, from 0
        cut = F.when(end > 20, F.trim(F.substr(after, F.lit(1), end + 1))).otherwise(
            F.coalesce(F.nullif(F.trim(F.substring(after, 1, 200)), F.lit("")), h["text"])
        )
        return F.struct(h["text"].alias("name"), F.when(at == 0, h["text"]).otherwise(cut).alias("text"))

    return rows.withColumn("steps", F.transform(chosen, told))


def is_article(path: Column) -> Column:
    """``path`` in lower case."""
    return path.rlike(catalog.ARTICLE_PATH) | (F.coalesce("og_type", F.lit("")) == "article") | _there(F.col("published")) | (
        (F.col("words") > 300) & _there(F.col("author"))
    )


def is_product(path: Column) -> Column:
    priced = F.col("body").rlike(r"\$[0-9]+\.?[0-9]*") & F.col("body").contains("cart")
    return path.rlike(catalog.PRODUCT_PATH) | (F.coalesce("og_type", F.lit("")) == "product") | priced


def kept_pages(pages: DataFrame) -> DataFrame:
    """What :func:`page_json_ld` reads of page records with :data:`PAGE_FIELDS` and ``identity``, written once: pages are read and parsed one time for
    their objects and for their sites' identities, and texts are kept only where they are about the site."""
    path = urls.path_of(F.col("url"))
    return checkpointed(
        _page_told(pages).select(
            "site", "page_id", "url", "identity", F.when(extract.about_site(F.col("url")), F.col("body")).alias("body"), *_TOLD,
            F.when(path == "/", F.col("navigation")).alias("navigation"),
        )
    )


#: What is told of a page besides its site, number and address.
_TOLD = ("title", "description", "author", "published", "modified", "og_image", "breadcrumbs", "faq", "steps", "own", "article", "product")


def _page_told(pages: DataFrame) -> DataFrame:
    """The rows with ``steps``, ``own`` types of JSON-LD, and whether they are an ``article`` or a ``product``."""
    low = F.lower(urls.path_of(F.col("url")))
    return how_to_steps(pages).withColumns(
        {
            "own": F.transform("json_ld", lambda x: F.get_json_object(x, "$['@type']")), "article": is_article(low),
            "product": is_product(low),
        }
    )


def page_json_ld(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """``site, slug, page_id, kinds, json``: objects that a page should have and hasn't, as a JSON list. Of pages with one slug the last one
    that has any counts. ``pages`` are page records or :func:`kept_pages`, ``identities(site, identity)``."""
    path = urls.path_of(F.col("url"))
    low = F.lower(path)
    told = pages if set(_TOLD) <= set(pages.columns) else _page_told(pages)
    rows = told.drop("identity").join(identities, "site", "left")
    home = F.concat(F.lit("https://"), F.col("site"))
    name = F.when(_there(F.col("identity.name")), F.col("identity.name")).otherwise(F.col("site"))
    lacks = lambda kind: ~F.array_contains("own", kind)
    title, url, told, image = F.col("title"), F.col("url"), _if_there(F.col("description")), _if_there(F.col("og_image"))
    item = lambda kind, *fields: _object(kind, *fields, context=False)
    crumbs = F.transform("breadcrumbs", lambda b, i: item("ListItem", ("position", i + 1), ("name", b["name"]), ("item", b["url"])))
    faq = F.transform("faq", lambda f: item("Question", ("name", f["question"]), ("acceptedAnswer", item("Answer", ("text", f["answer"])))))
    steps = F.transform("steps", lambda s, i: item("HowToStep", ("position", i + 1), ("name", s["name"]), ("text", s["text"])))
    parts = F.transform(F.slice("navigation", 1, 20), lambda n: item("WebPage", ("name", n["text"]), ("url", n["url"])))
    logo = F.col("identity.logo")
    publisher = item("Organization", ("name", name), ("logo", F.when(_there(logo), item("ImageObject", ("url", _absolute(logo, home))))))
    author = F.when(_there(F.col("author")), item("Person", ("name", F.col("author"))))
    spoken = item(
        "SpeakableSpecification", ("cssSelector", F.array(*map(F.lit, ("h1", "h2", ".article-summary", '[itemprop="description"]')))),
    )
    article = lambda kind: F.to_json(
        _object(kind, ("headline", title), ("url", url), ("description", told), ("author", author), ("datePublished", _if_there(F.col("published"))), ("dateModified", _if_there(F.col("modified"))), ("image", image), ("publisher", publisher), ("speakable", spoken))
    )
    written = F.col("article") & lacks("Article") & lacks("BlogPosting")
    blog = low.rlike(catalog.BLOG_PATH)
    made = (
        (
            "BreadcrumbList", (F.size("breadcrumbs") > 1) & lacks("BreadcrumbList"),
            F.to_json(_object("BreadcrumbList", ("itemListElement", crumbs))),
        ),
        ("FAQPage", (F.size("faq") > 0) & lacks("FAQPage"), F.to_json(_object("FAQPage", ("mainEntity", faq)))),
        ("BlogPosting", written & blog, article("BlogPosting")), ("Article", written & ~blog, article("Article")),
        (
            "HowTo", (F.size("steps") >= 2) & lacks("HowTo"),
            F.to_json(_object("HowTo", ("name", title), ("description", told), ("step", steps))),
        ),
        (
            "Product", F.col("product") & lacks("Product"),
            F.to_json(_object("Product", ("name", title), ("url", url), ("description", told), ("image", image))),
        ),
        (
            "SiteNavigationElement", (F.size("navigation") >= 3) & (path == "/"),
            F.to_json(_object("SiteNavigationElement", ("name", F.lit("Main Navigation")), ("hasPart", parts))),
        ),
    )
    objects = F.filter(
        F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), x.alias("json"))) for kind, when, x in made)),
        lambda o: o.isNotNull(),
    )
    rows = rows.select("site", "page_id", urls.slug_of(path).alias("slug"), objects.alias("objects")).where(F.size("objects") > 0)
    last = rows.groupBy("site", "slug").agg(F.max_by(F.struct("page_id", "objects"), "page_id").alias("last"))
    kinds, texts = (F.transform("last.objects", lambda o: o[x]) for x in ("kind", "json"))
    return last.select(
        "site", "slug", "last.page_id", F.array_join(kinds, ",").alias("kinds"),
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("json"),
    )


def site_json_ld(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """``site, kind, json``: a site's Organization and WebSite, where none of its pages has one."""
    own = pages.select("site", F.explode_outer(F.transform("json_ld", lambda x: F.get_json_object(x, "$['@type']"))).alias("kind"))
    there = own.groupBy("site").agg(
        *(F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("Organization", "WebSite"))
    )
    rows = there.join(identities, "site", "left")
    i, home = F.col("identity"), F.concat(F.lit("https://"), F.col("site"))
    name = F.when(_there(i["name"]), i["name"]).otherwise(F.col("site"))
    contact = F.when(
        _there(i["email"]), _object("ContactPoint", ("email", i["email"]), ("telephone", _if_there(i["phone"])), context=False),
    )
    same = F.when(F.size(i["social"]) > 0, F.transform(i["social"], lambda s: s["url"]))
    organization = _object(
        "Organization", ("name", name), ("url", home), ("logo", F.when(_there(i["logo"]), _absolute(i["logo"], home))),
        ("contactPoint", contact), ("sameAs", same),
    )
    website = _object("WebSite", ("name", name), ("url", home), ("description", _if_there(i["tagline"])))
    made = F.array(
        *(
            F.when(~F.col(k), F.struct(F.lit(k).alias("kind"), F.to_json(x).alias("json")))
            for k, x in (("Organization", organization), ("WebSite", website))
        )
    )
    return rows.select("site", F.inline(F.filter(made, lambda x: x.isNotNull())))


def _phrases(names: tuple[str, ...], text: Column, *more: tuple[Column, str]) -> list[Column]:
    seen = lambda p: reduce(lambda a, b: a | b, (c.contains(p.replace(" ", by, 1)) for c, by in more), text.contains(p))
    return [F.coalesce(F.bool_or(seen(p)), F.lit(False)).cast("int") for p in names]


def site_types(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """``site, site_type``, by the first rule that fits: three phrases of shops on its pages; an address or phone; three addresses of posts; three
    phrases of software services, on its pages or in their addresses."""
    low, at = F.lower("body"), F.lower("url")
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    sums = pages.groupBy("site").agg(
        add(_phrases(catalog.SHOP_PHRASES, low)).alias("shop"), F.count_if(at.rlike(catalog.PUBLISHED_AT)).alias("posts"),
        add(_phrases(catalog.SOFTWARE_PHRASES, low, (at, "-"))).alias("software"),
        F.coalesce(F.bool_or(F.col("url").rlike(catalog.PUBLISHED_AT)), F.lit(False)).alias("publishes"),
    )
    rows = sums.join(identities, "site", "left")
    local = _there(F.col("identity.address")) | _there(F.col("identity.phone"))
    kind = F.when(F.col("shop") >= 3, "e-commerce").when(local, "local-business").when(F.col("posts") >= 3, "publisher").when(
        F.col("software") >= 3, "saas",
    ).otherwise("organization")
    return rows.select("site", kind.alias("site_type"), "publishes", "identity")


def schema_templates(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """``site, site_type, place, name, filename, priority, json``: templates of the schemas that fit a site's type and that it hasn't. What isn't
    known of it stands in double braces."""
    types = pages.select(
        "site",
        F.explode(F.flatten(F.transform("json_ld", lambda x: F.split(F.coalesce(type_of(x), F.lit("")), ","))).alias("t")).alias("t"),
    ).where("t <> ''").distinct()
    order = Window.partitionBy("site").orderBy("page_id", "place")
    asked = pages.select("site", "page_id", F.posexplode("faq").alias("place", "f")).withColumn(
        "r", F.row_number().over(order),
    ).where("r <= 10")
    question = _object(
        "Question", ("name", F.col("f.question")), ("acceptedAnswer", _object("Answer", ("text", F.col("f.answer")), context=False)),
        context=False,
    )
    asked = asked.groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", question.alias("q")))), lambda x: x["q"]).alias("questions")
    )
    rows = site_types(pages, identities).join(asked, "site", "left")

    i, home = F.col("identity"), F.concat(F.lit("https://"), F.col("site"))
    blank = lambda name: F.lit("{{" + name + "}}")
    known = lambda field, name: F.when(_there(i[field]), i[field]).otherwise(blank(name))
    part = lambda kind, *fields: _object(kind, *fields, context=False)
    links = F.coalesce(F.transform(i["social"], lambda s: s["url"]), F.array().cast("array<string>"))
    rating = ("aggregateRating", part("AggregateRating", ("ratingValue", blank("RATING")), ("reviewCount", blank("REVIEW_COUNT"))))
    town = part(
        "PostalAddress", ("streetAddress", blank("STREET")), ("addressLocality", blank("CITY")), ("addressCountry", blank("COUNTRY")),
    )
    # fixed values: names, files, priorities and fields of templates
    organization = _object(
        "Organization", ("name", known("name", "ORGANIZATION_NAME")), ("url", home), ("logo", known("logo", "LOGO_URL")),
        ("description", blank("DESCRIPTION")), ("foundingDate", blank("FOUNDING_DATE")), ("email", known("email", "EMAIL")),
        ("telephone", _if_there(i["phone"])), ("address", F.when(_there(i["address"]), town)),
        ("sameAs", F.when(F.size(links) > 0, links).otherwise(F.array(*map(blank, ("LINKEDIN_URL", "YOUTUBE_URL", "FACEBOOK_URL"))))),
        ("contactPoint", part("ContactPoint", ("contactType", F.lit("customer service")), ("email", known("email", "EMAIL")))),
    )
    website = _object(
        "WebSite", ("name", known("name", "SITE_NAME")), ("url", home),
        (
            "potentialAction",
            part(
                "SearchAction", ("target", part("EntryPoint", ("urlTemplate", F.concat(home, F.lit("/search?q={search_term_string}"))))),
                ("query-input", F.lit("required name=search_term_string")),
            ),
        ),
    )
    days = F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")))
    local = _object(
        "LocalBusiness", ("name", known("name", "BUSINESS_NAME")), ("url", home), ("logo", known("logo", "LOGO_URL")),
        ("description", blank("DESCRIPTION")), ("telephone", known("phone", "PHONE")), ("email", known("email", "EMAIL")),
        (
            "address",
            part(
                "PostalAddress", ("streetAddress", known("address", "STREET_ADDRESS")), ("addressLocality", blank("CITY")),
                ("postalCode", blank("POSTAL_CODE")), ("addressCountry", blank("COUNTRY_CODE")),
            ),
        ),
        ("geo", part("GeoCoordinates", ("latitude", blank("LATITUDE")), ("longitude", blank("LONGITUDE")))),
        (
            "openingHoursSpecification",
            F.array(part("OpeningHoursSpecification", ("dayOfWeek", days), ("opens", F.lit("09:00")), ("closes", F.lit("17:00")))),
        ),
        ("sameAs", links), ("priceRange", blank("PRICE_RANGE")),
    )
    article = _object(
        "Article", ("headline", blank("ARTICLE_TITLE")), ("description", blank("ARTICLE_DESCRIPTION")),
        ("image", blank("ARTICLE_IMAGE_URL")), ("datePublished", blank("YYYY-MM-DD")), ("dateModified", blank("YYYY-MM-DD")),
        (
            "author",
            part(
                "Person", ("name", blank("AUTHOR_NAME")), ("url", blank("AUTHOR_PAGE_URL")), ("jobTitle", blank("JOB_TITLE")),
                ("worksFor", part("Organization", ("name", blank("ORGANIZATION_NAME")))),
                ("sameAs", F.array(blank("LINKEDIN_PROFILE"), blank("TWITTER_PROFILE"))),
            ),
        ),
        (
            "publisher",
            part("Organization", ("name", blank("ORGANIZATION_NAME")), ("logo", part("ImageObject", ("url", blank("LOGO_URL"))))),
        ),
        ("mainEntityOfPage", part("WebPage", ("@id", blank("PAGE_URL")))),
    )
    offer = part(
        "Offer", ("price", blank("PRICE")), ("priceCurrency", blank("CURRENCY")), ("availability", F.lit("https://schema.org/InStock")),
        ("url", blank("PRODUCT_URL")),
    )
    product = _object(
        "Product", ("name", blank("PRODUCT_NAME")), ("description", blank("PRODUCT_DESCRIPTION")), ("image", blank("PRODUCT_IMAGE_URL")),
        ("brand", part("Brand", ("name", blank("BRAND_NAME")))), ("offers", offer), rating,
    )
    software = _object(
        "SoftwareApplication", ("name", known("name", "APP_NAME")), ("url", home), ("applicationCategory", blank("CATEGORY")),
        ("operatingSystem", F.lit("Web")), ("description", blank("DESCRIPTION")),
        ("offers", part("Offer", ("price", blank("PRICE")), ("priceCurrency", blank("CURRENCY")))),
        ("author", part("Organization", ("name", known("name", "ORGANIZATION_NAME")), ("url", home))), rating,
    )
    kind, always = F.col("site_type"), F.lit(True)
    templates = (
        ("Organization", "Organization", "organization-schema.json", "critical", always, organization),
        ("WebSite", "WebSite + SearchAction", "website-schema.json", "recommended", always, website),
        ("LocalBusiness", "LocalBusiness", "local-business-schema.json", "critical", kind == "local-business", local),
        ("Article", "Article + Author", "article-author-schema.json", "critical", (kind == "publisher") | F.col("publishes"), article),
        ("Product", "Product", "product-schema.json", "critical", kind == "e-commerce", product),
        ("SoftwareApplication", "SoftwareApplication", "saas-schema.json", "recommended", kind == "saas", software),
        (
            "FAQPage", "FAQPage", "faq-schema.json", "recommended", F.col("questions").isNotNull(),
            _object("FAQPage", ("mainEntity", F.col("questions"))),
        ),
    )
    cells = [
        F.when(
            when,
            F.struct(
                F.lit(k + 1).alias("place"), F.lit(t).alias("t"), F.lit(name).alias("name"), F.lit(file).alias("filename"),
                F.lit(priority).alias("priority"), F.to_json(x).alias("json"),
            ),
        )
        for k, (t, name, file, priority, when, x) in enumerate(templates)
    ]
    fitting = rows.select("site", "site_type", F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    return fitting.join(types, ["site", "t"], "left_anti").select("site", "site_type", "place", "name", "filename", "priority", "json")
