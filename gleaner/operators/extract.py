"""Page records: what a document tree tells of a page, one nested row for each, from one pass over its HTML.

Every page's tree is built once, in Arrow batches, and is gone before the next one. A page that is null or no markup gives an
empty record; nothing raises.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import catalog
from ..functions import addresses, markdown, urls
from ..functions.dom import Node, parse

_PAIR = lambda a, b: f"array<struct<{a}:string,{b}:string>>"
FIELDS = {
    "title": "string", "description": "string", "canonical": "string", "language": "string", "og_title": "string",
    "og_description": "string", "og_image": "string", "og_type": "string", "og_site_name": "string", "tw_card": "string",
    "tw_title": "string", "tw_description": "string", "tw_image": "string", "author": "string", "author_bio": "string",
    "published": "string", "modified": "string", "keywords": "array<string>", "robots": "string", "google": "string", "bing": "string",
    "yandex": "string", "viewport": "string", "hreflang": _PAIR("lang", "url"), "charset": "string", "doctype": "boolean",
    "headings": "array<struct<level:int,text:string>>", "body": "string", "words": "int", "faq": _PAIR("question", "answer"),
    "lists": "array<array<string>>", "tables": "array<array<array<string>>>", "statistics": "array<string>", "sources": "array<string>",
    "quotes": "array<string>", "navigation": _PAIR("text", "url"), "breadcrumbs": _PAIR("name", "url"), "internal": "array<string>",
    "external": "array<string>", "images": _PAIR("src", "alt"), "json_ld": "array<string>", "microdata": "array<string>",
    "rdfa": "array<string>",
    "schema": "struct<types:array<string>,faq_page:boolean,dated:boolean,org:boolean,logo:boolean,contact:boolean,same_as:boolean,org_named:boolean,org_complete:boolean>",
    "identity": "struct<name:string,tagline:string,logo:string,favicon:string,email:string,phone:string,address:string,social:array<struct<platform:string,url:string>>,copyright:string,tech:array<string>>",
}
_CUT = frozenset("script style nav footer header aside iframe noscript svg".split())
_SPACE = re.compile(r"\s+")


def _trim(node: Node | None) -> str:
    return node.text().strip() if node else ""


def _main(n: Node) -> bool:
    return n.tag in ("main", "article") or n.get("role") == "main"


def _has(name: str, part: str):
    return lambda n: part in n.get(name)


def _meta(root: Node, url: str, html: str) -> dict:
    tags = root.all("meta")

    def meta(name: str) -> str | None:
        for attr in ("name", "property"):
            if found := next((n.get("content") for n in tags if n.get(attr) == name), ""):
                return found
        return None

    def link(rel: str) -> str | None:
        return next((n.get("href") for n in root.all("link") if n.get("rel") == rel), "") or None

    typed = next((n.get("content") for n in tags if n.get("http-equiv") == "Content-Type"), "")
    charset = next((n.get("charset") for n in tags if "charset" in n.attrs), "") or next(
        iter(re.findall(r"(?i)charset=([^\s;]+)", typed)), None,
    )
    page = next(iter(root.all("html")), None)
    time = root.first(lambda n: n.tag == "time" and "datetime" in n.attrs)
    return {
        "title": _trim(root.first("title")) or meta("og:title") or _trim(root.first("h1")),
        "description": meta("description") or meta("og:description") or "", "canonical": link("canonical"),
        "language": (page.get("lang") if page else "") or meta("language"), "og_title": meta("og:title"),
        "og_description": meta("og:description"), "og_image": meta("og:image"), "og_type": meta("og:type"),
        "og_site_name": meta("og:site_name"), "tw_card": meta("twitter:card"), "tw_title": meta("twitter:title"),
        "tw_description": meta("twitter:description"), "tw_image": meta("twitter:image"), "author": meta("author"),
        "author_bio": _bio(root),
        "published": meta("article:published_time") or meta("datePublished") or meta("date") or (
            time.get("datetime") if time else ""
        ) or None,
        "modified": meta("article:modified_time") or meta("dateModified"),
        "keywords": [k for k in (w.strip() for w in (meta("keywords") or "").split(",")) if k], "robots": meta("robots"),
        "google": meta("google-site-verification"), "bing": meta("msvalidate.01"), "yandex": meta("yandex-verification"),
        "viewport": meta("viewport"),
        "hreflang": [{"lang": n.get("hreflang"), "url": n.get("href")} for n in root.all("link") if n.get("hreflang") and n.get("href")],
        "charset": charset, "doctype": bool(re.match(r"(?i)\s*<!doctype\s", html)),
    }


def _bio(root: Node) -> str | None:
    under = root.under(lambda p: p.get("itemprop") == "author")
    by_author = root.first(lambda n: n.get("itemprop") == "description" and under[n.at])
    for node in (by_author, root.first(lambda n: "author-bio" in n.get("class").split())):
        if len(_trim(node)) > 10:
            return _trim(node)
    node = root.first(lambda n: n.tag == "a" and n.get("rel") == "author")
    while node is not None and node.tag not in ("p", "div", "span"):
        node = node.parent
    return _trim(node) if 20 < len(_trim(node)) < 500 else None


def _faq(root: Node) -> list[dict]:
    found: list[tuple[str, str]] = []
    under = root.under(_has("itemtype", "FAQPage"))
    for n in root.all(lambda n: "Question" in n.get("itemtype") and under[n.at]):
        joined = lambda *names: "".join(x.text() for x in n.all(lambda x: x.get("itemprop") in names)).strip()  # noqa: E731, B023
        found.append((joined("name"), joined("acceptedAnswer", "text")))
    for n in root.all("details"):
        rest = "".join(c if isinstance(c, str) else c.text() for c in n.children if isinstance(c, str) or c.tag != "summary")
        found.append(("".join(s.text() for s in n.all("summary")).strip(), rest.strip()))
    for n in root.all("h2 h3 h4"):
        after = n.next()
        if _trim(n).endswith("?") and after is not None and after.tag in ("p", "div") and len(_trim(after)) > 20:
            found.append((_trim(n), _trim(after)))
    listed = root.under(lambda p: p.tag == "dl")
    for n in root.all(lambda n: n.tag == "dt" and listed[n.at]):
        after = n.next()
        found.append((_trim(n), _trim(after) if after is not None and after.tag == "dd" else ""))
    first: dict[str, str] = {}
    for question, answer in found:
        if question and answer:
            first.setdefault(question, answer)
    return [{"question": q, "answer": a} for q, a in first.items()]


def _citations(root: Node, body: str) -> dict:
    seen: set[str] = set()

    def fresh(found: Iterator[str]) -> list[str]:
        return [x for x in found if not (x in seen or seen.add(x))]

    statistics = fresh(m.group().strip() for p in catalog.STATISTICS for m in re.finditer(p, body, re.ASCII))
    cited = [_trim(n) for n in root.all("cite") if len(_trim(n)) > 2] + [n.get("cite") for n in root.all("blockquote") if n.get("cite")]
    told = ((m[1] if m.re.groups else m[0]).strip() for p in catalog.SOURCES for m in re.finditer(p, body, re.ASCII))
    sources = fresh(iter(cited)) + fresh(x for x in told if 3 < len(x) < 100)
    return {
        "statistics": statistics, "sources": sources, "quotes": fresh(_trim(n) for n in root.all("blockquote") if 20 < len(_trim(n)) < 500),
    }


def _content(root: Node) -> dict:
    cut, main = root.under(lambda p: p.tag in _CUT), root.under(_main)
    chosen = [n for n in root.walk() if _main(n) and n.tag not in _CUT and not cut[n.at]]
    text = "".join(n.text(_CUT) for n in chosen)
    if len(text.strip()) < 50:
        page = root.first("body")
        text = (page.text(_CUT) if page else "") or root.text(_CUT)
    body = _SPACE.sub(" ", text).strip()
    lists = [
        [t for t in (_trim(c) for c in n.children if isinstance(c, Node) and c.tag == "li") if t] for n in root.all("ul ol") if main[n.at]
    ]
    tables = [[[_trim(c) for c in row.all("th td")] for row in n.all("tr")] for n in root.all("table")]
    tables = [[row for row in t if row] for t in tables]
    return {
        "headings": [{"level": int(n.tag[1]), "text": _trim(n)} for n in root.all("h1 h2 h3 h4 h5 h6") if _trim(n)],
        "body": body, "words": len(body.split()), "faq": _faq(root), "lists": [x for x in lists if x], "tables": [t for t in tables if t],
    } | _citations(root, body)


def _links(root: Node, url: str) -> dict:
    internal, external = {}, {}
    for n in root.all("a"):
        href = n.get("href")
        if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")) and (target := addresses.normalize(href, url)):
            (internal if addresses.host(target) == addresses.host(url) else external)[target] = None
    return {"internal": list(internal), "external": list(external)}


def _places(root: Node, url: str) -> dict:
    def within(tag: str) -> list[dict]:
        found: dict[str, str] = {}
        under = root.under(lambda p: p.tag == tag)
        for n in root.all(lambda n: n.tag == "a" and under[n.at]):
            if _trim(n) and n.get("href") and (target := addresses.normalize(n.get("href"), url)):
                found.setdefault(target, _trim(n))
        return [{"text": t, "url": u} for u, t in found.items()]

    crumbs, under = [], root.under(_has("itemtype", "BreadcrumbList"))
    for n in root.all(lambda n: "ListItem" in n.get("itemtype") and under[n.at]):
        name = "".join(x.text() for x in n.all(lambda x: x.get("itemprop") == "name")).strip()
        item = n.first(lambda x: x.get("itemprop") == "item")
        if name:
            crumbs.append({"name": name, "url": addresses.normalize(item.get("href") if item else "", url) or url})
    for fits in () if crumbs else (
        _has("class", "breadcrumb"), lambda n: n.get("aria-label") in ("breadcrumb", "Breadcrumb"), lambda n: n.get("id") == "breadcrumbs",
    ):
        box = root.first(fits)
        if box is None:
            continue
        crumbs += [
            {"name": _trim(a), "url": addresses.normalize(a.get("href"), url) or url} for a in box.all("a") if _trim(a) and a.get("href")
        ]
        last = box.all(lambda n: n.tag in ("span", "li") and n.next() is None)
        if last and _trim(last[-1]) and (not crumbs or crumbs[-1]["name"] != _trim(last[-1])):
            crumbs.append({"name": _trim(last[-1]), "url": url})
        if crumbs:
            break
    return {
        "navigation": within("nav") or within("header"), "breadcrumbs": crumbs,
        "images": [{"src": n.get("src"), "alt": n.get("alt")} for n in root.all("img") if n.get("src")],
    }


def _parsed(root: Node) -> list:
    out = []
    for n in root.all(lambda n: n.tag == "script" and n.get("type") == "application/ld+json"):
        try:
            out.append(json.loads(n.text()))
        except ValueError:
            pass
    return out


def _structured(root: Node, parsed: list) -> dict:
    items = []
    for x in parsed:
        graph = x.get("@graph") if isinstance(x, dict) else None
        items += [i for i in (x if isinstance(x, list) else graph if isinstance(graph, list) else [x]) if isinstance(i, (dict, list)) and i]

    def described(kind: str, name: str, marked: str, *attrs: str) -> list[str]:
        out = []
        for n in root.all(lambda n: n.get(kind) and (kind == "typeof" or "itemscope" in n.attrs)):
            held = {
                "@type": n.get(kind).split("/")[-1] or n.get(kind), "itemtype": n.get(kind),
            } if kind == "itemtype" else {"@type": n.get(kind)}
            for p in n.all(lambda p: marked in p.attrs):
                value = next((p.get(a) for a in attrs if p.get(a)), "") or _trim(p)
                if p.get(marked) and value:
                    held[p.get(marked)] = value
            out.append(json.dumps(held, ensure_ascii=False))
        return out

    dicts = [i for i in items if isinstance(i, dict)]
    types = lambda i: [str(t) for t in i["@type"]] if isinstance(i.get("@type"), list) else [str(i["@type"])] if i.get("@type") else []
    orgs = [i for i in dicts if {"Organization", "LocalBusiness"} & set(types(i))]
    named = [i for i in dicts if i.get("@type") in ("Organization", "LocalBusiness")]
    return {
        "json_ld": [json.dumps(i, ensure_ascii=False) for i in items],
        "microdata": described("itemtype", "itemtype", "itemprop", "content", "href", "src"),
        "rdfa": described("typeof", "typeof", "property", "content", "href"),
        "schema": {
            "types": list(dict.fromkeys(t for i in dicts for t in types(i))), "faq_page": any(i.get("@type") == "FAQPage" for i in dicts),
            "dated": any(i.get("dateModified") or i.get("datePublished") for i in dicts), "org": bool(orgs),
            "logo": any(i.get("logo") for i in orgs), "contact": any(i.get("contactPoint") for i in orgs),
            "same_as": any(isinstance(i.get("sameAs"), list) and i["sameAs"] for i in orgs), "org_named": bool(named),
            "org_complete": any(i.get("name") and i.get("url") and (i.get("logo") or i.get("image")) for i in named),
        },
    }


def _identity(root: Node, url: str, html: str, parsed: list, meta: dict) -> dict:
    name = meta["og_site_name"]
    for x in parsed:
        if name or not isinstance(x, dict):
            break
        name = x.get("name") if x.get("@type") == "Organization" else None
        for i in x.get("@graph") if isinstance(x.get("@graph"), list) else []:
            if isinstance(i, dict) and i.get("@type") == "Organization" and i.get("name"):
                name = i["name"]
    title = "".join(n.text() for n in root.all("title")).strip()
    logo = None
    for x in parsed:
        if isinstance(x, dict) and x.get("logo"):
            logo = x["logo"] if isinstance(x["logo"], str) else x["logo"].get("url") if isinstance(x["logo"], dict) else None
    image = lambda fits: next((n.get("src") for n in root.all(lambda n: n.tag == "img" and fits(n))[:1]), "")
    linked, boxed, headed = root.under(lambda p: p.tag == "a" and "logo" in p.get("class")), root.under(_has("class", "logo")), root.under(
        lambda p: p.tag == "header"
    )
    logos = (
        lambda n: linked[n.at], lambda n: boxed[n.at], lambda n: headed[n.at] and "logo" in n.get("alt").lower(), _has("class", "logo"),
        _has("id", "logo"),
    )
    hrefs = [n.get("href") for n in root.all("a") if "href" in n.attrs]
    page = root.first("body")
    text = page.text() if page else ""
    after = lambda scheme: next((h[len(scheme) :] for h in hrefs if h.startswith(scheme) and h[len(scheme) :].split("?")[0].strip()), None)
    email, phone = after("mailto:"), after("tel:")
    found = re.search(r"[\w.+-]+@[\w-]+\.[\w.]+", text, re.ASCII)
    social: dict[str, str] = {}
    for h in hrefs:
        platform = next((p for p, pattern in catalog.SOCIAL if re.search(pattern, h) and p not in social), None)
        if platform:
            social[platform] = h
    prop = lambda p: "".join(n.text() for n in root.all(lambda n: n.get("itemprop") == p)).strip()
    address = _SPACE.sub(" ", _trim(root.first("address")))
    if len(address) <= 5:
        parts = [prop(p) for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
        address = ", ".join(p for p in parts if p) if parts[0] or parts[1] else None
    marked = r"(?i)(?:©|\(c\)|copyright)\s*\d{4}[^.]*\."
    copied = re.search(marked, "".join(n.text() for n in root.all("footer"))) or re.search(marked, text)
    icon = lambda rel: next((n.get("href") for n in root.all("link") if n.get("rel") == rel and n.get("href")), None)
    generator = next((n.get("content") for n in root.all("meta") if n.get("name") == "generator"), "")
    attrs = {a for n in root.walk() for a in n.attrs}
    near = lambda part: any(part in n.get(a) for n in root.walk() for t, a in (("link", "href"), ("script", "src")) if n.tag == t)
    tech = [generator] + [
        label
        for label, texts, names, linked in catalog.TECH if any(t in html for t in texts) or attrs & set(names) or any(map(near, linked))
    ]
    return {
        "name": (str(name) if name else None) or (re.split(r"\s*[|–—-]\s*", title)[-1].strip() if title else addresses.host(url) or None),
        "tagline": meta["description"] or None, "logo": logo or next((x for x in map(image, logos) if x), None) or meta["og_image"],
        "favicon": icon("icon") or icon("shortcut icon") or icon("apple-touch-icon"),
        "email": email.split("?")[0].strip() if email else found.group() if found else None, "phone": phone.strip() if phone else None,
        "address": address, "social": [{"platform": p, "url": u} for p, u in social.items()],
        "copyright": copied.group().strip() if copied else None, "tech": list(dict.fromkeys(t for t in tech if t)),
    }


def _group(*names: str) -> frozenset[str]:
    return frozenset(names)


_META_FIELDS = _group(*list(FIELDS)[: list(FIELDS).index("headings")])
_CONTENT_FIELDS = _group("headings", "body", "words", "faq", "lists", "tables", "statistics", "sources", "quotes")
_PLACE_FIELDS, _LINK_FIELDS, _DATA_FIELDS = _group("navigation", "breadcrumbs", "images"), _group("internal", "external"), _group(
    "json_ld", "microdata", "rdfa", "schema",
)


def record(html: str | None, url: str | None, fields: frozenset[str] = frozenset(FIELDS)) -> dict:
    """Fields of one page, and others of :data:`FIELDS` that come with them."""
    html, url = html or "", url or ""
    root, out = parse(html), {}
    if fields & (_META_FIELDS | {"identity"}):
        out |= _meta(root, url, html)
    if fields & _CONTENT_FIELDS:
        out |= _content(root)
    if fields & _LINK_FIELDS:
        out |= _links(root, url)
    if fields & _PLACE_FIELDS:
        out |= _places(root, url)
    if fields & (_DATA_FIELDS | {"identity"}):
        parsed = _parsed(root)
        out |= _structured(root, parsed)
        if "identity" in fields:
            out["identity"] = _identity(root, url, html, parsed, out)
    if "markdown" in fields:
        out["markdown"] = markdown.of_page(root)
    return out


def records(pages: DataFrame, *fields: str, html: str = "html", url: str = "url") -> DataFrame:
    """The rows of ``pages`` with these fields of their records, or with all but ``markdown``; columns of those names are replaced.

    Only what the fields need is looked for. The tree of a page is gone before the next one's is built.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = list(fields) or list(FIELDS)
    kinds, wanted = FIELDS | {"markdown": "string"}, frozenset(names)
    kept = pages.drop(*names)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"{n} {kinds[n]}" for n in names)).fields])
    arrow, others = to_arrow_schema(schema), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # records are larger than pages
                part = batch.slice(a, 64)
                rows = [record(h, u, wanted) for h, u in zip(part.column(html).to_pylist(), part.column(url).to_pylist())]
                found = [pa.array([r[n] for r in rows], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*(part.column(n).cast(arrow.field(n).type) for n in others), *found], schema=arrow)

    return kept.mapInArrow(run, schema)


_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"
_ADDRESS = r"[0-9]{1,5}\s[A-Za-z0-9_\s]+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl)[.,]?\s+[A-Za-z0-9_\s]+,\s*[A-Z]{2}\s+[0-9]{5}"


def about_site(url: Column) -> Column:
    """Whether a page is about its site, by its address; :func:`site_identity` reads no other texts."""
    return F.lower(urls.path_of(url)).rlike("/(about|contact|team)")


def site_identity(rows: DataFrame) -> DataFrame:
    """``site`` and ``identity`` of its home page: the one at the root, else the first. E-mail and address, where it has none, come
    from the texts of the first pages about the site that hold one."""
    path = F.lower(urls.path_of(F.col("url")))
    home = F.struct(F.when(path.isin("/", "/index.html", "/index"), 0).otherwise(1), "page_id")
    found = lambda pattern: F.when(about_site(F.col("url")), F.nullif(F.regexp_extract("body", pattern, 0), F.lit("")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("page_id")))
    sums = rows.groupBy("site").agg(
        F.min_by("identity", home).alias("i"), first(found(_EMAIL)).alias("email"), first(found(_ADDRESS)).alias("address"),
    )
    filled = F.col("i").withField("email", F.coalesce("i.email", "email")).withField("address", F.coalesce("i.address", "address"))
    return sums.select("site", filled.alias("identity"))
