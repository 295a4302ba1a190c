"""What is made for sites: cases that the queries' tables don't hold, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions import markdown, text, urls
from gleaner.functions.dom import parse
from gleaner.functions.variants import parsed
from gleaner.operators import citability, context, crawl, extract, json_ld, payloads, playbooks, robots, sites, texts


def pages(spark, rows):
    """Records of ``(site, page_id, url, html)``."""
    return extract.records(spark.createDataFrame(rows, "site string, page_id long, url string, html string"))


@pytest.mark.parametrize(
    "html, text",
    [
        ("<main><h1>A <em>b</em></h1><p>One<br>two <b> bold </b>end</p></main>", "# A *b*\n\nOne  \ntwo **bold** end"),
        ("<ul><li>one<li>two<ul><li>in</ul></ul>", "-   one\n-   two\n    -   in"),
        ('<ol start="4"><li>a</li><li>b</li></ol>', "4.  a\n5.  b"), ("<ul><li><p>a</p><p>b</p></li></ul>", "-   a\n    \n    b"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
        ('<pre><code class="language-py">x = 1\n  y*</code></pre>', "```py\nx = 1\n  y*\n```"),
        (
            '<p><a href="/a" title="t">x</a> <img src="/i.png" alt="i"> <img alt="none"> <code>a*b</code></p>',
            '[x](/a "t") ![i](/i.png) `a*b`',
        ),
        ("<p># no</p><p>1. no</p><p>- no</p><p>a*b_c[d]</p><p>&gt; no</p>", "\\# no\n\n1\\. no\n\n\\- no\n\na\\*b\\_c\\[d\\]\n\n\\> no"),
        ("<table><tr><td>a<td>b<tr><td>c</table><hr>", "a\n\nb\n\nc\n\n* * *"),
        ("<nav>no</nav><p>yes</p><script>no</script><footer>no</footer>", "yes"), ("", ""), ("plain", "plain"),
        ("<b><p>block</p> inside</b>", "block\n\ninside"),
    ],
)
def test_markdown(html, text):
    assert markdown.of_page(parse(html)) == text


def test_markdown_takes_what_holds_enough():
    long = "word " * 40
    assert markdown.of_page(parse(f"<body><main>short</main><article>{long}</article><p>out</p></body>")) == long.strip()
    assert markdown.of_page(parse(f'<body><div class="a content">{long}</div><p>out</p></body>')) == long.strip()
    assert markdown.of_page(parse("<body><main>short</main><p>out</p></body>")) == "short\n\nout"


def test_deep_and_wide_pages_take_linear_time():
    import time

    began = time.time()
    assert markdown.of_page(parse("<div>" * 30_000 + "x")) == "x"
    wide = extract.record("<main>" + "<h2>q?</h2><p>an answer that is long enough</p>" * 5_000 + "</main>", "https://a.example/")
    assert len(wide["headings"]) == 5_000 and len(wide["faq"]) == 1 and time.time() - began < 30


def test_locations(spark):
    """All four kinds of evidence, their order, and sites that nothing tells of."""
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    alternate = lambda *langs: "".join(f'<link rel="alternate" hreflang="{x}" href="/{x}">' for x in langs)
    rows = [
        ("a.lt", 1, "https://a.lt/1", ld({"@type": "Thing"})),
        ("a.lt", 2, "https://a.lt/2", ld([{"address": {}}, {"address": {"addressLocality": "Kaunas", "addressCountry": "LT"}}])),
        ("a.lt", 3, "https://a.lt/3", ld({"address": {"addressRegion": "Later"}})), ("b.co.uk", 1, "https://b.co.uk/", alternate("de-AT")),
        ("c.com", 1, "https://c.com/", '<html lang="lv">'), ("c.com", 2, "https://c.com/2", alternate("x-default", "en", "pt-BR")),
        ("d.org", 1, "https://d.org/", alternate("pl", "xx-YY")), ("e.io", 1, "https://e.io/", '<html lang="en">'),
        ("e.io", 2, "https://e.io/2", '<html lang="fi-FI">'), ("f.net", 1, "https://f.net/", '<html lang="fr">'),
        ("g.net", 1, "https://g.net/", None),
    ]
    got = {r["site"]: (r["rank"], r["location"]) for r in context.locations(pages(spark, rows)).collect()}
    assert got == {
        "a.lt": (1, "Kaunas, LT"), "b.co.uk": (2, "United Kingdom"), "c.com": (3, "Brazil"), "d.org": (3, "Poland"), "e.io": (4, "Finland"),
    }


def test_business_context(spark):
    ld = '<script type="application/ld+json">[{"@type":"Service","name":"Repair"},{"@type":["Product","Thing"],"name":"no"},{"@type":"Product","name":"Widget"},{"industry":"Later"}]</script>'
    rows = [
        (
            "a.com", 1, "https://a.com/services",
            f"<title>x | A Co</title>{ld}<h2>Painting walls</h2><h2>no</h2><h3>Not second</h3><meta name=keywords content='Paint, walls ,PAINT'>",
        ),
        ("a.com", 2, "https://a.com/products/1", "<h2>Widget</h2><h2>Gadget</h2><h1>Home page</h1>"),
        ("b.com", 1, "https://b.com/", "<p>nothing"),
    ]
    got = {r["site"]: r.asDict() for r in context.business_context(pages(spark, rows)).collect()}
    a = got["a.com"]
    assert (a["name"], a["language"], a["industry"], a["location"]) == ("A Co", "en", "Service", None)
    assert (a["keywords"], a["services"], a["products"]) == (
        ["paint", "walls", "painting walls", "widget", "gadget", "home page"], ["Repair", "Painting walls"], ["Widget", "Gadget"],
    )
    assert (got["b.com"]["industry"], got["b.com"]["keywords"], got["b.com"]["name"]) == ("general", [], "b.com")


def test_templates_without_fields(spark):
    schema = "site string, name string, industry string, location string, services array<string>, keywords array<string>, language string"
    rows = [
        ("a", "A {industry}", "tools", None, [], [], "en"), ("b", "B", "tools", "Vilnius city", ["s0", "s1"], ["k0", "k1"], "lt"),
        ("c", "C", "tools", "Paris", ["s0"], ["k0"], "lt-LT"),
    ]
    got = {}
    for r in sorted(context.template_queries(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r["site"], r["place"])):
        got.setdefault(r["site"], []).append(r["query"])
    assert len(got["a"]) == 18 and got["a"][0] == "what does A {industry} do and are they reputable" and got["a"][2] == "how to choose a good tools provider"
    assert len(got["b"]) == 20 and got["b"][4] == "kiek kainuoja s0 Vilniuje" and got["b"][15] == "s0 vs s1 which is better"
    assert len(got["c"]) == 19 and got["c"][10] == "best tools companies in Paris comparison" and got["c"][12] == "s0 price comparison Paris"


def test_steps_and_objects(spark):
    body = "<main><h2>Step 1 Open</h2><p>Open the lid of the box slowly. Then wait.</p><h2>2) Close</h2><p>Short. End.</p><h3>3. Last</h3></main>"
    nav = "<nav>" + "".join(f'<a href="/{k}">N{k}</a>' for k in range(25)) + "</nav>"
    rows = [
        ("a.com", 1, "https://a.com/", f"<title>Home</title>{nav}"), ("a.com", 2, "https://a.com/guide.html", f"<title>T</title>{body}"),
        ("a.com", 3, "https://a.com/shop/x/", "<title>X</title><p>$5.00 in the cart</p>"),
        ("a.com", 4, "https://a.com/shop/x", "<title>Y</title><p>again</p>"),
        ("b.com", 1, "https://b.com/how", "<title>How to sing</title><h2>Breathe</h2><h3>Sing</h3><h4>no</h4>"),
        ("b.com", 2, "https://b.com/posts/1", '<title>P</title><script type="application/ld+json">{"@type":"Article"}</script>'),
    ]
    records = pages(spark, rows)
    got = {
        (r["site"], r["slug"]): (r["page_id"], {x["@type"]: x for x in json.loads(r["json"])})
        for r in json_ld.page_json_ld(records.drop("identity"), extract.site_identity(records)).collect()
    }
    assert set(got) == {("a.com", "index"), ("a.com", "guide"), ("a.com", "shop-x"), ("b.com", "how")}
    assert [len(got["a.com", "index"][1]["SiteNavigationElement"]["hasPart"]), got["a.com", "shop-x"][0]] == [20, 4]
    steps = got["a.com", "guide"][1]["HowTo"]["step"]
    assert [(s["position"], s["name"]) for s in steps] == [(1, "Step 1 Open"), (2, "2) Close"), (3, "3. Last")]
    assert steps[0]["text"] == "Open the lid of the box slowly." and steps[1]["text"].startswith(
        "Short. End."
    ) and steps[2]["text"] == "3. Last"
    assert [s["name"] for s in got["b.com", "how"][1]["HowTo"]["step"]] == ["Breathe", "Sing"]


def test_site_types(spark):
    rows = [
        ("shop.com", 1, "https://shop.com/", "<p>Buy now</p>"), ("shop.com", 2, "https://shop.com/2", "<p>the price at checkout</p>"),
        ("local.com", 1, "https://local.com/", '<a href="tel:+1 5">c</a>'),
        *[("news.com", k, f"https://news.com/news/{k}", "") for k in range(3)],
        ("soft.com", 1, "https://soft.com/free-trial", "<p>dashboard login</p>"), ("org.com", 1, "https://org.com/", None),
    ]
    records = pages(spark, rows)
    identities = extract.site_identity(records)
    assert dict(map(tuple, json_ld.site_types(records, identities).select("site", "site_type").collect())) == {
        "shop.com": "e-commerce", "local.com": "local-business", "news.com": "publisher", "soft.com": "saas", "org.com": "organization",
    }
    made = {(r["site"], r["name"]): json.loads(r["json"]) for r in json_ld.schema_templates(records, identities).collect()}
    assert {n for s, n in made if s == "local.com"} == {"Organization", "WebSite + SearchAction", "LocalBusiness"} and {n for s, n in made if s == "news.com"} == {"Organization", "WebSite + SearchAction", "Article + Author"}
    local = made["local.com", "LocalBusiness"]
    assert local["telephone"] == "+1 5" and local["openingHoursSpecification"][0]["dayOfWeek"][4] == "Friday" and local["sameAs"] == [] and local["email"] == "{{EMAIL}}"
    assert made["soft.com", "SoftwareApplication"]["author"]["url"] == "https://soft.com" and "telephone" not in made[
        "soft.com", "Organization"
    ]
    assert made["shop.com", "WebSite + SearchAction"]["potentialAction"]["query-input"] == "required name=search_term_string"


def test_question_matches(spark):
    """Against every passage with every question."""
    rng = random.Random(5)
    words = ["alpha", "Alphabet", "beta", "gamma", "delta", "at", "of", "ÉTÉ", "what", "zeta's"]
    texts = [(i, k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(30) for k in range(rng.randint(0, 6))]
    heads = [
        (i, q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + rng.choice(["?", "? ", "", "'?"]))
        for i in range(40)
        for q in range(3)
    ] + [(1, 9, None), (2, 9, ""), (3, 9, "?")]
    expected = set()
    for i, k, passage in texts:
        for j, q, head in heads:
            if i == j and (head or "").strip().endswith("?"):
                terms = [w for w in re.sub("[?'\"]", "", head).split() if len(w) > 3]
                n = sum(t.lower() in passage.lower() for t in terms)
                if terms and n / len(terms) >= 0.5:
                    expected.add((i, k, q, n, len(terms)))
    found = spark.createDataFrame(texts, "doc long, place int, passage string").repartition(3)
    got = citability.question_matches(found, spark.createDataFrame(heads, "doc long, question int, heading string"), "doc")
    assert {tuple(r) for r in got.collect()} == expected and len(expected) > 20
    assert citability.question_matches(found, spark.createDataFrame([], "doc long, question int, heading string"), "doc").count() == 0


def test_questions_within_rows(spark):
    """Texts that bring their questions: the same pairs as with headings joined, each text's only, and nothing is shuffled."""
    heads = "array<struct<question:int,heading:string>>"
    texts_ = [
        (1, "The beta test ran\nnothing of it here", [(0, "Beta tests?"), (1, "zeta gamma")]), (2, "what beta gamma", [(4, "Zeta delta?")]),
        (3, "what beta", None), (4, None, [(0, "What beta?")]), (5, "It's Zeta's SPATE", [(7, "zetas 'pate' pate of at?"), (8, "?")]),
    ]
    docs = spark.createDataFrame(texts_, f"doc long, text string, told {heads}").select("doc", "text", citability.questions(F.col("told")).alias("asked"))
    found = texts.passages(docs, "doc", "asked", separator="\n", least=1)
    got = citability.question_matches(found, None, "doc")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 1, 2), (5, 0, 7, 2, 3)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    counts = {r["doc"]: (r["passages"], r["answering"]) for r in citability.answering(found, "doc").collect()}
    assert counts == {1: (2, 1), 2: (1, 0), 3: (1, 0), 5: (1, 1)}


def test_patterns_tried_by_words(spark):
    """Tried only where one of its words is, a pattern is found as often as tried everywhere; so are figures with boundaries."""
    rng = random.Random(8)
    forms = (*catalog.DEFINITIVE, *catalog.UNIQUE, *catalog.FIGURES, catalog.COMPARED)
    spelled = [w for x in forms for w in re.split(r"[^a-zA-Z$€%'\\-]+", re.sub(r"\\[bsd]|\(\?:", " ", x)) if w] + [
        "studies", "study", "means", "refers", "case", "We", "1,234", "2024", "5x", "3.5%", "$9.99", "é", "Anna", "İ", "K", "_is", "x",
        "€5", "grew by 5", "Client results", "we found", "our data", "I've been", "is a", "according to", "12,345",
    ]
    texts_ = [("".join(w + rng.choice([" ", " ", " ", "\t", "\u00a0", ".", "\n", ""]) for w in rng.choices(spelled, k=rng.randint(1, 90))),) for _ in range(4000)]
    rows = citability._lowered(spark.createDataFrame(texts_, "passage string"))
    p, low = F.col("passage"), F.col("low")
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    checks = [
        (citability._hits(p, patterns), citability._hits_where(low, p, patterns, held))
        for these, held in ((catalog.DEFINITIVE, catalog.DEFINITIVE_HOLD), (catalog.UNIQUE, catalog.UNIQUE_HOLD))
        for patterns in [tuple("(?i)" + text.bounded(x) for x in these)]
    ] + [(p.rlike("(?i)" + x.replace(r"\b", edge)).cast("int"), p.rlike(citability._edged(x)).cast("int")) for x in (*catalog.FIGURES, catalog.COMPARED)]
    sums = rows.agg(*(F.count_if(a != b) for a, b in checks), *(F.sum(a) for a, _ in checks)).first()
    assert all(n == 0 for n in sums[: len(checks)]) and all(n > 20 for n in sums[len(checks) :])


def test_lead_of_other_blanks(spark):
    """The first words are read with single blanks between them, the passage as it is."""
    rows = [("According\tto them",), ("According  to them",), ("According to them",), ("Them",), ("word " * 60 + "according to them",)]
    got = citability.dimensions(spark.createDataFrame(rows, "passage string").withColumn("words", F.size(F.split("passage", " +"))))
    assert [r["answer"] for r in got.collect()] == [10, 10, 25, 0, 15] and "low" not in got.columns


def test_check_as_of(spark):
    """Against every scan with every check; one domain has most of the rows, over many days, with ties."""
    rng = random.Random(6)
    rows = [
        (
            k, 1 if k % 5 else rng.randint(2, 9), rng.choice(["scan", "check"]), rng.choice(["completed", "completed", "failed"]),
            float(k % 13), f"2024-01-{rng.randint(1, 28):02d} 0{rng.randint(0, 3)}:00:00",
        )
        for k in range(600)
    ]
    jobs = spark.createDataFrame(
        [*rows, (900, 1, "scan", "completed", 1.0, None)], "job_id long, domain long, type string, status string, score double, t string",
    ).withColumn("at", F.to_timestamp("t"))
    expected = set()
    done = [r for r in rows if r[3] == "completed"]
    for j, d, kind, _, _, at in done:
        if kind == "scan":
            best = max(((t, i, s) for i, e, k, _, s, t in done if k == "check" and e == d and t <= at), default=(None, None, None))
            expected.add((d, j, best[1], best[2]))
    for days in (1, 7, 1000):
        assert {(r["domain"], r["job_id"], r["check_id"], r["visibility"]) for r in playbooks.check_as_of(jobs, days).collect()} == expected


def test_half_a_policy_is_missing_a_file(spark):
    items = spark.createDataFrame(
        [("a", "AI Policy (ai.txt / ai.json)", "partial", 50), ("a", "robots.txt", "partial", 30), ("a", "llms.txt", "fail", 0)],
        "site string, name string, status string, score int",
    )
    files = spark.createDataFrame([("a", "ai.json"), ("a", "robots.txt")], "site string, name string")
    got = {(r["place"], r["component"]): (r["kind"], r["files"]) for r in playbooks.gaps(items, files).collect()}
    assert got[4, "AI Policy (ai.txt / ai.json)"] == ("missing", ["ai.txt"]) and got[2, "llms.txt"] == ("missing", ["llms.txt"]) and got[0, "robots.txt"] == ("incomplete", []) and got[100, "robots.txt"] == ("incomplete", [])
    assert got[6, "tdmrep.json"] == ("missing", [".well-known/tdmrep.json"]) and (101, "AI Content Directives") not in got
    assert {r["component"]: r["kind"] for r in playbooks.gaps(items).collect()}["AI Policy (ai.txt / ai.json)"] == "incomplete"


def test_robots_keep_the_order_of_rules(spark):
    old = "User-agent: *\nDisallow: /z\nDisallow: /a\nDisallow: /z\nUser-agent: Googlebot\nDisallow: /g\nUser-agent: GPTBot\nDisallow: /"
    files = spark.createDataFrame([("a.com", "robots.txt", old), ("b.com", "x", "")], "site string, name string, content string")
    made = lambda training: {
        r["site"]: r["content"]
        for r in sites.robots_txt(
            files.select("site").distinct(), robots.kept_disallows(robots.robots_rules(files)), "2024-06-01", training,
        ).collect()
    }
    text = made(True)["a.com"]
    assert "User-agent: *\nAllow: /\nDisallow: /z\nDisallow: /a\n" in text and "User-agent: Googlebot\nAllow: /\nDisallow: /z\nDisallow: /a\nDisallow: /g\n" not in text and text.count("# NOTE") == 1
    assert "Disallow" not in made(True)["b.com"] and "User-agent: GPTBot\nDisallow: /\nCrawl-delay: 10" in made(False)["a.com"]


def test_parsed(spark):
    texts = ['{"a": 1}', " [1, 2] ", "[1] x", "1, 2", "", None, "{broken", '"s"', "null"]
    got = [
        r["v"]
        for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select(
            "k", parsed(F.col("t")).isNotNull().alias("v"),
        ).sort("k").collect()
    ]
    assert got[:8] == [True, True, False, False, False, False, False, True]


def test_payloads(spark):
    rows = [
        (1, "failed", 2.0, '{"pagesScanned": 1e2, "geoServiceScore": "7", "crawlErrors": 0}'), (2, "failed", 2.0, "[]"),
        (3, "completed", None, None), (4, "completed", 1.0, '{"pagesScanned": 12345678901234567890}'),
    ]
    jobs = spark.createDataFrame(rows, "job_id long, status string, score double, result_json string")
    assert sorted(map(tuple, payloads.measures(jobs).collect())) == [
        (1, 100.0, 2.0, 0.0), (2, 0.0, 2.0, 1.0), (3, 0.0, None, 0.0), (4, 12345678901234567890.0, 1.0, 0.0),
    ]
    assert payloads.rejects(jobs).count() == 0 and payloads.recommendations(jobs).count() == 0


def test_no_fetch_is_lost(spark):
    rows = [
        ("a", "u1", 200, "text/html", "x", None, None), ("a", "u2", 200, None, "  <!DOCTYPE html><p>", None, 1),
        ("a", "u3", 200, "image/png", "bin", None, None), ("b", "u4", None, None, None, "timeout", 2),
        ("b", "u5", 500, "text/html", None, None, None), ("c", "u6", 200, None, "plain", None, None),
    ]
    fetches = spark.createDataFrame(rows, "site string, url string, status int, kind string, html string, error string, retries int")
    good, failed, others = crawl.outcomes(fetches)
    assert sorted(r["url"] for r in good.collect()) == ["u1", "u2"] and sorted(
        (r["url"], r["error"], r["retries"]) for r in failed.collect()
    ) == [("u4", "timeout", 2), ("u5", "no body", 0)]
    assert good.count() + failed.count() + others.count() == fetches.count()
    targets = spark.createDataFrame([("a", "u1"), ("b", "home"), ("c", "home"), ("d", "home")], "site string, url string")
    again = spark.createDataFrame(
        [
            (s, u, 200, "text/html", h, None, None)
            for s, u, h in (("a", "u1", "no"), ("b", "home", "<p>b"), ("b", "other", "no"), ("c", "home", None))
        ],
        fetches.schema,
    )
    assert sorted((r["site"], r["url"], r["fallback"]) for r in crawl.with_fallback(good, targets, again).collect()) == [
        ("a", "u1", False), ("a", "u2", False), ("b", "home", True),
    ]
    edges = spark.createDataFrame(
        [("a", 0, "p"), ("a", 2, "p"), ("a", 1, "x.PDF"), ("a", 1, "u1"), ("b", 3, "p")], "site string, depth int, target string",
    )
    assert sorted(map(tuple, crawl.to_follow(edges, good).collect())) == [("a", "p", 1), ("b", "p", 4)]


def test_small_url_functions(spark):
    rows = spark.createDataFrame([("/a/b.html",), ("/",), ("",), ("//x//y/",), ("/v1.2/z",)], "p string")
    assert [r[0] for r in rows.select(urls.slug_of(F.col("p"))).collect()] == ["a-b", "index", "index", "x--y", "v1"]
    rows = spark.createDataFrame([("http://a",), ("https://a",), ("a.b",)], "u string")
    assert [r[0] for r in rows.select(urls.with_https(F.col("u"))).collect()] == ["https://a", "https://a", "https://a.b"]


def test_templates_are_whole():
    assert [len(t) for t in catalog.QUERY_TEMPLATES.values()] == [20, 20]


def test_query_lines(spark, tmp_path):
    from gleaner.sources.tables import query_lines, spread

    (tmp_path / "q.txt").write_text("# a comment\n  best tools \n\n   \n#x\nwhy # not\n")
    assert [r["query"] for r in query_lines(spark, str(tmp_path / "q.txt")).collect()] == ["best tools", "why # not"]
    few = spark.range(10).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(
        spark.range(0, 10, 1, 40)
    ).rdd.getNumPartitions() == 40


def test_identity_is_filled_from_pages_about_the_site(spark):
    rows = [
        ("a.com", 1, "https://a.com/x", "<p>no address"),
        ("a.com", 5, "https://a.com/about", "<p>write to first@a.com or second@a.com, 12 Main St, Springfield, IL 62701"),
        ("a.com", 7, "https://a.com/contact", "<p>later@a.com"), ("b.com", 3, "https://b.com/team", "<p>team@b.com"),
        ("b.com", 9, "https://b.com/", '<title>T | B</title><a href="mailto:home@b.com">m</a>'),
        ("c.com", 1, "https://c.com/other", "<body><p>x@c.com elsewhere"), ("c.com", 2, "https://c.com/other2", "<p>x"),
    ]
    got = {r["site"]: r["identity"] for r in extract.site_identity(pages(spark, rows)).collect()}
    assert (got["a.com"]["email"], got["a.com"]["address"]) == ("first@a.com", "12 Main St, Springfield, IL 62701")
    assert (got["b.com"]["email"], got["b.com"]["name"]) == ("home@b.com", "B") and got["c.com"]["email"] == "x@c.com"


def test_medians_and_compression(spark):
    from gleaner.operators import audit

    rng = random.Random(8)
    rows = [
        (f"s{k % 4}", rng.choice([None, rng.randint(-3, 3), rng.randint(0, 10**6)]), rng.randint(0, 2)) for k in range(201)
    ] + [("alone", None, 7)]
    expected = {}
    for s in {r[0] for r in rows}:
        mids = []
        for k in (1, 2):
            values = sorted(r[k] for r in rows if r[0] == s and r[k] is not None)
            mids.append(values[len(values) // 2] if values else None)
        expected[s] = tuple(mids)
    got = audit.medians(spark.createDataFrame(rows, "site string, a long, b int"), "a", "b")
    assert {r["site"]: (r["mid_a"], r["mid_b"]) for r in got.collect()} == expected
    told = [("a", {"content-encoding": "br"}), ("a", {"x": "y"}), ("b", {}), ("b", None)]
    pages_ = spark.createDataFrame(told, "site string, headers map<string,string>")
    probed = spark.createDataFrame([("a", "gzip")], "site string, encoding string")
    assert sorted(
        (r["site"], (r["headers"] or {}).get("content-encoding") or "") for r in sites.compressed(pages_, probed).collect()
    ) == [("a", "br"), ("a", "gzip"), ("b", ""), ("b", "")]


def test_sitemaps_are_split(spark):
    entries = spark.createDataFrame(
        [("a", k, f"u{k}", "daily", "0.5") for k in range(7)] + [("b", 1, "u", "daily", "1.0")],
        "site string, page_id long, loc string, changefreq string, priority string",
    )
    made = {(r["site"], r["file"]): r["content"].count("<loc>") for r in sites.sitemap_xml(entries, 3).collect()}
    assert made == {("a", 0): 3, ("a", 1): 3, ("a", 2): 1, ("b", 0): 1}


def test_engines_are_few(spark):
    from gleaner.operators import service

    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    engines = spark.createDataFrame([("a",), ("b",), ("a",)], "engine string")
    assert sorted(map(tuple, service.asked_everywhere(queries, engines).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert service.asked_everywhere(queries, engines.where("false")).count() == 0
    with pytest.raises(ValueError):
        service.asked_everywhere(queries, engines, 1)


def test_given_pages_cut_off_within_a_reference(spark, tmp_path):
    """Only references that a semicolon ends are read, and addresses in running text are nobody's."""
    import duckdb

    from gleaner.plans import made

    words = "Plain words that go on for long enough to be the article of a page and then some more of them "
    page = lambda t, more: f'<!doctype html><html lang="en"><head><title>{t}</title></head><body><nav><ul><li><a href="/a?b=1&lt=2">M</a></li></ul></nav><article><h1>{t}</h1><p>{words}{more}</article></body></html>'
    rows = [
        (1, "https://a.example/about", page("Salt &amp", "Write to us@a.example for &lt more")),
        (2, "https://b.example/", page("A &amp; B &copy; C &am", "us@b.example &amp;amp; &middot; &quot")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("given_records", "given_bodies", "page_markdown", "llms_full_txt", "given_site_json_ld"):
        ours = made.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(made.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        theirs = sorted(tuple(dict(zip(names, r))[c] for c in ours.columns) for r in cursor.fetchall())
        assert sorted(tuple(r) for r in ours.collect()) == theirs, name
