"""Values at the edges: rounding, thresholds, words, addresses."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from gleaner import catalog
from gleaner.functions import addresses, dom, scores, text, urls
from gleaner.operators import composite, extract, files, history, robots, texts, visibility


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,rounded", [(2.5, 3), (-2.5, -2), (0.4, 0), (-0.6, -1)])
def test_half_up(spark, x, rounded):
    assert one(spark, scores.half_up(F.col("v")), v=x) == rounded


@pytest.mark.parametrize("score,grade", [(90, "A+"), (89, "A"), (80, "A"), (70, "B"), (60, "C"), (50, "D"), (49, "F")])
def test_grade(spark, score, grade):
    assert one(spark, scores.grade(F.col("v")), v=score) == grade


@pytest.mark.parametrize("t,words,split", [("", 0, 1), ("a", 1, 1), ("a b", 2, 2), (" é 😀 ", 2, 4), ("x　y\n", 2, 3)])
def test_words(spark, t, words, split):
    assert one(spark, text.word_count(F.col("t")), t=t) == words
    assert one(spark, text.tokens_split(F.col("t")), t=t) == split


@pytest.mark.parametrize("w,n", [("be", 1), ("make", 1), ("banana", 3), ("the", 1), ("rhythm", 1), ("idea", 2), ("123", 1)])
def test_syllables(spark, w, n):
    assert one(spark, text.syllables(F.col("w")), w=w) == n


@pytest.mark.parametrize(
    "url,domain,path,section",
    [
        ("https://www.X.example/Blog/a?b#c", "x.example", "/Blog/a", "Blog"), ("http://x.example", "x.example", "/", "Main"),
        ("oddity", "oddity", "/", "Main"), ("https://x.example/index.html", "x.example", "/index.html", "Main"),
        ("https://x.example/zz", "x.example", "/zz", "Pages"),
    ],
)
def test_urls(spark, url, domain, path, section):
    assert one(spark, urls.domain_of(F.col("u")), u=url) == domain
    assert one(spark, urls.path_of(F.col("u")), u=url) == path
    assert one(spark, urls.section_of(F.col("u")), u=url) == section


def test_accepted_files(spark):
    rows = [
        ("sitemap.xml", "<urlset/>", True), ("sitemap.xml", "x", False), ("ai.json", "{}", True), ("ai.json", "{", False),
        ("robots.txt", "<!DOCTYPE html>", False), ("robots.txt", "User-agent: *", True),
    ]
    got = spark.createDataFrame(rows, "name string, content string, ok boolean").select(
        "ok", files.accepted(F.col("name"), F.col("content")).isNotNull().alias("got"),
    ).collect()
    assert all(r["ok"] == r["got"] for r in got)


def test_bots_without_robots(spark):
    row = robots.bot_blocking(spark.createDataFrame([("a", "llms.txt", "x")], "site string, name string, content string")).first()
    assert (row["blocked"], row["score"], row["status"], row["strategy_status"]) == (0, 100, "pass", "not_applicable")


def test_personal_patterns_where_their_words_are(spark):
    """Tried only where its words are, a pattern of a personal text is found as everywhere; texts without them aren't searched by patterns."""
    said = ["I 'm", "I am", "i'm", "we are", "we 're", "My", "army", "our", "hour", "I think", "I've", "we've", "I found", "In my experience", "x"]
    docs = spark.createDataFrame([(f"Of {x}{end}",) for x in said for end in ("", " it", "s")], "text string")
    everywhere = reduce(lambda a, b: a | b, (F.lower("text").rlike(text.bounded(p)) for p in catalog.PERSONAL))
    found = texts.machine_style(docs, "text")
    rows = found.select("personal", everywhere.alias("expected")).collect()
    assert all(r["personal"] == r["expected"] for r in rows) and {r["expected"] for r in rows} == {True, False}
    assert ", my)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_bots_with_empty_robots(spark):
    rows = robots.bot_blocking(spark.createDataFrame([("a", "robots.txt", ""), ("a", "ai.txt", "x")], "site string, name string, content string"))
    row = rows.first()
    assert (row["blocked"], row["score"], row["status"], row["strategy"], row["strategy_status"]) == (0, 100, "pass", 0, "fail")


def test_robots_rules_of_one_group(spark):
    files_ = spark.createDataFrame(
        [("a", "robots.txt", "User-agent: GPTBot\nDisallow: /admin\nDisallow: /\nUser-agent: x\nDisallow:")],
        "site string, name string, content string",
    )
    assert sorted((r["agent"], r["path"]) for r in robots.robots_rules(files_).collect()) == [("gptbot", "/"), ("gptbot", "/admin")]


@pytest.mark.parametrize(
    "href,page,target",
    [
        ("page.html", "https://x.example/a/b", "https://x.example/a/page.html"),
        ("//y.example/z/", "http://x.example/", "http://y.example/z"), ("../c/./d/", "https://x.example/a/b/e", "https://x.example/a/c/d"),
        ("/é b?q=ä#f", "https://x.example/a", "https://x.example/%C3%A9%20b?q=%C3%A4"),
        ("https://X.example", "https://y.example/a", "https://x.example/"), ("?q=1", "https://x.example/a", "https://x.example/a?q=1"),
        ("../../..", "https://x.example/a/b", "https://x.example/"), ("", "https://x.example/a#b", "https://x.example/a"),
    ],
)
def test_resolved(spark, href, page, target):
    rows = spark.createDataFrame([(href, page)], "h string, p string")
    assert urls.resolved(rows, F.col("h"), F.col("p"), "to").first()["to"] == target
    assert addresses.normalize(href, page) == target


def test_diff_buckets(spark):
    schema = "site string, name string, score int, status string"
    before = spark.createDataFrame(
        [
            ("s", "gone", 5, "fail"), ("s", "fixed", 10, "fail"), ("s", "broken", 100, "pass"), ("s", "up", 10, "fail"),
            ("s", "down", 30, "fail"), ("s", "same", 1, "fail"),
        ],
        schema,
    )
    after = spark.createDataFrame(
        [
            ("s", "new", 5, "fail"), ("s", "newpass", 100, "pass"), ("s", "fixed", 90, "pass"), ("s", "broken", 10, "fail"),
            ("s", "up", 20, "fail"), ("s", "down", 20, "fail"), ("s", "same", 1, "fail"),
        ],
        schema,
    )
    got = {r["name"]: r["bucket"] for r in composite.diff(before, after).collect()}
    assert got == {
        "gone": "unchanged", "fixed": "resolved", "broken": "new_issue", "up": "improved", "down": "regressed", "same": "unchanged",
        "new": "new_issue", "newpass": "unchanged",
    }


def test_projected_raises_and_keeps(spark):
    rows = [
        ("s", 0, "robots.txt", "ai_infrastructure", 0, 100, "fail"),
        ("s", 1, "Structured Data (JSON-LD)", "content_quality", 90, 100, "pass"),
        ("s", 2, "Title Tags", "foundational_seo", 10, 100, "fail"),
    ]
    items = spark.createDataFrame(rows, "site string, seq int, name string, category string, score int, max_score int, status string")
    assert {r["name"]: (r["score"], r["status"]) for r in composite.projected(items).collect()} == {
        "robots.txt": (100, "pass"), "Structured Data (JSON-LD)": (90, "pass"), "Title Tags": (10, "fail"),
    }


def test_engine_of_failures_alone_scores_zero(spark):
    rows = spark.createDataFrame(
        [("e", "x", ["https://a.example"], "boom")], "engine string, response string, citations array<string>, error string",
    )
    got = visibility.engine_scores(visibility.citations(rows, "a.example", "a")).first()
    assert (got["run"], got["score"]) == (0, 0)


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(2, "z", 1), (3, "w", 2)], "k int, v string, t int")
    assert sorted(map(tuple, history.upsert(a, b, "k", "t").select("k", "v", "t").collect())) == [(1, "x", 1), (2, "z", 1), (3, "w", 2)]


def test_tree_closes_what_browsers_close():
    root = dom.parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<p>e<div>f</div><table><tr><td>1<td>2<tr><td>3</table></b><br>g")
    assert [n.text() for n in root.all("li")] == ["a", "bc", "c"] and [n.text() for n in root.all("p")] == ["d", "e"]
    assert [[c.text() for c in r.all("td")] for r in root.all("tr")] == [["1", "2"], ["3"]] and root.text().endswith("g")


@pytest.mark.parametrize(
    "html",
    [
        "", None, "no markup", "<", "<!doctype html>", "<p" * 50, "</div>" * 3,
        "<script type='application/ld+json'>[1, null, \"x\"]</script>",
    ],
)
def test_records_of_odd_pages(html):
    found = extract.record(html, "https://x.example/")
    assert set(found) == set(extract.FIELDS) and found["headings"] == [] and found["json_ld"] == []


def test_main_within_main_counts_twice():
    body = extract.record(f"<main><article>{'word ' * 20}</article></main>", "https://x.example/")["body"]
    assert body.count("word") == 40


def test_classes_of_letters_have_no_ranges(spark):
    """Java asks ranges one after the other: whole texts took up to 19 times as long."""
    from gleaner.llm import divergence
    from gleaner.plans import rich

    assert "-Z" not in text.bounded("x") and "\\x00-" not in divergence.TERM
    plan = rich.rich_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Za-z0-9.,!?]" not in plan
    counted = spark.range(1).select(text.syllable_count(F.lit("a").substr(F.col("id"), F.lit(1))))
    assert "(?<=" not in counted._jdf.queryExecution().analyzed().toString()


def test_counts_of_texts_with_odd_blanks_and_letters(spark):
    odd = [
        "", " ", "The tree be ee the. Free-lance co-op don't e'er naïve", " one two﻿three.　 Four!?  ", "été à l'école. Über Straße",
        "été eye queue. ie eie bee's", "x" * 5 + "\x1c1 a1e2b3e \x85 \x0b y.y", "KELVIN Kelvin İe", "“Quoted” — e—e re-e be-e.",
    ]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    found = rows.select(
        "t", text.word_count(F.col("t")).alias("w"), text.syllable_count(F.col("t")).alias("s"), text.tokens_split(F.col("t")).alias("k"),
        F.aggregate(F.transform(text.words(F.col("t")), text.syllables), F.lit(0), lambda a, x: a + x).alias("of_words"),
        F.size(text.words(F.col("t"))).alias("words"), F.size(F.split("t", f"{text.SPACE}+")).alias("split"),
        text.sentence_count(F.col("t")).alias("n"), F.size(text.sentences(F.col("t"))).alias("sentences"),
    ).collect()
    for r in found:
        assert (r.w, r.s, r.k, r.n) == (r.words, r.of_words, r.split, r.sentences), r
