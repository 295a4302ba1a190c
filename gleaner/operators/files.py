"""Checks of well-known files: a projection over ``(site, name, content)``, a row for each file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores
from ..functions.variants import parsed
from . import robots


def accepted(name: Column, content: Column) -> Column:
    """A captured body as that file's content, or null: by kind it must look like one, and no text file is a web page."""
    low = F.lower(content)
    page = low.contains("<!doctype") | low.contains("<html")
    fits = (
        F.when(name == "sitemap.xml", content.contains("<urlset") | content.contains("<sitemapindex"))
        .when(name == "BingSiteAuth.xml", content.contains("<users") | content.contains("<access-token"))
        .when(name.endswith(".json"), parsed(content).isNotNull())
        .otherwise(~page)
    )
    return F.when(fits, content)


def column_of(name: str) -> str:
    """The column that holds a well-known file's text."""
    return "file_" + name.replace(".", "_").replace("-", "_")


def texts_of_files(files: DataFrame) -> DataFrame:
    """``site`` and a column for each well-known file, empty if it is missing; ``robots_closed``, whom robots.txt lets in."""
    text = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("content"))), F.lit(""))
    wide = files.groupBy("site").agg(*(text(n).alias(column_of(n)) for n in catalog.FILES))
    return wide.withColumn("robots_closed", robots.closed_to(F.col(column_of("robots.txt"))))


def as_items(rows: DataFrame, made: dict[str, tuple[Column, Column | Callable[[Column], Column]]]) -> DataFrame:
    """``site, seq, name, category, score, max_score, status, severity``: a row for each item that is made, numbered in their fixed order.

    Items are scores and statuses; a status may be a function of the score, which is computed once, in a projection of its own."""
    order = [name for checks in catalog.CHECKS.values() for name, _ in checks]
    rows = rows.withColumns({f"_score{seq}": made[name][0].cast("int") for seq, name in enumerate(order) if name in made})
    cells = []
    for seq, name in enumerate(order):
        if name in made:
            score, status = F.col(f"_score{seq}"), made[name][1]
            status = status(score) if callable(status) else status
            # a policy counts as content once there is one
            category = F.when(score > 0, "content_quality").otherwise("ai_infrastructure") if name.startswith("AI Policy") else F.lit(
                catalog.CATEGORY[name]
            )
            cells.append(
                F.struct(
                    F.lit(seq).alias("seq"), F.lit(name).alias("name"), category.alias("category"), score.alias("score"),
                    F.lit(100).alias("max_score"), status.alias("status"), F.lit(catalog.SEVERITY[name]).alias("own"),
                )
            )
    out = rows.select("site", F.inline(F.array(*cells)))
    return out.select(
        "site", "seq", "name", "category", "score", "max_score", "status",
        F.when(F.col("status").isin("pass", "not_applicable"), "info").otherwise(F.col("own")).alias("severity"),
    )


def file_items() -> dict[str, tuple[Column, Column]]:
    """Score and status of every check on files alone, over the columns of :func:`texts_of_files`."""
    f = lambda name: F.col(column_of(name))
    there = lambda name: (f(name) != "").cast("int")
    plain = lambda name: (100 * there(name), F.when(f(name) != "", "pass").otherwise("fail"))
    major = sum(
        (f("robots.txt").contains(b).cast("int") for b in catalog.MAJOR_CRAWLERS[1:]),
        f("robots.txt").contains(catalog.MAJOR_CRAWLERS[0]).cast("int"),
    )
    named = F.when(f("robots.txt") == "", 0).when(major == 0, 30).otherwise(scores.half_up(F.least(F.lit(100.0), 30 + major / 5 * 70)))
    sitemap = F.when(f("sitemap.xml") == "", 0).otherwise(
        50 + 25 * f("sitemap.xml").contains("<loc>").cast("int") + 25 * f("sitemap.xml").contains("<lastmod>").cast("int")
    )
    marks = [f("llms.txt").rlike(p).cast("int") for p in (r"(?m)^# .+", r"(?m)^> .+", r"(?m)^## .+", r"\[[^\]]+\]\([^)]+\)")]
    llms = F.when(f("llms.txt") == "", 0).otherwise(40 + 15 * sum(marks[1:], marks[0]))
    both = there("ai.txt") + there("ai.json")
    true = lambda json, path: (~F.coalesce(F.try_variant_get(json, path, "string"), F.lit("")).isin("", "false", "0", "null")).cast("int")
    card = parsed(f("agent-card.json"))
    fields = sum(
        (p * true(card, f"$.{k}") for k, p in catalog.AGENT_CARD[1:]),
        catalog.AGENT_CARD[0][1] * true(card, f"$.{catalog.AGENT_CARD[0][0]}"),
    )
    agent_card = F.when(f("agent-card.json") == "", 0).when(card.isNull(), 10).otherwise(30 + fields)
    agents = parsed(f("agents.json"))
    inner = F.coalesce(F.try_variant_get(agents, "$[0]", "variant"), F.try_variant_get(agents, "$.agents[0]", "variant"))
    said = sum((true(inner, f"$.{k}") for k in ("endpoint", "url")), true(inner, "$.description"))
    agents_json = F.when(f("agents.json") == "", 0).when(agents.isNull(), 10).otherwise(
        40 + F.when(inner.isNull(), 0).otherwise(30 + 15 * true(inner, "$.name") + F.when(said > 0, 15).otherwise(0))
    )
    return {
        "robots.txt": (named, F.when(f("robots.txt") == "", "fail").when(major >= 3, "pass").otherwise("partial")),
        "sitemap.xml": (sitemap, lambda s: scores.partly_if_any(s, 75)), "llms.txt": (llms, lambda s: scores.partly_if_any(s, 70)),
        "llms-full.txt": plain("llms-full.txt"),
        "AI Policy (ai.txt / ai.json)": (50 * both, F.when(both == 2, "pass").when(both == 1, "partial").otherwise("fail")),
        "AI Bot Blocking": robots.blocking_check(f("robots.txt"), F.col("robots_closed")),
        "Training vs Retrieval Bot Strategy": robots.strategy_check(f("robots.txt"), F.col("robots_closed")),
        "agent-card.json": (agent_card, lambda s: F.when(s >= 70, "pass").when(s > 10, "partial").otherwise("fail")),
        "agents.json": (agents_json, lambda s: scores.status(s, 70, 40)),
        **{n: plain(n) for n in ("security.txt", "tdmrep.json", "manifest.json", "humans.txt")},
    }


def file_checks(files: DataFrame) -> DataFrame:
    """The items of the checks on files alone; a missing file scores 0."""
    return as_items(texts_of_files(files), file_items())
