"""Checks over captured page records, whose fields an extractor or crawler has filled: one aggregation by site for all of them.

Columns: ``site, page_id, status, description, og_title, og_description, tw_card, tw_title, tw_description, viewport, response_ms,
hops, depth, images, images_alt, levels (heading levels in order), words, encoding, author, author_bio``. Null and empty both mean
that something is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores


def _there(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def ordered(levels: Column) -> Column:
    """One first-level heading, and no level left out on the way down."""
    one = F.size(F.filter(levels, lambda x: x == 1)) == 1
    following = F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), following, lambda a, b: b > a + 1)
    return one & ~F.exists(steps, lambda x: x)


def record_checks(pages: DataFrame) -> DataFrame:
    """``site, seq, name, category, score, max_score, status, severity``; checks that don't apply are not_applicable and score 0."""
    n, headed, content = F.count("*"), F.size("levels") > 0, F.col("words") > 200
    description = F.trim(F.coalesce("description", F.lit("")))
    told = F.length(description) >= 20
    sums = pages.groupBy("site").agg(
        n.alias("n"), F.count_if(F.col("words") < 300).alias("thin"), F.count_if(F.col("words") > 500).alias("deep"),
        F.count_if((F.col("words") > 500) & (F.size("levels") >= 3)).alias("built"), F.count_if(headed).alias("headed"),
        F.count_if(headed & ordered(F.col("levels"))).alias("ordered"),
        F.count_if(F.length(F.coalesce("description", F.lit(""))) >= 30).alias("described"),
        F.count_if(F.coalesce("encoding", F.lit("")).rlike("gzip|br|deflate")).alias("packed"),
        F.count_if(_there("og_title") & _there("og_description")).alias("og"),
        F.sum(_there("tw_card").cast("int") + _there("tw_title").cast("int") + _there("tw_description").cast("int")).alias("tw"),
        F.count_if(content).alias("content"), F.count_if(content & _there("author")).alias("authored"),
        F.count_if(content & _there("author_bio")).alias("bios"), F.sum("images").alias("images"), F.sum("images_alt").alias("alts"),
        F.count_if(_there("viewport")).alias("fitted"), F.count_if((F.col("status") < 200) | (F.col("status") >= 400)).alias("broken"),
        F.count_if(F.col("response_ms") > 3000).alias("slow"), F.count_if(F.col("hops") > 1).alias("chains"),
        F.count_if(F.col("depth") > 3).alias("buried"),
    )
    repeats = pages.where(told).groupBy("site", description.alias("d")).agg(F.count("*").alias("k")).groupBy("site").agg(
        F.sum("k").alias("told"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("repeated"),
    )
    s = sums.join(repeats, "site", "left").fillna(0, ["told", "repeated"])
    c = F.col
    share = lambda x, of="n": F.when(c(of) > 0, c(x) / c(of)).otherwise(0.0)
    percent = lambda x: scores.half_up(x * 100)
    depth = F.least(F.lit(100), scores.half_up((1 - share("thin")) * 30 + share("deep") * 40 + share("built") * 30))
    card, author = percent(c("tw") / (3 * c("n"))), F.least(
        F.lit(100), scores.half_up(share("authored", "content") * 60 + share("bios", "content") * 40),
    )
    alt = F.when(c("images") == 0, 100).otherwise(percent(c("alts") / c("images")))
    less = lambda x: percent(1 - share(x))
    by_score = lambda x, p=60: F.when(x >= p, "pass").when(x > 0, "partial").otherwise("fail")
    items = [
        ("Content Structure & Depth", depth, by_score(depth)),
        (
            "Heading Hierarchy", F.when(c("headed") > 0, percent(share("ordered", "headed"))).otherwise(0),
            F.when(c("headed") == 0, "not_applicable").otherwise(scores.status(share("ordered", "headed"), 0.8, 0.5)),
        ),
        ("Meta Descriptions", percent(share("described")), scores.status(share("described"), 0.8, 0.5)),
        (
            "Duplicate Meta Descriptions", F.when(c("told") > 0, percent(1 - share("repeated", "told"))).otherwise(100),
            scores.few(c("repeated"), 2),
        ),
        ("Compression", percent(share("packed")), scores.partly_if_any(share("packed"), 0.8)),
        ("Open Graph Tags", percent(share("og")), scores.status(share("og"), 0.8, 0.5)), ("Twitter Card Tags", card, by_score(card)),
        (
            "Author & Expertise Signals", F.when(c("content") == 0, 50).otherwise(author),
            F.when(c("content") == 0, "partial").otherwise(by_score(author)),
        ),
        ("Image Alt Text", alt, scores.status(alt, 80, 50)),
        ("Mobile Viewport", percent(share("fitted")), scores.status(share("fitted"), 0.9, 0.5)),
        ("Broken Pages", less("broken"), F.when(c("broken") == 0, "pass").when(share("broken") <= 0.1, "partial").otherwise("fail")),
        ("Page Response Time", less("slow"), scores.few(c("slow"), 3)), ("Redirect Chains", less("chains"), scores.few(c("chains"), 3)),
        ("Crawl Depth", less("buried"), scores.few(c("buried"), 5)),
    ]
    cells = F.array(
        *(
            F.struct(
                F.lit(i).alias("seq"), F.lit(name).alias("name"), F.lit(catalog.CATEGORY[name]).alias("category"),
                score.cast("int").alias("score"), status.alias("status"), F.lit(catalog.SEVERITY[name]).alias("own"),
            )
            for i, (name, score, status) in enumerate(items)
        )
    )
    out = s.select("site", F.inline(cells))
    return out.select(
        "site", "seq", "name", "category", "score", F.lit(100).alias("max_score"), "status",
        F.when(c("status").isin("pass", "not_applicable"), "info").otherwise(c("own")).alias("severity"),
    )
