"""Composite scores over audit items ``(site, seq, name, category, score, max_score, status)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores


def weight_of(column: str, weights: dict[str, float]) -> Column:
    """A fixed weight table as one expression: no join, and twice the weight as an integer so that sums are exact."""
    pairs = [F.lit(x) for k, w in weights.items() for x in (k, int(2 * w))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0))


def _weighted(items: DataFrame, weight: Column, name: str) -> DataFrame:
    rows = items.where("status <> 'not_applicable'").withColumn("w", weight)
    total = rows.groupBy("site").agg(F.sum(F.col("score") * F.col("w")).alias("s"), F.sum(F.col("max_score") * F.col("w")).alias("m"))
    score = F.when(F.col("m") > 0, scores.half_up(F.col("s") / F.col("m") * 100)).otherwise(0)
    return total.select("site", score.alias(name))


def overall(items: DataFrame) -> DataFrame:
    rows = _weighted(items, weight_of("category", catalog.CATEGORY_WEIGHTS), "overall")
    return rows.withColumn("grade", scores.grade(F.col("overall")))


def search_health(items: DataFrame) -> DataFrame:
    return _weighted(items, weight_of("name", catalog.SEARCH_HEALTH), "search_health")


def service_score(items: DataFrame) -> DataFrame:
    return _weighted(items, weight_of("name", catalog.SERVICE_SCORE), "service_score")


def category_summary(items: DataFrame) -> DataFrame:
    """Passed (partly counts) and total of each category, and its unweighted score."""
    return items.where("status <> 'not_applicable'").groupBy("site", "category").agg(
        F.count_if(F.col("status").isin("pass", "partial")).alias("passed"), F.count("*").alias("total"),
        scores.half_up(F.sum("score") / F.sum("max_score") * 100).alias("score"),
    )


def issue_counts(items: DataFrame) -> DataFrame:
    """Errors, warnings and notices of each site, of items that apply and don't pass."""
    rows = items.where("status NOT IN ('pass', 'not_applicable') AND severity IN ('error', 'warning', 'notice')")
    return rows.groupBy("site", "severity").agg(F.count("*").alias("issues"))


def _looked_up(table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.col("name")], F.lit(default))


def priorities(items: DataFrame, most: int = 5) -> DataFrame:
    """What would raise the overall score most: items that need work and aren't made automatically, with effort and time.

    A site has 68 items at most, so its best ones are found by gathering those, not by a window."""
    weighed = F.col("max_score") * weight_of("category", catalog.CATEGORY_WEIGHTS)
    open_ = ~F.col("status").isin("pass", "not_applicable") & (F.col("score") < 100) & ~F.col("name").isin(*catalog.PROJECTED)
    effort = F.when((F.col("name") == "Meta Descriptions") & (F.col("score") < 50), "hard").otherwise(_looked_up(catalog.EFFORT, "medium"))
    action = F.struct(
        "seq", "name", "score", ((F.col("max_score") - F.col("score")) * weight_of("category", catalog.CATEGORY_WEIGHTS)).alias("gain"),
        effort.alias("effort"), _looked_up(catalog.SEARCH_IMPACT, "low").alias("search_impact"),
        _looked_up(catalog.TIME_TO_IMPACT, "2-6 months").alias("time_to_impact"),
    )
    sums = items.groupBy("site").agg(
        F.sum(F.when(F.col("status") != "not_applicable", weighed)).alias("whole"), F.collect_list(F.when(open_, action)).alias("actions"),
    )
    impact = lambda a: F.when(F.col("whole") > 0, F.floor(a["gain"] / F.col("whole") * 1000 + F.lit(0.5)) / 10).otherwise(0.0)
    ranked = F.slice(
        F.array_sort(
            F.transform(
                "actions", lambda a: F.struct((-impact(a)).alias("order"), a["seq"].alias("seq"), impact(a).alias("impact"), a.alias("a")),
            )
        ),
        1, most,
    )
    rows = sums.select("site", F.posexplode(ranked).alias("place", "r"))
    return rows.select(
        "site", (F.col("place") + 1).alias("place"), "r.a.name", "r.impact", "r.a.effort", "r.a.search_impact", "r.a.time_to_impact",
    )


def projected(items: DataFrame) -> DataFrame:
    """Items as they'd stand with everything made that can be made."""
    pairs = [F.lit(x) for k, v in catalog.PROJECTED.items() for x in (k, v)]
    better = F.create_map(*pairs)[F.col("name")]
    score = F.greatest("score", F.coalesce(better, "score"))
    status = F.when(
        better.isNotNull() & (F.col("score") < better), F.when(better >= 70, "pass").otherwise("partial"),
    ).otherwise(F.col("status"))
    return items.withColumn("status", status).withColumn("score", score)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items of two audits side by side: new_issue, resolved, improved, regressed or unchanged."""
    a = before.select("site", "name", F.col("score").alias("before"), F.col("status").alias("was"))
    b = after.select("site", "name", F.col("score").alias("after"), F.col("status").alias("now"))
    rows = a.join(b, ["site", "name"], "full")
    delta = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    was, now = F.col("was"), F.col("now")
    bucket = (
        F.when(was.isNull(), F.when(now != "pass", "new_issue").otherwise("unchanged")).when(now.isNull(), "unchanged")
        .when((was != "pass") & (now == "pass"), "resolved").when((was == "pass") & (now != "pass"), "new_issue")
        .when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")
    )
    return rows.select(
        "site", "name", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"),
        F.coalesce("was", F.lit("n/a")).alias("was"), F.coalesce("now", F.lit("n/a")).alias("now"), bucket.alias("bucket"),
    )
