"""Operators of the service around audits: action lists, gaps, users and sessions, jobs as events, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog

_OPEN = "status NOT IN ('pass', 'not_applicable')"


def client_actions(items: DataFrame) -> DataFrame:
    """What a client has to do, by category and then in the order of the items."""
    rows = items.where(_OPEN).where((F.col("score") < 100) & ~F.col("name").isin(*catalog.PROJECTED))
    order = F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(catalog.CHECKS) for x in (c, k))), F.col("category"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(order, "seq"))
    return rows.select("site", place.alias("place"), "name", "category", "score")


def triage(items: DataFrame) -> DataFrame:
    """Open items as quick, strategic or medium ones."""
    kind = F.when(F.col("name").isin(*catalog.QUICK), "quick").when(F.col("name").isin(*catalog.STRATEGIC), "strategic").otherwise("medium")
    return items.where(_OPEN).where("category <> 'non_scored'").select("site", "name", kind.alias("kind"))


def side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two audits of the same items by their place: who has to act, or that all is well."""
    a, b = (d.select("site", "seq", "name", F.col("score").alias(s)) for d, s in ((before, "before"), (after, "after")))
    rows = a.join(b.drop("name"), ["site", "seq"])
    part = F.when(F.col("before") >= 70, "good").when(F.col("after") > F.col("before"), "engine").otherwise("client")
    return rows.select("site", "seq", "name", "before", "after", part.alias("part"))


def answers_with_queries(responses: DataFrame, queries: DataFrame) -> DataFrame:
    """Every response with the first query of the same text; ``responses(id, query)``, ``queries(seq, query, category)``."""
    first = queries.groupBy("query").agg(F.min_by("category", "seq").alias("category"))
    return responses.join(first, "query", "left")


def asked_everywhere(queries: DataFrame, engines: DataFrame, most: int = 1000) -> DataFrame:
    """Each query to each ``engine``, of which there may be ``most``; more raise."""
    names = [r["engine"] for r in engines.select("engine").distinct().orderBy("engine").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} engines")
    return queries.withColumn("engine", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))


def state_of(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """A table from its change events: of each column the last value that isn't null; keys whose last event is a deletion are gone."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    rows = events.groupBy(key).agg(*(last(c).alias(c) for c in columns), F.max_by("deleted", order).alias("_gone"))
    return rows.where(~F.coalesce("_gone", F.lit(False))).drop("_gone")


def live_sessions(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """Sessions that are neither revoked nor over, with their users, who must be active."""
    live = sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > F.to_timestamp(F.lit(now))))
    return live.join(users.where("active"), "user_id")


def visible_to(jobs: DataFrame, access: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Jobs that a user may see: all for an admin, else their own and those of domains they have access to."""
    if admin:
        return jobs
    granted = access.where(F.col("user_id") == user).select("domain").distinct().withColumn("_granted", F.lit(True))
    return jobs.join(granted, "domain", "left").where((F.col("created_by") == user) | F.col("_granted")).drop("_granted")


def overview(users: DataFrame) -> DataFrame:
    """How many users there are, how many are active, and when the last one signed in."""
    return users.agg(F.count("*").alias("users"), F.count_if("active").alias("active"), F.max("last_login").alias("last_login"))


def reliability(rows: DataFrame) -> DataFrame:
    """``domain, scans, zero_rate, pages, failure_rate, weeks`` -> how far the crawler can be trusted there."""
    from ..functions import scores

    step = lambda c, *steps: F.coalesce(*(F.when(F.col(c) >= a, p) for a, p in steps), F.lit(0))
    below = lambda c, *steps: F.coalesce(*(F.when(F.col(c) <= a, p) for a, p in steps), F.lit(0))
    total = 20 + step("scans", (4, 30), (2, 15)) + below("zero_rate", (0.0, 20), (0.25, 10)) + step("pages", (20, 15), (5, 8)) + below(
        "failure_rate", (0.1, 15), (0.25, 8),
    ) + step("weeks", (8, 10))
    score = F.least(F.lit(100), total)
    return rows.select("domain", score.alias("reliability"), scores.confidence_level(score).alias("level"))


def distinct_recommendations(rows: DataFrame, most: int = 4) -> DataFrame:
    """The first recommendations of each site, whatever their case, trimmed and not empty: ``site, seq, recommendation``."""
    told = rows.withColumn("text", F.trim("recommendation")).where("text <> ''")
    first = told.groupBy("site", F.lower("text").alias("low")).agg(F.min(F.struct("seq", "text")).alias("f"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("f.seq", "low"))
    return first.select("site", place.alias("place"), F.col("f.text").alias("recommendation")).where(F.col("place") <= most)
