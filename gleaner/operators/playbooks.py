"""Scans beside checks: the latest check of a domain, the check that was the latest when a scan ran, and what to tell a client about a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog


def latest_check(jobs: DataFrame) -> DataFrame:
    """Every completed scan with the newest completed check of its domain: ``domain, job_id, at, check_id, visibility``."""
    done = jobs.where("status = 'completed'")
    newest = done.where("type = 'check'").groupBy("domain").agg(F.max(F.struct("at", "job_id", "score")).alias("c"))
    return done.where("type = 'scan'").join(newest, "domain", "left").select(
        "domain", "job_id", "at", F.col("c.job_id").alias("check_id"), F.col("c.score").alias("visibility"),
    )


def check_as_of(jobs: DataFrame, days: int = 1) -> DataFrame:
    """Every completed scan with the newest check of its domain that was completed by then: ``domain, job_id, at, check_id, visibility``.

    Rows meet by domain and stretch of ``days``, so a domain with very many rows is no single task; what earlier stretches leave comes from a
    table with a row for each of them. A check at the very time of a scan counts; of several the one with the largest id.
    """
    done = jobs.where("status = 'completed' AND at IS NOT NULL").withColumn(
        "part", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / F.lit(days * 86_400_000_000)),
    )
    check = F.when(F.col("type") == "check", F.struct("at", "job_id", "score"))
    parts = done.groupBy("domain", "part").agg(F.max(check).alias("last"))
    before = Window.partitionBy("domain").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("domain", "part", F.max("last").over(before).alias("earlier"))
    # checks come before scans of the same time
    order = Window.partitionBy("domain", "part").orderBy(
        "at", F.when(F.col("type") == "check", 0).otherwise(1), "job_id",
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = done.select("domain", "part", "type", "job_id", "at", F.max(check).over(order).alias("within")).where("type = 'scan'")
    rows = within.join(carried, ["domain", "part"], "left").withColumn("c", F.coalesce("within", "earlier"))
    return rows.select("domain", "job_id", "at", F.col("c.job_id").alias("check_id"), F.col("c.score").alias("visibility"))


def _paths(component: str) -> tuple[str, ...]:
    return catalog.GAP_PATHS.get(component, (component,))


def gaps(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``site, place, component, kind, files``: components whose files are missing, with those files, and what is there but incomplete.

    A component without an item is missing. Of a policy in two files each can be missing by itself: ``files(site, name)`` tells which; without it
    a policy that is partly there is incomplete.
    """
    rows = [(k, n, True, list(_paths(n))) for k, n in enumerate(catalog.GAP_FILES)] + [
        (100 + k, n, False, []) for k, n in enumerate(catalog.GAP_SETTINGS)
    ]
    parts = F.array(
        *(
            F.struct(
                F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(f).alias("is_file"),
                F.array(*map(F.lit, p)).cast("array<string>").alias("paths"),
            )
            for k, n, f, p in rows
        )
    )
    every = items.select("site").distinct().select("site", F.inline(parts))
    rows = every.join(items.select("site", "name", "status", "score"), ["site", "name"], "left")
    policy = F.col("is_file") & (F.size("paths") > 1) & (F.col("score") > 0) & (F.col("status") != "pass")
    there = F.array().cast("array<string>")
    if files is not None:
        held = files.where(F.col("name").isin(*(p for n in catalog.GAP_FILES for p in _paths(n) if len(_paths(n)) > 1))).groupBy("site").agg(F.array_sort(F.collect_set("name")).alias("there"))
        rows, there = rows.join(held, "site", "left"), F.coalesce("there", there)
    lost = F.when(
        policy, F.array_except("paths", there) if files is not None else F.array().cast("array<string>"),
    ).otherwise(F.col("paths"))
    missing = F.col("is_file") & (
        F.col("status").isNull() | ((F.col("status") != "pass") & ((F.col("score") == 0) | (policy & (F.size(lost) > 0))))
    )
    kind = F.when(missing, "missing").when(F.col("status").isNotNull() & (F.col("status") != "pass"), "incomplete")
    return rows.select(
        "site", "place", F.col("name").alias("component"), kind.alias("kind"),
        F.when(missing, lost).otherwise(F.array().cast("array<string>")).alias("files"),
    ).where("kind IS NOT NULL")


def playbooks(items: DataFrame, files: DataFrame, scores: DataFrame, checks: DataFrame) -> DataFrame:
    """A row for each site, the newest first: ``place, site, generated_at, service_score, overall, grade, visibility``, scores of four categories,
    files that are there and missing, up to four things to do.

    ``scores(site, generated_at, service_score, overall, grade)``; ``checks(site, visibility)``.
    """
    found = gaps(items, files)
    order = lambda c: F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("place", "component", "files"))))
    per = found.groupBy("site").agg(order("missing").alias("missing"), order("incomplete").alias("incomplete"))
    lost = F.flatten(F.transform("missing", lambda m: m["files"]))
    first = F.transform("missing", lambda m: F.concat(F.lit("add "), F.array_join(m["files"], " + ")))
    then = F.transform("incomplete", lambda m: F.concat(F.lit("complete "), m["component"]))
    total = sum(len(_paths(n)) for n in catalog.GAP_FILES)
    by = items.where("status <> 'not_applicable' AND max_score > 0").groupBy("site")
    share = lambda c: F.floor(
        F.sum(F.when(F.col("category") == c, F.col("score"))) / F.sum(F.when(F.col("category") == c, F.col("max_score"))) * 100 + F.lit(0.5)
    ).cast("int")
    categories = by.agg(
        *(
            share(c).alias(a)
            for a, c in (
                ("seo", "foundational_seo"), ("discoverability", "ai_discoverability"), ("content", "content_quality"),
                ("infrastructure", "ai_infrastructure"),
            )
        )
    )
    rows = scores.join(per, "site", "left").join(categories, "site", "left").join(checks, "site", "left")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "site", "generated_at", "service_score", "overall", "grade", "visibility", "seo", "discoverability", "content", "infrastructure",
        F.coalesce(lost, none).alias("missing_files"),
        F.slice(F.concat(F.coalesce(first, none), F.coalesce(then, none)), 1, 4).alias("to_do"),
    )
    rows = rows.withColumn("files_there", F.lit(total) - F.size("missing_files"))
    return rows.orderBy(F.desc("generated_at"), "site")
