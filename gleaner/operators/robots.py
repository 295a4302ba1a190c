"""robots.txt as rules, and what its rules do to crawlers: group folds over its lines, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scores

_STRINGS = "array<string>"
_RULES = "array<struct<line:int,agent:string,directive:string,path:string>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _agent(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"(?i)^User-agent:\s*(.+)$", 1))


def robots_rules(files: DataFrame) -> DataFrame:
    """``site, line, agent, directive, path`` of every rule with a path. Agents gather until a line that is neither a rule nor a
    crawl delay or sitemap; rules don't end a group."""
    start = F.struct(_empty(_STRINGS).alias("agents"), _empty(_RULES).alias("rules"), F.lit(0).alias("line"))

    def step(state: Column, line: Column) -> Column:
        agent, at = _agent(line), (state["line"] + 1).alias("line")
        directive, path = F.lower(F.regexp_extract(line, r"(?i)^(Allow|Disallow):", 1)), F.regexp_extract(
            line, r"(?i)^(?:Allow|Disallow):\s*(.*)$", 1,
        )
        more = F.transform(
            state["agents"],
            lambda a: F.struct(state["line"].alias("line"), a.alias("agent"), directive.alias("directive"), path.alias("path")),
        )
        same = lambda rules: F.struct(state["agents"].alias("agents"), rules.alias("rules"), at)
        return (
            F.when(agent != "", F.struct(F.concat(state["agents"], F.array(F.lower(agent))).alias("agents"), state["rules"].alias("rules"), at)) .when((directive != "") & (path != ""), same(F.concat(state["rules"], more))) .when((line == "") | line.startswith("#") | line.rlike("(?i)^(Allow|Disallow|Crawl-delay|Sitemap):"), same(state["rules"])) .otherwise(F.struct(_empty(_STRINGS).alias("agents"), state["rules"].alias("rules"), at))
        )

    folded = files.where("name = 'robots.txt' AND content <> ''").select(
        "site", F.aggregate(_lines(F.col("content")), start, step, lambda s: s["rules"]).alias("rules"),
    )
    return folded.select("site", F.inline("rules"))


def kept_disallows(rules: DataFrame) -> DataFrame:
    """``site, agent, path, line``: what a new robots.txt keeps of an old one, each path once, with the first line it stands in; rules of known
    crawlers are made anew."""
    known = [b.lower() for b in catalog.AI_CRAWLERS]
    rows = rules.where((F.col("directive") == "disallow") & ~F.col("agent").isin(known))
    return rows.groupBy("site", "agent", F.trim("path").alias("path")).agg(F.min("line").alias("line"))


def closed_to(content: Column) -> Column:
    """``blocked``: agents that a rule for the whole site shuts out; ``last_allowed`` and ``last_blocked``: agents whose own line is
    the last before such a rule. Here any line that is no agent, comment or blank ends the group."""
    start = F.struct(*(_empty(_STRINGS).alias(c) for c in ("agents", "blocked", "last_allowed", "last_blocked")))

    def step(state: Column, line: Column) -> Column:
        agent, shut, opened = _agent(line), line.rlike(r"(?i)^Disallow:\s*/\s*$"), line.rlike(r"(?i)^Allow:\s*/\s*$")
        agents = state["agents"]
        last = F.slice(agents, F.greatest(F.size(agents), F.lit(1)), 1)
        grown = lambda c, when, more: F.when(when, F.concat(state[c], more)).otherwise(state[c]).alias(c)
        return (
            F.when(agent != "", F.struct(F.concat(agents, F.array(F.lower(agent))).alias("agents"), *(state[c].alias(c) for c in ("blocked", "last_allowed", "last_blocked")))) .when((line == "") | line.startswith("#"), state) .otherwise(F.struct(_empty(_STRINGS).alias("agents"), grown("blocked", shut, agents), grown("last_allowed", opened, last), grown("last_blocked", shut, last)))
        )

    return F.aggregate(_lines(content), start, step)


def _among(bots: tuple[str, ...], *held: Column) -> Column:
    """Which of the bots, in lower case, are in any of these arrays."""
    return F.filter(
        F.array(*(F.lit(b.lower()) for b in bots)),
        lambda b: sum((F.array_contains(h, b).cast("int") for h in held[1:]), F.array_contains(held[0], b).cast("int")) > 0,
    )


def blocked_bots(rules: Column) -> Column:
    """Crawlers that the whole site is closed to: by name, or by ``*`` unless a rule of their own opens it. ``rules`` are :func:`closed_to`."""
    bots = F.array(*(F.lit(b.lower()) for b in catalog.AI_CRAWLERS))
    everyone = F.when(F.array_contains(rules["blocked"], "*"), F.array_except(bots, rules["last_allowed"])).otherwise(_empty(_STRINGS))
    return F.array_union(F.array_intersect(bots, rules["blocked"]), everyone)


def blocking_check(content: Column, rules: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Score and, from that, status; without a robots.txt nothing is closed. More than half of 13 closed leave less than half."""
    share = F.coalesce(F.size(blocked_bots(rules)), F.lit(0)) / len(catalog.AI_CRAWLERS)
    return F.when(content != "", scores.half_up((1 - share) * 100)).otherwise(100), lambda s: F.when(
        s == 100, "pass",
    ).when(s < 50, "fail").otherwise("partial")


def strategy_check(content: Column, rules: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Whether crawlers that train are shut out while those that retrieve may come in."""
    low = F.lower(content)
    training = F.size(_among(catalog.TRAINING_BOTS, rules["last_blocked"]))
    named = lambda b: F.contains(low, b) & ~F.array_contains(rules["last_blocked"], b)
    retrieval = F.size(
        F.filter(
            F.array(*(F.lit(b.lower()) for b in catalog.RETRIEVAL_BOTS)), lambda b: F.array_contains(rules["last_allowed"], b) | named(b),
        )
    )
    mentioned = F.exists(F.array(*(F.lit(b.lower()) for b in catalog.TRAINING_BOTS + catalog.RETRIEVAL_BOTS)), lambda b: F.contains(low, b))
    both = F.least(F.lit(100.0), 40 + training / 4 * 30 + retrieval / 4 * 30)
    score = F.when(~mentioned, 0.0).when((training > 0) & (retrieval > 0), both).when(
        retrieval > 0, scores.half_up(retrieval / 4 * 50).cast("double"),
    ).otherwise(20.0)
    score = F.when(content != "", score).otherwise(0.0)
    return scores.half_up(score), lambda s: F.when(content == "", "not_applicable").otherwise(scores.partly_if_any(s, 60))


def bot_blocking(files: DataFrame) -> DataFrame:
    """One row for each site that has any file. A robots.txt without content is one that names no crawler; only where there is none at all the
    strategy is not applicable."""
    is_robots = F.col("name") == "robots.txt"
    wide = files.groupBy("site").agg(
        F.coalesce(F.max(F.when(is_robots, F.col("content"))), F.lit("")).alias("robots"), (F.count_if(is_robots) > 0).alias("there"),
    ).withColumn("closed", closed_to(F.col("robots")))
    (score, status), (strategy, _) = (check(F.col("robots"), F.col("closed")) for check in (blocking_check, strategy_check))
    rows = wide.select(
        "site", "there", F.size(blocked_bots(F.col("closed"))).alias("blocked"), score.alias("score"), strategy.alias("strategy"),
    )
    return rows.select(
        "site", "blocked", "score", status(F.col("score")).alias("status"), "strategy",
        F.when(~F.col("there"), "not_applicable").otherwise(scores.partly_if_any(F.col("strategy"), 60)).alias("strategy_status"),
    )
