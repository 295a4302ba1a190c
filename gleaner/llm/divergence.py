"""Divergence of sources by exact arithmetic on term counts.

Of each language the terms that enough of its documents hold are kept. A group (language, source) gives a kept term with c occurrences
the share ``1 + floor(SCALE * (c + 2) / (N + 2 V))``, and two shares p and q differ by ``floor((p - q)^2 / (p + q))``. All numbers are
whole.

Terms whose sparse vector of counts by source is the same behave alike, so vectors are counted and worked on once each. The difference
of two sources summed over all terms is, with z the share of no occurrence,

    V d(zs, zt)  +  terms of s: d(ps, zt) - d(zs, zt)  +  terms of t: d(zs, pt) - d(zs, zt)
                 +  terms of both: d(ps, pt) - d(ps, zt) - d(zs, pt) + d(zs, zt)

so that only sources that a vector holds are paired for it, whatever the number of sources; terms of one source are counted by their
count. Every sum is added up where the rows are before they are shuffled. A term's vector has an entry a source, and the pairs of a
language are as many as its sources squared, as the result has to be; nothing else grows faster than the input.

Null text, language and source are read as empty. Empty texts, and texts without kept terms, still make their group occur. A language
without kept terms has pairs of value 0. Repeated rows are documents of their own; ids and other columns aren't read. Ties go to the
smaller item in UTF-8. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, saved

# [^\x00-\x40\x5B-\x60\x7B-\x7F]+, character by character: Java looks such a class up in a table, but asks ranges one after the other
TERM = "[^" + "".join(rf"\x{k:02X}" for k in range(0x80) if not chr(k).isalpha()) + "]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def _lowered(text: Column) -> Column:
    """A-Z only; where all is ASCII, ``lower`` does just that."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, d`` of ``(lang, source, text)``: occurrences, and documents that hold the term."""
    words = docs.select("lang", "source", F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0)).alias("words"))
    # all words, and behind them each different one once
    each = F.posexplode(F.concat("words", F.array_distinct("words"))).alias("at", "term")
    found = F.when(F.col("at") < F.col("k"), 1)
    return words.select("lang", "source", F.size("words").alias("k"), each).groupBy("lang", "source", "term").agg(
        F.count(found).alias("n"), (F.count("*") - F.count(found)).alias("d"),
    )


def _share(c: str, base: str) -> Column:
    """Exact for any counts of 64 bits: the product has up to 29 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({c} + 2 AS DECIMAL(20,0))) div CAST({base} AS DECIMAL(20,0))")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(
    docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group, its difference from every other source of the language (``pair``), and
    the ``top`` terms that it has more of than the language (``term``). ``least``: documents of the language that a kept term is in."""
    store = Scratch(docs.sparkSession, "divergence")
    told = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(told(lang_col, "lang"), told(source_col, "source"), told(text_col, "text"))

    vector = F.array_sort(F.collect_list(F.struct("source", F.col("n").alias("c"))))
    terms = term_counts(docs).groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("whole"), vector.alias("vector"))
    terms = store.saved(terms.where(F.col("docs") >= least).drop("docs"), "terms")
    vectors = store.saved(
        terms.groupBy("lang", "vector").agg(F.count("*").alias("terms")).withColumn("id", F.monotonically_increasing_id()), "vectors",
    )

    entries = vectors.select("id", "lang", "terms", F.size("vector").alias("sources"), F.inline("vector"))
    of_group = entries.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("terms")).alias("n"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("n_lang"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(
        0, ["n", "v", "n_lang"],
    )
    groups = groups.select(
        "lang", "source", "v", (F.col("n") + 2 * F.col("v")).alias("base"), (F.col("n_lang") + 2 * F.col("v")).alias("base_lang"),
    )
    # where nothing is kept no share is asked for: 1 stands for it, and all differences are 0
    groups = store.saved(
        groups.withColumn("z", F.when(F.col("v") > 0, _share("0", "greatest(base, 1)")).otherwise(F.lit(1).cast("long"))), "groups",
    )

    known = entries.join(groups.select("lang", "source", "base", "z"), ["lang", "source"]).withColumn("p", _share("c", "base")).select(
        "id", "lang", "terms", "sources", "source", "c", "p", "z",
    )
    known = store.saved(known, "entries")

    s, t = (groups.select("lang", F.col("source").alias(x), F.col("z").alias(f"z_{x}"), "v") for x in "st")
    none = s.join(t.drop("v"), "lang").where("s < t").select("lang", "s", "t", F.expr(f"v * {_apart('z_s', 'z_t')}").alias("value"))

    own = known.groupBy("lang", "source", "c").agg(F.sum("terms").alias("terms"), F.first("p").alias("p"), F.first("z").alias("z"))
    one = own.join(t.drop("v"), "lang").where("source <> t")
    one = one.select(
        "lang", F.least("source", "t").alias("s"), F.greatest("source", "t").alias("t"),
        F.expr(f"terms * ({_apart('p', 'z_t')} - {_apart('z', 'z_t')})").alias("value"),
    )

    held = known.where("sources > 1").groupBy("id", "lang", "terms").agg(
        F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("held")
    )
    pairs = held.select("lang", "terms", "held", F.posexplode("held").alias("at", "a")).select(
        "lang", "terms", "a", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("b"),
    )
    value = f"terms * ({_apart('a.p', 'b.p')} - {_apart('a.p', 'b.z')} - {_apart('a.z', 'b.p')} + {_apart('a.z', 'b.z')})"
    both = pairs.select("lang", F.col("a.source").alias("s"), F.col("b.source").alias("t"), F.expr(value).alias("value"))

    sums = none.unionByName(one).unionByName(both).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    sides = F.explode(
        F.array(
            F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")),
        )
    ).alias("x")
    pair = sums.select("lang", "value", sides).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    shares = terms.select("lang", "term", "whole", F.inline("vector")).join(
        groups.select("lang", "source", "base", "base_lang"), ["lang", "source"],
    )
    shares = shares.select("lang", "source", "term", _share("c", "base").alias("p"), _share("whole", "base_lang").alias("q")).where("p > q")
    term = shares.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"),
    )

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    result = saved(ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top)), "divergence")
    store.clear()
    return result


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
