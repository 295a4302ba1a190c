"""Language ID by Bayesian evidence fusion.

Evidence for each language: the text's likelihood under byte trigrams, how often texts of that language declare what this
one declares in its markup, and the prior of the host, which is smoothed towards its address suffix's, which is smoothed
towards the whole corpus's. Priors and declaration rates are sums of text-only posteriors, aggregated by group in Spark.

Rejected (``accepted`` false) are texts without letters (null and empty ones too), texts whose trigrams fit their best
language clearly worse than chance, and texts with no language above ``least`` posterior. Null hosts, suffixes and declarations are
no evidence. Of languages that tie, the first by name is taken. Repeated rows stay rows, null ids null. Whole texts are read.
Other columns are ignored, whatever their names. An empty table gives no rows; without labels the one language is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import get, new_dir, put, runs, saved
from ._text import by_text, pieces, raw

CODES = 1 << 14
#: Different (language, trigram) counts a task holds before it sends them on.
BUFFER = 2_000_000
#: Overlapping trigrams aren't independent: the log likelihood counts by this factor. Texts a level of priors weighs.
TEMPER, STRENGTH = 0.3, 50.0
#: Nats a trigram by which a text may fit worse than chance: a short text may hold a key or a code.
SLACK = 1.5
#: Bytes of evidence that are sent to every executor at most; more is joined by key, hot keys split by Spark.
SENT = 32 << 20

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x61:0x7B] = np.arange(1, 27)
_FOLD[0x41:0x5B] = np.arange(1, 27)
_FOLD[0x80:] = np.arange(27, 155)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte trigrams with a letter in the middle, and where each text's start."""
    data, offsets = raw(texts)
    b = _FOLD[data].astype(np.uint32)
    left, right = np.zeros_like(b), np.zeros_like(b)
    left[1:], right[:-1] = b[:-1], b[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    left[edges], right[edges - 1] = 0, 0
    on = np.flatnonzero(b)
    code = ((left[on] * np.uint32(24001) + b[on] * np.uint32(155) + right[on]) * np.uint32(2654435761)) >> np.uint32(18)
    return code, np.searchsorted(on, offsets)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # CODES x languages


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts of all rows by their label, whatever labels there are; rows without one are left out."""
    rows = docs.select(F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")).where("text is not null and lang is not null")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        return keys[order][at], np.add.reduceat(n[order], at) if len(at) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in pieces(batches):
            code, first = trigrams(batch.column("text"))
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            held.append(np.unique(np.repeat(lang, np.diff(first)) * CODES + code, return_counts=True))
            size += len(held[-1][0])
            if size >= BUFFER:
                keys, n = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([n, *(c for _, c in held)]))
                held, size = [], 0
                if len(keys) >= BUFFER:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((keys // CODES).astype(np.int32)), pa.array((keys % CODES).astype(np.int32)), pa.array(n)],
                        names=["lang", "code", "n"],
                    )
                    keys, n = keys[:0], n[:0]
        keys, n = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([n, *(c for _, c in held)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys // CODES).astype(np.int32)), pa.array((keys % CODES).astype(np.int32)), pa.array(n)],
            names=["lang", "code", "n"],
        )

    counts = rows.mapInArrow(run, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((CODES, max(len(langs), 1)), 0.5)
    table[counts["code"], counts["lang"]] += counts["n"]
    return Model(tuple(langs) or ("und",), np.log(table / table.sum(0)))


def _score(at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = get(at, 0, "logs")  # languages x CODES
        for batch in pieces(batches):
            code, first = trigrams(batch.column("text"))
            n = np.diff(first)
            fit = np.stack([by_text(row[code].astype(np.float64), first) for row in logs], 1)
            weighed = TEMPER * fit
            p = np.exp(weighed - weighed.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(logs)).cast(pa.list_(pa.float64())) for x in (weighed, p)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "host", "suffix", "declared")), pa.array(n), pa.array(fit.max(1) / np.maximum(n, 1)),
                    *lists,
                ],
                names=["id", "host", "suffix", "declared", "n", "fit", "fits", "p"],
            )

    return run


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, suffix: Column | None = None,
    declared: Column | None = None, least: float = 0.5,
) -> DataFrame:
    """One row per input row: ``id_col``, ``lang``, ``confidence`` (its posterior), ``text_lang`` (by the text alone), ``accepted``."""
    none = F.lit(None).cast("string")
    take = lambda c: none if c is None else c.cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), take(host).alias("host"), take(suffix).alias("suffix"),
        F.lower(F.regexp_extract(take(declared), "^[A-Za-z]+", 0)).alias("declared"),
    )
    at = new_dir(docs.sparkSession, "trigrams")
    put(at, 0, {"logs": np.ascontiguousarray(model.logs.T.astype(np.float32))})
    rows = saved(
        rows.mapInArrow(
            _score(at), "id long, host string, suffix string, declared string, n long, fit double, fits array<double>, p array<double>",
        ),
        "language",
    )
    size = len(model.languages)
    told = rows.where("n > 0")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(size)]
    array = lambda prefix="s": F.array(*(F.col(f"{prefix}{i}") for i in range(size)))
    smooth = lambda counts, above: F.zip_with(
        counts, above, lambda c, a: (c + STRENGTH * a) / (F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) + STRENGTH),
    )

    whole = told.agg(*sums, F.count("*").alias("all")).select(
        F.transform(array(), lambda s: (F.coalesce(s, F.lit(0.0)) + 1) / (F.col("all") + size)).alias("prior")
    ).first()["prior"]
    prior = F.array(*map(F.lit, whole))
    by_suffix = told.where("suffix is not null").groupBy("suffix").agg(*sums).select("suffix", smooth(array(), prior).alias("of_suffix"))
    by_host = told.where("host is not null").groupBy("host").agg(*sums, F.first("suffix").alias("suffix")).join(by_suffix, "suffix", "left")
    by_host = by_host.select("host", smooth(array(), F.coalesce("of_suffix", prior)).alias("of_host"))
    # how likely each language is to declare this: shrunk towards how often anyone does
    declared_all = told.where("declared <> ''").agg(*sums).select(
        F.transform(array(), lambda s: F.coalesce(s, F.lit(0.0))).alias("n")
    ).first()["n"]
    total = max(sum(declared_all), 1e-9)
    by_declared = told.where("declared <> ''").groupBy("declared").agg(*sums)
    share = sum(F.col(f"s{i}") for i in range(size)) / F.lit(total)
    by_declared = by_declared.select(
        "declared",
        F.array(*((F.col(f"s{i}") + STRENGTH * share) / (declared_all[i] + STRENGTH) for i in range(size))).alias("of_declared"),
    )

    # one row for each combination of evidence that occurs
    ones = F.array(*[F.lit(1.0)] * size)
    evidence = saved(rows.select("host", "suffix", "declared").distinct(), "evidence")
    for column, table in (("host", by_host), ("suffix", by_suffix), ("declared", by_declared)):
        evidence = evidence.join(table, column, "left")
    factors = F.zip_with(F.coalesce("of_host", "of_suffix", prior), F.coalesce("of_declared", ones), lambda a, b: F.log(a * b + 1e-12))
    evidence = saved(
        evidence.select(*(F.col(c).alias(f"_{c}") for c in ("host", "suffix", "declared")), factors.alias("factors")), "evidence",
    )
    few = evidence.count() * 8 * (size + 2) <= SENT
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("host", "suffix", "declared")]
    rows = rows.join(F.broadcast(evidence) if few else evidence.hint("merge"), same)
    rows = rows.withColumn("logs", F.zip_with("fits", "factors", lambda a, b: a + b)).withColumn("top", F.array_max("logs"))
    names = F.array(*map(F.lit, model.languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return rows.select(
        F.col("id").alias(id_col), best(F.col("logs")).alias("lang"), confidence.alias("confidence"),
        F.when(F.col("n") > 0, best(F.col("p"))).alias("text_lang"),
        ((F.col("n") > 0) & (F.col("fit") >= -float(np.log(CODES)) - SLACK) & (confidence >= least)).alias("accepted"),
    )


def _decide(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs), host=F.col("source"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``: trigrams are learned from all labelled rows; ``source`` is the host."""
    return _decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on ``pages``: markup declares a language, addresses have hosts and suffixes."""
    from .url_filter import host_of, suffix_of

    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    pages = pages.withColumn("text", text)
    return identify(
        pages, train(docs), "page_id", host=host_of(F.col("url")), suffix=suffix_of(host_of(F.col("url"))),
        declared=F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
    )
