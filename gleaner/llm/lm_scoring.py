"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Counting: every task hashes the words of its texts, sums equal bigrams in bounded buffers and sends one sorted block for
each shard. Shards of bigrams form a grid by left and by right word, so a frequent word's bigrams fall in a whole row or column
of them. The second exchange sums what the shards know of each word: occurrences, words before it, totals as a context.
Shards grow in number with the corpus, so no task's share grows. Workers map the arrays into memory and look up sorted batches.

The order is 2: with all trigrams kept, counts and arrays of a third order go beyond four times the input on disk.

Texts: null and empty are one end token. A text of any length is read whole. Repeated rows count as often as they occur.
With nothing to learn from, N and V are 0 and every token gets the uniform probability 1 of 1 unknown type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import find, get, new_dir, put, runs, seal
from ._text import hash_word, pair, pieces, words_of

END, START = np.uint64(hash_word("\n</s>")), np.uint64(hash_word("\n<s>"))
#: Tokens a task gathers before it sends their bigrams on.
BUFFER = 1_500_000
#: Bytes of text for each shard of the model, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 24 << 20, 48
_BLOCK = "shard int, left binary, times binary, right binary, counts binary"
_WORDS = "shard int, keys binary, raw binary, before binary, seen binary, n1 binary, n2 binary, n3 binary, origin int, b1 long, b2 long, b3 long, b4 long"


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its hash and the hash before it; per text: how many tokens, and the words before them."""
    words = words_of(batch.column("text"))
    n = words.counts
    right = np.insert(words.hashes, words.first[1:], END)
    left = np.insert(words.hashes, words.first[:-1], START)
    return left, right, n + 1, words.first


def _grid(left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bigram: a place in a grid of about as many rows as columns."""
    rows = max(1, int(shards**0.5))
    return (left % np.uint64(rows)) * np.uint64(shards // rows) + right % np.uint64(shards // rows)


def _count(shards: int):
    def blocks(left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((right, left, _grid(left, right, shards)))
        left, right = left[order], right[order]
        at = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        counts = np.diff(np.r_[at, len(left)]).astype(np.uint32)
        left, right = left[at], right[at]
        shard = _grid(left, right, shards).astype(np.int32)
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        rows = []
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            first = runs(left[a:b])
            rows.append(
                (
                    int(k), left[a:b][first].tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(), right[a:b].tobytes(),
                    counts[a:b].tobytes(),
                )
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
            names=["shard", "left", "times", "right", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in pieces(batches):
            left, right, _, _ = _arrays(batch)
            held.append((left, right))
            size += len(left)
            if size >= BUFFER:
                yield from blocks(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield from blocks(*(np.concatenate(x) for x in zip(*held)))

    return count


def _bytes(values, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in values]) if len(values) else np.empty(0, kind)


def _least(values: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest kind that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _bigrams(at: str, shards: int):
    """One shard: writes its bigrams, and tells every word's shard what it has seen."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        left = np.repeat(_bytes(pdf["left"], np.uint64), _bytes(pdf["times"], np.uint32))
        right, counts = _bytes(pdf["right"], np.uint64), _bytes(pdf["counts"], np.uint32)
        del pdf
        order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        left, right, counts = left[first], right[first], np.add.reduceat(counts, first, dtype=np.uint64)
        keys = pair(left, right)
        order = np.argsort(keys)
        put(at, shard, {"bi": keys[order], "bic": _least(counts[order])})
        del keys
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        # what each context has: occurrences, kinds of followers seen once, twice, more often
        c = runs(left)
        context = left[c]
        seen, n1, n2, n3 = (np.add.reduceat(x, c, dtype=np.uint64) for x in (counts, counts == 1, counts == 2, counts > 2))
        # what each word has: occurrences, kinds of words before it
        order = np.argsort(right, kind="stable")
        right, counts = right[order], counts[order]
        w = runs(right)
        raw, before = np.add.reduceat(counts, w, dtype=np.uint64), np.diff(np.r_[w, len(right)]).astype(np.uint64)
        word = right[w]
        every = np.union1d(context, word)
        table = np.zeros((6, len(every)), np.uint64)
        table[0, i := np.searchsorted(every, word)], table[1, i] = raw, before
        i = np.searchsorted(every, context)
        table[2, i], table[3, i], table[4, i], table[5, i] = seen, n1, n2, n3
        to = (every % np.uint64(shards)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(shards + 1))
        rows = []
        for k in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[k] : bounds[k + 1]]
            rows.append((int(k), every[own].tobytes(), *(_packed(x[own]) for x in table), shard, *(of_counts if not rows else [0] * 4)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _WORDS.split(", ")])

    return reduce


def _packed(values: np.ndarray) -> bytes:
    """Counts byte by byte, all lowest bytes first: mostly zeros, which Spark's codec finds."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(parts) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0] for x in parts])


def _unigrams(at: str):
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        stats = [int(pdf[f"b{k}"].sum()) for k in (1, 2, 3, 4)]
        keys = _bytes(pdf["keys"], np.uint64)
        columns = [_unpacked(pdf[x]) for x in ("raw", "before", "seen", "n1", "n2", "n3")]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = runs(keys)
        raw, before, seen, n1, n2, n3 = (np.add.reduceat(x[order], first, dtype=np.uint64) for x in columns)
        put(
            at, shard,
            {
                "uni": keys[first], "raw": _least(raw), "before": _least(before), "seen": _least(seen),
                "kinds": _least(np.stack([n1, n2, n3], 1)),
            },
        )
        known = before > 0
        row = [int(raw.sum()), int(known.sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), *stats]
        return pd.DataFrame([[shard, [int(x) for x in np.unique(pdf["origin"])], *row]], columns=["shard", "origins", *_STATS])

    return reduce


_STATS = ["n", "v", "pairs", "u1", "u2", "u3", "u4", "b1", "b2", "b3", "b4"]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 1, 2 and 3 or more; where a count of counts is missing, the one absolute discount."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    return [min(max(d, 0.0), k) if d > 0 else min(y, k) for d, k in zip(found, (1, 2, 3))]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, how many shards, and sums over all of them."""

    at: str
    shards: int
    n: int
    v: int
    pairs: int
    unigram: tuple[float, ...]
    bigram: tuple[float, ...]
    kinds: tuple[int, ...]


def train(docs: DataFrame) -> Model:
    """Learn from every row's ``text``."""
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(LEAST_SHARDS, -(-size // SHARD_BYTES)))
    at = new_dir(spark, "lm")
    blocks = texts.mapInArrow(_count(shards), _BLOCK)
    # as many tasks as shards, so that what one reads doesn't grow
    words = blocks.repartitionById(shards, "shard").groupBy("shard").applyInPandas(_bigrams(at, shards), _WORDS)
    stats = words.repartitionById(shards, "shard").groupBy("shard").applyInPandas(
        _unigrams(at), "shard int, origins array<int>, " + ", ".join(f"{c} long" for c in _STATS),
    )
    done = stats.collect()  # a row for each shard
    row = {c: sum(r[c] for r in done) for c in _STATS}
    seal(at, shards, [r["shard"] for r in done], "uni", "raw", "before", "seen", "kinds")
    seal(at, shards, sorted({k for r in done for k in r["origins"]}), "bi", "bic")
    uni, bi = ([row[f"{k}{i}"] for i in (1, 2, 3, 4)] for k in "ub")
    kinds = (uni[0], uni[1], row["v"] - uni[0] - uni[1])
    return Model(at, shards, row["n"], row["v"], row["pairs"], tuple(_discounts(*uni)), tuple(_discounts(*bi)), kinds)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield int(k), slice(bounds[k], bounds[k + 1])


def _words_in(model: Model, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of distinct words: occurrences, kinds before, times as context, and the weight its context leaves to the lower order."""
    order = np.argsort(words % np.uint64(model.shards), kind="stable")
    raw, before, seen, left = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
    for k, part in _by_shard((words % np.uint64(model.shards))[order], model.shards):
        own = order[part]
        at, there = find(get(model.at, k, "uni"), words[own])
        own, at = own[there], at[there]
        if len(own):
            raw[own], before[own], seen[own] = get(model.at, k, "raw")[at], get(model.at, k, "before")[at], get(model.at, k, "seen")[at]
            left[own] = get(model.at, k, "kinds")[at] @ np.array(model.bigram)
    return raw, before, seen, left


def _pairs_in(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys, shard = pair(left, right), _grid(left, right, model.shards)
    order = np.lexsort((keys, shard))
    counts = np.zeros(len(keys))
    for k, part in _by_shard(shard[order], model.shards):
        own = order[part]
        at, there = find(get(model.at, k, "bi"), keys[own])
        counts[own[there]] = get(model.at, k, "bic")[at[there]]
    return counts


def _less(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    d = np.array([0.0, *discounts])
    return np.maximum(counts - d[np.minimum(counts, 3).astype(np.int64)], 0)


def _log_probabilities(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: times in training, log10 of the add-one share, log10 of the model's probability."""
    words, to = np.unique(np.concatenate([left, right]), return_inverse=True)
    l, r = to[: len(left)], to[len(left) :]
    raw, before, seen, back = _words_in(model, words)
    lower = _less(before, model.unigram)
    free = sum(d * k for d, k in zip(model.unigram, model.kinds))
    unigram = (lower + free / (model.v + 1)) / model.pairs if model.pairs else np.full(len(words), 1.0 / (model.v + 1))
    counts = _pairs_in(model, left, right)
    total = seen[l]
    p = np.where(total > 0, (_less(counts, model.bigram) + back[l] * unigram[r]) / np.maximum(total, 1), unigram[r])
    return raw[r], np.log10((raw[r] + 1) / (model.n + model.v + 1)), np.log10(p)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """For each row: ``keep`` as it is, n_tokens, n_known, base_score, score and perplexity of its whole ``text``.

    The model's probabilities of all words and one unknown type sum to 1 after every context.
    """
    schema = docs.select(*keep).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = pa.schema(
        [
            *to_arrow_schema(schema),
            *(
                (n, t)
                for n, t in (
                    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                    ("perplexity", pa.float64()),
                )
            ),
        ]
    )
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    out = StructType(
        [
            *schema.fields, StructField("n_tokens", LongType()), StructField("n_known", LongType()),
            *(StructField(x, DoubleType()) for x in ("base_score", "score", "perplexity")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            left, right, n, _ = _arrays(batch)
            raw, base, log = _log_probabilities(model, left, right)
            first = np.r_[0, np.cumsum(n)][:-1]
            known, base, log = (np.add.reduceat(x, first) for x in ((raw > 0).astype(np.int64), base, log))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).cast(target.field(c).type) for c in keep), pa.array(n), pa.array(known), pa.array(base),
                    pa.array(log), pa.array(10 ** np.minimum(-log / n, 300)),
                ],
                schema=target,
            )

    return docs.select(*keep, "text").mapInArrow(run, out)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in that fold; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    model = train(docs.where(~out))
    scored = score(docs, model, "doc_id")
    return scored.select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score",
        "perplexity",
    )
