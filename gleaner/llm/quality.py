"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's vector holds log word frequencies in ``BUCKETS`` hashed places, scaled to length 1, and standardised statistics of
its bytes, words and the metadata column with its declared length. All pairs of entries interact through ``RANK`` factors;
they are summed in linear time as ``((sum v x)^2 - sum (v x)^2) / 2``. The machine is fitted on at most ``SAMPLE`` labelled
rows, picked by a hash; every text is scored whole.

Null and empty texts have no words and the statistics of an empty text, and get a score like any other. A null declared
length counts as the true one. Rows of ``labels`` with a null id or label are left out; where an id has several labels, the
larger share counts (ties: 1). Repeated rows stay rows. Without labels of both kinds every score is the smoothed base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import ALNUM, SPACE, U, by_text, pieces, words_of
from .lm_scoring import held_out

BUCKETS, RANK, SAMPLE = 1 << 12, 8, 6000
STATS = (
    "length", "declared", "words", "word_length", "long_words", "distinct", "upper", "digits", "symbols", "stops", "breaks", "high", "bars",
    "bangs", "repeats",
)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PLANES = (
    (_UPPER, _class("0123456789"), ALNUM & ~SPACE & ~_class(".,")),
    (_class(".,"), _class("\n"), np.arange(256) >= 0x80),
    (_class("|"), _class("!"), np.zeros(256, bool)),
)
#: Three counters of 21 bits each in one number.
_TABLES = [sum(p.astype(np.uint64) << U(21 * i) for i, p in enumerate(planes)) for planes in _PLANES]


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    columns = []
    if len(offsets) > 1 and np.diff(offsets).max() >= 1 << 21:
        return np.stack([by_text(p[data], offsets) for planes in _PLANES for p in planes], 1)
    for table in _TABLES:
        packed = by_text(table[data], offsets)
        columns += [(packed >> U(21 * i)) & U((1 << 21) - 1) for i in range(3)]
    return np.stack(columns, 1).astype(np.int64)


def vectors(texts: pa.Array, declared: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word weights (first, places, values) and dense statistics of each text."""
    words = words_of(texts)
    n = words.counts
    key = (words.owner.astype(np.uint64) << U(12)) | (words.hashes & U(BUCKETS - 1))
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.r_[at, len(key)])
    key = key[at]
    owner, places = (key >> U(12)).astype(np.int64), (key & U(BUCKETS - 1)).astype(np.int64)
    values = np.log1p(times)
    first = np.searchsorted(owner, np.arange(len(n) + 1))
    values = values / np.sqrt(np.maximum(by_text(values**2, first), 1e-12))[owner]

    offsets = _offsets(texts)
    c = _byte_counts(words.data, offsets).astype(float)
    size = np.diff(offsets).astype(float)
    chars = size.copy()
    if declared is not None:
        told = declared.cast(pa.float64()).to_numpy(zero_copy_only=False)
        chars = np.where(np.isnan(told), size, told)
    width = (words.ends - words.starts).astype(float)
    m, b = np.maximum(n, 1), np.maximum(size, 1)
    dense = np.stack(
        [
            np.log1p(size), np.log1p(np.maximum(chars, 0)), np.log1p(n), by_text(width, words.first) / m,
            by_text(width > 20, words.first) / m, np.diff(first) / m, c[:, 0] / b, c[:, 1] / b, c[:, 2] / b, c[:, 3] / m, c[:, 4] / m,
            c[:, 5] / b, c[:, 6] / m, c[:, 7] / m, by_text(np.maximum(times - 3, 0).astype(float), first) / m,
        ],
        1,
    )
    return first, places, values, dense


def _offsets(texts: pa.Array) -> np.ndarray:
    from ._text import raw

    return raw(texts)[1]


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, first: np.ndarray, places: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
        x = np.clip((dense - self.mean) / self.scale, -4, 4)
        w, v = self.weights, self.factors
        linear = self.bias + by_text(values * w[places], first) + x @ w[BUCKETS:]
        for k in range(v.shape[1]):
            part = values * v[places, k]
            s = by_text(part, first) + x @ v[BUCKETS:, k]
            squares = by_text(part * part, first) + (x * x) @ (v[BUCKETS:, k] ** 2)
            linear = linear + (s * s - squares) / 2
        return 1 / (1 + np.exp(-np.clip(linear, -500, 500)))


def fit(
    first: np.ndarray, places: np.ndarray, values: np.ndarray, dense: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.05,
    l2: float = 2e-4, seed: int = 3,
) -> Machine:
    """AdaGrad on the logistic loss, over mini-batches."""
    size = BUCKETS + dense.shape[1] if dense.ndim == 2 else BUCKETS
    base = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(base / (1 - base)))
    if not len(y) or y.min() == y.max():
        return Machine(bias, np.zeros(size), np.zeros((size, RANK)), np.zeros(size - BUCKETS), np.ones(size - BUCKETS))
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    x = np.clip((dense - mean) / scale, -4, 4).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    gw, gv, gb = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            own = order[a : a + 64]
            batch = np.zeros((len(own), size), np.float32)
            for i, j in enumerate(own):
                batch[i, places[first[j] : first[j + 1]]] = values[first[j] : first[j + 1]]
            batch[:, BUCKETS:] = x[own]
            sums = batch @ v
            squares = batch * batch
            score = bias + batch @ w + ((sums**2).sum(1) - squares @ (v**2).sum(1)) / 2
            g = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[own]) / len(own)).astype(np.float32)
            dw = batch.T @ g + l2 * w
            dv = batch.T @ (g[:, None] * sums) - v * (squares.T @ g)[:, None] + l2 * v
            db = float(g.sum())
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, bias = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), bias - rate * db / np.sqrt(gb)
    return Machine(bias, w.astype(float), v.astype(float), mean, scale)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
    label_col: str = "quality", sample: int = SAMPLE,
) -> Machine:
    """Fit on the labelled rows of ``docs``; leave out held-out rows before."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        (F.col(length_col) if length_col else F.lit(None)).cast("double").alias("declared"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            first, places, values, dense = vectors(batch.column("text"), batch.column("declared"))
            cut = lambda x, kind: [x[a:b].astype(kind).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"), pa.array(cut(places, np.uint16), pa.binary()), pa.array(cut(values, np.float32), pa.binary()),
                    pa.array([row.tobytes() for row in dense], pa.binary()),
                ],
                names=["y", "places", "values", "dense"],
            )

    # the sample has a fixed bound, so its ids may go to every task
    rows = texts.join(F.broadcast(told), "id").select("text", "declared", "y").mapInArrow(
        run, "y int, places binary, values binary, dense binary",
    ).toPandas()
    rows = rows.iloc[np.lexsort((rows["dense"].to_numpy(), rows["places"].to_numpy()))] if len(rows) else rows
    places, values = ([np.frombuffer(x, k) for x in rows[c]] for c, k in (("places", np.uint16), ("values", np.float32)))
    first = np.r_[0, np.cumsum([len(x) for x in places])].astype(np.int64)
    dense = np.stack([np.frombuffer(x, float) for x in rows["dense"]]) if len(rows) else np.zeros((0, len(STATS)))
    return fit(
        first, np.concatenate([*places, np.empty(0, np.uint16)]).astype(np.int64), np.concatenate([*values, np.empty(0, np.float32)]),
        dense, rows["y"].to_numpy(float),
    )


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
) -> DataFrame:
    """``id_col`` and ``score``, the probability of label 1, of every row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        (F.col(length_col) if length_col else F.lit(None)).cast("double").alias("declared"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(machine.score(*vectors(batch.column("text"), batch.column("declared"))))],
                names=["id", "score"],
            )

    return rows.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), "score")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = held_out(F.col("doc_id"), 3, 1)
    scored = score(docs, train(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
