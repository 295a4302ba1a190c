"""Approximate nearest neighbours by additive quantisation.

``M`` codebooks of ``K`` full-dimensional entries are learned from a bounded sample of unit vectors: residual k-means, then
least squares over all books at once. Every vector is encoded by beam search and kept as ``M`` bytes, the norm of its
reconstruction and its cosine with that. A query's scores come from its lookup table. The best ``keep`` of each code block
are compared exactly, in double precision, on the original vectors; so is every other vector whose angle to the query can,
by the triangle inequality over its reconstruction, be as small as the k-th best found so far. The result is exact: codes only
spare comparisons.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
ids. Repeated vectors tie, and ties go to the smaller id, before and after the exact comparison. Rows are told apart by
themselves, not by ids: a query is compared with every row but its own, also with those of its id, and each of several query
rows of one id is answered for itself. Tables without vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import get, new_dir, put, saved, seal

#: Vectors that the codebooks are learned from at most.
SAMPLE = 8192
BOOKS, ENTRIES, BEAM = 8, 256, 6
QUERY_BLOCK, KEEP = 512, 100


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


@dataclass(frozen=True)
class Books:
    entries: np.ndarray  # M x K x d

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Beam search: after each book the ``beam`` partial sums nearest to x go on."""
        n, (m, k, d) = len(x), self.entries.shape
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.entries:
            near = (book * book).sum(1) - 2 * rest @ book.T + (rest * rest).sum(2, keepdims=True)
            flat = near.reshape(n, -1)
            best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, 1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, best // k], (best % k).astype(np.uint8)[:, :, None]], 2)
            rest = rest[row, best // k] - book[best % k]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.entries))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    means = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = ((means * means).sum(1) - 2 * x @ means.T).argmin(1)
        count = np.bincount(to, minlength=len(means))
        sums = np.zeros_like(means, np.float64)
        np.add.at(sums, to, x)
        means[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
    return means


def learn(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 2, seed: int = 5) -> Books:
    rng = np.random.default_rng(seed)
    k, rest, found = min(entries, len(x)), x, []
    for _ in range(books):
        found.append(_means(rest, k, rng))
        rest = rest - found[-1][((found[-1] ** 2).sum(1) - 2 * rest @ found[-1].T).argmin(1)]
    model = Books(np.stack(found))
    for _ in range(rounds):  # all books at once: least squares for fixed codes
        hot = np.zeros((len(x), books * k), np.float32)
        codes = model.encode(x)
        for i in range(books):
            hot[np.arange(len(x)), i * k + codes[:, i].astype(np.int64)] = 1
        gram = hot.T @ hot + 1e-2 * np.eye(books * k, dtype=np.float32)
        model = Books(
            (
                model.entries.reshape(-1, x.shape[1]) + np.linalg.solve(gram, hot.T @ (x - model.decode(codes)))
            ).astype(np.float32).reshape(model.entries.shape)
        )
    return model


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(id, v)`` of the vectors that take part, and their length."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    ).where(finite.alias("f") & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 1
    return rows.where(F.size("v") == dim), dim


def _codes(model: Books, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim))
            norms, cosines, codes = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32), np.zeros(
                (len(x), len(model.entries)), np.uint8,
            )
            for a in range(0, len(x), 512):
                part = slice(a, a + 512)
                codes[part] = model.encode(x[part])
                near = model.decode(codes[part])
                norms[part] = np.sqrt((near * near).sum(1))
                cosines[part] = (near * x[part]).sum(1) / np.maximum(norms[part], 1e-12)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "v")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms),
                    pa.array(cosines),
                ],
                names=["id", "v", "codes", "norm", "cosine"],
            )

    return run


def index(rows: DataFrame, model: Books, dim: int) -> DataFrame:
    """Every vector of ``(id, v)`` with its codes, their norm and its cosine with what they stand for."""
    return rows.mapInArrow(_codes(model, dim), "id long, v array<double>, codes binary, norm float, cosine float")


def _put(uri: str):
    def run(pdf):
        put(
            uri, int(pdf["block"].iloc[0]),
            {"rows": pdf["row"].to_numpy(np.int64), "ids": pdf["id"].to_numpy(np.int64), "vectors": np.stack(pdf["v"]).astype(np.float64)},
        )
        return pdf.iloc[:1][["block"]]

    return run


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest number near 1: cosines stay the same to the bit, and none overflows."""
    _, power = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -power)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, both :func:`_scaled`; equal rows give equal bits."""
    return np.einsum("ij,ij->i", np.broadcast_to(q, x.shape).copy(), x) / (_length(q[None]) * _length(x))


def _scan(model: Books, dim: int, uri: str, blocks: int, k: int, keep: int):
    m, n, d = model.entries.shape
    #: What single precision may lose in a lookup, with room.
    slack = 2e-5 * float(np.sqrt((model.entries**2).sum(2)).max(1).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor: dict[int, np.ndarray] = {}  # by query block: k-th best scores of this task so far
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column("id").to_numpy(), kind="stable")
            ids, x = batch.column("id").to_numpy()[order], _matrix(batch.column("v"), dim)[order]
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, m)[order]
            norms, cosine = (np.maximum(batch.column("norm").to_numpy()[order], 1e-12)), batch.column("cosine").to_numpy()[order].astype(np.float64)
            off = slack / norms.astype(np.float64)
            aside = np.sqrt(np.maximum(1 - cosine * cosine, 0) + 2e-6)
            x = _scaled(x)
            scaled = x.copy()
            scaled /= _length(scaled)[:, None]
            for block in range(blocks):
                queries, vectors = np.asarray(get(uri, block, "ids")).astype(np.int64), np.asarray(get(uri, block, "vectors"))
                numbers = np.asarray(get(uri, block, "rows")).astype(np.int64)
                if not len(queries):
                    continue
                vectors = _scaled(vectors)
                unit = vectors.copy()
                unit /= _length(unit)[:, None]
                table = (unit.astype(np.float32) @ model.entries.reshape(-1, d).T).reshape(-1, m, n)
                least, found = floor.setdefault(block, np.full((len(queries), k), -np.inf)), []
                for j, q in enumerate(queries.tolist()):
                    score = (sum(table[j, i, codes[:, i]] for i in range(m)) / norms).astype(np.float64)
                    first = np.argpartition(score, -keep)[-keep:] if len(ids) > keep else np.arange(len(ids))
                    known = np.r_[least[j], scaled[first] @ unit[j]]
                    floor_now = np.sort(known)[-k] - 1e-9
                    near = np.clip(score, -1, 1)
                    most = near * cosine + np.sqrt(1 - near * near + 2 * off) * aside + 2 * off  # cosine of the difference of both angles
                    reach = np.flatnonzero((most >= floor_now) | (near + off + 1e-6 >= cosine))
                    close = (scaled[reach] if 8 * len(reach) < len(ids) else scaled) @ unit[j]
                    close = close if len(close) == len(reach) else close[reach]
                    top = reach[close >= floor_now]
                    exact = _exact(vectors[j], x[top])
                    best = np.lexsort((ids[top], -exact))[:k]
                    least[j] = np.sort(np.r_[least[j], exact[best]])[-k:]
                    own = (ids[top[best]] == q) & (exact[best] == _exact(vectors[j], vectors[j][None])[0])  # as the query's own row would be
                    found.append((np.full(len(best), numbers[j]), np.full(len(best), q), ids[top[best]], exact[best], own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found)], names=["row", "query_id", "vec_id", "score", "own"],
                )

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = KEEP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query`` (a condition on ``id``) its ``k`` nearest others by cosine."""
    rows, dim = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(sample):
        return rows.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"),
        ).where("false")
    model = learn(_unit(np.stack(sample["v"]).astype(np.float64)))
    asked = saved(rows.where(is_query).withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks, uri = max(1, -(-asked.count() // QUERY_BLOCK)), new_dir(rows.sparkSession, "asked")
    done = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(
        _put(uri), "block int",
    ).collect()
    seal(uri, blocks, [r["block"] for r in done], "rows", "ids", "vectors")
    # one more than asked for: the query's own row is among them, or so many others as near that it doesn't matter
    exact = index(rows, model, dim).mapInArrow(
        _scan(model, dim, uri, blocks, k + 1, keep), "row long, query_id long, vec_id long, score double, own boolean",
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    seen = Window.partitionBy("row").orderBy("place")
    rest = best.withColumn("copies", F.sum(F.col("own").cast("int")).over(seen)).where("NOT (own AND copies = 1)")
    return rest.withColumn("rank", F.row_number().over(seen)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
