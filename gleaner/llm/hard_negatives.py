"""Hard negatives by a full sort of every anchor's scores.

Components become integers, ``floor(256 * x)``, and a row's score is its inner product with the anchor: exact, whatever the order of
sums. An anchor's positives are its first rows of the same label; for each of them, the first rows of other labels whose score is at
most the positive's and at least ``low`` percent of it are its negatives. Higher scores come first, ties by smaller id.

Rows are dealt into blocks of bounded size. A block's rows are sorted by id once and, for each anchor, stably by score; a binary search
finds where a positive's upper limit lies, and entries are read from there until there are enough or the lower limit is passed. Blocks
are met twice, for positives and for negatives, and each gives at most as many rows as are asked for: the best of all blocks' best are
the best of all rows. Anchors lie in blocks in the shared folder; no task holds all anchors, all rows or all scores of an anchor.

Rows with a null id, label or vector, or with a null or non-finite component take no part; nor do rows whose scaled components' squares
sum to more than 2^61, since scores have 64 bits. A row meets rows of its own length only (a vector without components scores 0). Rows
are told apart by themselves, not by ids: a repeated id or a repeated row is another row, and an anchor that occurs twice is answered
twice. A positive without negatives, and an anchor without positives, give no rows; so does an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch, get, put, saved, seal
from ._text import give_back

#: Anchors that are scored against a block of rows at a time; numbers that a block of rows holds at most, and its rows.
ANCHORS, NUMBERS, ROWS = 128, 1 << 21, 16384
LARGEST = 2.0**61
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, label, v, anchor)`` of the rows that take part; labels as text."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x * 256) + 1) * (F.abs(x * 256) + 1))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite).where(square <= LARGEST)


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), dim)


def _put(uri: str, *columns: str, prefix: str = ""):
    """Write a block of anchors, or of what was found for them, by anchor."""

    def run(pdf):
        pdf = pdf.sort_values([c for c in ("anchor", "place") if c in pdf])
        kinds = {"v": lambda x: np.floor(256 * np.stack(x).astype(np.float64)), "label": lambda x: x.to_numpy().astype("U")}
        put(uri, int(pdf["block"].iloc[0]), {prefix + c: kinds.get(c, lambda x: x.to_numpy(np.int64))(pdf[c]) for c in columns})
        return pdf.iloc[:1][["block"]]

    return run


@dataclass
class Block:
    """Rows of one length, by id."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Whole inner products; in floating point where no sum can leave the whole numbers it holds, by Cauchy and Schwarz."""
        most = np.sqrt((anchors * anchors).sum(1).max(initial=0)) * np.sqrt((self.v * self.v).sum(1).max(initial=0))
        if most < 2.0**52:
            return (anchors @ self.v.T).astype(np.int64)
        return anchors.astype(np.int64) @ self.v.T.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows of a task in blocks that ``NUMBERS`` and ``ROWS`` bound, those of each length apart."""

    def made(parts: list[pa.RecordBatch], dim: int) -> Block:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return Block(ids[order], rows["label"].to_numpy().astype("U")[order], _whole(rows["v"].combine_chunks(), dim)[order])

    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dim))
            most = max(1, min(ROWS, NUMBERS // max(1, dim)))
            for a in range(0, own.num_rows, most):
                parts = held.setdefault(dim, [])
                piece = own.slice(a, most)
                if sum(p.num_rows for p in parts) + piece.num_rows > most:
                    yield made(held.pop(dim), dim)
                    parts = held.setdefault(dim, [])
                parts.append(piece)
    for dim, parts in held.items():
        yield made(parts, dim)


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, highest first, ties in the order given."""
    if len(scores) > 4 * n:
        some = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return some[np.argsort(-scores[some], kind="stable")[:n]]
    return np.argsort(-scores, kind="stable")[:n]


def _same(uri: str, blocks: list[tuple[int, int]], n: int):
    """``(anchor, score, id)``: the first n rows of the anchor's label in each block of rows, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            for block, dim in blocks:
                if dim != rows.v.shape[1]:
                    continue
                numbers, labels = get(uri, block, "anchor"), get(uri, block, "label")
                scores, found = rows.scores(np.asarray(get(uri, block, "v"))), []
                for j, label in enumerate(labels):
                    own = np.flatnonzero(rows.labels == label)
                    best = own[_first(scores[j, own], n)]
                    found.append((np.full(len(best), numbers[j]), scores[j, best], rows.ids[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor", "score", "id"])
        give_back()

    return run


def _other(uri: str, blocks: list[tuple[int, int]], n: int, low: int):
    """``(anchor, place, score, id)``: each block's first n rows of other labels between the limits of the anchor's positive there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            for block, dim in blocks:
                if dim != rows.v.shape[1]:
                    continue
                numbers, labels = np.asarray(get(uri, block, "anchor")), get(uri, block, "label")
                at, place, upper = (np.asarray(get(uri, block, c)) for c in ("positive-anchor", "positive-place", "positive-score"))
                first, last = np.searchsorted(at, numbers, "left"), np.searchsorted(at, numbers, "right")
                scores, found = rows.scores(np.asarray(get(uri, block, "v"))), []
                for j, label in enumerate(labels):
                    other = np.flatnonzero(rows.labels != label)
                    order = other[np.argsort(-scores[j, other], kind="stable")]  # rows lie by id, so ties do too
                    falling = -scores[j, order]
                    for k in range(first[j], last[j]):
                        start = int(np.searchsorted(falling, -upper[k], "left"))
                        best = order[start : start + n]
                        best = best[scores[j, best] >= -(-low * int(upper[k]) // 100)]
                        found.append(
                            (np.full(len(best), numbers[j]), np.full(len(best), place[k], np.int32), scores[j, best], rows.ids[best])
                        )
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor", "place", "score", "id"],
                    )
        give_back()

    return run


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id",
    label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where ``is_anchor`` holds (a condition
    on the table's columns) and each of its positives, up to ``negatives`` rows."""
    spark, store = vectors.sparkSession, Scratch(vectors.sparkSession, "mine")
    rows = store.saved(usable(vectors, is_anchor, id_col, label_col, vector_col))
    anchors = store.saved(
        rows.where("anchor").select("id", "label", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("anchor")),
        "anchors",
    )
    # so many blocks for the anchors of each length that each has about ANCHORS
    lengths = {r["dim"]: -(-r["n"] // ANCHORS) for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()}
    start, blocks = {}, []
    for dim, n in lengths.items():
        start[dim] = len(blocks)
        blocks += [(len(blocks) + i, dim) for i in range(n)]
    if not blocks:
        store.clear()
        return spark.createDataFrame([], RESULT)
    at = F.create_map(
        *[F.lit(x) for dim, n in lengths.items() for x in (dim, F.struct(F.lit(start[dim]).alias("start"), F.lit(n).alias("n")))]
    )[F.col("dim")]
    anchors = anchors.withColumn("block", (at["start"] + F.pmod(F.xxhash64("anchor"), at["n"])).cast("int"))
    uri = store.dir("blocks")
    done = anchors.groupBy("block").applyInPandas(_put(uri, "anchor", "label", "v"), "block int").collect()
    seal(uri, len(blocks), [r["block"] for r in done], "anchor", "label", "v")
    blocks = [b for b in blocks if b[0] in {r["block"] for r in done}]

    wide = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("size")).first()
    tasks = max(
        -(-wide["n"] // ROWS), -(-(wide["size"] or 0) // NUMBERS), min(spark.sparkContext.defaultParallelism, -(-wide["n"] // 1024)),
    )
    dealt = rows.select("id", "label", "v").repartition(tasks)

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = dealt.mapInArrow(_same(uri, blocks, positives + 1), "anchor long, score long, id long").withColumn(
        "place", F.row_number().over(order),
    ).where(F.col("place") <= positives + 1)
    # the anchor itself is one of those rows: one that has its id and its score with itself goes, or none, if it came too late
    itself = anchors.select(
        "anchor", "block", F.col("id").alias("anchor_id"),
        F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + F.floor(x * 256) * F.floor(x * 256)).alias("own"),
    )
    own = Window.partitionBy("anchor").orderBy("place")
    rest = best.join(itself, "anchor").withColumn("itself", (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own")))
    rest = rest.withColumn("copies", F.sum(F.col("itself").cast("int")).over(own)).where("NOT (itself AND copies = 1)")
    found = store.saved(
        rest.withColumn("place", F.row_number().over(own)).where(F.col("place") <= positives).select(
            "anchor", "block", "anchor_id", F.col("place").cast("int"), "score", "id",
        ),
        "positives",
    )
    # blocks whose anchors have no positives are not asked again
    put_found = _put(uri, "anchor", "place", "score", prefix="positive-")
    done = {
        r["block"]
        for r in found.select("block", "anchor", "place", "score").groupBy("block").applyInPandas(put_found, "block int").collect()
    }

    near = dealt.mapInArrow(_other(uri, [b for b in blocks if b[0] in done], negatives, low), "anchor long, place int, score long, id long")
    near = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")),
    ).where(F.col("rank") <= negatives)
    told = found.select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = saved(
        near.join(told, ["anchor", "place"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ),
        "negatives",
    )
    store.clear()
    return result


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
