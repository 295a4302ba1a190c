"""Benchmark decontamination by latent semantic retrieval.

Words become 16-bit ids once; passages are two adjacent blocks of ``BLOCK`` words. Spark counts in how many blocks each
hashed feature stands, then sums the sketch ``A'A Omega`` of the TF-IDF blocks A, from which a randomised (Nystroem) SVD gives the
latent directions; the first ``SKIP``, common to whole languages, are left out. Passages near a benchmark part by cosine, with
enough of its weighted words, are candidates. So is every passage around which enough of the part's words stand for a common
subsequence to be long enough, whatever its cosine: it holds some of the part's rarest words, by which it is found, so none is
lost. A candidate is decided by the longest common subsequence with the words around it, and by the same for the item's answer,
its last quarter: ``lcs >= EXACT``, or ``lcs >= LOOSE`` with the answer there. What passes by ids, which several words may share, is
decided again by the words' 64-bit hashes, so texts that only share ids with an item are no leaks; equal words have equal ids, so none
that is one is missed.

Null and empty texts and items, and those without an id, match nothing. Items longer than ``PART`` words are matched in parts
of ``PART`` words, each half of the next, the last one at the item's end; only that one has the answer, as far as it goes, and
the others need ``EXACT``. Items under ``SHORT`` words need all their words in order. Repeated rows and items give one pair for
each pair of ids. Texts are read whole, and all passages are compared with all items, a bounded number of parts at a time.
Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import runs, saved
from ._text import U, give_back, pieces, words_of

BLOCK, PART, SHORT = 32, 64, 8
FEATURES, RANK, SKIP = 1 << 13, 48, 8
NEAR, COVER, EXACT, LOOSE = 0.25, 0.55, 0.8, 0.6
#: Benchmark parts that one pass over the passages holds, and blocks a task works on at once.
PARTS, AT_ONCE = 4096, 20_000
#: Of a part's rarest words, how many must stand around a passage before all of them are counted.
FIRST = 3
#: Entries that are gathered at once.
STEP = 16_384


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = row & where.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = words_of(batch.column("text"))
        ids = (words.hashes & U(0xFFFF)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([ids[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary())],
            names=["id", "words"],
        )


@dataclass
class _Blocks:
    """Sparse TF rows of blocks: entries sorted by block; ``text[b]`` is the row a block belongs to, ``at[b]`` its first word there."""

    block: np.ndarray
    feature: np.ndarray
    times: np.ndarray
    text: np.ndarray
    at: np.ndarray


def _blocks(texts: list[np.ndarray]) -> _Blocks:
    n = np.array([len(t) for t in texts], np.int64)
    many = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), many)
    first = np.r_[0, np.cumsum(many)]
    at = (np.arange(first[-1]) - first[text]) * BLOCK
    ids = np.concatenate(texts) if len(texts) else np.empty(0, np.uint16)
    start = np.r_[0, np.cumsum(n)]
    owner = np.repeat(np.arange(len(n)), n)
    block = first[owner] + (np.arange(len(ids)) - start[owner]) // BLOCK
    key = (block << 13) | (ids.astype(np.int64) & (FEATURES - 1))
    key.sort()
    k = runs(key)
    key, times = key[k], np.diff(np.r_[k, len(key)])
    return _Blocks(key >> 13, key & (FEATURES - 1), times, text, at)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, words in zip(batch.column("id").to_pylist(), batch.column("words")):
            ids.append(i)
            texts.append(np.frombuffer(words.as_buffer(), np.uint16))
            size += len(texts[-1]) + BLOCK
            if size >= AT_ONCE * BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts
    del ids, texts
    give_back()


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, blocks = np.zeros(FEATURES, np.int64), 0
    for _, texts in _chunks(batches):
        b = _blocks(texts)
        total += np.bincount(b.feature, minlength=FEATURES)
        blocks += len(b.text)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[np.arange(FEATURES), -1].astype(np.int32)), pa.array(np.r_[total, blocks])], names=["feature", "n"],
    )


def _weights(b: _Blocks, idf: np.ndarray) -> np.ndarray:
    w = ((1 + np.log(b.times)) * idf[b.feature]).astype(np.float32)
    norm = np.sqrt(np.maximum(np.bincount(b.block, w * w, len(b.text)), 1e-12)).astype(np.float32)
    return w / norm[b.block]


def _omega() -> np.ndarray:
    return np.random.default_rng(17).normal(size=(FEATURES, RANK)).astype(np.float32)


_SLABS = 64


def _sketch(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, total = _omega(), np.zeros((FEATURES, RANK), np.float64)
        for _, texts in _chunks(batches):
            b = _blocks(texts)
            w = _weights(b, idf)
            rows = np.zeros((len(b.text), RANK), np.float32)
            for a in range(0, len(w), STEP):  # pieces that stay in a core's cache
                part = slice(a, a + STEP)
                first = runs(b.block[part])
                rows[b.block[part][first]] += np.add.reduceat(omega[b.feature[part]] * w[part, None], first, axis=0)
            order = np.argsort(b.feature.astype(np.uint16), kind="stable")
            feature, block, w = b.feature[order], b.block[order], w[order]
            for a in range(0, len(w), STEP):
                part = slice(a, a + STEP)
                first = runs(feature[part])
                total[feature[part][first]] += np.add.reduceat(rows[block[part]] * w[part, None], first, axis=0)
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() % 32
        slabs = total.reshape(_SLABS, -1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(_SLABS, dtype=np.int32)), pa.array(np.full(_SLABS, task, np.int32)),
                pa.array([s.tobytes() for s in slabs], pa.binary()),
            ],
            names=["slab", "task", "sums"],
        )

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x) for x in pdf["sums"])
    return pdf.iloc[:1].assign(sums=[total.tobytes()])


@dataclass(frozen=True)
class Space:
    idf: np.ndarray
    basis: np.ndarray  # FEATURES x (RANK - SKIP)
    values: np.ndarray


def word_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return saved(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_ids, "id long, words binary"),
        "words",
    )


def latent_space(words: DataFrame) -> Space:
    """IDF and latent directions of all blocks of ``word_ids``."""
    n = {r["feature"]: r["n"] for r in words.mapInArrow(_df, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    df = np.array([n.get(i, 0) for i in range(FEATURES)], float)
    idf = np.log((n.get(-1, 0) + 1) / (df + 1)).clip(0.05).astype(np.float32)
    slabs = words.mapInArrow(_sketch(idf), "slab int, task int, sums binary").groupBy("slab", "task").applyInPandas(_add, "slab int, task int, sums binary").groupBy("slab").applyInPandas(_add, "slab int, task int, sums binary")
    rows = {r["slab"]: np.frombuffer(r["sums"]) for r in slabs.select("slab", "sums").collect()}
    sketch = np.concatenate([rows.get(k, np.zeros(FEATURES * RANK // _SLABS)) for k in range(_SLABS)]).reshape(FEATURES, RANK)
    # Nystroem: A'A ~ Z (Omega' Z)^-1 Z'
    core = _omega().astype(float).T @ sketch
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    keep = value > max(value.max(), 1e-12) * 1e-9
    basis, sigma, _ = np.linalg.svd(sketch @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False) if keep.any() else (
        np.zeros((FEATURES, 1)), np.zeros(1), None,
    )
    skip = SKIP if basis.shape[1] > 2 * SKIP else 0
    return Space(idf, basis[:, skip:].astype(np.float32), sigma[skip:])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _vectors(b: _Blocks, space: Space) -> np.ndarray:
    w = (1 + np.log(b.times)) * space.idf[b.feature]
    out = np.zeros((len(b.text), space.basis.shape[1]), np.float32)
    for a in range(0, len(w), STEP):
        part = slice(a, a + STEP)
        block = b.block[part]
        first = runs(block)
        out[block[first]] += np.add.reduceat(space.basis[b.feature[part]] * w[part, None].astype(np.float32), first, axis=0)
    return out


@dataclass(frozen=True)
class Part:
    item: int
    words: tuple[int, ...]
    #: How many of the last words are the item's answer.
    answer: int
    #: Which of the item's parts it is.
    place: int = 0

    def least(self, exact: float, loose: float) -> int:
        """Fewer common words than these are never accepted."""
        m = len(self.words)
        return m if m < SHORT else max(1, int(np.ceil((min(exact, loose) if self.answer else exact) * m - 1e-9)))

    def span(self, at: int) -> slice:
        """The words around a passage that starts at this word."""
        return slice(max(0, at - len(self.words)), at + 2 * BLOCK + len(self.words))

    def decide(self, around: list[int], exact: float, loose: float) -> tuple[float, float, bool]:
        mine = list(self.words)
        share = lcs(mine, around) / len(mine)
        told = lcs(mine[-self.answer :], around) / self.answer if self.answer else 0.0
        if len(mine) < SHORT:
            return share, told, share == 1
        return share, told, share >= exact or (share >= loose and told >= exact)


def parts_of(item: int, words: list[int]) -> list[Part]:
    """An item's parts: the whole, or pieces that overlap by half and end where it ends."""
    n, quarter = len(words), max(1, len(words) // 4)
    if n <= PART:
        return [Part(item, tuple(words), quarter)] if n else []
    starts = [*range(0, n - PART, PART // 2), n - PART]
    return [Part(item, tuple(words[a : a + PART]), min(quarter, PART // 4) if a == n - PART else 0, k) for k, a in enumerate(starts)]


def _holding(parts: list[Part], idf: np.ndarray, exact: float, loose: float):
    """A function from texts and their blocks to all pairs (block, part) around which a part has words enough to be accepted."""
    least = np.array([p.least(exact, loose) for p in parts])
    size = np.array([len(p.words) for p in parts])
    have = np.zeros((len(parts), FEATURES), np.uint8)
    rare: list[tuple[int, int]] = []
    for i, p in enumerate(parts):
        words = np.array(p.words)
        np.add.at(have[i], words & (FEATURES - 1), 1)
        # of all but least - FIRST of the part's words, the rarest, at least FIRST are there
        first = np.argsort(-idf[words & (FEATURES - 1)], kind="stable")[: len(words) - least[i] + min(FIRST, least[i])]
        rare += [(w, i) for w in np.unique(words[first]).tolist()]
    rare.sort()
    word, part = (np.array(x, np.int64) for x in zip(*rare))
    start = np.searchsorted(word, np.arange((1 << 16) + 1))

    def pairs(texts: list[np.ndarray], b: _Blocks, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(texts).astype(np.int64)
        on = np.flatnonzero(start[ids + 1] > start[ids])
        times = (start[ids + 1] - start[ids])[on]
        q = part[np.repeat(start[ids[on]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        n = np.array([len(t) for t in texts])
        text, zero = np.repeat(np.arange(len(n)), n)[on], np.r_[0, np.cumsum(n)]
        first, last = np.searchsorted(b.text, np.arange(len(n))), np.searchsorted(b.text, np.arange(len(n)), "right") - 1
        at, text = np.repeat(on - zero[text], times), np.repeat(text, times)
        lo = np.maximum((at - 2 * BLOCK - size[q]) // BLOCK + 1, 0) + first[text]  # passages whose words around hold this one
        hi = np.minimum(first[text] + (at + size[q]) // BLOCK, last[text])
        many = np.maximum(hi - lo + 1, 0)
        key = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key += np.repeat(q, many) * len(b.text)
        key.sort()
        each = runs(key)
        times, key = np.diff(np.r_[each, len(key)]), key[each]
        key = key[times >= np.minimum(FIRST, least[key // max(len(b.text), 1)])]
        q, p = key // len(b.text), key % len(b.text)
        beyond = -(-size[q] // BLOCK)
        lo, hi = np.maximum(p - beyond, first[b.text[p]]), np.minimum(p + 1 + beyond, last[b.text[p]])
        begin, count = bounds[lo], bounds[hi + 1] - bounds[lo]
        keep = np.zeros(len(p), bool)
        for s in range(0, len(p), 2000):
            k = count[s : s + 2000]
            row = np.repeat(np.arange(len(k)), k)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + begin[s : s + 2000][row]
            own = q[s : s + 2000]
            common = np.minimum(b.times[entry], have[own[row], b.feature[entry]])
            enough = np.bincount(row, common, len(k)) >= least[own]
            on = np.flatnonzero((common > 0) & enough[row])  # a word counts no more often than the part has it, over all blocks
            order = np.argsort(key := row[on] * FEATURES + b.feature[entry[on]], kind="stable")
            key = key[order]
            each = runs(key)
            if len(each):
                row = key[each] // FEATURES
                capped = np.minimum(np.add.reduceat(common[on][order], each, dtype=np.int64), have[own[row], key[each] % FEATURES])
                keep[s : s + 2000] = np.bincount(row, capped, len(k)) >= least[own]
        return p[keep], q[keep]

    return pairs


def _retrieve(space: Space, parts: list[Part], exact: float, loose: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Blocks(
            *(
                np.concatenate(x)
                for x in zip(
                    *(
                        (np.full(len(f), i), f, c)
                        for i, p in enumerate(parts)
                        for f, c in [np.unique(np.array(p.words) & (FEATURES - 1), return_counts=True)]
                    )
                )
            ),
            np.arange(len(parts)), np.zeros(len(parts), np.int64),
        )
        queries = _unit(_vectors(own, space))
        weight = np.zeros((len(parts), FEATURES), np.float32)
        weight[own.block, own.feature] = space.idf[own.feature]
        weight /= weight.sum(1, keepdims=True)
        holding, least, bags = _holding(parts, space.idf, exact, loose), [
            p.least(exact, loose) for p in parts
        ], [Counter(p.words) for p in parts]
        for ids, texts in _chunks(batches):
            b = _blocks(texts)
            v = _vectors(b, space)
            both = v.copy()
            follows = np.flatnonzero(b.text[1:] == b.text[:-1])
            both[follows] += v[follows + 1]
            bounds = np.searchsorted(b.block, np.arange(len(v) + 1))
            passages = _unit(both)
            chosen = [holding(texts, b, bounds)]
            for a in range(0, len(passages), 4096):
                near = passages[a : a + 4096] @ queries.T
                q, p = np.nonzero((near >= NEAR).T)  # part by part, so that its weights stay in a core's cache
                p = p + a
                last = np.minimum(p + 1, len(v) - 1)
                last = np.where(b.text[last] == b.text[p], last, p)
                lo, n = bounds[p], bounds[last + 1] - bounds[p]
                for s in range(0, len(p), 2000):  # which have enough of the part's weighted words
                    k = n[s : s + 2000]
                    if not len(k):
                        continue
                    row = np.repeat(np.arange(len(k)), k)
                    entry = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + lo[s : s + 2000][row]
                    seen = weight[q[s : s + 2000][row], b.feature[entry]]
                    twice = np.bincount(row, seen, len(k))
                    own = np.flatnonzero(twice >= COVER) + s
                    chosen.append((p[own], q[own]))
            found: list[tuple[int, int, int, int, float]] = []
            p, q = (np.concatenate(x) for x in zip(*chosen))
            for pair in np.unique(q * len(v) + p).tolist():
                j, i = divmod(pair, len(v))
                text, part = int(b.text[i]), parts[j]
                around = texts[text][part.span(int(b.at[i]))].tolist()
                seen = Counter(around)
                if sum(min(k, seen[w]) for w, k in bags[j].items()) >= least[j] and part.decide(around, exact, loose)[2]:
                    found.append((ids[text], part.item, part.place, int(b.at[i]), float(passages[i] @ queries[j])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 5, kinds)],
                names=["id", "item_id", "part", "at", "cosine"],
            )

    return run


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items' parts by whole hashes."""
    for batch in pieces(batches):
        words = words_of(batch.column("text"))
        whole = words.hashes.view(np.int64)
        rows = [
            p
            for i, a, b in zip(batch.column("id").to_pylist(), words.first[:-1], words.first[1:])
            for p in parts_of(i, whole[a:b].tolist())
        ]
        columns = [
            pa.array([p.item for p in rows], pa.int64()), pa.array([p.place for p in rows], pa.int32()),
            pa.array([p.words for p in rows], pa.list_(pa.int64())), pa.array([p.answer for p in rows], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "part", "words", "answer_words"])


def _decide(exact: float, loose: float):
    """Windows of texts that stand by whole hashes: ``(id, item_id, cosine, lcs, answer)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, rows = words_of(batch.column("text")), []
            whole = words.hashes.view(np.int64)
            for i, a, b, windows in zip(
                batch.column("id").to_pylist(), words.first[:-1], words.first[1:], batch.column("windows").to_pylist(),
            ):
                for w in windows:
                    part = Part(w["item_id"], tuple(w["words"]), w["answer_words"])
                    share, told, leak = part.decide(whole[a:b][part.span(w["at"])].tolist(), exact, loose)
                    if leak:
                        rows.append((i, part.item, w["cosine"], share, told))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)],
                names=["id", "item_id", "cosine", "lcs", "answer"],
            )

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", exact: float = EXACT, loose: float = LOOSE,
) -> DataFrame:
    """Pairs ``(id_col, item_id)`` of texts and the benchmark items in them, with the best passage's cosine, LCS share and answer share."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"),
    ).distinct()
    words = word_ids(docs, id_col, text_col)
    space = latent_space(words)
    spark = docs.sparkSession
    schema = "id long, item_id long, part int, at long, cosine double"
    found = spark.createDataFrame([], schema)
    parts: list[Part] = []
    seen: set[Part] = set()

    def passed() -> DataFrame:
        return found.unionByName(saved(words.mapInArrow(_retrieve(space, list(parts), exact, loose), schema), "leaks"))

    for row in word_ids(items, "id").toLocalIterator():  # a part of the items at a time
        for part in parts_of(row["id"], np.frombuffer(row["words"], np.uint16).tolist()):
            if part not in seen:
                seen.add(part)
                parts.append(part)
        if len(parts) >= PARTS:
            found = passed()
            parts, seen = [], set()
    if parts:
        found = passed()
    # written first, so that Spark knows how few they are
    whole = saved(items.mapInArrow(_whole_parts, "item_id long, part int, words array<long>, answer_words int"), "parts")
    windows = found.where("id is not null").join(whole, ["item_id", "part"]).groupBy("id").agg(
        F.collect_list(F.struct("item_id", "words", "answer_words", "at", "cosine")).alias("windows")
    )
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
    ).join(saved(windows, "windows"), "id")
    decided = texts.mapInArrow(_decide(exact, loose), "id long, item_id long, cosine double, lcs double, answer double")
    best = decided.groupBy("id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", "best.cosine", "best.lcs", "best.answer")


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
