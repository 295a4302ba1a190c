"""N-gram Jaccard join with token-combination prefixes.

A text's set is its distinct 5-word shingles. The method:

1. Spark counts in how many texts each shingle stands; those in two or more go to sorted arrays that workers map.
2. The global order is (that count, hash). Two sets with Jaccard >= t share at least k = 2 of the first
   ``n - ceil(t n) + k`` shingles of either set, the extended prefix. Shingles of one text only can't be shared and are
   skipped, so most texts index nothing.
3. Equal sets are one class (by a 64-bit digest of the set), so groups of exact copies weigh no more than one text.
4. Classes that share a key are candidates: rare shingles are keys by themselves, frequent ones only in pairs of two that
   both texts have (a shingle is frequent for all texts or for none). Keys also hold both size classes, and a text takes
   part only for those sizes of a partner for which its shared shingles can be enough. All candidates are verified, so
   every link between two classes is found; its members are linked by membership. Components come from the links.

Every link is checked on whole sets: ``100 * intersection >= percent * union``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, find, get, put, runs, saved, seal
from ._text import U, by_text, give_back, mix, pair, pieces, words_of
from .components import connected

#: Shingles a task gathers before it sends their counts on.
BUFFER = 1_500_000
SHARD_BYTES, LEAST_SHARDS = 24 << 20, 48
#: A shingle of that many texts or more is frequent, unless a text has more than MOST_COMBINED frequent ones in its prefix.
FREQUENT, MOST_COMBINED = 64, 12
#: Size classes grow by this factor.
STEP = 1.05
#: Shingles of fewer texts than this are keys without size classes.
SIZED = 16
#: Classes of a bucket that one row holds, on average, and shingles that are compared at once.
BLOCK, COLUMNS = 256, 4096
LAST = np.iinfo(np.int32).max
_M = U(0x9FB21C651E98DF25)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's start. Fewer words than ``width``: one shingle of all."""
    words = words_of(texts)
    h, n = words.hashes, words.counts
    m = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.r_[0, np.cumsum(m)]
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], m)
    out = np.zeros(len(at), np.uint64)
    length = np.repeat(np.minimum(n, width), m)
    for k in range(width):
        if (length > k).all():
            out = out * _M + h[at + k]
        else:
            on = length > k
            out[on] = out[on] * _M + h[at[on] + k]
    out = mix(out + length.astype(np.uint64))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[:-1][m > 0]] = True
    return out[new], np.r_[0, np.cumsum(by_text(new, first))]


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, byte by byte, so that Spark's codec finds their zeros."""
    steps = np.diff(sorted_keys, prepend=np.uint32(0)).astype(np.uint32)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32)[:, 0], dtype=np.uint32)


def _count(shards: int, width: int):
    def blocks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        h = ((h % U(shards)) << U(32)) | (h >> U(32))
        h.sort()
        at = runs(h)
        counts = np.minimum(np.diff(np.r_[at, len(h)]), 65535).astype(np.uint16)
        h = h[at]
        bounds = np.searchsorted(h, np.arange(shards + 1, dtype=np.uint64) << U(32))
        own = np.flatnonzero(np.diff(bounds))
        keys = h.astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own, pa.int32()), pa.array([_pack(keys[bounds[k] : bounds[k + 1]]) for k in own], pa.binary()),
                pa.array([counts[bounds[k] : bounds[k + 1]].tobytes() for k in own], pa.binary()),
            ],
            names=["shard", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in pieces(batches):
            held.append(shingles(batch.column("text"), width)[0])
            size += len(held[-1])
            if size >= BUFFER:
                yield from blocks(held)
                held, size = [], 0
        if size:
            yield from blocks(held)

    return run


def _merge(at: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys = np.concatenate([_unpack(x) for x in pdf["keys"]])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["counts"]])
        order = np.argsort(keys)
        keys = keys[order]
        first = runs(keys)
        total = np.minimum(np.add.reduceat(counts[order], first, dtype=np.int64), 65535)
        shared = total > 1
        put(at, shard, {"key": keys[first][shared], "df": total[shared].astype(np.uint16)})
        del keys, counts, order, total, first, shared
        give_back()
        return pd.DataFrame({"shard": [shard]})

    return run


def _frequencies(at: str, shards: int, h: np.ndarray) -> np.ndarray:
    """In how many texts each shingle stands, 1 if it isn't stored."""
    out = np.ones(len(h), np.uint16)
    key = ((h % U(shards)) << U(32)) | (h >> U(32))
    order = np.argsort(key)
    key = key[order]
    bounds = np.searchsorted(key, np.arange(shards + 1, dtype=np.uint64) << U(32))
    for k in np.flatnonzero(np.diff(bounds)):
        part = order[bounds[k] : bounds[k + 1]]
        i, there = find(get(at, int(k), "key"), key[bounds[k] : bounds[k + 1]].astype(np.uint32))
        out[part[there]] = get(at, int(k), "df")[i[there]]
    return out


_MARKS = "id long, n long, cls long, rest long, tokens array<long>, dfs array<int>, places array<int>, hot int, held binary"


def _mark(at: str, shards: int, width: int, percent: int):
    """Per text: size and class of its set; where its prefix has shared shingles, those and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, first = shingles(batch.column("text"), width)
            n = np.diff(first)
            df = _frequencies(at, shards, h)
            cls = mix(by_text(mix(h ^ U(0x5851F42D4C957F2D)), first) + n.astype(np.uint64))
            prefix = np.minimum(n, n - -(-percent * n // 100) + 2)
            single = by_text(df == 1, first)
            tokens, dfs, places, hot, held, size = [], [], [], np.zeros(len(n), np.int32), [None] * len(n), np.zeros(len(n), np.int64)
            for i in np.flatnonzero((prefix > single) & (n > 1)):
                a, b = first[i], first[i + 1]
                own, times = h[a:b], df[a:b]
                order = np.argsort(times, kind="stable")[single[i] : prefix[i]]
                tokens.append(own[order])
                dfs.append(times[order])
                places.append(np.arange(single[i], prefix[i]))
                hot[i], held[i], size[i] = (times[order] >= FREQUENT).sum(), own.tobytes(), len(order)
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            flat = [
                np.concatenate(x).astype(t) if x else np.empty(0, t) for x, t in ((tokens, np.uint64), (dfs, np.int32), (places, np.int32))
            ]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat[0].view(np.int64), *flat[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(cls.view(np.int64), mask=n == 0),
                    pa.array((n - single).astype(np.int64)), *lists, pa.array(hot), pa.array(held, pa.binary()),
                ],
                names=["id", "n", "cls", "rest", "tokens", "dfs", "places", "hot", "held"],
            )

    return run


def _keep(at: str):
    """Writes what verifying needs of a shard's classes: sizes, whole sets, rare and frequent prefix shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        arrays = {"cls": pdf["cls"].to_numpy(np.int64), "size": pdf["size"].to_numpy(np.int64)}
        for name in ("held", "rare", "often"):
            lists = [np.frombuffer(x, np.uint64) for x in pdf[name]] if name == "held" else [
                np.asarray(x, np.int64).view(np.uint64) for x in pdf[name]
            ]
            arrays |= {name: np.concatenate(lists), f"{name}_at": np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)}
        put(at, int(pdf["shard"].iloc[0]), arrays)
        del arrays, lists
        give_back()
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])]})

    return run


def _common(lists: list[np.ndarray], left: int) -> np.ndarray:
    """How many values each of the first ``left`` lists of distinct values has in common with each of the others."""
    out = np.zeros((left, len(lists) - left), np.float32)
    if not out.size:
        return out
    owner, values = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    owner, first = owner[order], runs(values[order])
    many = np.diff(np.r_[first, len(values)])
    column = np.repeat(np.cumsum(many > 1) - 1, many)
    held = np.repeat(many > 1, many)
    owner, column = owner[held], column[held]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        dense = np.zeros((len(lists), int(column[hi - 1]) - a + 1), np.float32)
        dense[owner[lo:hi], column[lo:hi] - a] = 1
        out += dense[:left] @ dense[left:].T
    return out


def _first_common(lists: list[np.ndarray], left: int, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` values that each of the first ``left`` lists has in common with each of the others, in the order that all
    lists keep, and how many of them there are."""
    values, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    each, column, many = np.unique(values, return_inverse=True, return_counts=True)
    on = many[column] > 1
    place = np.full((len(lists), len(each)), LAST, np.int32)
    place[owner[on], column[on]] = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists])[on] if len(on) else 0
    place, each = place[:, many > 1], each[many > 1]
    found, n = np.zeros((left, len(lists) - left, k), np.uint64), np.zeros((left, len(lists) - left), np.int64)
    if not len(each):
        return found, n
    theirs = place[left:] < LAST
    for i in range(left):
        mine = np.flatnonzero(place[i] < LAST)
        if not len(mine):
            continue
        mine = mine[np.argsort(place[i, mine])]
        both = theirs[:, mine]
        n[i] = both.sum(1)
        for j in range(k):
            at = both.argmax(1)
            found[i, :, j] = each[mine[at]]
            both[np.arange(len(both)), at] = False
    return found, n


class _Classes:
    """What the store has of classes."""

    def __init__(self, at: str, shards: int, ids: np.ndarray):
        self.at, self.ids, self.places = at, ids, []
        for c in ids.tolist():
            shard = c % shards
            self.places.append((shard, int(get(at, shard, "cls").searchsorted(c))))
        self.size = np.array([get(at, shard, "size")[i] for shard, i in self.places], np.int64)
        self.n = np.array([(b := get(at, shard, "held_at"))[i + 1] - b[i] for shard, i in self.places], np.int64)

    def lists(self, name: str, chosen: np.ndarray | None = None) -> list[np.ndarray]:
        out = []
        for shard, i in self.places if chosen is None else (self.places[k] for k in chosen.tolist()):
            bounds = get(self.at, shard, f"{name}_at")
            out.append(get(self.at, shard, name)[bounds[i] : bounds[i + 1]])
        return out


def _links(store: _Classes, left: int, keys: list[tuple[int, int | None]], percent: int) -> np.ndarray:
    """Which of the first ``left`` classes link with which of the others, of those pairs that belong to one of these keys.

    A pair belongs to the first rare shingle that both prefixes have; without one, to the first two frequent ones.
    """
    n, m = store.n[:left, None], store.n[None, left:]
    mine = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (store.ids[:left, None] != store.ids[None, left:])
    if not mine.any():
        return mine
    first, many = _first_common(store.lists("rare"), left)
    alone = np.array([x for x, y in keys if y is None], np.int64).view(np.uint64)
    own = (many > 0) & np.isin(first[:, :, 0], alone)
    if len(alone) < len(keys):
        both, of_two = _first_common(store.lists("often"), left, 2)
        two = np.array([k for k in keys if k[1] is not None], np.int64).view(np.uint64)
        own |= (many == 0) & (of_two > 1) & np.isin(pair(both[:, :, 0], both[:, :, 1]), pair(two[:, 0], two[:, 1]))
    mine &= own
    rows, columns = np.flatnonzero(mine.any(1)), np.flatnonzero(mine.any(0))
    if not len(rows):
        return mine
    both = _common(store.lists("held", np.r_[rows, columns + left]), len(rows)).astype(np.int64)
    part = np.ix_(rows, columns)
    mine[part] &= 100 * both >= percent * (store.n[rows][:, None] + store.n[columns + left][None, :] - both)
    return mine


class _Forest:
    """Union-find: of the edges seen, those that join what wasn't joined."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y] if y in self.up else y
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[b] = a
            self.edges.append((a, b))


def _block_links(at: str, shards: int, percent: int) -> Callable[
    [pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
]:
    """Of every row ``keys, lo, hi`` of a batch: the linked classes a and b, and the numbers of rows in each."""

    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for keys, lo, hi in zip(batch.column("keys"), batch.column("lo"), batch.column("hi")):
            keys = list(zip(*(keys.values.field(c).to_pylist() for c in "xy")))
            a, b = (v.values.to_numpy() if v.is_valid else None for v in (lo, hi))
            alone = b is None
            b = a if alone else b
            store = _Classes(at, shards, np.r_[a, b])
            found = _links(store, len(a), keys, percent)
            i, j = np.nonzero(np.triu(found, 1) if alone else found)
            if len(i):
                yield a[i], b[j], store.size[i], store.size[len(a) + j]

    return of


def _summed(at: str, shards: int, percent: int):
    """Rows that each class links with, as sums, and edges ``a, b`` enough to connect what is linked; pairs are never sent on."""
    links = _block_links(at, shards, percent)

    def sent(rows: dict[int, int], forest: _Forest) -> pa.RecordBatch:
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        cls = np.fromiter(rows, np.int64, len(rows))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[cls, edges[:, 0]]), pa.array(np.r_[cls, edges[:, 1]]),
                pa.array(np.r_[np.fromiter(rows.values(), np.int64, len(rows)), np.zeros(len(edges), np.int64)]),
            ],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, forest = Counter(), _Forest()
        for batch in batches:
            for a, b, many, others in links(batch):
                for ends, weights in ((a, others), (b, many)):
                    each, to = np.unique(ends, return_inverse=True)
                    for c, n in zip(each.tolist(), np.bincount(to, weights).astype(np.int64).tolist()):
                        rows[c] += n
                for ends in zip(a.tolist(), b.tolist()):
                    forest.add(*ends)
            if len(rows) >= 50_000:
                yield sent(rows, forest)
                rows, forest = Counter(), _Forest()
        yield sent(rows, forest)

    return run


def _paired(at: str, shards: int, percent: int):
    links = _block_links(at, shards, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in links(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _written(at: str, shards: int, done: DataFrame, *names: str) -> None:
    """Run the writers; of each shard only its number comes back."""
    seal(at, shards, [r["shard"] for r in done.collect()], *names)


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, links: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Membership and links. One row per input row: ``id_col``, ``n_shingles``, ``class_id``, ``n_links``, ``component_id``; and ``(a, b)``
    with a < b for each two classes of different sets that link (lazily; None without ``links``). Rows of one class link with each other and with all rows of
    the classes theirs links with; ``n_links`` counts those rows.

    Rows link when their shingle sets have a Jaccard similarity of at least ``percent`` / 100; ``component_id`` is the least id
    reachable by links. Null and empty texts and texts of separators alone have no shingles and link with nothing: their
    component is their own id. A null id links like any other but is never a component's id (null if it has no other).
    Repeated rows stay rows. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(LEAST_SHARDS, -(-size // SHARD_BYTES)))
    way, kept_on = Scratch(spark, "join"), Scratch(spark, "join-links")
    at = way.dir("shingles")
    counts = texts.select("text").mapInArrow(_count(shards, width), "shard int, keys binary, counts binary")
    _written(at, shards, counts.repartitionById(shards, "shard").groupBy("shard").applyInPandas(_merge(at), "shard int"), "key", "df")
    marks = way.saved(texts.mapInArrow(_mark(at, shards, width, percent), _MARKS), "marks")

    posts = marks.where(F.size("tokens") > 0).select("cls", "n", "rest", "hot", F.explode(F.arrays_zip("tokens", "dfs", "places")).alias("p")).select("cls", "n", "rest", "hot", F.col("p.tokens").alias("token"), F.col("p.dfs").alias("df"), F.col("p.places").alias("place"))
    buckets = posts.groupBy("token").agg(
        F.min("cls").alias("least"), F.max("cls").alias("most"), F.max("hot").alias("hot_most"),
    ).where("least < most")
    frequent = (F.col("df") >= FREQUENT) & (F.col("hot_most") <= MOST_COMBINED)
    posts = posts.drop("hot").join(buckets.select("token", "hot_most"), "token").groupBy("token", "cls").agg(
        *(F.first(c).alias(c) for c in ("n", "rest", "place", "df")), F.first(frequent).alias("frequent"),
    )
    own = F.struct("place", "token", "df")
    texts_of = posts.groupBy("cls").agg(
        *(F.first(c).alias(c) for c in ("n", "rest")), F.sort_array(F.collect_list(F.when(~F.col("frequent"), own))).alias("rare"),
        F.sort_array(F.collect_list(F.when(F.col("frequent"), F.col("token")))).alias("often"),
    )
    texts_of = way.saved(texts_of, "prefixes")
    kept = kept_on.dir("sets")
    sets = marks.where("held is not null").join(texts_of.select("cls", F.transform("rare", lambda x: x.token).alias("rare"), "often"), "cls").groupBy("cls").agg(F.first("held").alias("held"), F.first("rare").alias("rare"), F.first("often").alias("often"), F.count("*").alias("size"))
    sets = sets.withColumn("shard", F.pmod("cls", F.lit(shards)).cast("int"))
    _written(
        kept, shards, sets.repartitionById(shards, "shard").groupBy("shard").applyInPandas(_keep(kept), "shard int"), "cls", "size",
        *(n + x for n in ("held", "rare", "often") for x in ("", "_at")),
    )

    size_class = lambda size: F.floor(F.log(size) / float(np.log(STEP))).cast("int")
    mine = size_class(F.col("n"))
    reach = lambda place: F.least(F.col("rest"), 1 + F.col("n") - place)  # noqa: E731  # what stands before the place may hold one shared shingle at most
    sizes = lambda place: F.filter(
        F.sequence(size_class(F.greatest(F.lit(1.0), F.col("n") * percent / 100.0)), size_class(F.col("n") * 100.0 / percent)),
        lambda c: (100 + percent) * reach(place) >= percent * (F.col("n") + F.pow(F.lit(STEP), c) - 1e-6),
    )
    # key: one or two shingles and, where many texts may have them, the size classes of both sides
    row = lambda x, y, c: F.struct(
        x.alias("x"), y.alias("y"), F.least(mine, c).alias("low"), F.greatest(mine, c).alias("high"), (mine <= c).alias("smaller"),
        (mine >= c).alias("larger"),
    )
    null, nothing = F.lit(None).cast("long"), F.lit(None).cast("int")
    plain = lambda x: F.struct(
        x.alias("x"), null.alias("y"), nothing.alias("low"), nothing.alias("high"), F.lit(True).alias("smaller"),
        F.lit(True).alias("larger"),
    )
    alone = texts_of.select("cls", "n", "rest", F.explode("rare").alias("p"))
    alone = alone.select(
        "cls",
        F.inline(
            F.when(F.col("p.df") < SIZED, F.array(plain(F.col("p.token")))).otherwise(
                F.transform(sizes(F.col("p.place")), lambda c: row(F.col("p.token"), null, c))
            )
        ),
    )
    several = texts_of.where(F.size("often") > 1).select("cls", "n", "rest", F.posexplode("often").alias("i", "x"), "often").select(
        "cls", "n", "rest", "x", F.explode(F.slice("often", F.col("i") + 2, MOST_COMBINED)).alias("y"),
    )
    several = several.select("cls", F.inline(F.transform(sizes(F.lit(0)), lambda c: row(F.col("x"), F.col("y"), c))))
    keys = alone.unionByName(several).withColumn("key", F.xxhash64("x", "y", "low", "high"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.bool_or("smaller").alias("some"), F.bool_or("larger").alias("others"), F.count("*").alias("many")).where("lo < hi AND some AND others").select("key", F.ceil(F.col("many") / BLOCK).alias("blocks"))
    keys = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks"))
    # a bucket's classes in blocks: one of either side, or of those that are on both
    side = F.when(F.col("smaller") & F.col("larger"), 2).when(F.col("smaller"), 0).otherwise(1)
    lists = kept_on.saved(
        keys.groupBy("key", "blocks", "block", side.alias("side")).agg(
            F.first("x").alias("x"), F.first("y").alias("y"), F.sort_array(F.collect_list("cls")).alias("all"),
        ),
        "lists",
    )
    one = lists.where("side = 2 AND blocks = 1 AND size(all) > 1").select(
        "x", "y", F.col("all").alias("lo"), F.lit(None).cast("array<long>").alias("hi"),
    )
    other = lists.where("side = 1 OR (side = 2 AND blocks > 1)").select(
        "key", F.col("side").alias("other_side"), F.col("block").alias("other_block"), F.col("all").alias("hi"),
    )
    meet = lists.where("(side = 2 AND blocks > 1) OR side = 0").join(other, "key").where(
        "(side = 0 AND other_side = 1) OR (side = 2 AND other_side = 2 AND block <= other_block)"
    )
    same = (F.col("side") == 2) & (F.col("block") == F.col("other_block"))
    meet = one.unionByName(meet.select("x", "y", F.col("all").alias("lo"), F.when(~same, F.col("hi")).alias("hi")))
    # what has many keys in common meets once
    meet = meet.groupBy("lo", "hi").agg(F.collect_list(F.struct("x", "y")).alias("keys"))
    sums = way.saved(meet.mapInArrow(_summed(kept, shards, percent), "a long, b long, links long"), "links")
    labels = connected(sums.where("a <> b"))

    rows = marks.select("id", "n", "cls")
    rows = way.saved(
        rows.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("id", "n", "cls", F.coalesce("label", "cls").alias("label")),
        "rows",
    )
    least = rows.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    members = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("size"))
    others = sums.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))
    many = members.join(others, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    found = rows.join(least, "label", "left").join(many, "cls", "left")
    found = saved(
        found.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        ),
        "joined",
    )
    way.clear()
    if not links:
        kept_on.clear()
        return found, None
    pairs = meet.mapInArrow(_paired(kept, shards, percent), "a long, b long")
    return found, pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of :func:`join` without its links."""
    return join(docs, id_col, text_col, width, percent, links=False)[0]


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
