"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its texts in a pseudorandom order, form one stream that is cut into blocks of ``block`` words. A
source fills as many slots as its target has blocks. A pseudorandom permutation of all slots deals them to output shards of
``SHARD`` places, so a shard's source counts are a multinomial draw in the shares of the targets, given that each source's total
is exact. Slot j of a source takes the block at index ``permutation(j)``: a swap-or-not shuffle of the source's blocks, another
one in each epoch. Blocks and slots are joined by (source, index). A block is used twice at most, since no target is above twice
its source.

Nothing but a row for each source passes one task: running sums go through buckets and groups of buckets, and hot sources
fall in many of them. Equal seeds give equal results, whatever the partitions.

Edge cases: null and empty texts have size 0 and give nothing. A null source is a source, the last one. Repeated rows are
separate texts. With no words at all every target is 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import saved

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
ROUNDS = 12
#: Texts in a bucket and buckets in a group of them, on average.
IN_BUCKET, IN_GROUP = 128, 1024
#: Slots of a shard of the output (the last one may have fewer), slots that are made from one row, and such rows of one task.
SHARD, CHUNK, CHUNKS = 4096, 2048, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 (n > 0) for each key: swap-or-not, so it is one for every n."""

    def swap(x: Column, k: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(F.lit(0), k, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(1), k, F.greatest(x, y), *key), F.lit(2)) == 0, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def shares(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` -> also ``target``.

    Weights go round the sources by code point, null last. They share ``total`` times all sizes; what a source can't take
    beyond ``most`` times its size goes to the others by weight. That level is found from running sums in the order of
    (cap / weight), not by repetition.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.lit(float(total)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    rows = rows.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    return rows.select(
        "source", "source_size", F.least(F.coalesce(F.max("level").over(whole) * F.col("weight"), F.col("cap")), "cap").alias("target"),
    )


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """One row per input row: ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, words unless said otherwise."""
    return _taken(*_parts(docs, id_col, text_col, source_col, block, seed), id_col)


def slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The plan of the mix: slots ``(key, slot, shard, place, block, upto)``, ``upto`` being the words of the block that are taken, and
    pieces ``(id, key, block, a, b, from_word)``: words ``a`` to ``b`` of the block are the text's words from ``from_word`` on."""
    _, _, slot_rows, pieces = _parts(docs, id_col, text_col, source_col, block, seed)
    return slot_rows, pieces.select(
        "id", "key", "block", "a", "b", (F.col("block") * block + F.col("a") - F.col("start")).alias("from_word"),
    )


def _parts(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, seed: int):
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("key"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("at"),
    )
    rows = saved(rows, "sizes")
    sources = shares(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("key", _key(F.col("source")))
    sources = saved(sources, "sources")

    # where each text starts in its source's stream
    n = rows.count()
    buckets = max(1, -(-n // IN_BUCKET))
    full = rows.where("size > 0").withColumn("bucket", F.pmod("at", F.lit(buckets))).withColumn(
        "group", F.floor(F.col("bucket") / IN_GROUP),
    )
    own = full.groupBy("key", "group", "bucket").agg(F.sum("size").alias("words"))
    groups = own.groupBy("key", "group").agg(F.sum("words").alias("words"))
    up_to = lambda column, keys, order: F.sum(column).over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col(column)
    groups = groups.select("key", "group", up_to("words", ["key"], ["group"]).alias("before_group"))
    own = own.select("key", "group", "bucket", up_to("words", ["key", "group"], ["bucket"]).alias("before_bucket")).join(groups, ["key", "group"]).select("key", "bucket", (F.col("before_group") + F.col("before_bucket")).alias("before"))
    full = full.withColumn("inside", up_to("size", ["key", "bucket"], ["at", F.col("id").asc_nulls_last(), "size"]))
    full = full.join(own, ["key", "bucket"]).select("id", "key", "size", (F.col("before") + F.col("inside")).alias("start"))

    # blocks: the pieces of texts that each holds
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = full.select("*", F.explode(F.sequence(first, last)).alias("block"))
    pieces = pieces.withColumns(
        {
            "a": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
            "b": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)),
        }
    )

    # slots: whole epochs of a source's blocks, then some of them, the last one cut
    wanted = F.round("target").cast("long")
    s = sources.where("source_size > 0").withColumns(
        {"blocks": F.ceil(F.col("source_size") / block), "epochs": F.floor(wanted / F.col("source_size"))}
    )
    s = s.withColumn("rest", wanted - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("more", F.ceil(F.col("rest") / block)).withColumn("slots", F.col("epochs") * F.col("blocks") + F.col("more"))
    all_, before = Window.partitionBy(), Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"all": F.sum("slots").over(all_), "before": F.coalesce(F.sum("slots").over(before), F.lit(0))}).where("slots > 0")
    chunks = s.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    many = s.agg(F.sum(F.ceil(F.col("slots") / CHUNK))).first()[0] or 1
    chunks = chunks.repartition(int(-(-many // CHUNKS)), "key", "chunk")  # a number of its own, or a few rows would stay in one task
    slot_rows = chunks.select(
        "*", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)).alias("slot"),
    )
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    dealt = permuted(F.col("before") + F.col("slot"), F.col("all"), F.lit(seed), F.lit("deal"))
    slot_rows = slot_rows.withColumn("dealt", dealt).select(
        "key", "slot", F.floor(F.col("dealt") / SHARD).alias("shard"), (F.col("dealt") % SHARD).alias("place"),
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("key"), epoch).alias("block"),
        F.when(
            (F.col("slot") == F.col("slots") - 1) & (F.col("more") > 0), F.col("rest") - (F.col("more") - 1) * block,
        ).otherwise(F.lit(block)).alias("upto"),
    )
    return rows, sources, slot_rows, pieces


def _taken(rows: DataFrame, sources: DataFrame, slot_rows: DataFrame, pieces: DataFrame, id_col: str) -> DataFrame:
    uses = slot_rows.groupBy("key", "block").agg(F.collect_list("upto").alias("uses"))  # two at most
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda s, upto: s + F.greatest(F.least(upto, F.col("b")) - F.col("a"), F.lit(0)))
    # as large as the input's blocks: never sent to every executor, however small it looks when compressed
    got = pieces.join(uses.hint("merge"), ["key", "block"], "left").select(
        "id", "key", "size", "start", F.coalesce(taken, F.lit(0)).alias("taken"),
    )
    got = got.groupBy("id", "key", "size", "start").agg(F.sum("taken").alias("taken")).select("id", "key", "size", "taken")
    none = rows.where("size = 0").select("id", "key", "size", F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none).join(sources, "key").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
