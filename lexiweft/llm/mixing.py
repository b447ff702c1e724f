"""Mixing sources to target weights, in words.

Each source's words, in a fixed pseudorandom order of its documents, are packed into blocks of block_words. The mix is a
row of slots, cut into output shards. Each shard draws how many of its slots every source has from a multinomial law of the
target shares, and deals them out inside it by a pseudorandom permutation. Over all shards a source's draws miss its quota
by about the root of it; slots drawn beyond a quota go, in order, to the sources that were drawn too seldom, so that the whole
is exact to a block and no block is taken too often. The k-th slot of a source goes to block perm(k mod n) of its n blocks,
with another permutation in each round; blocks are joined to the documents' parts in them by source and index. Nothing is
kept in order across tasks: permutations are Feistel networks of the index, and documents get their places by sums over
hashed bins of a bounded mean size.

The driver and each task hold a few numbers a source, and the draws; most_sources bounds the first, and more raise an error;
shards are made larger where there would be more than MOST_DRAWS draws.

Contract: one row per input row. A null text has size 0. Sources are in code point order, null last, and weigh 5, 2, 1,
repeating; targets stop at three times the source's size and the excess is shared again. Sources without words have
target 0. Reruns agree, whatever the partitioning. Repeated rows are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import column, in_arrow, materialize, table, word_count

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
#: Shards times sources: 8 MB.
MOST_DRAWS = 1 << 20
BIN_ROWS = 2048


def targets_of(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """The targets of sources in order: shares of all words by weight, none above `most` times its size."""
    target, left, free = [0.0] * len(sizes), float(sum(sizes)), {i for i, s in enumerate(sizes) if s > 0}
    while free:
        unit = left / sum(weights[i % len(weights)] for i in free)
        over = {i for i in free if weights[i % len(weights)] * unit > most * sizes[i]}
        for i in over or free:
            target[i] = float(most * sizes[i]) if over else weights[i % len(weights)] * unit
        if not over:
            break
        left -= sum(target[i] for i in over)
        free -= over
    return target


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each row a bijection of 0..n-1, chosen by seed: a Feistel network over the next even number of bits, walked
    until the value is below n."""
    index, n, seed = (np.asarray(x, np.uint64) for x in (index, n, seed))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)))
    half = np.maximum(1, np.ceil((bits + (np.uint64(1) << bits.astype(np.uint64) < n)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        h, m, s, x = half[todo], mask[todo], seed[todo], out[todo]
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + s * np.uint64(4) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def _placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (key, source, size) with start: the words of the same source before them."""
    bins = max(1, math.ceil(n_rows / BIN_ROWS))
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("key", "size"), F.lit(bins)))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    offsets = binned.groupBy("source", "bin").agg(F.sum("size").alias("n")).select("source", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bin").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = binned.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = joined["source"].eqNullSafe(offsets["source"]) & (joined["bin"] == offsets["bin"])
    return joined.join(offsets, on).select("key", joined["source"], "size", (F.col("offset") + F.col("_in")).alias("start"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, most_sources: int = 1_000_000) -> DataFrame:
    """key, size, source_size, target, taken (words that the mix takes of the document, repeats counted), n_shards (output shards that hold some)."""
    spark = docs.sparkSession
    rows = materialize(docs.select(docs[key].cast("long").alias("key"), docs[source].cast("string").alias("source"), word_count(docs[text]).alias("size")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sums.sort(key=lambda r: (r.source is None, r.source))
    words = [r.words for r in sums]
    target = targets_of(words)
    blocks = [math.ceil(w / block_words) for w in words]
    # A block of a source has words / blocks words in the mean; no block is taken more than MOST_TIMES times.
    quota = [min(MOST_TIMES * n, round(t * n / w)) if w else 0 for t, n, w in zip(target, blocks, words)]
    known = spark.createDataFrame([(r.source, i, r.words, t) for i, (r, t) in enumerate(zip(sums, target))], "source string, s int, source_size long, target double").coalesce(1)
    rows = rows.alias("r").join(F.broadcast(known.withColumnRenamed("source", "name")), F.col("r.source").eqNullSafe(F.col("name")))  # at most most_sources rows
    facts = rows.select("key", "s", "size", "source_size", "target")

    n_slots = sum(quota)
    taken = facts.select("key", "s", "size").where("size > 0")
    placed = _placed(taken.withColumnRenamed("s", "source"), sum(r.rows for r in sums)).withColumnRenamed("source", "s")
    first, last = F.col("start"), F.col("start") + F.col("size") - 1
    parts = placed.select("key", "s", "size", "start", F.explode(F.sequence(F.floor(first / block_words), F.floor(last / block_words))).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    parts = parts.select("key", "s", "size", "start", "block", overlap.alias("overlap"))
    slots = slot_blocks(spark, quota, blocks, shard_slots, seed).groupBy("s", "block").agg(F.count("*").alias("times"), F.collect_set("shard").alias("shards"))  # a block has MOST_TIMES slots at most
    counted = parts.join(slots, ["s", "block"], "left").groupBy("s", "start", "key", "size").agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("n_shards"))
    columns = ["size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("n_shards").cast("long").alias("n_shards")]
    nothing = {"taken": F.lit(0), "n_shards": F.lit(0)}
    if not n_slots:
        return facts.withColumns(nothing).select(F.col("key").alias(key), *columns)
    sized = counted.join(F.broadcast(known.drop("source")), "s").select("key", *columns)
    return sized.unionByName(facts.where("size = 0").withColumns(nothing).select("key", *columns)).withColumnRenamed("key", key)


def draws(quota: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """shards x sources: multinomial counts of each shard's slots, by the quotas' shares. The last shard may be shorter."""
    n_slots = sum(quota)
    share = np.array(quota, np.float64) / n_slots
    sizes = [shard_slots] * (n_slots // shard_slots) + [n_slots % shard_slots] * (n_slots % shard_slots > 0)
    return np.array([np.random.default_rng((seed, k)).multinomial(size, share) for k, size in enumerate(sizes)], np.int64)


def slot_blocks(spark: SparkSession, quota: list[int], blocks: list[int], shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """shard, s, block: what each slot of the mix holds."""
    n_slots, n_of, wanted = sum(quota), np.array(blocks, np.int64), np.array(quota, np.int64)
    if not n_slots:
        return spark.createDataFrame([], "shard long, s int, block long")
    shard_slots = max(shard_slots, math.ceil(n_slots / max(1, MOST_DRAWS // len(quota))))
    drawn = draws(quota, shard_slots, seed)
    edges = np.cumsum(drawn, axis=1)  # in a shard, the slots up to and with each source's
    before = np.cumsum(drawn, axis=0) - drawn  # a source's slots in the shards before
    total = drawn.sum(axis=0)
    beyond = np.cumsum(np.maximum(total - wanted, 0)) - np.maximum(total - wanted, 0)
    short = np.cumsum(np.maximum(wanted - total, 0))

    def run(batches):
        for batch in batches:
            slot = column(batch, "id").to_numpy(zero_copy_only=False)
            if not len(slot):
                continue
            shard = slot // shard_slots
            place = permute(slot % shard_slots, edges[shard, -1], seed + shard).astype(np.int64)
            s = (edges[shard] <= place[:, None]).sum(axis=1)
            k = before[shard, s] + place - (edges[shard, s] - drawn[shard, s])
            over = np.flatnonzero(k >= wanted[s])  # the source has its quota: the next one that is short gets the slot
            rank = beyond[s[over]] + k[over] - wanted[s[over]]
            s[over] = np.searchsorted(short, rank, "right")
            k[over] = wanted[s[over]] - (short[s[over]] - rank)
            n = n_of[s]
            block = permute(k % n, n, (seed + 1 + s) * 8 + k // n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(s.astype(np.int32)), pa.array(block)], ["shard", "s", "block"])

    return in_arrow(spark.range(n_slots), run, "shard long, s int, block long")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 7, **options) -> DataFrame:
    """docs, each row as often as the mix takes it: the whole part of taken / size, and once more with the probability of
    the rest, by a hash of key and seed. Rows without words, of which nothing can be taken, go."""
    taken = mix(docs, text, key, source, seed=seed, **options).where("taken > 0").groupBy(key).agg((F.sum("taken") / F.sum("size")).alias("_times")).withColumnRenamed(key, "_key")
    luck = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.col("_times") + luck).cast("int")
    return docs.join(taken, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_n", copies).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
