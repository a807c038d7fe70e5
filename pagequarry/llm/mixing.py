"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in a keyed random order and form a stream of words,
cut into blocks of ``block_words``. The source's quota is a whole number of
passes over that stream plus its first part. The block quotas of all sources
are split over the output shards: at each node of a binary tree over the
shards, one multivariate-hypergeometric draw says how many of each source's
blocks go left, so every shard gets its exact number of blocks and every
source keeps its exact quota. A keyed permutation then says which block fills
which place, so shards draw disjoint blocks, and each shard is shuffled by
another hash of its pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collapsed, feistel, hash52, mix64, numbered, running_start, stored, word_count

PIECE = T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("words", T.LongType())]))


def water_fill(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Share the sum of ``sizes`` by weight, no share above ``limit`` times its
    size; what is above goes to the others by weight until none is above."""
    target, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > limit * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in sorted(over):
            target[i] = float(limit * sizes[i])
            left -= target[i]
        free -= over
    return target


def split_quota(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), exact in both sums."""
    out = np.zeros((n_shards, len(blocks)), dtype=np.int64)
    total = int(blocks.sum())
    room = np.array([total * (k + 1) // n_shards - total * k // n_shards for k in range(n_shards)])

    def down(lo: int, hi: int, here: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = here
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, int(room[lo:mid].sum()), method="marginals")
        down(lo, mid, left)
        down(mid, hi, here - left)

    down(0, n_shards, blocks.astype(np.int64))
    return out


def _sizes(docs: DataFrame, seed: int) -> DataFrame:
    """Stored rows of doc_id, source, size, tie (a hash of the text), place and copies."""
    size, tie = word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    base = collapsed(docs.select("doc_id", "source", size, tie))
    return stored(base.withColumn("place", hash52(F.lit(seed), F.col("doc_id"), F.col("tie"), F.col("size"))), "sizes")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size,
    target, taken and ``pieces`` (one per pass: epoch, shard, place, words).

    ``docs`` needs doc_id, text and source; other columns are ignored. Null
    texts, empty texts and texts of white space have size 0 and are never
    taken. The null source is a source of its own, ordered last. Repeated rows
    are documents of their own; rows of one id or of none are told apart by
    their texts. An empty table gives an empty plan. Texts, however long, are
    counted whole; a document is cut only where its source's quota ends. One
    row per source is held on the driver. Options are those of ``_plan``.
    """
    seed = options.get("seed", 17)
    return _plan(_sizes(docs, seed), **options)


def _plan(base: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeat_limit: int = 3, n_shards: int = 8, block_words: int = 4096, seed: int = 17) -> DataFrame:
    spark = base.sparkSession
    rows = [(r["source"], r["size"]) for r in base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in rows]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeat_limit)
    quota = [min(round(t), repeat_limit * s) for t, s in zip(target, sizes)]
    part = np.array([q % s if s else 0 for q, s in zip(quota, sizes)], dtype=np.int64)
    passes = np.array([q // s if s else 0 for q, s in zip(quota, sizes)], dtype=np.int64)
    per_pass = np.array([-(-s // block_words) for s in sizes], dtype=np.int64)
    blocks = passes * per_pass + -(-part // block_words)
    until = np.cumsum(split_quota(blocks, n_shards, seed), axis=0) if len(rows) else np.zeros((n_shards, 0), np.int64)

    schema = "source string, rank int, source_size long, target double"
    known = spark.createDataFrame([(r[0], i, sizes[i], target[i]) for i, r in enumerate(rows)], schema)
    # one row per source: a few bytes each, so the driver's own list bounds it
    base = base.join(F.broadcast(known) if len(rows) <= 100_000 else known, base["source"].eqNullSafe(known["source"])).drop(known["source"])
    placed = running_start(base, "rank", ["place", "doc_id", "tie", "size"], F.col("size"), "start")

    def draw(rank: pd.Series, start: pd.Series, size: pd.Series, place: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(rank))]
        s, at, n, h = (x.to_numpy() for x in (rank, start, size, place))
        for e in range(repeat_limit):
            words = np.where(e < passes[s], n, np.where(e == passes[s], np.clip(part[s] - at, 0, n), 0))
            block = e * per_pass[s] + at // block_words
            for one in np.unique(s[words > 0]):
                mine = np.flatnonzero((s == one) & (words > 0))
                slot = feistel(block[mine], int(blocks[one]), seed * 1_000_003 + int(one))
                shard = np.searchsorted(until[:, one], slot, side="right")
                key = (mix64((h[mine] ^ at[mine] * 0x9E3779B1).astype(np.uint64) * np.uint64(8) + np.uint64(e)) >> np.uint64(1)).astype(np.int64)
                for i, k, p, w in zip(mine.tolist(), shard.tolist(), key.tolist(), words[mine].tolist()):
                    out[i].append({"epoch": e, "shard": k, "place": p, "words": w})
        return pd.Series(out)

    pieces = F.pandas_udf(draw, PIECE)("rank", "start", "size", "place")
    placed = placed.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return placed.select("doc_id", "source", "tie", "copy", "start", "size", "source_size", "target", taken.alias("taken"), "pieces")


def mix(docs: DataFrame, chunk: int = 10_000, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, one row per pass in which at
    least half of a document's words are taken, dealt to shards and shuffled in them.

    The first document of a source appears whenever a word of it is taken, so
    no source with a target of a word or more is left out. Documents that the
    quota leaves out do not appear; an empty table gives no row. Plan and rows
    meet by doc_id, text and source, and by a number within those, so null ids
    and repeated rows each keep their own share; keys of more than ``chunk``
    rows are numbered in pieces. Texts are passed whole, however long. Columns
    of any other name pass through.
    """
    key = ["id", "tie", "source"]
    known = lambda df: df.withColumns({"id": F.coalesce(F.col("id").cast("string"), F.lit("null")), "source": F.struct("source")})
    base = _sizes(docs, options.get("seed", 17))
    hot = known(base.where(F.col("copies") > chunk).select(F.col("doc_id").alias("id"), "tie", "source"))
    plan = known(_plan(base, **options).withColumnRenamed("doc_id", "id"))
    whole = F.col("p.words") * 2 >= F.col("size")
    opening = (F.col("p.epoch") == 0) & (F.col("start") == 0)
    plan = plan.select(*key, F.col("copy").alias("n"), "start", "size", F.explode("pieces").alias("p")).where(whole | opening)
    rows = known(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), "source"))
    rows = numbered(rows, key, hot, "n", chunk)
    out = rows.join(plan.select(*key, "n", F.col("p.shard").alias("shard"), F.col("p.place").alias("place")), [*key, "n"])
    # a shard is written by several tasks, each with a range of its places
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select("row", "shard", "place").repartitionByRange(parts, "shard", "place").sortWithinPartitions("shard", "place").select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
