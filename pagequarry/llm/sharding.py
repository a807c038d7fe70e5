"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` from a hash of (document, child) and the smallest draw
wins, which gives each child its weight's share. A child whose weight rises
only takes rows, one whose weight falls only loses them, and no draw depends on
another child: what moves stays within the subtrees whose weights changed, up
to the level where a weight changed.

A cluster grows by a region of its own (here of one rack and one shard), so
the new shard takes rows and no others swap: this is the law ``key``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HASH_BITS, collapsed, hash52, read, running_start, stored

Tree = list[tuple[str, float, list[tuple[str, float, list[tuple[int, float]]]]]]


def tree_of(n_shards: int, base: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """Regions of racks of shards with weight 1 each. The first ``base`` shards
    fill whole racks and regions; every later one is a region of its own."""
    first, out = min(n_shards, base), []
    for r, lo in enumerate(range(0, first, per_rack * racks)):
        members = [range(k, min(k + per_rack, first)) for k in range(lo, min(lo + per_rack * racks, first), per_rack)]
        inner = [(f"{r}/{i}", float(len(m)), [(s, 1.0) for s in m]) for i, m in enumerate(members)]
        out.append((f"{r}", sum(x[1] for x in inner), inner))
    for s in range(base, n_shards):
        out.append((f"own{s}", 1.0, [(f"own{s}/0", 1.0, [(s, 1.0)])]))
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    u = (hash52(key, F.lit(node)).cast("double") + 0.5) / float(1 << HASH_BITS)
    return -F.log(u) / weight


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; the earlier one of equals."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(children)]
    best = F.least(*draws)["i"]
    return reduce(lambda rest, x: F.when(best == x[0], x[1][2]).otherwise(rest), list(enumerate(children))[:-1], children[-1][2])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard a key descends to. A null key is a key like any other."""
    regions = []
    for region, w, racks in tree:
        inner = [(f"k{rack}", rw, _choose(key, [(f"s{s}", sw, F.lit(s)) for s, sw in shards])) for rack, rw, shards in racks]
        regions.append((f"r{region}", w, _choose(key, inner)))
    return _choose(key, regions)


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row.

    ``docs`` needs doc_id and text; other columns are ignored. Size is the bytes
    of the text plus 1 (null text: 1). Slots count from 0 without a gap in each
    shard, by a hash of doc_id, then doc_id, checksum and size: repeated rows
    take neighbouring slots of one shard. Rows without doc_id share a shard, as
    the law asks, but not a task. An empty table gives no row; long texts are
    read whole.
    """
    key = F.col("doc_id")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(key, tree).cast("int").alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        hash52(key).alias("place"),
    )
    base = stored(collapsed(base), "shards")
    placed = running_start(base, "shard", ["place", "doc_id", "text_crc32", "size"], F.lit(1).cast("long"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_shard(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), tree_of(8), tree_of(9))
