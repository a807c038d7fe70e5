"""Near-duplicates by a chosen-path set similarity join on minwise tokens.

A document is its set of word shingles. Documents with equal sets are one
class. Every class is put in one node of each of several independent trees, by
the minwise token at the tree's root position; a node above the leaf limit is
branched, its members going to one child for each of two positions that the
node's own hash chooses among those that the tree keeps for the level, by their
tokens there. In a leaf, classes whose token vectors agree in too few places for
the threshold are set apart; what remains is compared exhaustively on full sets.
Inside a leaf a class that is already connected needs no further comparison with
its component, so links come out as stars and their number is linear in the
members. Components of all links are found by contraction.

Large families of near copies stand together in every tree and no branch parts
them. So members of root nodes above the leaf limit are first compared, in
blocks, with a centre of their node. What that connects is a family; a node of
one family needs nothing more, and elsewhere members of a family are not compared
with each other. What is still too large, at the last level or beside a family, is
cut into blocks and each pair of blocks, but two of one family, is a leaf: no
partner is capped.

A pair at the threshold t survives a tree with the chance t * (1 - (1 - t)**2)**3
of its root and three levels. ``design`` chooses the number of trees and the least
agreement of tokens so that a link is missed with a chance of at most 1e-6.

What is shuffled is kept small: of the roots only rows that meet another go on, the
families stage gives them a name without moving tokens again, and a text goes to
its leaves once computed, as its set or as itself compressed, whichever is shorter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed_width, grouped, hash_words, mix64, read, stored, text_chunks

POSITIONS = 24
LEVELS = 3
LEAF_DOCS = 4000
LEAF_SHINGLES = 4_000_000
#: So many rows of leaves go to all texts; above, texts are first sifted by a filter of 2**FILTER_BITS bits.
FEW_MEMBERS = 200_000
FILTER_BITS = 25


def design(percent: int, miss: float = 1e-6) -> tuple[int, int, int]:
    """(trees, positions, least agreement) for links at ``percent``: the trees and the
    pre-filter each lose a pair at the threshold with a chance of at most ``miss / 2``."""
    if not 30 <= percent <= 100:
        raise ValueError("percent must be from 30 to 100: below, trees would be too many")
    t = percent / 100
    survive = t * (1 - (1 - t) ** 2) ** LEVELS
    trees = 1 if survive >= 1 else math.ceil(math.log(miss / 2) / math.log1p(-survive))
    positions, least, below = max(POSITIONS, trees), 0, 0.0
    while least < positions:
        below += math.comb(positions, least) * t**least * (1 - t) ** (positions - least)
        if below > miss / 2:
            break
        least += 1
    return trees, positions, least


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    _, _, h, bounds = hash_words(data, offsets, lower=True)
    n = len(h)
    runs = np.zeros(n, dtype=np.uint64)
    if n >= k:
        whole = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            whole = mix64(whole + h[j : n - k + 1 + j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
        runs[: n - k + 1] = whole
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(runs[lo : hi - k + 1])
        elif hi > lo:
            short = np.full(1, hi - lo, dtype=np.uint64)
            for x in h[lo:hi]:
                short = mix64(short * np.uint64(0xFF51AFD7ED558CCD) + x)
            yield short
        else:
            yield runs[:0]


def _tokens(sets: list[np.ndarray], positions: int) -> np.ndarray:
    """The minwise tokens of each set, none of them empty: 32 bits of the smallest keyed
    hash of its members at every position. Different hashes that look equal there
    bring further sets together and part none."""
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    every, out = np.concatenate(sets), np.empty((len(sets), positions), dtype=np.uint32)
    for i, seed in enumerate(mix64(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))):
        x = (every ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = (np.minimum.reduceat(x, first) >> np.uint64(16)).astype(np.uint32)
    return out


def _short(tokens: np.ndarray) -> list[bytes]:
    """16 bits of each token, which is enough to see where vectors agree: too many
    places may seem to, never too few, and links are confirmed on full sets."""
    return [t.tobytes() for t in tokens.astype(np.uint16)]


def _closed(text: np.ndarray, shingles: np.ndarray) -> bytes:
    """A set as it is or as its text, compressed, whichever is shorter; the last byte tells."""
    packed = zlib.compress(text.tobytes())
    return packed + b"t" if len(packed) < shingles.nbytes else shingles.tobytes() + b"s"


def _opened(bodies: pa.Array, k: int, max_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sets that ``_closed`` packed, in order; about ``max_bytes`` are open at a time."""
    held: list[bytes | np.ndarray] = []

    def sets() -> Iterator[np.ndarray]:
        texts = [x for x in held if isinstance(x, bytes)]
        made = shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), k)
        for x in held:
            yield next(made) if isinstance(x, bytes) else x

    size = 0
    for body in bodies:
        raw = body.as_py()
        text = raw.endswith(b"t")
        held.append(zlib.decompress(raw[:-1]) if text else np.frombuffer(raw, dtype=np.uint64, count=len(raw) // 8))
        size += len(held[-1]) * (1 if text else 8)
        if size >= max_bytes:
            yield from sets()
            held, size = [], 0
    yield from sets()


def _describe(docs: DataFrame, k: int, positions: int) -> DataFrame:
    """doc_id, n, a digest of the set in two longs, and its tokens (32 bits each, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in text_chunks(batch.column("text")):
                sets = list(shingle_sets(data, offsets, k))
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                lo, hi, sig = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [None] * len(n)
                if len(some):
                    full = [sets[j] for j in some]
                    every, first = np.concatenate(full), np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    lo[some] = np.add.reduceat(mix64(every), first)
                    hi[some] = np.add.reduceat(mix64(every ^ np.uint64(0x5851F42D4C957F2D)), first)
                    for j, t in zip(some.tolist(), _tokens(full, positions)):
                        sig[j] = t.tobytes()
                columns = [batch.column("doc_id").slice(i, len(n)), pa.array(n, pa.int64()), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "lo", "hi", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, lo long, hi long, sig binary")


MEMBERS = "node long, rep long, n long, family long, tree long"


def _node(parts: np.ndarray, tree: np.ndarray | int, token: np.ndarray) -> np.ndarray:
    return mix64(parts ^ mix64(token + np.uint64(1) * np.asarray(tree, dtype=np.uint64))).view(np.int64)


def _members(b: pa.RecordBatch, node: np.ndarray, at: np.ndarray, tree: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(at)
    columns = [pa.array(node), b.column("rep").take(rows), b.column("n").take(rows), b.column("family").take(rows), pa.array(tree.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "rep", "n", "family", "tree"])


def _roots(names: DataFrame, trees: int, positions: int) -> DataFrame:
    """(node, rep, n, tree): every class at the root of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = fixed_width(b.column("sig"), np.uint32, positions)
            t = np.tile(np.arange(1, trees + 1, dtype=np.uint64), len(sig))
            node = _node(mix64(t), t, sig[:, :trees].reshape(-1).astype(np.uint64))
            rows = pa.array(np.repeat(np.arange(len(sig)), trees))
            columns = [pa.array(node), b.column("rep").take(rows), b.column("n").take(rows), pa.array((t - np.uint64(1)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "rep", "n", "tree"])

    return names.select("rep", "n", "sig").mapInArrow(run, "node long, rep long, n long, tree long")


def _children(large: DataFrame, level: int, positions: int) -> DataFrame:
    """Members of large nodes, in the children at two positions that the node's hash
    chooses. Each level of a tree has positions of its own, so none is spent twice."""
    pool = np.uint64((positions - 1) // LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = fixed_width(b.column("sig"), np.uint32, positions)
            node = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            tree = b.column("tree").to_numpy(zero_copy_only=False).astype(np.uint64)
            rows, out = np.arange(len(sig)), []
            first = mix64(node) % pool
            second = (first + np.uint64(1) + mix64(node + np.uint64(7)) % (pool - np.uint64(1))) % pool
            for pick in (first, second):
                pos = (tree + np.uint64(1) + np.uint64(level) * pool + pick) % np.uint64(positions)
                out.append(_node(mix64(node), pos + np.uint64(1000), sig[rows, pos.astype(np.int64)].astype(np.uint64)))
            yield _members(b, np.concatenate(out), np.tile(rows, 2), np.tile(tree, 2))

    return large.mapInArrow(run, MEMBERS)


def _blocks(members: DataFrame, leaf_docs: int, leaf_shingles: int) -> DataFrame:
    """(node, rep, family) of large nodes in blocks, each pair of blocks a leaf but
    for two blocks of one family. A family of less than half a leaf has no blocks
    of its own."""
    kinds = members.groupBy("node", "family").agg(F.count("*").alias("c"))
    own = kinds.where(F.col("c") * 2 > leaf_docs).select("node", "family", F.col("family").cast("string").alias("kind"))
    rows = members.join(own, ["node", "family"], "left").withColumn("kind", F.coalesce("kind", F.lit("rest")))
    sizes = rows.groupBy("node", "kind").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sizes = sizes.select("node", "kind", F.greatest(F.ceil(F.col("c") * 2 / leaf_docs), F.ceil(F.col("w") * 2 / leaf_shingles)).alias("parts"))
    listed = sizes.groupBy("node").agg(F.collect_list(F.struct("kind", "parts")).alias("kinds"))
    rows = rows.join(sizes, ["node", "kind"]).join(listed, "node")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode("kinds"))
    rows = rows.where((F.col("kind") == "rest") | (F.col("kind") != F.col("other.kind")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other.parts") - 1)))
    this, that = F.struct("kind", "b"), F.struct(F.col("other.kind").alias("kind"), F.col("o").alias("b"))
    return rows.select(F.xxhash64("node", F.least(this, that), F.greatest(this, that)).alias("node"), "rep", "family")


def _leaves(names: DataFrame, rows: DataFrame, families: bool, positions: int, leaf_docs: int, leaf_shingles: int) -> DataFrame:
    """(node, rep, family) of every node below the roots ``rows`` with members of two
    or more families, none above the leaf limits but by a single long document."""
    kept = []
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("family").alias("lo"), F.max("family").alias("hi"))
        sizes = stored(sizes.where("c > 1 and lo <> hi").drop("lo", "hi"), "sizes")
        small = (F.col("c") <= leaf_docs) & (F.col("w") <= leaf_shingles)
        kept.append(rows.join(sizes.where(small).select("node"), "node").select("node", "rep", "family"))
        large = sizes.where(~small).select("node")
        if large.isEmpty():
            break
        if level < LEVELS and families:
            # a large family beside few others needs no branch
            kinds = rows.join(large, "node").groupBy("node", "family").agg(F.count("*").alias("c"))
            beside = kinds.groupBy("node").agg((F.sum("c") - F.max("c")).alias("rest")).where(F.col("rest") * 2 <= leaf_docs)
            beside = stored(beside.select("node"), "beside")
            if not beside.isEmpty():
                kept.append(_blocks(rows.join(beside, "node"), leaf_docs, leaf_shingles))
                large = large.join(beside, "node", "left_anti")
        if level == LEVELS:
            kept.append(_blocks(rows.join(large, "node"), leaf_docs, leaf_shingles))
            break
        rows = stored(_children(rows.join(large, "node").join(names.select("rep", "sig"), "rep"), level, positions), "nodes")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _families(rows: DataFrame, leaf_docs: int, leaf_shingles: int) -> DataFrame | None:
    """(node, rep, family) of leaves that compare the members of large root nodes with
    a centre of theirs, block by block; None if no root node is large. Centres are
    least by one order of all classes, so trees mostly agree on them."""
    large = rows.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("least"))
    large = stored(large.where((F.col("c") > leaf_docs) | (F.col("w") > leaf_shingles)).select("node", F.col("least.rep").alias("centre")), "large")
    if large.isEmpty():
        return None
    pairs = stored(rows.join(large, "node").where("rep <> centre").select("centre", "rep", "n").distinct(), "pairs")
    sizes = pairs.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") * 2 / leaf_docs), F.ceil(F.sum("n") * 2 / leaf_shingles)).alias("parts"))
    cut = pairs.join(sizes, "centre").select(F.xxhash64("centre", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("node"), "centre", "rep")
    centres = cut.select("node", F.col("centre").alias("rep")).distinct()
    return cut.select("node", "rep").unionByName(centres).withColumn("family", F.col("rep"))


def _beside(sig: np.ndarray, family: np.ndarray, least: int) -> np.ndarray:
    """Members of a group that agree with one of another family, so that a large
    family brings only those that something may link to."""
    names, at, count = np.unique(family, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return np.zeros(len(family), dtype=bool)
    big = at == np.argmax(count)
    keep = ~big
    if len(family) > 8:
        for one in sig[~big]:
            keep[big] |= (sig[big] == one).sum(axis=1) >= least
    else:
        keep[:] = True
    return keep


def _agreeing(rows: pa.RecordBatch, first: np.ndarray, least: int, positions: int) -> pa.RecordBatch:
    """Splits each leaf into groups whose members' token vectors agree in ``least``
    places with some other member's, and drops members without a partner. A
    group is named by its members, so equal groups of several trees meet."""
    sig, rep = fixed_width(rows.column("short"), np.uint16, positions), rows.column("rep").to_numpy(zero_copy_only=False)
    family = rows.column("family").to_numpy(zero_copy_only=False)
    sizes = np.diff(first)
    group = np.full(len(rep), -1)
    pairs = first[:-1][sizes == 2]
    near = pairs[((sig[pairs] == sig[pairs + 1]).sum(axis=1) >= least) & (family[pairs] != family[pairs + 1])]
    group[near] = group[near + 1] = np.arange(len(near))
    made = len(near)
    for lo, hi in zip(first[:-1][sizes > 2].tolist(), first[1:][sizes > 2].tolist()):
        todo = np.arange(lo, hi)
        while len(todo):
            whole, front, todo = [todo[:1]], [todo[0]], todo[1:]
            while front and len(todo):
                close = (sig[todo] == sig[front.pop()]).sum(axis=1) >= least
                front += todo[close].tolist()
                whole.append(todo[close])
                todo = todo[~close]
            at = np.concatenate(whole)
            group[at[_beside(sig[at], family[at], least)]] = made
            made += 1
    rep, group = rep[group >= 0], group[group >= 0]
    keep = np.bincount(group, minlength=made)[group] > 1
    rep, group = rep[keep], group[keep]
    name = np.zeros(made, dtype=np.uint64)
    np.add.at(name, group, mix64(rep.view(np.uint64) + np.uint64(11)))
    return pa.RecordBatch.from_arrays([pa.array(name[group].view(np.int64)), pa.array(rep)], names=["leaf", "rep"])


def stars(sets: list[np.ndarray], sig: np.ndarray, rep: np.ndarray, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of a leaf as (member, smallest member of its component there)."""
    sizes = np.array([len(s) for s in sets])
    every, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
    root, todo = np.arange(len(rep)), np.arange(len(rep))
    while len(todo):
        first, todo = todo[0], todo[1:]
        front = [first]
        while front and len(todo):
            p = front.pop()
            near = (sig[todo] == sig[p]).sum(axis=1) >= least
            near &= (sizes[todo] * 100 >= sizes[p] * percent) & (sizes[p] * 100 >= sizes[todo] * percent)
            hit = np.zeros(len(todo), dtype=bool)
            for j in np.flatnonzero(near):
                s = every[at[todo[j]] : at[todo[j] + 1]]
                where = np.searchsorted(sets[p], s)
                common = int((sets[p][np.minimum(where, sizes[p] - 1)] == s).sum())
                hit[j] = 100 * common >= percent * (sizes[p] + len(s) - common)
            front += todo[hit].tolist()
            root[todo[hit]] = first
            todo = todo[~hit]
    moved = root != np.arange(len(rep))
    return rep[moved], rep[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b), for every id in one.

    Each round points every node to its smallest neighbour, follows pointers
    twice and contracts, so chains shorten by a factor and stars close at once.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "pointers")
        for _ in range(2):
            nxt = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            point = point.join(nxt, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        point = stored(point, "pointers")
        left, right = point.select("a", F.col("p").alias("x")), point.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(edges, "edges")
        point = point.withColumnsRenamed({"a": "id", "p": "root"})
        if labels is None:
            labels = point
        else:
            step = point.select(F.col("id").alias("root"), F.col("root").alias("_r"))
            labels = stored(labels.join(step, "root", "left").select("id", F.coalesce("_r", "root").alias("root")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents named in ``ids`` and of few others, by a Bloom
    filter of two bits to an id. Its size is fixed, so with very many ids more
    others pass; none is missed, and the join after it drops the others."""
    width, mask = FILTER_BITS, (1 << FILTER_BITS) - 1
    h = F.xxhash64("doc_id")
    spots = ids.select(F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, width).bitwiseAND(F.lit(mask)))).alias("p"))
    spots = spots.select(F.floor(F.col("p") / 32768).alias("b"), (F.col("p") % 32768).alias("at"))
    bits = np.zeros((1 << max(width, 15)) // 8, dtype=np.uint8)
    for r in spots.groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        bits[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            keep = np.ones(len(x), dtype=bool)
            for p in (x & np.uint64(mask), (x >> np.uint64(width)) & np.uint64(mask)):
                keep &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield b.select(["doc_id", "text"]).filter(pa.array(keep))

    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(run, "doc_id long, text string")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, leaf_docs: int = LEAF_DOCS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Two documents are linked if their sets of ``words``-word shingles (the whole
    text as one, if shorter) have 100 * intersection >= percent * union; every
    link is confirmed on full sets, and one at the threshold is missed with a
    chance of at most ``miss``. component_id is the smallest doc_id reachable.
    Null, empty and white texts have no shingles and no link. Rows without
    doc_id have no link, a null component_id, and are kept. Repeated rows stay,
    with one component. An empty table gives no row. ``docs`` needs doc_id and
    text; other columns are ignored. No text is cut, no group capped.
    """
    trees, positions, least = design(percent, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stored(_describe(docs, words, positions), "described")
    full = described.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")), "classes")
    # one document may stand, repeated under its id, for several sets: name all but one of these by digest
    several = stored(classes.groupBy("least").agg(F.count("*").alias("c")).where("c > 1").select("least"), "several")
    names = classes.withColumn("rep", F.col("least"))
    if not several.isEmpty():
        digest = F.struct("lo", "hi", "n")
        own = classes.select("least", "lo", "hi", "n").join(several, "least").groupBy("least").agg(F.min(digest).alias("own"))
        rep = F.when(F.col("own").isNull() | (digest == F.col("own")), F.col("least")).otherwise(F.xxhash64("lo", "hi"))
        names = stored(classes.join(own, "least", "left").withColumn("rep", rep).drop("own"), "names")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = fixed_width(b.column("sig"), np.uint32, positions)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(_short(sig), pa.binary())], names=["rep", "short"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("lo").to_numpy(zero_copy_only=False)
            for i, data, offsets in text_chunks(batch.column("text")):
                made = list(shingle_sets(data, offsets, words))
                good = [j for j, s in enumerate(made) if len(s) and int(mix64(s).sum(dtype=np.uint64).view(np.int64)) == wanted[i + j]]
                at = pa.array([i + j for j in good], pa.int64())
                short = _short(_tokens([made[j] for j in good], positions)) if good else []
                body = [_closed(data[offsets[j] : offsets[j + 1]], made[j]) for j in good]
                columns = [batch.column("leaves").take(at), batch.column("rep").take(at), pa.array(short, pa.binary()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["leaves", "rep", "sig", "body"])

    def link(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        sig, rep = fixed_width(rows.column("sig"), np.uint16, positions), rows.column("rep").to_numpy(zero_copy_only=False)
        opened, left, right = _opened(rows.column("body"), words), [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            sets = [next(opened) for _ in range(lo, hi)]
            by = np.unique(rep[lo:hi], return_index=True)[1]
            a, b = stars([sets[i] for i in by.tolist()], sig[lo + by], rep[lo + by], percent, least)
            left.append(a)
            right.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    tokens = names.select("rep", "sig").mapInArrow(shorten, "rep long, short binary")

    def links(leaves: DataFrame) -> DataFrame:
        known = leaves.join(tokens, "rep").select("node", "rep", "family", "short")
        groups = grouped(known, "node", lambda rows, first: _agreeing(rows, first, least, positions), "leaf long, rep long")
        groups = stored(groups.distinct(), "groups")
        # the document that stands for a class brings its text to all leaves of the class
        holders = groups.groupBy("rep").agg(F.collect_list("leaf").alias("leaves"))
        holders = stored(holders.join(names.select("rep", F.col("least").alias("doc_id"), "lo"), "rep"), "holders")
        few = groups.count() <= FEW_MEMBERS
        texts = docs.join(F.broadcast(holders), "doc_id") if few else _sifted(docs, holders.select("doc_id")).join(holders, "doc_id")
        sets = texts.select("leaves", "rep", "lo", "text").mapInArrow(sets_of, "leaves array<long>, rep long, sig binary, body binary")
        return grouped(sets.select(F.explode("leaves").alias("leaf"), "rep", "sig", "body"), "leaf", link, "a long, b long")

    # most roots hold one class and go no further
    roots = _roots(names, trees, positions)
    met = roots.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    rows = stored(roots.join(met, "node"), "roots").withColumn("family", F.col("rep"))
    edges, opening = None, _families(rows, leaf_docs, leaf_shingles)
    if opening is not None:
        edges = stored(links(opening).distinct(), "family_links")
        family = components(edges).select(F.col("id").alias("rep"), F.col("root").alias("r"))
        rows = stored(rows.drop("family").join(family, "rep", "left").withColumn("family", F.coalesce("r", "rep")).drop("r"), "rows")
    found = links(_leaves(names, rows, edges is not None, positions, leaf_docs, leaf_shingles))
    roots = components(found if edges is None else found.unionByName(edges))
    # a class is named by its smallest doc_id, and so is a component
    labelled = names.select("rep", "lo", "hi", "n", "least").join(roots, F.col("rep") == F.col("id"), "left").withColumn("root", F.coalesce("root", "rep"))
    best = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = stored(labelled.join(best, "root").select("lo", "hi", "n", "component_id"), "labels")
    joined = described.join(labelled, ["lo", "hi", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
