"""Nearest neighbours: inverted file with product-quantised residuals, checked by bounds.

Vectors are scaled to length 1, so the nearest by distance is the nearest by
cosine. Coarse centroids and residual codebooks are fitted on a bounded sample;
every vector is then indexed under its centroid with the code of its residual.
Lists stand on shelves, neighbouring small ones together; shelves and the
queries that visit them are cut into blocks of bounded size, so a list that
holds a third of all rows is many tasks. A query first visits the shelves of its
nearest lists. There a row is passed over only if its distance by the code, less
the error of that code, is beyond the k-th nearest; all others are ranked by the
exact cosine of the original vectors. Then the query visits each further shelf
with a list whose centroid is near enough for its radius to bring a nearer row.
So nothing nearer is missed, whatever the rows; the sample decides the work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored

FOUND = "query_id long, vec_id long, score double"
SLACK = 1e-6  # more than rounding moves a distance between vectors of length 1


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part: an id, no null or
    non-finite component, and not all zero."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & sound)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _closest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and one codebook for each group of dimensions."""

    def __init__(self, sample: np.ndarray, n_lists: int, n_groups: int, n_codes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.centroids = _kmeans(sample, n_lists, rng)
        rest = sample - self.centroids[_closest(sample, self.centroids)]
        self.groups = [g for g in np.array_split(np.arange(sample.shape[1]), min(n_groups, sample.shape[1]))]
        self.books = [_kmeans(rest[:, g], n_codes, rng, 8) for g in self.groups]

    def probes(self, sample: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
        """How many lists hold ``recall`` of the ``k`` nearest in the sample of its first
        rows. The rows left out of the sample are denser, so this errs upwards."""
        c, q = self.centroids, sample[:asked]
        near = q @ sample.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort((c * c).sum(axis=1)[None] / 2 - q @ c.T, axis=1), axis=1)
        ranks = np.sort(np.take_along_axis(place, _closest(sample, c)[best], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _closest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([_closest(rest[:, g], b) for g, b in zip(self.groups, self.books)], axis=1).astype(np.uint8)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = self.centroids[at]
        for j, (g, b) in enumerate(zip(self.groups, self.books)):
            out[:, g] += b[codes[:, j]]
        return out

    def shelves(self, counts: np.ndarray, size: int, seed: int) -> np.ndarray:
        """The shelf of each list: lists of a like centroid share one of up to ``size`` rows."""
        near = np.zeros(len(counts), dtype=np.int64)
        if counts.sum() > size:
            near = _closest(self.centroids, _kmeans(self.centroids, int(-(-counts.sum() // size)), np.random.default_rng(seed), 8))
        out, shelf, held = np.zeros(len(counts), dtype=np.int64), 0, 0
        for at in np.argsort(near, kind="stable"):
            if held and held + counts[at] > size:
                shelf, held = shelf + 1, 0
            out[at] = shelf
            held += counts[at]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, of any size of components."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, to within SLACK for lengths about 1."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, the same for equal rows wherever they stand. Where squares
    would leave the range of doubles, of the rows scaled first."""
    with np.errstate(all="ignore"):
        own, square = (q * q).sum(), (rows * rows).sum(axis=1)
        out = (rows * q).sum(axis=1) / (np.sqrt(own) * np.sqrt(square))
    far = (square < 1e-250) | (square > 1e250) | (own < 1e-250) | (own > 1e250)
    if far.any():
        out[far] = (unit(rows[far]) * unit(q[None])).sum(axis=1)
    return out


def best_of(name: int, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best distinct ids but ``name``, ties to the smaller, with their best scores."""
    top = np.lexsort((ids, -score))
    top = top[ids[top] != name]
    top = top[np.sort(np.unique(ids[top], return_index=True)[1])[:k]]
    return ids[top], score[top]


def near_of(ids: np.ndarray, raw: np.ndarray, u: np.ndarray, coded: np.ndarray, blur: np.ndarray, names: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows in order of their ids, what can be among the ``k`` nearest of each query, and no further than its reach.

    A row lies between its distance by the code less ``blur``, the error of that
    code, and that distance and ``blur``."""
    uq, own = unit(q), ids[None] == names[:, None]
    far = apart(uq, coded)
    most = np.where(own, np.inf, far + blur)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    best = np.minimum.reduceat(most, first, axis=1)
    if best.shape[1] > k:
        reach = np.minimum(reach, np.partition(best, k - 1, axis=1)[:, k - 1])
    may = (far - blur <= reach[:, None] + 2 * SLACK) & ~own
    at = np.flatnonzero(may.any(axis=0))
    if not len(at):
        return []
    score = np.where(may[:, at], uq @ u[at].T, -np.inf)
    first = np.flatnonzero(np.concatenate(([True], ids[at[1:]] != ids[at[:-1]])))
    best = np.maximum.reduceat(score, first, axis=1)
    least = 1 - reach * reach / 2
    if best.shape[1] > k:
        least = np.maximum(least, np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k])
    good = (score >= least[:, None] - 4 * SLACK) & (score > -np.inf)
    out = []
    for j in np.flatnonzero(good.any(axis=1)):
        some = at[good[j]]
        vec, exact = best_of(names[j], ids[some], cosine(q[j], raw[some]), k)
        out.append((np.full(len(vec), names[j]), vec, exact))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    Both frames need vec_id and embedding; other columns are ignored. A query's
    own row (its vec_id) is no candidate. Vectors that ``valid`` leaves out take
    no part on either side; vectors of one length are searched among
    themselves, as others have no cosine with them. Rows repeated under one
    vec_id count once, with their best score; ties go to the smaller vec_id. A
    query that finds fewer than ``k`` in the lists it visits then visits all, so
    only a want of candidates leaves it with fewer. With no query or no
    candidate nothing is returned. Options are those of ``search_length``.
    """
    spark = vectors.sparkSession
    rows, asked = valid(vectors), valid(queries)
    # one number for each length of vector
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.countDistinct("vec_id").alias("n")).orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = None
    for r in dims:
        own = F.size("v") == r["d"]
        one = search_length(rows.where(own), asked.where(own), r["d"], r["n"], k, **options)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return out
    if len(dims) > 1:
        # an id may stand for vectors of several lengths
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_length(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int, sample_rows: int = 16_384, n_lists: int | None = None, n_probe: int | None = None, recall: float = 0.96, n_groups: int = 16, n_codes: int = 256, block_rows: int = 4096, block_queries: int = 1024, seed: int = 5) -> DataFrame:
    """Candidates (query_id, vec_id, score) among vectors of one length, the ``k`` nearest of each query among them.

    The fit reads at most ``sample_rows`` distinct rows, the first by a hash of
    id and vector; every row is indexed. ``n_lists`` defaults to the square root
    of the ids, at most 4096, ``n_probe``, the lists visited at first, to what
    reaches ``recall`` within the sample, 16 at least.
    """
    spark = rows.sparkSession
    mark = F.xxhash64("vec_id", "v")
    marks = rows.select(mark.alias("m")).distinct().orderBy("m").limit(sample_rows)
    picked = rows.withColumn("m", mark).join(F.broadcast(marks), "m", "left_semi").dropDuplicates(["vec_id", "v"])
    sample = sorted((r["m"], r["vec_id"], r["v"]) for r in picked.collect())  # at most sample_rows rows
    sample = np.array([r[2] for r in sample], dtype=np.float64).reshape(-1, dim)
    lists = n_lists or int(np.clip(np.sqrt(n), 1, 4096))
    index = Index(unit(sample), lists, n_groups, n_codes, seed)
    lists = len(index.centroids)
    probes = min(lists, n_probe or max(16, index.probes(unit(sample), k, recall)))
    shared = spark.sparkContext.broadcast(index)  # of a size the parameters fix

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.array(batch.column("v").flatten()).reshape(-1, dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b)
            u = unit(x)
            at, codes = shared.value.encode(u)
            away = np.sqrt(((u - shared.value.centroids[at]) ** 2).sum(axis=1))
            columns = [pa.array(at.astype(np.int32)), b.column("vec_id"), pa.array(away), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "vec_id", "away", "code", "raw"])

    indexed = rows.dropDuplicates(["vec_id", "v"]).mapInArrow(encode, "list int, vec_id long, away double, code binary, raw binary")
    indexed = stored(indexed, "index")
    # two numbers a list
    counts, radius = np.zeros(lists, dtype=np.int64), np.full(lists, -np.inf)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        counts[r["list"]], radius[r["list"]] = r["n"], r["r"]
    shelf = index.shelves(counts, block_rows, seed)
    held = np.bincount(shelf, weights=counts).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with a bit for each shelf of their nearest lists."""
        for whole in batches:
            for i in range(0, len(whole), 512):
                b = whole.slice(i, 512)
                x = matrix(b)
                near = np.argsort(apart(unit(x), shared.value.centroids), axis=1, kind="stable")[:, :probes]
                first = np.zeros((len(x), len(held)), dtype=bool)
                first[np.arange(len(x))[:, None], shelf[near]] = True
                columns = [b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([f.tobytes() for f in np.packbits(first, axis=1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "raw", "first"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a reach the first shelves, with one all others that hold a list within it."""
        for whole in batches:
            for i in range(0, len(whole), 512):
                b = whole.slice(i, 512)
                bits = np.frombuffer(b"".join(b.column("first").to_pylist()), dtype=np.uint8).reshape(len(b), -1)
                go = np.unpackbits(bits, axis=1, count=len(held)).astype(bool)
                if b.column("reach").null_count < len(b):
                    x = np.frombuffer(b"".join(b.column("raw").to_pylist()), dtype=np.float64).reshape(-1, dim)
                    reach = b.column("reach").to_numpy(zero_copy_only=False)
                    q, at = np.nonzero(apart(unit(x), shared.value.centroids) - radius <= reach[:, None] + SLACK)
                    within = np.zeros_like(go)
                    within[q, shelf[at]] = True
                    go = within & ~go
                q, to = np.nonzero(go & (held > 0))
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), b.column("query_id").take(take), b.column("reach").take(take), b.column("raw").take(take)], names=["shelf", "query_id", "reach", "raw"])

    def search(key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own) and len(ask):
            own = own.sort_values(["vec_id", "raw"], kind="stable")
            ids, names = own["vec_id"].to_numpy(), ask["query_id"].to_numpy()
            codes = np.frombuffer(b"".join(own["code"]), dtype=np.uint8).reshape(len(own), -1)
            raw = np.frombuffer(b"".join(own["raw"]), dtype=np.float64).reshape(-1, dim)
            q = np.frombuffer(b"".join(ask["raw"]), dtype=np.float64).reshape(-1, dim)
            reach = ask["reach"].astype("float64").fillna(np.inf).to_numpy()
            u, coded = unit(raw), shared.value.decode(own["list"].to_numpy(), codes)
            blur = np.sqrt(((u - coded) ** 2).sum(axis=1))
            for i in range(0, len(q), 128):
                out += near_of(ids, raw, u, coded, blur, names[i : i + 128], q[i : i + 128], reach[i : i + 128], k)
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), zip(*out))})

    asked = stored(asked.dropDuplicates(["vec_id", "v"]).mapInArrow(place, "query_id long, raw binary, first binary"), "asked")
    # a row of each shelf is in one of nr blocks
    size = spark.createDataFrame([(i, int(s)) for i, s in enumerate(shelf)], "list int, shelf int")
    blocks = lambda c, s: np.maximum(1, -(-c // s)).tolist()
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda name, n: F.pmod(F.xxhash64(name, "raw"), F.col(n)).cast("int")
    keys = ["shelf", "rb", "qb"]

    def find(asked: DataFrame, name: str) -> DataFrame:
        visits = stored(asked.mapInArrow(visit, "shelf int, query_id long, reach double, raw binary"), f"visits_{name}")
        asking = np.zeros(len(held), dtype=np.int64)
        for r in visits.groupBy("shelf").count().collect():
            asking[r["shelf"]] = r["count"]
        known = [(i, r, c) for i, (r, c) in enumerate(zip(blocks(held, block_rows), blocks(asking, block_queries))) if asking[i]]
        parts = lambda: F.broadcast(spark.createDataFrame(known, "shelf int, nr int, nq int"))
        left = indexed.join(F.broadcast(size), "list").join(parts(), "shelf").withColumn("rb", block("vec_id", "nr")).withColumn("qb", spread("nq")).select(*keys, "list", "vec_id", "code", "raw")
        right = visits.join(parts(), "shelf").withColumn("qb", block("query_id", "nq")).withColumn("rb", spread("nr")).select(*keys, "query_id", "reach", "raw")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
        # an id may stand in several blocks, and a query for several vectors
        return stored(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), f"found_{name}")

    found = find(asked.withColumn("reach", F.lit(None).cast("double")), "first")
    if int(np.count_nonzero(held)) > 1:
        kth = F.get(F.sort_array(F.collect_list("score"), False), k - 1)
        reach = found.groupBy("query_id").agg(F.sqrt(F.greatest(2 - 2 * kth, F.lit(0.0))).alias("reach"))
        further = asked.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        found = found.unionByName(find(further, "further")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found


def op6_ann(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
