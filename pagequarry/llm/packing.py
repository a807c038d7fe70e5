"""Lexical retrieval packing with a sharded BM25 index.

Documents become ids once, in a stored table. Document frequencies and the mean
length are counted over all of it. Rows are then placed by minwise terms, drawn
with a chance that grows with a term's weight, so that documents that share heavy
terms lie side by side whatever order they came in. Each task takes its documents
in shards of bounded size and builds an inverted index of BM25 weights for each;
a seed asks the index of its own shard only. A window
starts with a seed, the rest of the last document or the next unused one;
the index returns its best unused neighbours, and they fill the window. The one
that does not fit is cut there, and its rest is the next seed, so windows are
full but for the last of a task, which is the only one padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, read, stored, trim, with_fields
from .tokens import bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75


def to_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, n and ids (bytes of little-endian 16-bit numbers, ``end_id`` last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = bpe(vocabulary, folder), np.array([end_id], dtype="<u2").tobytes()
        for b in batches:
            for i, made in coder.encode_column(b.column("text")):
                ids = [x.tobytes() + end for x in made]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(ids)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def frequencies(ids: DataFrame, n_terms: int = 1 << 16) -> tuple[np.ndarray, int, float]:
    """Documents with each id, documents, and their mean length, over all rows.
    As many numbers as the vocabulary has reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        seen, some = np.zeros(n_terms, dtype=np.uint8), np.zeros(n_terms, dtype=np.uint8)  # of up to 255 documents
        for b in batches:
            for x in b.column("ids"):
                one = np.frombuffer(x.as_py(), dtype="<u2")
                seen[one] = 1
                some += seen
                seen[one] = 0
                docs, total = docs + 1, total + len(one)
                if docs % 255 == 0:
                    df += some
                    some[:] = 0
        df += some
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((term, [-1, -2]))), pa.array(np.concatenate((df[term], [docs, total])))], names=["term", "c"])

    rows = ids.select("ids").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()
    got = {int(r["term"]): int(r["c"]) for r in rows}
    df = np.zeros(n_terms, dtype=np.int64)
    for t, c in got.items():
        if t >= 0:
            df[t] = c
    docs = got.get(-1, 0)
    return df, docs, got.get(-2, 0) / max(1, docs)


def ranks(idf: np.ndarray, count: int = 4) -> np.ndarray:
    """``count`` orders of all terms. The first of a document's terms in one of them is
    a term drawn with a chance by idf squared, the same for documents of the same terms."""
    place = np.empty((count, len(idf)), dtype=np.uint16)
    for k in range(count):
        u = ((mix64(np.arange(len(idf), dtype=np.uint64) + np.uint64((k + 1) << 32)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        place[k, np.argsort(-np.log(u) / np.maximum(idf, 1e-9) ** 2, kind="stable")] = np.arange(len(idf))
    return place


def placed(ids: DataFrame, idf: np.ndarray, n: int, shard_docs: int) -> DataFrame:
    """The ``n`` rows dealt out and sorted by their minwise terms. Equal ones are told
    apart by where they were read, so that a hot key is cut into as many tasks as it
    fills. No more tasks are made than shards can be filled."""
    spark = ids.sparkSession
    shared = spark.sparkContext.broadcast(ranks(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            if not len(b):
                continue
            bodies = [np.frombuffer(x.as_py(), dtype="<u2") for x in b.column("ids")]
            first, whole = np.concatenate(([0], np.cumsum([len(x) for x in bodies])[:-1])), np.concatenate(bodies)
            m = [np.minimum.reduceat(r[whole], first).astype(np.int64) for r in shared.value]
            key = m[0] << 47 | m[1] << 31 | m[2] << 15 | m[3] >> 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key), pa.array(np.arange(at, at + len(b)))], names=[*b.schema.names, "_key", "_at"])
            at += len(b)

    keyed = ids.mapInArrow(run, with_fields(ids, "_key long, _at long"))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // shard_docs))
    return keyed.repartitionByRange(parts, "_key", "_at").sortWithinPartitions("_key", "_at").drop("_key", "_at")


class Shard:
    """BM25 inverted index of one shard's documents; used ones are never returned."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, query_terms: int | None = None):
        self.n, self.most = len(docs), query_terms
        self.free = np.ones(self.n, dtype=bool)
        self.next = 0
        size = np.array([len(d) for d in docs], dtype=np.int64)
        pairs = np.repeat(np.arange(self.n) << 16, size)
        pairs |= np.concatenate(docs)
        pairs.sort()
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf, pairs = np.diff(new, append=len(pairs)), pairs[new]
        doc, term = pairs >> 16, pairs & 0xFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self.own = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms, self.weights = term, weight if query_terms else None
        by = np.argsort(term, kind="stable")
        names, first, held = np.unique(term[by], return_index=True, return_counts=True)
        self.doc, self.weight = doc[by], weight[by]
        self.at, self.to = np.zeros(len(idf) + 1, dtype=np.int64), np.zeros(len(idf) + 1, dtype=np.int64)
        self.at[names], self.to[names] = first, first + held
        # terms of a quarter of the documents or more also have a row over all documents
        wide = np.flatnonzero(4 * held >= self.n)
        self.row, self.rows = np.full(len(idf) + 1, -1, dtype=np.int64), np.zeros((len(wide), self.n))
        self.row[names[wide]] = np.arange(len(wide))
        for k, (lo, hi) in enumerate(zip(first[wide].tolist(), (first + held)[wide].tolist())):
            self.rows[k, self.doc[lo:hi]] = self.weight[lo:hi]

    def first(self) -> int:
        while self.next < self.n and not self.free[self.next]:
            self.next += 1
        return self.next if self.next < self.n else -1

    def neighbours(self, seed: int, count: int) -> list[int]:
        """The best unused documents for a seed, by all its terms or, where that is
        given, its ``query_terms`` heaviest; the next unused ones in order where no
        term is shared."""
        lo, hi = self.own[seed], self.own[seed + 1]
        t = self.terms[lo:hi]
        if self.most and len(t) > self.most:
            t = t[np.argpartition(-self.weights[lo:hi], self.most)[: self.most]]
        row = self.row[t]
        score = self.rows[row[row >= 0]].sum(axis=0)  # term by term, so equal documents have equal sums
        t = t[row < 0]
        if len(t):
            spans = list(zip(self.at[t].tolist(), self.to[t].tolist()))
            score += np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), weights=np.concatenate([self.weight[a:b] for a, b in spans]), minlength=self.n)
        score[~self.free] = -1.0
        if count < self.n:
            best = np.argpartition(-score, count - 1)[:count]
        else:
            best = np.arange(self.n)
        best = best[np.lexsort((best, -score[best]))]
        return [int(i) for i in best if score[i] >= 0]


def pack(docs: DataFrame, window: int = 1024, shard_docs: int = 1024, shard_ids: int = 4_000_000, query_terms: int | None = None, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored. A document is its
    ids and id 0 after them; null and empty texts are id 0 alone. Each id lies in
    exactly one piece; documents longer than a window run over several. Repeated
    rows and rows without doc_id are packed like any other. Equal scores go to
    the document placed earlier. An empty table gives no piece. ``shard_docs`` and
    ``shard_ids`` bound an index, not what is packed: a longer document is a
    shard by itself.
    """
    ids = stored(to_ids(docs, vocabulary, folder), "ids")
    df, n, mean = frequencies(ids)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(mean, 1.0)))  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        sequence, filled, rows = TaskContext.get().partitionId() << 32, 0, []

        def put(name: int | None, body: np.ndarray, lo: int, hi: int) -> None:
            nonlocal sequence, filled
            while lo < hi:
                take = min(hi - lo, window - filled)
                rows.append((name, lo, take, zlib.crc32(body[lo : lo + take].astype("<u4").tobytes()), len(body), sequence, filled))
                lo, filled = lo + take, filled + take
                if filled == window:
                    sequence, filled = sequence + 1, 0

        def shard(held: list[tuple[int | None, np.ndarray]]) -> None:
            index = Shard([d for _, d in held], idf, mean, query_terms)
            seed = -1
            while True:
                if seed < 0 or not filled:
                    seed = index.first() if seed < 0 else seed
                    if seed < 0:
                        return
                    if index.free[seed]:
                        index.free[seed] = False
                        put(held[seed][0], held[seed][1], 0, len(held[seed][1]))
                if not filled:
                    seed = -1
                    continue
                room, found = window - filled, index.neighbours(seed, 4)
                if not found:
                    if index.first() < 0:
                        return
                    seed = -1
                    continue
                for d in found:
                    index.free[d] = False
                    size = len(held[d][1])
                    put(held[d][0], held[d][1], 0, size)
                    if size >= room:
                        seed = d  # its rest opens the next window
                        break
                    room -= size

        def packed() -> pa.RecordBatch:
            trim()
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])
            rows.clear()
            return out

        held, size = [], 0
        for b in batches:
            for name, data in zip(b.column("doc_id"), b.column("ids")):
                body = np.frombuffer(data.as_py(), dtype="<u2")
                if held and (len(held) >= shard_docs or size + len(body) > shard_ids):
                    shard(held)
                    held, size = [], 0
                    yield packed()
                held.append((name.as_py(), body))
                size += len(body)
        if held:
            shard(held)
            yield packed()

    return placed(ids.select("doc_id", "ids"), idf, n, shard_docs).mapInArrow(run, PIECES)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
