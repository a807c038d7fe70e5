"""Training-order materialisation: token ids in fixed-stride files, in a keyed order.

Texts are cut into sequences of ``seq_len`` ids. A first pass counts the
sequences of each input partition, which numbers all sequences without a gap;
a keyed Feistel permutation with cycle-walking gives each its global slot. A
second pass makes the ids, and each range of slots is sorted and written to one
file of fixed-stride records, so that any slot is read by one seek and training
resumes anywhere. Ids cross the network once and are stored once.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import feistel, read, shared_dir, stored
from .files import commit, manifest, opened, start, temporary
from .tokens import bpe

HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4")])
NO_ID = -(1 << 63)
READ_SCHEMA = "slot long, shard int, byte_offset long, doc_id long, part int, n_tokens int, ids binary"


def write_slots(docs: DataFrame, uri: str | None = None, seq_len: int = 512, key: int = 2024, file_bytes: int = 64 << 20, vocabulary: str = "byte_bpe_50k", folder: str | None = None, end_id: int = 0, pad_id: int = 0) -> str:
    """Write every sequence of ``docs`` (doc_id, text; other columns are ignored)
    and return the folder.

    A document gives its ids and ``end_id``, cut every ``seq_len``; the last
    piece is padded with ``pad_id`` and its header says how many ids count. Null
    and empty texts give one sequence of one id. Texts are never cut short.
    Repeated rows are sequences of their own; a null doc_id comes back null. An
    empty table gives a manifest without files. ``docs`` must give the same rows
    in the same partitions when read twice, as tables do; a second pass that
    counts differently raises.
    """
    spark = docs.sparkSession
    uri = uri or f"{shared_dir(spark)}/slots"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
        coder = bpe(vocabulary, folder)
        for i, made in coder.encode_column(batch.column("text")):
            for d, ids in zip(batch.column("doc_id").slice(i, len(made)).to_pylist(), made):
                yield d, np.append(ids, np.uint16(end_id))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(-(-len(ids) // seq_len) for b in batches for _, ids in encoded(b))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["pid", "n"])

    counts = {r["pid"]: r["n"] for r in docs.mapInArrow(count, "pid int, n long").collect()}
    first, total = {}, 0
    for pid in sorted(counts):
        first[pid] = total
        total += counts[pid]
    record = HEAD.itemsize + 2 * seq_len
    per_file = max(1, file_bytes // record)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        at, stop = first.get(pid, 0), first.get(pid, 0) + counts.get(pid, 0)
        rows, index = [], at
        for batch in batches:
            for d, ids in encoded(batch):
                for part, lo in enumerate(range(0, len(ids), seq_len)):
                    piece = ids[lo : lo + seq_len]
                    head = np.array([(NO_ID if d is None else d, part, len(piece))], dtype=HEAD)
                    rows.append(head.tobytes() + piece.tobytes())
                if len(rows) >= 1024:
                    yield placed(rows, index)
                    index, rows = index + len(rows), []
        if rows:
            yield placed(rows, index)
        if index + len(rows) != stop:
            raise ValueError("the input gave other rows when read again")

    def placed(rows: list[bytes], index: int) -> pa.RecordBatch:
        slot = feistel(np.arange(index, index + len(rows)), total, key)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_file).astype(np.int32)), pa.array(rows, pa.binary())], names=["slot", "shard", "record"])

    files = -(-total // per_file)
    rows = docs.mapInArrow(cut, "slot long, shard int, record binary")
    rows = rows.repartitionById(max(1, files), "shard").sortWithinPartitions("slot")
    start(uri)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(uri)
        out, now, made = None, {}, []
        pad = np.full(seq_len, pad_id, dtype="<u2").tobytes()

        def close() -> None:
            if out is not None:
                out.close()
                now["sha256"] = now.pop("hash").hexdigest()
                made.append(now)

        for b in batches:
            for slot, shard, data in zip(*(b.column(c).to_pylist() for c in ("slot", "shard", "record"))):
                if out is None or now["shard"] != shard:
                    close()
                    name = f"slots-{shard:07d}.bin"
                    now = {"name": name, "tmp": temporary(name), "shard": shard, "first": shard * per_file, "records": 0, "hash": hashlib.sha256()}
                    out = fs.open_output_stream(f"{top}/{now['tmp']}", compression=None)
                if slot != now["first"] + now["records"]:
                    raise ValueError(f"slot {slot} is out of place")
                data += pad[len(data) - HEAD.itemsize :]
                out.write(data)
                now["hash"].update(data)
                now["records"] += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(m) for m in made])], names=["file"])

    listed = stored(rows.mapInArrow(write, "file string"), "written")
    commit(uri, (json.loads(r[0]) for r in listed.toLocalIterator()), {"records": total, "record_bytes": record, "seq_len": seq_len, "key": key, "per_file": per_file, "vocabulary": vocabulary})
    return uri


def read_slots(spark: SparkSession, uri: str, first: int = 0, count: int | None = None) -> DataFrame:
    """The sequences of slots first .. first + count - 1, by seeks; all of them by default."""
    made = manifest(uri)
    size, stop = made["record_bytes"], made["records"] if count is None else min(first + count, made["records"])
    step = max(1, (8 << 20) // size)
    spans = []
    for f in made["files"]:
        for lo in range(0, f["records"], step):
            a, b = max(first, f["first"] + lo), min(stop, f["first"] + min(lo + step, f["records"]))
            if a < b:
                spans.append((f["name"], f["shard"], f["first"], a, b))
    wanted = spark.createDataFrame(spans, "name string, shard int, first long, lo long, hi long")
    wanted = wanted.repartition(max(1, min(len(spans), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(uri)
        for b in batches:
            for s in b.to_pylist():
                with fs.open_input_file(f"{top}/{s['name']}") as f:
                    f.seek((s["lo"] - s["first"]) * size)
                    data = f.read((s["hi"] - s["lo"]) * size)
                at = np.arange(s["hi"] - s["lo"])
                heads = [np.frombuffer(data, dtype=HEAD, count=1, offset=int(i) * size)[0] for i in at]
                ids = [data[i * size + HEAD.itemsize : i * size + HEAD.itemsize + 2 * int(h["n"])] for i, h in zip(at.tolist(), heads)]
                slots = at + s["lo"]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([s["shard"]] * len(at), pa.int32()), pa.array((slots - s["first"]) * size), pa.array([None if h["doc_id"] == NO_ID else int(h["doc_id"]) for h in heads], pa.int64()), pa.array([int(h["part"]) for h in heads], pa.int32()), pa.array([int(h["n"]) for h in heads], pa.int32()), pa.array(ids, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids"])

    return wanted.mapInArrow(load, READ_SCHEMA)


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return ids.map(lambda b: zlib.crc32(np.frombuffer(b, dtype="<u2").astype("<u4").tobytes()))


def op8_tokenbin(spark, sf_dir: str) -> DataFrame:
    uri = write_slots(read(spark, sf_dir, "documents"))
    return read_slots(spark, uri).select("doc_id", "part", "n_tokens", "slot", "shard", "byte_offset", ids_crc32("ids").alias("ids_crc32"))
