"""Shared pieces: word hashing, numbering without a global sort, shared tables.

Words are maximal runs of bytes other than space and 0x09-0x0D, taken on the
UTF-8 form of the whole text.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 52


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


# --------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares (``spark.checkpoint.dir``).

    Where that setting is missing, a local temporary folder takes its place in
    local mode, as in tests; on a cluster this raises, as executors could not
    read each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pagequarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts lineage.

    Executors lost later cost a re-read of the table, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of a frame with further fields, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


# ------------------------------------------------------------ numbering of rows


def hash52(*parts: Column) -> Column:
    """A uniform 52-bit number from md5, the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def collapsed(df: DataFrame) -> DataFrame:
    """Equal rows as one, with their number in ``copies``; combined before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies"))


def running_start(df: DataFrame, group: str, order: list[str], value: Column, out: str, rows_per_part: int = 50_000, chunk: int = 10_000) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` (not null) in the total order ``order``.

    ``df`` is a stored table of ``collapsed`` rows. It is dealt out by ranges of
    the whole order, so neither a hot group nor a hot first key stands in one
    task; only the totals of ranges are summed per group. Each row then comes
    back ``copies`` times, the number of each in ``copy``; rows of many copies
    are expanded in chunks that are dealt out.
    """
    n, most = df.agg(F.count("*"), F.max("copies")).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_part))
    ranged = df.repartitionByRange(parts, group, *order).withColumn("_p", F.spark_partition_id()).withColumn("_v", value)
    ranged = stored(ranged, "ranged")
    worth = F.col("_v") * F.col("copies")
    totals = ranged.groupBy(group, "_p").agg(F.sum(worth).alias("_t"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_s", F.coalesce(F.sum(worth).over(inside), F.lit(0))).join(totals, [group, "_p"])
    if (most or 0) > chunk:
        rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / chunk)))).repartition(parts)
    else:
        rows = rows.withColumn("_c", F.lit(0).cast("long"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("copies")) - 1)))
    return rows.withColumn(out, F.col("_o") + F.col("_s") + F.col("copy") * F.col("_v")).drop("_p", "_v", "_o", "_s", "_c", "copies")


def numbered(rows: DataFrame, key: list[str], hot: DataFrame, out: str, chunk: int = 10_000) -> DataFrame:
    """Number the rows of each ``key`` (no nulls in it) from 0, in any order.

    ``hot`` holds the keys of more than ``chunk`` rows. Theirs are stored once
    and numbered in runs of ``chunk`` rows, whose totals are summed per key.
    """
    one = Window.partitionBy(*key).orderBy(F.lit(0))
    number = (F.row_number().over(one) - 1).cast("long")
    if hot.isEmpty():
        return rows.withColumn(out, number)
    hot = stored(hot.select(*key), "hot")
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    at = F.monotonically_increasing_id()
    own = stored(rows.join(hot, key, "left_semi").withColumn("_at", at), "hot_rows")
    own = own.withColumn("_run", F.floor(F.col("_at") / chunk))
    totals = own.groupBy(*key, "_run").agg(F.count("*").alias("_t"))
    before = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "_run", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    run = Window.partitionBy(*key, "_run").orderBy("_at")
    own = own.withColumn("_n", F.row_number().over(run) - 1).join(totals, [*key, "_run"])
    own = own.withColumn(out, F.col("_o") + F.col("_n")).select(*rows.columns, out)
    return rows.join(hot, key, "left_anti").withColumn(out, number).unionByName(own)


# ---------------------------------------------------------- groups without pandas


def grouped(df: DataFrame, key: str, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``run`` to whole groups of equal ``key`` (long, not null), many at a time.

    It gets the rows of several groups in one batch with the first row of each
    (and the end), which spares the cost that a call per group has where most
    groups are pairs. Only a group that spans batches is held back.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = rows.column(key).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            cut = len(rows) if last else int(first[-1])
            held[:] = [] if last else [rows.slice(cut)]
            if cut:
                yield run(rows.slice(0, cut), np.append(first, cut) if last else first)

        for batch in batches:
            if not len(batch):
                continue
            spans = held and held[0].column(key)[0].as_py() == batch.column(key)[len(batch) - 1].as_py()
            held.append(batch)
            if not spans:
                yield from ready(False)
        if held:
            yield from ready(True)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key).mapInArrow(stream, schema)


def fixed_width(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A binary column without nulls, all values of one width, as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype).reshape(-1, width)


# ------------------------------------------------------------- keyed permutation


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed bijection of 0..n-1: a balanced Feistel network over the next even
    number of bits, walked along its cycle until the value falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << shift) | right

    x = once(np.asarray(index).astype(np.uint64))
    while (far := x >= np.uint64(n)).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


# ------------------------------------------------------------------ word hashing

_MULT = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        inverse = pow(_MULT, -1, 1 << 64)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, m, dtype=np.uint64)))) for m in (_MULT, inverse)]
    return _POWERS[0], _POWERS[1]


def trim() -> None:
    """Give freed memory back to the system; numpy's and Arrow's pools hold it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20):
    """Cut a string column into runs of whole texts of about ``max_bytes``.

    Yields (first row, bytes, offsets of the texts in them). Null texts are
    empty; a text above the size stands alone and stays whole.
    """
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts: (start, end, hash of 64 bits, number of words before each text).

    A word's hash is a polynomial over per-byte random values, taken from one
    running sum over the bytes, and finalised. ``lower`` folds A-Z only.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return start, end, h, np.searchsorted(start, offsets)
