"""A deterministic sharded WARC writer, and its reader.

Records are ordered by page_id. An exact histogram of bytes over page_id,
refined where it is heavy, gives range boundaries that depend on the data
alone, so reruns write the same files. A task sorts its ranges and streams each
into files that roll by compressed size, one gzip member a record, with headers
and digests made anew. Files are written under temporary names; the driver
renames those of the finished job and writes a manifest last.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stored
from .files import commit, manifest, opened, start, temporary

READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def even_ranges(df: DataFrame, key: str, weight: str, target: int, most: int = 1 << 16) -> tuple[list[int], list[int]]:
    """Lower bounds of ranges of ``key`` (long, not null), each of about ``target``
    weight or, where that would make more than ``most`` ranges, of the whole over
    ``most``; and for each, into how many parts a hash must cut it, which is above 1
    only for a single value that is heavier. The same data give the same bounds. A
    histogram is refined where it is heavy; of each level at most 8 * ``most`` cells
    reach the driver, or 4,096 of the first."""
    low, high, total = df.agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None:
        return [], []
    target = max(target, -(-int(total) // most))
    shift = max(0, (high - low).bit_length() - 12)
    place = F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    cell = lambda s: F.floor(place / F.lit(1 << s).cast("decimal(20,0)")).cast("long")
    cells = {int(r[0]): int(r[1]) for r in df.groupBy(cell(shift).alias("c")).agg(F.sum(weight)).collect()}
    out = {c << shift: w for c, w in cells.items()}
    heavy = [c for c, w in cells.items() if w > target]
    while heavy and shift:
        finer = max(0, shift - 3)
        wanted = df.sparkSession.createDataFrame([(c,) for c in heavy], "p long")  # at most ``most`` numbers
        inner = df.withColumn("p", cell(shift)).join(F.broadcast(wanted), "p", "left_semi")
        cells = {int(r[0]): int(r[1]) for r in inner.groupBy(cell(finer).alias("c")).agg(F.sum(weight)).collect()}
        for c in heavy:
            out.pop(c << shift, None)
        out |= {c << finer: w for c, w in cells.items()}
        heavy, shift = [c for c, w in cells.items() if w > target], finer
    bounds, parts, full = [], [], target
    for at in sorted(out):
        if full + out[at] > target:
            bounds.append(at + low)
            parts.append(max(1, -(-out[at] // target)))
            full = 0
        full += out[at]
    return bounds, parts


def _clean(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """One record. ``keeper``: the page that holds the same payload, or None."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    headers = [("WARC-Type", "revisit" if keeper is not None else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _clean(url))] if url is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if keeper is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(keeper, digest)), ("X-Refers-To-Page", str(keeper))]
    headers += [("X-Page", str(page_id))] if page_id is not None else []
    return _member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


def write_archives(pages: DataFrame, uri: str | None = None, revisit_bytes: int = 0, range_bytes: int = 32 << 20, roll_bytes: int = 32 << 20, date: str = "2025-01-01T00:00:00Z") -> str:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are
    ignored) and return the folder.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads
    of at least ``revisit_bytes`` bytes, those with the largest page_id are
    responses and the others revisits of it; rows repeated under that page_id
    are responses all. Rows without page_id come first; they are revisits if a
    page with an id holds their payload. A null url has no target header;
    control characters in a url are percent-encoded. Rows without an id, and one
    id that fills more than a range, are cut by a hash of url and payload; rows
    repeated whole share a file. A payload is written whole, however long. An
    empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    uri = uri or f"{shared_dir(spark)}/warc"
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    keyed = base.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    equal = keyed.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = keyed.join(stored(equal, "equal"), ["digest", "size"], "left")
    weighed = keyed.select("page_id", (F.col("size") + 600).alias("w"))
    nameless = weighed.where("page_id is null").agg(F.sum("w")).first()[0] or 0
    bounds, parts = even_ranges(weighed.where("page_id is not null"), "page_id", "w", range_bytes)
    bounds, parts = np.array(bounds, dtype=np.int64), np.array([max(1, min(1 << 16, -(-int(nameless) // range_bytes))), *parts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(parts)))

    def place(page: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.where(page.isna(), 0, np.searchsorted(bounds, page.fillna(0).to_numpy(np.int64), side="right"))
        return pd.Series(first[at] + spread.to_numpy(np.int64) % parts[at])

    spread = F.pmod(F.xxhash64("url", "digest"), F.lit(1 << 62))
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("keeper"), F.pandas_udf(place, "long")("page_id", spread).alias("range"))
    rows = rows.repartitionById(int(first[-1]), F.col("range").cast("int")).sortWithinPartitions("range", "page_id", "url", "payload")
    start(uri)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(uri)
        out, now, made = None, {}, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                now["sha256"] = now.pop("hash").hexdigest()
                made.append(dict(now))
                out = None

        def put(data: bytes) -> None:
            out.write(data)
            now["hash"].update(data)
            now["bytes"] += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or now["range"] != row["range"] or now["bytes"] >= roll_bytes:
                    roll = now["roll"] + 1 if out is not None and now["range"] == row["range"] else 0
                    close()
                    name = f"part-{row['range']:07d}-{roll:05d}.warc.gz"
                    now = {"name": name, "tmp": temporary(name), "range": row["range"], "roll": roll, "bytes": 0, "records": 0, "hash": hashlib.sha256()}
                    out = fs.open_output_stream(f"{top}/{now['tmp']}", compression=None)
                    info = f"software: pagequarry\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
                    put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "info")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                put(_record(row["page_id"], row["url"], row["payload"], row["keeper"], date))
                now["records"] += 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(m) for m in made])], names=["file"])

    listed = stored(rows.mapInArrow(write, "file string"), "written")
    commit(uri, (json.loads(r[0]) for r in listed.toLocalIterator()), {"format": "warc/1.1", "date": date})
    return uri


def records(stream, name: str) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of every record of a gzip archive."""
    z, held = zlib.decompressobj(31), []
    while True:
        data = z.unconsumed_tail or stream.read(1 << 20)
        if not data and not held:
            return
        if not data:
            raise ValueError(f"{name} ends within a record")
        while data:
            held.append(z.decompress(data))
            if not z.eof:
                data = b""
                continue
            data, z = z.unused_data, zlib.decompressobj(31)
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            held = []
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
            size = int(headers["content-length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError(f"{name}: a record's length is wrong")
            yield headers, rest[:size]


def read_archives(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    """The page records of a committed folder. Digests are checked on the way;
    ``payload_bytes`` and ``payload_digest`` of a revisit are those of the full payload."""
    names = [(f["name"],) for f in manifest(uri)["files"]]
    files = spark.createDataFrame(names, "name string").repartition(max(1, min(len(names), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(uri)
        fields = [f.split()[0] for f in READ_SCHEMA.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for head, block in records(stream, name):
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        full = head["warc-type"] == "response"
                        if full and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, refers = head.get("x-page"), head.get("x-refers-to-page")
                        rows.append((int(page) if page else None, head.get("warc-target-uri"), head["warc-type"], digest, size, int(refers) if refers else None, body if full and payload else None))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return files.mapInArrow(parse, READ_SCHEMA)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    uri = write_archives(read(spark, sf_dir, "pages"))
    return read_archives(spark, uri, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
