"""Files that executors write and read beside Spark's own sources.

Locations are URIs of any file system that pyarrow opens (file, hdfs, s3, gs).
A task writes under a temporary name of its own attempt; only what a finished
job lists is renamed into place, and the manifest is written last. A folder
without a manifest was never committed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs
from pyspark import TaskContext

MANIFEST = "MANIFEST.json"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def temporary(name: str) -> str:
    at = TaskContext.get()
    return f"_tmp/{name}.{at.stageId()}-{at.taskAttemptId()}"


def start(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(f"{path}/_tmp", recursive=True)


def commit(uri: str, files: Iterable[dict], extra: dict) -> dict:
    """Rename each file's ``tmp`` to its ``name``, many at a time, and write the
    manifest. A file that an interrupted commit renamed already is left alone."""
    fs, path = opened(uri)

    def rename(f: dict) -> dict:
        tmp = f"{path}/{f['tmp']}"
        if fs.get_file_info(tmp).type != pafs.FileType.NotFound:
            fs.move(tmp, f"{path}/{f['name']}")
        return {k: v for k, v in f.items() if k != "tmp"}

    with ThreadPoolExecutor(64) as pool:
        listed = list(pool.map(rename, sorted(files, key=lambda f: f["name"])))
    made = {**extra, "files": listed}
    with fs.open_output_stream(f"{path}/_tmp/{MANIFEST}") as out:
        out.write(json.dumps(made, sort_keys=True).encode())
    fs.move(f"{path}/_tmp/{MANIFEST}", f"{path}/{MANIFEST}")
    fs.delete_dir(f"{path}/_tmp")
    return made


def manifest(uri: str) -> dict:
    fs, path = opened(uri)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())
