"""Stored files (objects) under keys: written by executors in two phases, removed again if their record can't be written.

Executors first write all files of one ``write`` into a staging folder and list them in a table beside it; then, when every task has
ended, executors move them to their keys. If either step fails, what was written goes again, so of one write all files are there or
none; contents and keys never pass through the driver. ``put`` writes a record of the objects afterwards, and removes the objects if
that fails; ``sweep`` removes objects without a record, which a driver that was lost in between leaves behind.

Paths are folders or URIs that pyarrow can open (local, hdfs, s3, gs). Objects whose keys are known are read by key, on executors
(``read``, ``render.recognised_objects``); all of a folder, by Spark's ``binaryFile`` (``render.read_objects``), which lists it on the driver.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING = "_staging"


def opened(path: str) -> tuple:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def exists(store, name: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(name).type != fs.FileType.NotFound


def place_of(key: str | None) -> str | None:
    """Where a key's file lies in its folder; null if that is no key."""
    place = posixpath.normpath(key or "")
    return None if place.startswith(("..", "/", STAGING)) or place == "." else place


def read(store, root: str, key: str | None) -> bytes | None:
    """The content of the object under a key, null if there is none."""
    from pyarrow import fs

    if (place := place_of(key)) is None:
        return None
    try:
        with store.open_input_file(f"{root}/{place}") as found:
            return found.read()
    except OSError:
        if store.get_file_info(f"{root}/{place}").type == fs.FileType.File:
            raise
        return None


def spread(rows: DataFrame, *on: str) -> DataFrame:
    """``rows`` dealt over all cores by a hash, for those that are few bytes and much work; else a small file is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *on)


def write(objects: DataFrame, path: str) -> None:
    """All of (key, content) as files under ``path``, or none. A task that runs again stages files of its own; those that its last run lists count."""
    spark, staging = objects.sparkSession, f"{STAGING}/{uuid.uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        folder = f"{staging}/files/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{folder}", recursive=True)
        for batch in batches:
            keys, staged = [], []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (place := place_of(key)) is None:
                    raise ValueError(f"not a key: {key}")
                keys.append(place)
                staged.append(f"{folder}/{uuid.uuid4().hex}")
                with store.open_output_stream(f"{root}/{staged[-1]}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "staged": pa.array(staged, pa.string())})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        made = set()
        for batch in batches:
            for key, staged in zip(batch.column("key").to_pylist(), batch.column("staged").to_pylist(), strict=True):
                if (folder := posixpath.dirname(f"{root}/{key}")) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                if exists(store, f"{root}/{staged}"):  # else an earlier run of this task has moved it
                    store.move(f"{root}/{staged}", f"{root}/{key}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    store, root = opened(path)
    listed = None
    try:
        spread(objects.select("key", "content"), "key").mapInArrow(stage, "key string, staged string").write.parquet(f"{path}/{staging}/list")
        listed = spark.read.schema("key string, staged string").parquet(f"{path}/{staging}/list")
        listed.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    except Exception:
        if listed is not None:
            remove(listed, path)
        raise
    finally:
        if exists(store, f"{root}/{staging}"):
            store.delete_dir(f"{root}/{staging}")


def remove(keys: DataFrame, path: str) -> int:
    """Delete the objects with these keys, on executors; the number of files that were there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            gone = 0
            for key in batch.column("key").to_pylist():
                try:
                    store.delete_file(f"{root}/{key}")
                    gone += 1
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_pydict({"gone": [gone]})

    return keys.select("key").mapInArrow(run, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]


def put(objects: DataFrame, path: str, record: Callable[[DataFrame], object]) -> None:
    """Write objects, then their ``record`` (a table commit, given the keys); if that raises, the objects go again and the error goes on.

    ``objects`` should be written down already (a checkpoint, a table), for its keys are read anew.
    """
    write(objects, path)
    try:
        record(objects.select("key"))
    except Exception:
        remove(objects, path)
        raise


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, length) of all objects under ``path``."""
    _, root = opened(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    key = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1)
    return found.select(key.alias("key"), "length").filter(~F.col("key").startswith(STAGING))


def sweep(records: DataFrame, path: str) -> int:
    """Remove objects that no record (key) names; how many went. Not for use beside writers."""
    return remove(stored(records.sparkSession, path).join(records.select("key"), "key", "left_anti"), path)
