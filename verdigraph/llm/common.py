"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import scratch_path, shared_dir, spread, stored

__all__ = ["WORD", "batch_rows", "crc_mod", "hot_join", "load", "new_path", "opened", "parts", "release", "released", "save", "scratch_path", "shared_dir", "stored", "table", "text_bytes", "utf8"]

#: The word of the contracts; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(column).type) else pa.binary()
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(kind).to_pylist()]


def crc_mod(column: str, by: int):
    """crc32 of the column as text, modulo by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


#: Rows that go to a Python worker at a time, and Spark's default.
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Jobs run inside send so many rows to a worker at a time: whole texts are many bytes a row, and both sides hold a batch. A session's own number stays."""
    own = int(spark.conf.get(BATCH)) == BATCH_DEFAULT
    if own:
        spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        if own:
            spark.conf.set(BATCH, BATCH_DEFAULT)


def release(cycles: bool = True) -> None:
    """Gives memory that is free back to the system: Arrow's pool and the C library keep it otherwise. cycles: collects those first."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def released(run):
    """A function for mapInArrow that gives back its memory at its end. Workers outlive their tasks and wait, idle, for the next stage."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return lean


def opened(path: str, write: bool = False):
    """A file of the shared folder, to read at random or to write."""
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path)
    if write:
        where.create_dir(os.path.dirname(inside))
        return where.open_output_stream(inside)
    return where.open_input_file(inside)


def save(path: str, **arrays: np.ndarray) -> None:
    """Arrays, each compressed."""
    head, body = [], []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        data = pa.compress(x.tobytes(), "zstd", asbytes=True)
        head.append((name, x.dtype.str, x.nbytes, len(data)))
        body.append(data)
    told = json.dumps(head).encode()
    with opened(path, True) as out:
        out.write(len(told).to_bytes(8, "little") + told)
        for data in body:
            out.write(data)


def load(path: str) -> dict[str, np.ndarray]:
    with opened(path) as file:
        data = memoryview(file.read())
    at = 8 + int.from_bytes(data[:8], "little")
    found = {}
    for name, kind, size, length in json.loads(bytes(data[8:at])):
        found[name] = np.frombuffer(pa.decompress(data[at : at + length], size, "zstd", asbytes=True) if size else b"", kind)
        at += length
    return found


def new_path(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


#: Rows below which a key's share isn't looked at, and the most keys that are sent to the rows.
MANY, SENT_KEYS = 1_000_000, 10_000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts by key. facts: a row for each key, with n, how many of the ``total`` rows have it. Keys with more than a
    SENT_KEYS-th of all rows are fewer than SENT_KEYS, whatever the input: their facts are sent to the rows, the others meet by a shuffle."""
    told = facts.drop("n")
    if total < MANY:
        return rows.join(told, key)
    hot = F.broadcast(facts.where(F.col("n") > total // SENT_KEYS).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("n") <= total // SENT_KEYS).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)
