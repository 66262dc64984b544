"""The shared folder for written intermediate tables, and small helpers for inputs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a folder of its own only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files: each query's go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the work is done once, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ARROW_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few thousand at a time; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def released(work):
    """``work`` on Arrow batches; when its task ends, free memory goes back to the system instead of to the idle worker."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def apart(docs: DataFrame, *inner: str) -> DataFrame:
    """The same rows, with columns renamed that are called like an operator's own ones."""
    return docs.toDF(*[f"own {c}" if c.lower() in inner else c for c in docs.columns])


FILTER_BITS = 1 << 26


def likely_among(keys: DataFrame, key: str):
    """A function of a 64-bit column: false only for values that are not in ``keys``.

    A Bloom filter with three bits a value, 16 to 32 bits for each of the ``keys`` and ``FILTER_BITS`` (8 MB) at most: it
    passes through the driver. It spares a shuffle most rows without a partner; the join behind it decides, so a full
    filter costs speed and no rows.
    """
    wide = min(FILTER_BITS.bit_length() - 1, max(13, (16 * keys.count()).bit_length()))
    size, shift = (1 << wide) // 8, np.uint64(64 - wide)

    def places(values):
        v = values.astype(np.int64).view(np.uint64)
        return [((v >> np.uint64(s)) ^ (v * np.uint64(m))) >> shift for s, m in ((0, 0x9E3779B97F4A7C15), (7, 0xC2B2AE3D27D4EB4F), (13, 0x165667B19E3779F9))]

    def collect(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy()
            for at in places(values):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield pa.record_batch({"bits": pa.array([bits.tobytes()], pa.binary())})

    def merge(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            for part in batch.column(0):
                bits |= np.frombuffer(part.as_buffer(), np.uint8)
        yield pa.record_batch({"bits": pa.array([bits.tobytes()], pa.binary())})

    spark = keys.sparkSession
    parts = keys.select(key).coalesce(16).mapInArrow(collect, "bits binary")
    rows = parts.repartition(1).mapInArrow(merge, "bits binary").collect()
    shared = spark.sparkContext.broadcast(bytes(rows[0][0]) if rows else bytes(size))

    @F.pandas_udf("boolean")
    def among(values: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        hit = np.ones(len(values), bool)
        for at in places(values.to_numpy()):
            hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    return among
