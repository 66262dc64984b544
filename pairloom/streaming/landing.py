"""Streams of generated lines, entities and rewards.

The transformations are those of the batch operators; a stream only adds the source, the
state bounds and the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions import text as X
from pairloom.operators import entities as M
from pairloom.operators import validation as V

# A task keeps the files of both sides open, instead of sorting all its rows by side before it writes.
BOTH_OPEN = "spark.sql.maxConcurrentOutputFileWriters"
LINE = T.StructType([T.StructField("value", T.StringType())])


def table_stream(spark: SparkSession, folder: str, file_name: str, schema: T.StructType, files: int = 64) -> DataFrame:
    """Files of a folder whose name matches, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .option("pathGlobFilter", file_name)
        .parquet(folder)
    )


def landing_stream(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """Lines of text files as they arrive, blank ones skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return lines.select(
        F.col("_metadata")["file_name"].alias("batch"), X.strip(F.col("value")).alias("line")
    ).filter(F.length("line") > 0)


def validate_stream(lines: DataFrame, path: str, checkpoint: str, batch: str = "batch") -> StreamingQuery:
    """Write checked lines to ``path``, split by ``accepted``; runs until the input is used up.

    Readers of one side read its folders only. Each micro-batch overwrites its own folder, so a
    batch that is run again after a failure does not write its rows twice.
    """

    def write(frame: DataFrame, number: int) -> None:
        frame.sparkSession.conf.set(BOTH_OPEN, "2")  # the stream's own session
        rows = V.accept(frame)
        shown = F.when(~F.col("accepted"), F.col("line")).alias("line")
        rows.select(batch, "input", "output", shown, "accepted").write.mode("overwrite").partitionBy("accepted").parquet(
            f"{path}/run={number}"
        )

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`validate_stream` wrote; a filter on ``accepted`` reads only that side."""
    return spark.read.parquet(path).withColumn("accepted", F.col("accepted").cast("boolean"))


def merge_stream(entities: DataFrame, path: str, checkpoint: str, conv: str = "conv_id") -> StreamingQuery:
    """Keep the merged entities of every conversation in the table at ``path``, in whatever order chunks arrive.

    State per (conversation, kind, key) is the entity of the smallest (chunk_no, pos) so far, with all its fields; an
    earlier chunk that arrives late takes its place. Each micro-batch writes the keys it touched; a batch run again after
    a failure overwrites its own folder, and a restart goes on from the state of the checkpoint. The state has the size
    of the merged table; choose the RocksDB provider where it outgrows memory.
    """
    return upsert_to(M.first_of_key(entities, conv), path, checkpoint)


def merged(spark: SparkSession, path: str, conv: str = "conv_id") -> DataFrame:
    """What :func:`merge_stream` holds now: (conv, kind, key, chunk_no, pos, name and the other fields)."""
    return latest(spark.read.parquet(path), conv, "kind", "key")


def running_means(rewards: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the rewards so far per key, for an ``update`` or ``complete`` sink."""
    return rewards.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def upsert_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed rows of an aggregation; each micro-batch overwrites its own folder.

    The latest row per key is the one of the highest ``run`` (see :func:`latest`).
    """

    def write(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/run={number}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest ``run`` per key."""
    rest = [c for c in df.columns if c not in (*keys, "run")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run").alias("x")).select(*keys, "x.*")
