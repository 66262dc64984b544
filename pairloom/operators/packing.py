"""Packing token sequences into blocks of one length.

Both strategies pack within batches of ``batch_rows`` rows that follow each other by key, whatever
the keys are, so a batch, and with it every window and Python group, has a bounded number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import ordered


def _batches(df: DataFrame, key: str, ids: str, batch_rows: int) -> DataFrame:
    ranked = ordered.numbered(df.select(key, F.col(ids).alias("ids")), [key], "__rank")
    return ranked.select(F.floor(F.col("__rank") / batch_rows).alias("batch"), key, "ids")


def pack_wrapped(df: DataFrame, key: str, length: int, ids: str = "ids", batch_rows: int = 1000) -> DataFrame:
    """(batch, pack, ids): the token stream of a batch cut every ``length`` tokens."""
    rows = _batches(df, key, ids, batch_rows).filter(F.size("ids") > 0).withColumn("n", F.size("ids").cast("bigint"))
    before = Window.partitionBy("batch").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length)
    cut = rows.withColumn("pack", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("pack") * length - F.col("at"), F.lit(0))
    end = F.least((F.col("pack") + 1) * length - F.col("at"), F.col("n"))
    piece = F.slice("ids", (start + 1).cast("int"), (end - start).cast("int"))
    pieces = cut.select("batch", "pack", "at", piece.alias("piece"))
    whole = F.array_sort(F.collect_list(F.struct("at", "piece")))["piece"]
    return pieces.groupBy("batch", "pack").agg(F.flatten(whole).alias("ids"))


def best_fit(sizes: list[int], length: int) -> list[int]:
    """Bin of each item: items by falling size, each into the fullest bin it fits."""
    bins: list[int] = [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    count = 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            free, target = length, count
            count += 1
        else:
            free, target = room.pop(at)
        bins[i] = target
        insort(room, (free - sizes[i], target))
    return bins


def pack_best_fit(df: DataFrame, key: str, length: int, ids: str = "ids", batch_rows: int = 1000) -> DataFrame:
    """(batch, pack, ids): best-fit decreasing; longer rows are first cut every ``length`` tokens.

    Only sizes go to Python; the tokens are joined to their packs inside Spark.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = _batches(df, key, ids, batch_rows).filter(F.size("ids") > 0)
    starts = F.sequence(F.lit(0), F.size("ids") - 1, F.lit(length))
    pieces = rows.select("batch", key, "ids", F.posexplode(starts).alias("piece", "start")).select(
        "batch", key, "piece", F.slice("ids", F.col("start") + 1, F.lit(length)).alias("ids")
    )

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, "piece"])
        return frame[["batch", key, "piece"]].assign(pack=best_fit(frame["n"].tolist(), length))

    sizes = pieces.select("batch", key, "piece", F.size("ids").alias("n"))
    packs = sizes.groupBy("batch").applyInPandas(place, f"batch bigint, {key} {key_type}, piece int, pack bigint")
    placed = pieces.join(packs, ["batch", key, "piece"])
    whole = F.array_sort(F.collect_list(F.struct(key, "piece", "ids")))["ids"]
    return placed.groupBy("batch", "pack").agg(F.flatten(whole).alias("ids"))
