"""Order-dependent computations that never put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one
task. Here rows are split into blocks that follow the order (``row_no`` divided by a
block size, a time slot, the leading digits of a hash). A window runs inside each
block; one summary row per block carries values across block borders. Only the
summaries of a key meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.scratch import materialize

BLOCK = "__block"
PART, PLACE = "__part", "__place"


def ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows in range partitions of ``order``, with the partition and the place of each row in it.

    Written once: the borders come from a sample, and every later use must see the same ones. Parts have about
    the same number of rows whatever the values are; ``order`` should be total, since equal rows stay together.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return materialize(rows.select("*", F.spark_partition_id().alias(PART), place.alias(PLACE)), "ranged")


def numbered(df: DataFrame, order: list, name: str = "rank", first: int = 0) -> DataFrame:
    """Add the position of each row over the whole table, counted from ``first``.

    The place within a range partition plus the rows of the partitions before it; there is one count per
    partition, however many rows there are and whatever their keys.
    """
    rows = ranged(df, order)
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(sizes.select(PART, before.alias("__before"))), PART)
    return placed.select(*df.columns, (F.col("__before") + F.col(PLACE) + first).alias(name))


def _joined(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Attach block summaries. Plain equality keeps the partitioning the window made;
    keys must not be NULL (such rows get a NULL result)."""
    return rows.join(summary, keys + [BLOCK], "left")


def running_sums(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list,
    values: dict[str, Column],
    inclusive: bool = True,
    whole: str = "",
) -> DataFrame:
    """Add a running sum per entry of ``values``, over ``order`` within ``keys``.

    With a suffix ``whole`` the sums over all rows of the key are added under the names with that suffix. ``block`` must not decrease along ``order``. ``order`` must be total.
    """
    rows = df.withColumn(BLOCK, block)
    names = list(values)
    for n in names:
        rows = rows.withColumn("__v_" + n, values[n])
    totals = rows.groupBy(*keys, BLOCK).agg(*[F.sum("__v_" + n).alias("__t_" + n) for n in names])
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    every = [F.sum("__t_" + n).over(Window.partitionBy(*keys)).alias(n + whole) for n in names] if whole else []
    offsets = totals.select(
        *keys, BLOCK, *[F.coalesce(F.sum("__t_" + n).over(across), F.lit(0)).alias("__o_" + n) for n in names], *every
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = rows.select("*", *[F.coalesce(F.sum("__v_" + n).over(inside), F.lit(0)).alias("__l_" + n) for n in names])
    out = _joined(local, offsets, keys)
    sums = [(F.col("__l_" + n) + F.col("__o_" + n)).alias(n) for n in names]
    return out.select(*df.columns, *sums, *[n + whole for n in names if whole])


def neighbours(
    df: DataFrame, keys: list[str], block: Column, order: list[str], column: str, name: str, step: int
) -> DataFrame:
    """Add the previous (``step=-1``) or next (``step=1``) row's value of ``column``."""
    rows = df.withColumn(BLOCK, block)
    position = F.struct(*order)
    edge = F.max_by if step < 0 else F.min_by
    edges = rows.groupBy(*keys, BLOCK).agg(edge(F.struct(column), position).alias("__edge"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    beside = F.lag("__edge") if step < 0 else F.lead("__edge")
    summary = edges.select(*keys, BLOCK, beside.over(across).alias("__beside"))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    shifted = (F.lag(F.struct(column)) if step < 0 else F.lead(F.struct(column))).over(inside)
    out = _joined(rows.withColumn("__near", shifted), summary, keys)
    near = F.when(F.col("__near").isNotNull(), F.col("__near")[column]).otherwise(F.col("__beside")[column])
    return out.select(*df.columns, near.alias(name))


def concat_ordered(
    df: DataFrame, keys: list[str], block: Column, order: list[str], text: str, sep: str, name: str
) -> DataFrame:
    """Join the texts of a key in order: first within blocks, then block by block."""
    parts = (
        df.withColumn(BLOCK, block)
        .groupBy(*keys, BLOCK)
        .agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias("__rows"))
        .select(*keys, BLOCK, F.array_join(F.col("__rows")["__text"], sep).alias("__text"))
    )
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, "__text"))).alias("__rows"))
    return whole.select(*keys, F.array_join(F.col("__rows")["__text"], sep).alias(name))


def hash_order(key: Column, seed: int | str = 42) -> Column:
    """Seeded, engine-independent shuffle key of a row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(key: Column, seed: int | str = 42) -> Column:
    """The first 52 bits of :func:`hash_order`, exact as a double too."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("bigint")


SKETCH = 16_384  # size parameter of the quantile sketch
MARGIN = 1e-3  # share of the rows on either side of the wanted one; some times the sketch's error
EXACT = 2_000_000  # rows around the wanted one that the exact pass may count singly


def _quantiles(spark: SparkSession, sketch: bytes, first: float, last: float, margin: float) -> tuple[float, float]:
    """The sketch's values at two ranks (0 to 1), moved apart by a margin."""
    at = [F.lit(min(max(r, 0.0), 1.0)) for r in (first - margin, last + margin)]
    names = "kll_sketch_get_quantile_double(:sketch, :low), kll_sketch_get_quantile_double(:sketch, :high)"
    return tuple(spark.sql(f"SELECT {names}", {"sketch": F.lit(bytes(sketch)), "low": at[0], "high": at[1]}).first())


def order_statistics(df: DataFrame, columns: list[str], wanted: Column, count: int = 1) -> list[Row | None]:
    """Rows number ``wanted`` (from 1), ``wanted`` + 1, ... by numeric ``columns``; None beyond the end.

    ``wanted`` may use ``n``, the number of rows. Rows with a NULL in a column take no part; NaN sorts last. One pass
    keeps a mergeable quantile sketch of the first column, which brackets the wanted rows; one more counts the rows below
    the bracket and, value by value, those inside. Where a bracket would hold more than ``EXACT`` rows it is sketched
    again first: 10^12 rows take four passes. The data are neither sorted nor moved.
    """
    rows = df.select(*columns)
    for name in columns:
        rows = rows.filter(F.col(name).isNotNull())
    number = F.col(columns[0]).cast("double")
    rows = rows.withColumn("__x", F.when(F.isnan(number), math.inf).otherwise(number))
    x, margin = F.col("__x"), MARGIN
    while True:
        low, high, held = -math.inf, math.inf, None
        while held is None or held * 2 * margin > EXACT and low < high:
            inside = x.between(F.lit(low), F.lit(high))
            sketch = F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH)).alias("sketch")
            counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(x < F.lit(low)).alias("below"), F.count_if(inside).alias("m"), sketch)
            found = counted.withColumn("k", wanted.cast("bigint")).first()
            if not 1 <= found["k"] <= found["n"]:
                return [None] * count
            k, before, start = found["k"], (low, high), found["k"] - found["below"]
            if not 0 < start <= found["m"]:
                break  # the sketch was further off than the margin: the exact pass tells, and the margin grows
            low, high, held = *_quantiles(df.sparkSession, found["sketch"], start / found["m"], (start + count - 1) / found["m"], margin + 2 / found["m"]), found["m"]
            if (low, high) == before:
                break
        place = F.when(x < F.lit(low), 0).when(x > F.lit(high), 2).otherwise(1)
        value = F.when(place == 1, F.struct(*columns))
        tally = rows.groupBy(place.alias("place"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("place", "v").rowsBetween(Window.unboundedPreceding, 0))
        hits = [F.min(F.when(F.col("upto") >= k + i, F.struct("upto", "place", "v"))).alias(str(i)) for i in range(count)]
        hit = tally.withColumn("upto", upto).agg(*hits).first()
        if all(h is None or h["place"] == 1 for h in hit):
            return [h and h["v"] for h in hit]
        margin *= 8


def kth_smallest(df: DataFrame, columns: list[str], k: int | Column) -> Row | None:
    """The ``k``-th row (1-based) by numeric ``columns``, as a Row; None beyond the end."""
    return order_statistics(df, columns, F.lit(k) if isinstance(k, int) else k)[0]


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Quantile with linear interpolation between the two nearest values."""
    at = q * (F.col("n") - 1)
    rows = df.select(F.col(column).alias("v"))
    low, high = order_statistics(rows, ["v"], F.floor(at) + 1, 2)
    if low is None:
        return None
    n = rows.agg(F.count("v").alias("n")).first()["n"]
    part = q * (n - 1) - math.floor(q * (n - 1))
    return float(low["v"]) if part == 0 or high is None else float(low["v"]) + (float(high["v"]) - float(low["v"])) * part
