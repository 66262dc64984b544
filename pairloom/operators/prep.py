"""Training-set preparation: formatting, splits, vocabulary, truncation, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import arrays as A
from pairloom.functions import text as X
from pairloom.functions import ordered

TURN_START, TURN_END = "<start_of_turn>", "<end_of_turn>"  # fixed values: turn tokens
HEAD = TURN_START + "user\nReturn the prescription below as JSON.\n"
MIDDLE = TURN_END + "\n" + TURN_START + "model\n"
TAIL = TURN_END


# -- formatting --------------------------------------------------------------------------
def format_example(
    source: Column, output: Column, head: str = HEAD, middle: str = MIDDLE, tail: str = TAIL, marker: bool = True
) -> Column:
    """Instruction, input and output in one text; the output ends with exactly one marker."""
    answer = X.append_marker(output) if marker else output
    return F.concat(F.lit(head), source, F.lit(middle), answer, F.lit(tail))


def format_request(source: Column, head: str = HEAD, middle: str = MIDDLE) -> Column:
    """The same without an output, to ask a model for one."""
    return F.concat(F.lit(head), source, F.lit(middle))


def render_chat(
    turns: DataFrame, conv: str = "conv_id", role_names: dict[str, str] | None = None, block_turns: int = 4096
) -> DataFrame:
    """One text per conversation, each turn between its turn tokens."""
    names = {"assistant": "model"} if role_names is None else role_names
    role = F.col("role")
    for name, shown in names.items():
        role = F.when(F.col("role") == name, F.lit(shown)).otherwise(role)
    line = F.concat(F.lit(TURN_START), role, F.lit("\n"), F.col("text"), F.lit(TURN_END + "\n"))
    rows = turns.select(conv, "turn", line.alias("line"))
    return ordered.concat_ordered(rows, [conv], F.floor(F.col("turn") / block_turns), ["turn"], "line", "", "chat")


# -- splits and sampling -----------------------------------------------------------------
def split_hash(key: Column, seed: int = 42) -> Column:
    """What :func:`split_exact` orders rows by: the first 104 bits of a seeded hash, as two numbers."""
    low = F.conv(F.substring(ordered.hash_order(key, seed), 14, 13), 16, 10).cast("bigint")
    return F.struct(ordered.hash_number(key, seed).alias("high"), low.alias("low"))


def split_exact(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, hashed: bool = False) -> DataFrame:
    """Add ``split``: exactly ``ceil(fraction * n)`` rows are ``val``, the others ``train``.

    Rows are taken in the order of a seeded hash of their unique id. Only the hash that
    separates the two parts is searched for (see :func:`ordered.kth_smallest`); the rows
    themselves are neither sorted nor shuffled. ``hashed``: ``key`` holds :func:`split_hash` of the id already.
    """
    order = F.col(key) if hashed else split_hash(F.col(key), seed)
    high, low = order["high"], order["low"]
    hashes = df.select(high.alias("high"), low.alias("low"))
    last = ordered.kth_smallest(hashes, ["high", "low"], F.ceil(F.lit(float(fraction)) * F.col("n")))
    if last is None:
        return df.withColumn("split", F.lit("train"))
    in_val = (high < last["high"]) | ((high == last["high"]) & (low <= last["low"]))
    return df.withColumn("split", F.when(in_val, F.lit("val")).otherwise(F.lit("train")))


def split_ordered(df: DataFrame, key: str, fraction: float = 0.9) -> DataFrame:
    """Add ``split``: the first ``int(fraction * n)`` rows by a unique numeric id are ``train``."""
    last = ordered.kth_smallest(df, [key], F.floor(F.lit(float(fraction)) * F.col("n")))
    if last is None:
        return df.withColumn("split", F.lit("val"))
    return df.withColumn("split", F.when(F.col(key) <= last[key], F.lit("train")).otherwise(F.lit("val")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in a seeded random order."""
    rows = df.withColumn("__hash", ordered.hash_order(F.col(key), seed))
    return ordered.numbered(rows, ["__hash", key], name).drop("__hash")


def repeat_prompts(
    df: DataFrame, key: str, copies: int, batch: int = 1, repeats: int = 1, seed: int = 42
) -> DataFrame:
    """Each row ``copies`` times in a row, in seeded order; each batch ``repeats`` times.

    ``position`` is the place in the resulting order. The last, smaller batch is kept.
    """
    order = seeded_shuffle(df, key, seed, "__rank")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    group = F.floor(F.col("__rank") / batch)
    inside = F.col("__rank") - group * batch
    width = F.least(F.lit(batch).cast("bigint"), n - group * batch)
    rows = order.withColumn("__width", width).withColumn("__first", group * batch * repeats * copies).withColumn("__in", inside)
    rows = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    position = F.col("__first") + (F.col("repeat_no") * F.col("__width") + F.col("__in")) * copies + F.col("copy_no")
    return rows.select(*df.columns, "repeat_no", "copy_no", position.alias("position"))


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` draws, each a row chosen by a seeded hash of the draw's number.

    Draw i takes the row at the drawn place in the order of the unique ``key``. Draws of one row are counted before
    they meet the rows.
    """
    rows = ordered.numbered(df, [key], "__rank", 1)
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = df.sparkSession.range(1, n + 1).select((1 + ordered.hash_number(F.col("id"), seed) % size).alias("__rank"))
    counted = drawn.groupBy("__rank").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    repeated = rows.join(counted, "__rank").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return repeated.drop("__rank", "__n")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` different rows, those with the smallest seeded hash of their unique id."""
    rows = df.withColumn("__h", ordered.hash_number(F.col(key), seed))
    last = ordered.kth_smallest(rows, ["__h", key], n)
    if last is None:
        return df
    before = (F.col("__h") < last["__h"]) | ((F.col("__h") == last["__h"]) & (F.col(key) <= last[key]))
    return rows.filter(before).drop("__h")


# -- vocabulary --------------------------------------------------------------------------
def vocabulary(docs: DataFrame, words: Column, first_id: int = 0) -> DataFrame:
    """(token, n, token_id): ids by falling count, then by token. Written once, however often it is used."""
    counted = A.unnest(docs, [], words, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return ordered.numbered(counted, [F.col("n").desc(), "token"], "token_id", first_id)


BLOCK_ROWS = 256  # texts that meet their part of a vocabulary together


def _translated(rows: DataFrame, key: str, items: Column, table: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """(key, out): the items of each row replaced by ``target`` of the row in ``table`` whose ``source`` they are.

    Rows are dealt to blocks by their key. Each block asks the table once for each of its different items, so what
    travels is the rows and a dictionary per block, not every item. Items that the table lacks are left out. Rows of
    one key get the items of all of them, by place and then by value; rows without a key get none.
    """
    number = rows.agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("n")).scalar()
    block = F.pmod(F.xxhash64(key), F.greatest(number, F.lit(1)).cast("bigint"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__block", block).repartition(parts, "__block")  # rows travel as they are, items are made after
    asked = A.unnest(dealt, ["__block"], F.array_distinct(items), source).distinct()
    known = asked.join(table.select(source, target), source).select(F.col("__block").alias("__of"), source, target)
    whole = dealt.select("__block", key, items.alias("__items"))
    kind = whole.schema[key].dataType.simpleString()
    of = table.schema[target].dataType.simpleString()

    def translate(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, held = left.column(key).combine_chunks(), left.column("__items").combine_chunks()
        lengths = np.nan_to_num(pc.list_value_length(held).to_numpy(zero_copy_only=False)).astype("int64")
        order = pc.sort_indices(right.column(target))
        targets = right.column(target).take(order).combine_chunks()
        at = pc.index_in(held.flatten().cast(right.schema.field(source).type), value_set=right.column(source).take(order).combine_chunks())
        owner, place = np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found = pc.is_valid(at).to_numpy(zero_copy_only=False)
        owner, place, at = owner[found], place[found], at.drop_null().to_numpy(zero_copy_only=False)
        names = keys.dictionary_encode()
        codes = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
        if len(names.dictionary) < len(codes):  # a key is repeated, or there is none
            sorted_ = np.lexsort((at, place, codes[owner]))
            sorted_ = sorted_[codes[owner][sorted_] >= 0]
            per_key = np.bincount(codes[owner][sorted_], minlength=len(names.dictionary))
            first = np.cumsum(per_key) - per_key
            counts = np.where(codes >= 0, per_key[codes] if len(per_key) else 0, 0)
            begin = np.repeat(np.where(codes >= 0, first[codes] if len(first) else 0, 0), counts)
            at = at[sorted_][begin + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        else:
            counts = np.bincount(owner, minlength=len(codes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.table({key: keys, out: pa.ListArray.from_arrays(offsets, targets.take(pa.array(at)))})

    return whole.groupBy("__block").cogroup(known.groupBy("__of")).applyInArrow(translate, f"`{key}` {kind}, `{out}` array<{of}>")


def encode(docs: DataFrame, key: str, words: Column, vocab: DataFrame) -> DataFrame:
    """(key, ids): the words of each text as ids, in order; unknown words are left out."""
    return _translated(docs, key, words, vocab, "token", "token_id", "ids")


def decode(encoded: DataFrame, key: str, vocab: DataFrame, ids: str = "ids", sep: str = " ") -> DataFrame:
    """(key, text): ids back to words. The ids are written first, as they are read twice."""
    rows = _translated(ordered.materialize(encoded.select(key, ids), "encoded"), key, F.col(ids), vocab, "token_id", "token", "words")
    return rows.select(key, F.array_join("words", sep).alias("text"))


def tokenize_with(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """Column function around a caller's tokenizer, loaded once per Python task."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def tokenize(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_batch = load()
        for texts in parts:
            yield pd.Series(encode_batch(texts.fillna("").tolist()))

    return tokenize


# -- truncation to a budget --------------------------------------------------------------
def truncate_pair(
    df: DataFrame,
    max_length: int,
    max_prompt_length: int,
    mode: str = "keep_end",
    prompt: str = "prompt",
    chosen: str = "chosen",
    rejected: str = "rejected",
) -> DataFrame:
    """Cut the prompt where prompt + longer answer exceed ``max_length``; where they still do,
    cut both answers to ``max_length - max_prompt_length``."""
    longer = F.greatest(F.size(chosen), F.size(rejected))
    over = F.size(prompt) + longer > max_length
    short = F.when(over, A.truncate(F.col(prompt), max_prompt_length, mode)).otherwise(F.col(prompt))
    rows = df.withColumn("__longer", longer).withColumn(prompt, short)
    still = F.size(prompt) + F.col("__longer") > max_length
    cut = lambda c: F.when(still, A.first_n(F.col(c), max_length - max_prompt_length)).otherwise(F.col(c))
    return rows.select(*[cut(c).alias(c) if c in (chosen, rejected) else F.col(c) for c in df.columns])


# -- preference pairs --------------------------------------------------------------------
def extract_prompt(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Move the common start of both answers into ``prompt``."""
    rows = pairs.withColumn("prompt", X.shared_prefix(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.substring(F.col(c), F.length("prompt") + 1, F.length(c))
    return rows.withColumn(chosen, rest(chosen)).withColumn(rejected, rest(rejected))


def unpair(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two labelled rows per preference."""
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    both = F.array(
        F.struct(F.col(chosen).alias("completion"), F.lit(True).alias("label")),
        F.struct(F.col(rejected).alias("completion"), F.lit(False).alias("label")),
    )
    return pairs.select(*rest, F.explode(both).alias("x")).select(*rest, "x.*")


def mismatched_pairs(
    df: DataFrame, key: str, batch: int, completion: str = "completion", mode: str = "mirror"
) -> DataFrame:
    """Give each row the completion of another row of its batch, as ``kl_completion``.

    Batches are runs of ``batch`` rows by the unique ``key``, whatever its type and density. ``mirror`` pairs the first
    row with the last, ``rotate`` each row with the one before it.
    """
    rows = ordered.numbered(df, [key], "__rank").withColumn("__batch", F.floor(F.col("__rank") / batch))
    items = F.array_sort(F.collect_list(F.struct("__rank", *df.columns)))
    grouped = rows.groupBy("__batch").agg(items.alias("x"))  # at most `batch` rows
    other = {
        "mirror": F.reverse("x"),
        "rotate": F.concat(F.slice("x", F.size("x"), F.lit(1)), F.slice("x", F.lit(1), F.size("x") - 1)),
    }[mode]
    zipped = F.zip_with("x", other, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = grouped.select(F.explode(zipped).alias("z"))
    return out.select(
        *[F.col("z")["a"][c].alias(c) for c in df.columns],
        F.col("z")["b"][key].alias("kl_" + key),
        F.col("z")["b"][completion].alias("kl_" + completion),
    )


# -- combining datasets ------------------------------------------------------------------
def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two datasets side by side, matched by row id."""
    return left.join(right, key)


def concat_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def class_balance(df: DataFrame, label: str = "label", desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """Counts per class, and the range in which one of the two weights should lie."""
    counts = df.agg(
        F.greatest(F.count_if(F.col(label)), F.lit(1)).alias("num_desirable"), F.count(F.lit(1)).alias("n")
    ).select("num_desirable", F.greatest(F.col("n") - F.col("num_desirable"), F.lit(1)).alias("num_undesirable"))
    d, u = F.col("num_desirable"), F.col("num_undesirable")
    bounds = counts.select(
        d,
        u,
        F.round(u * undesirable / d, 2).alias("desirable_low"),
        F.round(u * undesirable / d * 1.33, 2).alias("desirable_high"),
        F.round(d * desirable / u / 1.33, 2).alias("undesirable_low"),
        F.round(d * desirable / u, 2).alias("undesirable_high"),
    )
    fits = F.lit(desirable).between(F.col("desirable_low"), F.col("desirable_high")) | F.lit(undesirable).between(
        F.col("undesirable_low"), F.col("undesirable_high")
    )
    return bounds.withColumn("balanced", (d == u) | fits)
