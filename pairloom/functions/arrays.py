"""Token-array operations: truncation, padding, masks and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100  # label value the loss skips


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, even inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per array entry (entries are not NULL).

    Same rows as ``explode``, but a costly ``items`` is computed once: for a plain ``explode``
    the optimizer adds a filter on the array's size, which computes it a second time.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(position).isNotNull())


def once(df: DataFrame, column: str) -> DataFrame:
    """The same rows, with ``column`` computed before what uses it.

    The optimizer would put its expression in the place of its uses: into filters that it pushes down, as often as they
    name the column, and into lambda functions, which are interpreted with all they hold. It moves nothing past ``explode``.
    """
    kept = [F.explode_outer(F.array(F.col(f"`{c}`"))).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept)


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The same rows with the column ``name``, which what follows reads and never computes again (see :func:`once`).

    Unlike :func:`let`, steps bound one after the other stay compiled: a lambda is interpreted with all that it holds.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def first_n(ids: Column, n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)))


def last_n(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) <= n, ids).otherwise(F.slice(ids, -n, n))


def truncate(ids: Column, n: int, mode: str = "keep_start") -> Column:
    if mode == "keep_start":
        return first_n(ids, n)
    if mode == "keep_end":
        return last_n(ids, n)
    raise ValueError(f"unknown truncation mode: {mode}")


def last_n_keeping(ids: Column, n: int, protected: list[int]) -> Column:
    """``n`` ids: every protected one, the rest taken from the end, order kept."""
    keep = F.array(*[F.lit(p) for p in protected])
    plain_at = F.filter(
        F.transform(ids, lambda x, i: F.when(~F.array_contains(keep, x), i)), lambda i: i.isNotNull()
    )
    wanted = F.lit(n) - (F.size(ids) - F.size(plain_at))
    cut = F.when(wanted <= 0, F.size(ids)).otherwise(
        F.coalesce(F.get(plain_at, F.size(plain_at) - wanted), F.lit(0))
    )
    return let(cut, lambda at: F.filter(ids, lambda x, i: F.array_contains(keep, x) | (i >= at)))


def pad_right(ids: Column, length: int, pad: int) -> Column:
    """Truncate on the right and fill up to ``length``."""
    kept = first_n(ids, length)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def add_bos(ids: Column, bos: int) -> Column:
    present = F.coalesce(F.get(ids, F.lit(0)) == bos, F.lit(False))
    return F.when(present, ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def add_eos(ids: Column, eos: int) -> Column:
    present = F.coalesce(F.get(ids, F.size(ids) - 1) == eos, F.lit(False))
    return F.when(present, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def prompt_labels(prompt: Column, answer: Column) -> Column:
    """Labels of prompt + answer: ignored over the prompt."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer)


def pad_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORE)).otherwise(x))


def attention_labels(labels: Column, mask: Column) -> Column:
    return F.zip_with(labels, mask, lambda x, m: F.when(m == 0, F.lit(IGNORE)).otherwise(x))


def completion_mask(prompt: Column, answer: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(answer)))


def left_pad_count(ids: Column, completion_length: int, pad: int) -> Column:
    """Pad tokens in the prompt part (everything before the completion)."""
    prompt = first_n(ids, F.size(ids) - completion_length)
    return F.size(F.filter(prompt, lambda x: x == pad))


def pads_to_right(ids: Column, pad: int) -> Column:
    kept = F.filter(ids, lambda x: x != pad)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.size(ids) - F.size(kept)))


def shifted_mask(ids: Column, left_pads: Column, max_left_pad: Column, pad: int) -> Column:
    """1 over completion tokens, 0 over left-over prompt tokens and pads."""
    skip = max_left_pad - left_pads
    return F.transform(ids, lambda x, i: ((i >= skip) & (x != pad)).cast("int"))


def _kept(ids: Column, eos: int) -> Column:
    """Number of tokens up to and including the first EOS, all where there is none."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at == 0, F.size(ids)).otherwise(at)


def mask_after_eos(ids: Column, eos: int) -> Column:
    """1 up to and including the first EOS, 0 after it."""
    kept = _kept(ids, eos)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.size(ids) - kept))


def cut_after_eos(ids: Column, eos: int, pad: int) -> Column:
    """Replace everything after the first EOS by pads."""
    kept = _kept(ids, eos)
    return F.concat(first_n(ids, kept), F.array_repeat(F.lit(pad), F.size(ids) - kept))


def drop_unterminated(mask: Column, ids: Column, eos: int) -> Column:
    """All zeros where the completion has no EOS."""
    return F.when(F.array_contains(ids, eos), mask).otherwise(F.transform(mask, lambda m: F.lit(0)))


def stepwise_ids(steps: Column, separator: list[int]) -> Column:
    """Concatenate the steps, each ended by the separator."""
    sep = F.array(*[F.lit(s) for s in separator])
    return F.flatten(F.transform(steps, lambda s: F.concat(s, sep)))


def stepwise_labels(steps: Column, labels: Column, separator: list[int], last_step_only: bool = False) -> Column:
    """The step's label on its last token, ignored elsewhere."""
    extra = len(separator)

    def one(step, i):
        value = F.get(labels, i).cast("int")
        if last_step_only:
            value = F.when(i == F.size(steps) - 1, value).otherwise(F.lit(IGNORE))
        return F.concat(F.array_repeat(F.lit(IGNORE), F.size(step) + (extra - 1)), F.array(value))

    return F.flatten(F.transform(steps, one))


def joined(ids: Column, sep: str = ",") -> Column:
    """Array as text, for display and comparison."""
    return F.array_join(ids.cast("array<string>"), sep, "null")
