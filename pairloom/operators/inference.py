"""Batch inference: a caller's model over rows, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply_model(
    df: DataFrame,
    load: Callable[[], Callable[[list, int], list]],
    input_column: str,
    keys: list[str],
    result_type: T.DataType = T.StringType(),
    batch_size: int = 32,
    max_retries: int = 2,
) -> DataFrame:
    """Run a model over ``input_column``; add ``result``, ``error`` and ``attempts``.

    ``load()`` returns the model, once per Python task: a function of (inputs, attempt) that
    returns one result per input, None where it failed. Only failed inputs are tried again.
    Rows are neither dropped nor moved; inputs of a batch are at most ``batch_size``.
    """
    needed = df.select(*keys, input_column)
    key_fields = [needed.schema[k] for k in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("result", result_type),
            T.StructField("error", T.StringType()),
            T.StructField("attempts", T.LongType()),
        ]
    )

    def tried(model, inputs: list) -> tuple[list, list, list]:
        results, errors, attempts = [None] * len(inputs), [None] * len(inputs), [0] * len(inputs)
        waiting = list(range(len(inputs)))
        for attempt in range(1, max_retries + 1):
            if not waiting:
                break
            try:
                got, problem = model([inputs[i] for i in waiting], attempt), "no result"
            except Exception as error:  # a model error is data: it goes to the error column
                got, problem = [None] * len(waiting), f"{type(error).__name__}: {error}"
            for i, value in zip(waiting, got):
                results[i], attempts[i] = value, attempt
                errors[i] = problem if value is None else None
            waiting = [i for i in waiting if results[i] is None]
        return results, errors, attempts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                results, errors, attempts = tried(model, part[input_column].tolist())
                yield part[keys].assign(result=results, error=errors, attempts=attempts)

    return needed.mapInPandas(run, schema)


def word_count_stub() -> Callable[[list, int], list]:
    """Stands in for a model: answers with JSON, and fails on texts that hold no object."""

    def model(texts: list, attempt: int) -> list:
        return [None if t is None or not t.rstrip("`\n ").endswith("}") else '{"words":%d}' % len(t.split(" ")) for t in texts]

    return model
