"""Streaming queries: each runs a stream over a table to its end and reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import jsonx as J
from pairloom import schemas
from pairloom.operators import validation as V
from pairloom.plans.json_queries import ACCEPTED, CHECKED, ENTITIES
from pairloom.plans.registry import q6, query, r6
from pairloom.functions.scratch import scratch_dir
from pairloom.plans.tables import Tables
from pairloom.streaming import landing as S


def stream_of(t, name):
    return S.table_stream(t.spark, t.folder, f"{name}.parquet", getattr(t, name).schema)


class Streamed(Tables):
    """The same derived inputs, with one table read as a stream."""

    def __init__(self, t, name):
        super().__init__(t.spark, t.folder)
        self._name, self._stream = name, stream_of(t, name)

    def __getattr__(self, name):
        return self._stream if name == self._name else super().__getattr__(name)


@query(
    "stream_validate",
    f"""SELECT batch, count(*) FILTER (WHERE {ACCEPTED}) AS valid, count(*) FILTER (WHERE NOT {ACCEPTED}) AS invalid
        FROM ({CHECKED}) GROUP BY batch""",
    ("lines",),
)
def _(t):
    base = scratch_dir(t.spark, "validate")
    S.validate_stream(Streamed(t, "lineitem").lines(), base + "/out", base + "/state").awaitTermination()
    out = S.read_checked(t.spark, base + "/out")
    return out.groupBy("batch").agg(F.count_if("accepted").alias("valid"), F.count_if(~F.col("accepted")).alias("invalid"))


@query(
    "stream_merge",
    f"""SELECT conv_id, kind, key, chunk_no, pos, name, dosage, frequency, duration, route, timing
        FROM (SELECT *, CASE WHEN kind = 'disease' THEN name ELSE lower(coalesce(name, '')) END AS key FROM ({ENTITIES}))
        WHERE kind <> 'disease' OR name <> ''
        QUALIFY row_number() OVER (PARTITION BY conv_id, kind, key ORDER BY chunk_no, pos) = 1""",
    ("model_output",),
)
def _(t):
    base = scratch_dir(t.spark, "merge")
    events = Streamed(t, "events")
    rows = events.model_output().select(
        "conv_id", "chunk_no", J.typed(J.recover_object(F.col("text")), schemas.PRESCRIPTION).alias("record")
    )
    S.merge_stream(V.explode_entities(rows, ["conv_id", "chunk_no"]), base + "/out", base + "/state").awaitTermination()
    return S.merged(t.spark, base + "/out")


@query("stream_running_mean", f"SELECT event_type, {q6('avg(value)')} AS mean, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    base = scratch_dir(t.spark, "means")
    means = S.running_means(stream_of(t, "events").select("event_type", "value"), "event_type", "value")
    S.upsert_to(means, base + "/out", base + "/state").awaitTermination()
    out = S.latest(t.spark.read.parquet(base + "/out"), "event_type")
    return out.select("event_type", r6(F.col("mean")).alias("mean"), "n")
