"""Exact top-k inner products over norm-sorted blocks.

Components x become floor(256 * x). Vectors are ordered by descending length: tiers between quantiles of the length,
and within a tier blocks of about ``BLOCK`` rows, so one length shared by a third of all rows is many blocks. All
vectors are rotated by the eigenvectors of the table's Gram matrix (its SVD), which moves most of each length into
the first ``HEAD`` coordinates. Queries are taken in blocks of the same kind, so they share lengths.

Pass 1 meets every query block with the first candidate blocks and gives each query a lower limit, its k-th best score
so far. Pass 2 meets a query block with the later blocks whose length times the query's can still reach that limit
(Cauchy-Schwarz); inside, the partial sum over the first coordinates plus the product of the remaining lengths
bounds each pair, and only pairs above the limit get their exact integer product. Blocks travel as rows of
bounded size. Ties go to the smaller id.

Vectors that are null, empty, or hold null or non-finite components take no part; rows without id neither. A row is
known by its id: rows with the query's id are no candidates of it, repeated rows of one id and one vector count once.
Vectors of another number of dimensions than the most frequent one take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import save

BLOCK = 1024
TIERS = 64
HEAD = 24


def whole_numbers(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v, norm): usable rows with integer components."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(usable & F.col(id_col).isNotNull())
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).dropDuplicates(["id", "v"])
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, strongest first. Each task sends one size x size sum."""

    def gram(batches):
        total = np.zeros((size, size))
        for batch in batches:
            m = _matrix(batch.column(0)).astype(np.float64)
            if len(m):
                total += m.T @ m
        yield pa.record_batch({"g": pa.array([total.ravel()], pa.list_(pa.float64()))})

    parts = rows.select("v").mapInArrow(gram, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    sums = parts.groupBy("i").agg(F.sum("x").alias("x")).collect()  # size squared numbers
    g = np.zeros(size * size)
    for r in sums:
        g[r["i"]] = r["x"]
    return np.linalg.eigh(g.reshape(size, size))[1][:, ::-1].copy()


def blocks(rows: DataFrame, cuts: list[float], counts: dict[int, int]) -> DataFrame:
    """(tier, sub, high, ids, data): rows dealt into blocks; tier 0 holds the longest vectors."""
    tier = sum((F.col("norm") < c).cast("int") for c in cuts) if cuts else F.lit(0)
    many = F.create_map(*[F.lit(x) for t, n in sorted(counts.items()) for x in (t, max(1, -(-n // BLOCK)))])
    dealt = rows.withColumn("tier", tier).withColumn("sub", F.pmod(F.xxhash64("id", "v"), F.coalesce(many[F.col("tier")], F.lit(1))).cast("int"))

    def gather(key, group):
        v = _matrix(group["v"].combine_chunks())
        ids = group["id"].to_numpy()
        order = np.lexsort((ids, -group["norm"].to_numpy()))
        return pa.table(
            {
                "tier": pa.array([key[0].as_py()], pa.int32()),
                "sub": pa.array([key[1].as_py()], pa.int32()),
                "high": pa.array([float(group["norm"].to_numpy().max())]),
                "ids": pa.array([np.ascontiguousarray(ids[order]).tobytes()], pa.binary()),
                "data": pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary()),
            }
        )

    return dealt.groupBy("tier", "sub").applyInArrow(gather, "tier int, sub int, high double, ids binary, data binary")


def exact_scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles while they stay below 2^53, else in whole numbers of any length.

    Products beyond 64 bits become the nearest 64-bit number.
    """
    if float(np.abs(c.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * len(q) < 2.0**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    own = q.tolist()
    whole = (sum(a * b for a, b in zip(row, own)) for row in c.tolist())
    return np.array([min(max(s, -(1 << 63) + 1), (1 << 63) - 1) for s in whole], np.int64)


def search_block(q_ids, q_whole, c_ids, c_whole, limits, turn, k):
    """Best k of one candidate block for each query: lists of (query, id, score)."""
    out = []
    q, c = q_whole.astype(np.float64), c_whole.astype(np.float64)
    head = min(HEAD, q.shape[1])
    qr, cr = q @ turn, c @ turn
    q_rest = np.sqrt(np.maximum((qr[:, head:] ** 2).sum(axis=1), 0))
    c_rest = np.sqrt(np.maximum((cr[:, head:] ** 2).sum(axis=1), 0))
    bound = qr[:, :head] @ cr[:, :head].T + np.outer(q_rest, c_rest)
    slack = 1e-6 * (1 + np.abs(bound))
    for i in range(len(q_ids)):
        may = np.flatnonzero((bound[i] + slack[i] >= limits[i]) & (c_ids != q_ids[i]))
        if not len(may):
            continue
        score = exact_scores(c_whole[may], q_whole[i])
        if len(may) > k:
            least = np.partition(score, len(may) - k)[len(may) - k]
            may, score = may[score >= least], score[score >= least]
        best = np.lexsort((c_ids[may], -score))[:k]
        out.extend((int(q_ids[i]), int(c_ids[may[j]]), int(score[j])) for j in best)
    return out


def meet(pairs: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """Search every (query block, candidate block) row: q_ids, q_data, limits, ids, data."""
    size = len(turn)

    def work(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_data"], np.int64).reshape(-1, size)
                c = np.frombuffer(r["data"], np.int64).reshape(-1, size)
                limits = np.frombuffer(r["limits"], np.float64) if r["limits"] else np.full(len(q_ids), -np.inf)
                found += search_block(q_ids, q, c_ids, c, limits, turn, k)
            columns = list(zip(*found)) if found else [(), (), ()]
            yield pa.record_batch({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), columns)})

    return pairs.select("q_ids", "q_data", "limits", "ids", "data").mapInArrow(work, "query_id bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from at most k per block."""
    line = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(line.alias("line"))


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for queries with id divisible by ``every`` against all other rows."""
    spark = vectors.sparkSession
    rows = save(whole_numbers(vectors, id_col, vector, scale), "vectors")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    size = int(sizes["size"])
    rows = rows.filter(F.size("v") == size)
    turn = rotation(rows, size)
    quantiles = rows.approxQuantile("norm", [1 - i / TIERS for i in range(1, TIERS)], 0.005)
    cuts = sorted(set(quantiles), reverse=True)
    tier = sum((F.col("norm") < c).cast("int") for c in cuts) if cuts else F.lit(0)
    count = lambda df: {r["tier"]: r["count"] for r in df.groupBy(tier.alias("tier")).count().collect()}
    queries = rows.filter(F.col("id") % every == 0)
    candidates = save(blocks(rows, cuts, count(rows)), "blocks")
    asked = blocks(queries, cuts, count(queries)).select(
        F.struct("tier", "sub").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("high").alias("q_high")
    )
    asked = save(asked, "queries")
    firsts = [r["tier"] for r in candidates.select("tier").distinct().orderBy("tier").limit(1).collect()]
    lead = candidates.filter((F.col("tier") == firsts[0]) & (F.col("sub") == 0)).select("ids", "data").first()  # one block

    # pass 1: the longest vectors for every query block
    first = asked.withColumns({"limits": F.lit(None).cast("binary"), "ids": F.lit(lead["ids"]), "data": F.lit(lead["data"])})
    first = meet(first, turn, k)
    first = save(first, "first")
    limits = best(first, k).select("query_id", F.when(F.size("line") == k, -F.get("line", k - 1)["s"]).alias("least"))

    def with_limits(key, blocks_table, limit_table):
        known = dict(zip(limit_table["query_id"].to_pylist(), limit_table["least"].to_pylist()))
        q_ids = np.frombuffer(blocks_table["q_ids"][0].as_py(), np.int64)
        least = [known.get(int(i)) for i in q_ids]
        values = np.array([-np.inf if x is None else float(x) for x in least])
        q = np.frombuffer(blocks_table["q_data"][0].as_py(), np.int64).reshape(len(q_ids), -1).astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        # the shortest candidate that can still matter to some query of the block
        need = np.where(values <= 0, 0.0, values / np.maximum(norms, 1e-12)).min()
        return pa.table({"limits": pa.array([values.tobytes()], pa.binary()), "need": pa.array([float(need)])}).add_column(
            0, "q", blocks_table["q"].slice(0, 1)
        )

    places = asked.select("q", F.col("q_ids"))

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["q_ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["q"]] * len(ids), batch.schema.field("q").type), pa.array(ids)], ["q", "query_id"])

    owner = places.mapInArrow(unpack, "q struct<tier:int,sub:int>, query_id bigint")
    own_limits = owner.join(limits, "query_id", "left")
    ready = asked.groupBy("q").cogroup(own_limits.groupBy("q")).applyInArrow(with_limits, "q struct<tier:int,sub:int>, limits binary, need double")
    ready = save(ready, "limits")

    # pass 2: blocks that some query of the block can still need; tiers are few, their blocks joined by tier
    tops = candidates.groupBy("tier").agg(F.max("high").alias("top"))
    names = candidates.select("tier", "sub", "high").filter(~((F.col("tier") == firsts[0]) & (F.col("sub") == 0)))
    tier_tops = {r["tier"]: r["top"] for r in tops.collect()}  # at most TIERS rows
    all_tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(float(h)).alias("top")) for t, h in sorted(tier_tops.items())])
    needed = F.filter(all_tiers, lambda t: t["top"] * (1 + 1e-9) >= F.col("need"))
    wanted = ready.select("q", "need", F.explode(needed).alias("t")).select("q", "need", "t.tier").join(names, "tier")
    wanted = wanted.filter(F.col("high") * (1 + 1e-9) >= F.col("need")).select("q", "tier", "sub")
    pairs = wanted.join(candidates.select("tier", "sub", "ids", "data"), ["tier", "sub"]).join(asked, "q").join(ready.select("q", "limits"), "q")
    found = first.unionByName(meet(pairs, turn, k))
    done = best(found, k).select("query_id", F.posexplode("line").alias("rank", "x"))
    return done.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
