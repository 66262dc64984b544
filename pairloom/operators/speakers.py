"""Speaker embeddings: normalising, clustering and reassigning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import let

EPS = 1e-8


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return let(norm + EPS, lambda scale: F.transform(vector, lambda x: x / scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def centroids(chunks: DataFrame, key: str) -> DataFrame:
    """Normalised mean vector per recording and label; map tasks send one sum per label."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    means = chunks.groupBy(key, "label").agg(vector_to_array(mean).alias("centroid"))
    return means.withColumn("centroid", l2_normalize(F.col("centroid")))


def reassign(chunks: DataFrame, means: DataFrame, key: str, threshold: float = 0.80) -> DataFrame:
    """Move a chunk to the most similar centroid where the cosine reaches ``threshold``.

    A recording's few centroids travel as one row. Equal similarities go to the lowest label.
    """
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("__means"))
    rows = chunks.join(packed, key)
    scored = F.transform(
        "__means", lambda m: F.struct(dot(F.col("embedding"), m["centroid"]).alias("sim"), (-m["label"]).alias("neg"))
    )
    rows = rows.withColumn("__best", F.array_max(scored))
    moved = F.col("__best")["sim"] >= threshold
    return rows.select(
        *[c for c in chunks.columns if c != "label"],
        F.col("__best")["sim"].alias("similarity"),
        F.when(moved, -F.col("__best")["neg"]).otherwise(F.col("label")).alias("label"),
    )


def _ward_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward merges (height, a, b) by nearest-neighbour chains; memory grows with n only."""
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            gap = np.einsum("ij,ij->i", centre - centre[at], centre - centre[at]) * (2 * size * size[at] / (size + size[at]))
            gap[~alive] = np.inf
            gap[at] = np.inf
            near = int(gap.argmin())
            if len(chain) > 1 and gap[chain[-2]] <= gap[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(np.sqrt(gap[near])), a, b))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[0])


def ward_labels(n: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Labels 0..k-1 in order of first appearance after the lowest n-k merges."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in merges[: n - k]:
        parent[root(b)] = root(a)
    roots = [root(i) for i in range(n)]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(r, len(seen)) for r in roots])


def silhouettes(x: np.ndarray, labellings: list[np.ndarray], rows: int = 512) -> list[float]:
    """Mean silhouette of each labelling; distances are taken once, ``rows`` at a time."""
    squares = (x * x).sum(1)
    members = [(labels[:, None] == np.arange(labels.max() + 1)[None, :]).astype(float) for labels in labellings]
    totals = np.zeros(len(labellings))
    for start in range(0, len(x), rows):
        part = slice(start, start + rows)
        distance = np.sqrt(np.maximum(squares[part, None] + squares[None, :] - 2 * x[part] @ x.T, 0))
        distance[np.arange(distance.shape[0]), np.arange(start, start + distance.shape[0])] = 0
        for i, member in enumerate(members):
            own, counts = member[part] > 0, member.sum(0)
            mean = (distance @ member) / np.maximum(counts[None, :] - own, 1)
            a = mean[own]
            b = np.where(own, np.inf, mean).min(1)
            score = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
            totals[i] += np.where(counts[own.argmax(1)] > 1, score, 0.0).sum()
    return list(totals / len(x))


def cluster(x: np.ndarray, max_k: int = 5) -> tuple[int, np.ndarray]:
    """Number of speakers with the best silhouette, from 2 up (the smallest of equals), and the labels for it.

    One chunk is one speaker; two chunks are two.
    """
    n = len(x)
    if n == 1:
        return 1, np.zeros(1, int)
    merges = _ward_merges(x)
    ks = range(2, max(2, min(max_k, n - 1)) + 1)
    labellings = [ward_labels(n, merges, k) for k in ks]
    best = int(np.argmax(silhouettes(x, labellings)))
    return ks[best], labellings[best]


def cluster_speakers(chunks: DataFrame, key: str, max_k: int = 5) -> DataFrame:
    """(key, chunk_no, k, label) by Ward clustering, each recording on its own.

    One rule for every recording, whatever its length. The unit of work is one recording: memory grows with
    its number of chunks, time with the square. For a recording of months, where that is too slow, call
    :func:`cluster_corpus` on it; its clusters are those of k-means.
    """
    key_type = chunks.schema[key].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_no")
        k, labels = cluster(np.vstack(frame["embedding"].to_numpy()), max_k)
        return pd.DataFrame({key: frame[key], "chunk_no": frame["chunk_no"], "k": k, "label": labels})

    needed = chunks.select(key, F.col("chunk_no").cast("bigint").alias("chunk_no"), "embedding")
    return needed.groupBy(key).applyInPandas(one, f"{key} {key_type}, chunk_no bigint, k bigint, label int")


def cluster_corpus(chunks: DataFrame, max_k: int = 5, seed: int = 42) -> tuple[int, DataFrame]:
    """Best k by silhouette and labels over a whole table, as distributed bisecting k-means.

    Works where one recording (or the corpus) is too large for :func:`cluster_speakers`;
    the clusters are those of k-means, not of Ward.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = chunks.withColumn("features", array_to_vector(F.col("embedding")))
    best = None
    for k in range(2, max_k + 1):
        model = BisectingKMeans(k=k, seed=seed, predictionCol="label_new").fit(data)
        labelled = model.transform(data)
        score = ClusteringEvaluator(predictionCol="label_new").evaluate(labelled)
        if best is None or score > best[0]:
            best = (score, k, labelled)
    return best[1], best[2].drop("features")
