"""Embeddings: centroids, assignment, agglomerative clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``label, centroid``: mean of unit vectors [A28]. Per dimension, so that means combine before the shuffle."""
    dims = df.select(label, F.posexplode(X.unit(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return dims.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def assigned(df: DataFrame, centroids: DataFrame, key: str, vector: str, label: str = "label", most: int = 10_000) -> DataFrame:
    """Adds ``nearest``: the label of the centroid with the largest dot product with the unit vector; ties by label [J18].

    Centroids are a query set of at most ``most`` rows, checked, and travel as one array.
    """
    n = centroids.count()
    if n > most:
        raise ValueError(f"{n} centroids; assign in blocks of {most}")
    table = centroids.agg(F.sort_array(F.collect_list(F.struct(label, "centroid"))).alias("_c"))
    dot = lambda c: F.aggregate(F.zip_with("_u", c["centroid"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    both = df.withColumn("_u", X.unit(F.col(vector))).crossJoin(F.broadcast(table))  # one row
    scored = F.transform("_c", lambda c: F.struct(dot(c).alias("d"), c[label].alias("l")))
    best = F.array_max(F.transform(scored, lambda s: s["d"]))
    return both.withColumn("nearest", F.filter(scored, lambda s: s["d"] == best)[0]["l"]).drop("_u", "_c")


def agglomerate(vectors: np.ndarray, threshold: float | None = 0.9, clusters: int | None = None, most: int = 6) -> list[int]:
    """Average-linkage clustering on cosine distance, to a threshold or a number; small clusters fold into the nearest [K7].

    Keeps the ``most`` largest (ties by label, T27). Labels count from the first member on.
    """
    n = len(vectors)
    if n <= 1 or clusters == 1:
        return [0] * n
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, np.inf)
    size, label, left = np.ones(n), np.arange(n), n
    while left > 1:
        i, j = np.unravel_index(np.argmin(dist), dist.shape)
        if clusters and clusters > 1:
            if left <= min(clusters, n):
                break
        elif dist[i, j] >= threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])  # Lance and Williams
        dist[i], dist[:, i] = merged, merged
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        left -= 1
    names = {v: k for k, v in enumerate(dict.fromkeys(label.tolist()))}
    out = np.array([names[v] for v in label.tolist()])
    if len(names) > most:
        sizes = np.bincount(out)
        keep = np.lexsort((np.arange(len(sizes)), -sizes))[:most]
        centers = {k: unit[out == k].mean(axis=0) for k in keep.tolist()}
        out = np.array([v if v in centers else max(centers, key=lambda k: float(centers[k] @ unit[i])) for i, v in enumerate(out.tolist())])
    return out.tolist()


def cluster_by(df: DataFrame, group: str, key: str, vector: str, **options) -> DataFrame:
    """``group, key, cluster`` for each recording; a recording's windows fit in one task [K7]."""
    kinds = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(key)
        return pdf[[group, key]].assign(cluster=agglomerate(np.stack(pdf[vector].to_numpy()).astype(float), **options))

    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster int")
