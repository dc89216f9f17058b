"""Multi-element samples: log-ratios, principal components, clusters, angles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clr(parts: Column) -> Column:
    """Centred log-ratio of an array of positive parts; null if one is missing or not positive."""
    good = ~F.exists(parts, lambda v: v.isNull() | (v <= 0))
    logs = F.transform(parts, lambda v: F.log(v))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) / F.size(parts)
    return F.when(good, F.transform(logs, lambda v: v - mean))


def moments(rows: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance (n - 1): one pass, one small row per task.

    What reaches the driver is dims x dims numbers, whatever the rows.
    """
    import pyarrow as pa

    def run(batches):
        n, s, q = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64())), "q": pa.array([q.ravel().tolist()], pa.list_(pa.float64()))})

    parts = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "n long, s array<double>, q array<double>")
    flat = parts.select("n", F.concat("s", "q").alias("v"))
    add = flat.select("n", F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    if not add or not add[0].n:
        return 0, np.zeros(dims), np.zeros((dims, dims))
    v, n = np.array([r.v for r in add]), int(add[0].n)
    mean = v[:dims] / n
    return n, mean, (v[dims:].reshape(dims, dims) - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal_components(rows: DataFrame, vector: str, dims: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, axes (a row each, the largest loading positive) and the mean."""
    _, mean, cov = moments(rows, vector, dims)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:keep]
    axes = axes[:, order].T
    for a in axes:
        if a[np.argmax(np.abs(a))] < 0:
            a *= -1
    return values[order], axes, mean


def project(rows: DataFrame, vector: str, axes: np.ndarray, mean: np.ndarray, out: str) -> DataFrame:
    """``out``: an array with a score per axis; expressions only."""
    x = F.zip_with(F.col(vector).cast("array<double>"), F.lit([float(m) for m in mean]), lambda v, m: v - m)
    score = lambda a: F.aggregate(F.zip_with(x, F.lit([float(v) for v in a]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(out, F.array(*(score(a) for a in axes)))


def k_means(rows: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 40) -> DataFrame:
    """Rows with ``cluster`` numbered from 0 by size; Spark's own k-means does the work."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))
    fitted = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__f", predictionCol="__c").fit(data)
    out = fitted.transform(data).drop("__f")
    sizes = sorted(((r["count"], r["__c"]) for r in out.groupBy("__c").count().collect()), key=lambda t: (-t[0], t[1]))
    number = F.create_map(*(x for i, (_, c) in enumerate(sizes) for x in (F.lit(c), F.lit(i))))
    return out.withColumn("cluster", number[F.col("__c")]).drop("__c")


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between two vectors in radians."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cos = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
