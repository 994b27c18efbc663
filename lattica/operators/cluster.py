"""Iterative nearest-center clustering of row vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(df: DataFrame, vector: str, centers: np.ndarray) -> DataFrame:
    """`df` with `cluster` and `distance`: the nearest center (ties: the first). The centers are one literal."""
    spread = [F.struct(F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, c.tolist())), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)]
    near = F.array_min(F.array(*spread))
    return df.withColumn("__n", near).withColumn("cluster", F.col("__n.k")).withColumn("distance", F.col("__n.d")).drop("__n")


def cluster(df: DataFrame, vector: str, start: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, DataFrame]:
    """Final centers, and `df` with cluster and distance. A round is one aggregate; empty clusters keep their center."""
    centers = np.asarray(start, float)
    for _ in range(rounds):
        dims = centers.shape[1]
        sums = assign(df, vector, centers).groupBy("cluster").agg(*(F.avg(F.col(vector)[d]).alias(f"c{d}") for d in range(dims))).collect()
        new = centers.copy()
        for r in sums:
            new[r["cluster"]] = [r[f"c{d}"] for d in range(dims)]
        if np.allclose(new, centers, atol=1e-12):
            break
        centers = new
    return centers, assign(df, vector, centers)


def summary(assigned: DataFrame) -> DataFrame:
    """Size and rms distance of each cluster."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms"))
