"""Random draws by seed and cell: the same for a seed, however the rows are dealt. Not bit-identical to other generators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lattica.ndarray import NdArray


def uniform(key: Sequence[Column], seed: int, draw: int = 0) -> Column:
    """In (0, 1), from a hash of seed, draw and the cell's coordinates."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), *key), 12).cast("double") + 0.5) / float(1 << 52)


def normal(key: Sequence[Column], seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, seed, 1))) * F.cos(2 * math.pi * uniform(key, seed, 2))


def exponential(key: Sequence[Column], seed: int, scale: float = 1.0) -> Column:
    return -F.log(uniform(key, seed)) * scale


def whole(key: Sequence[Column], seed: int, period: int) -> Column:
    """Whole number from 0 to period - 1."""
    return F.floor(uniform(key, seed) * period)


def bit(key: Sequence[Column], seed: int, probability: float = 0.5) -> Column:
    return (uniform(key, seed) < probability).cast("int")


def randomu(spark: SparkSession, seed: int, *dims: int) -> NdArray:
    return NdArray.full(spark, dims, lambda ix: uniform(ix, seed))


def randomn(spark: SparkSession, seed: int, *dims: int) -> NdArray:
    return NdArray.full(spark, dims, lambda ix: normal(ix, seed))


def randome(spark: SparkSession, seed: int, *dims: int, scale: float = 1.0) -> NdArray:
    return NdArray.full(spark, dims, lambda ix: exponential(ix, seed, scale))


def randomb(spark: SparkSession, seed: int, probability: float, *dims: int) -> NdArray:
    return NdArray.full(spark, dims, lambda ix: bit(ix, seed, probability), "smallint")


def randoml(spark: SparkSession, seed: int, period: int, *dims: int) -> NdArray:
    return NdArray.full(spark, dims, lambda ix: whole(ix, seed, period), "bigint")


def randomd(spark: SparkSession, seed: int, weights: Sequence[float], *dims: int) -> NdArray:
    """Draws from a discrete distribution: index k with weight weights[k]."""
    total, edge, out = sum(weights), 0.0, None

    def value(ix):
        nonlocal edge, out
        u = uniform(ix, seed)
        for k, w in enumerate(weights):
            edge += w / total
            out = F.when(u < edge, k) if out is None else out.when(u < edge, k)
        return out.otherwise(len(weights) - 1)

    return NdArray.full(spark, dims, value, "int")


def shuffled(a: NdArray, seed: int) -> NdArray:
    """A 1-D array in random order."""
    from lattica.ndarray import with_row_index

    keyed = a.df.select("v", F.xxhash64(F.lit(seed), F.col("i0")).alias("k"), F.col("i0").alias("o"))
    return NdArray(with_row_index(keyed, [F.col("k"), F.col("o")]).select("i0", "v"), a.dims)
