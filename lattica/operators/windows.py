"""Running, smoothing and difference operators along an axis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.ndarray import NdArray, along_axis, own, prefix, tiled, windowed


def runsum(a: NdArray, axis: int = 0, order: int = 1) -> NdArray:
    """Running sum; of order n, the inverse of the n-step difference (each n-th cell with its like)."""
    if order == 1:
        return prefix(a, axis, F.sum, lambda x, y: x + y)
    i = a.axes[a.axis(axis)]
    w = W.partitionBy(*a.others(axis), F.col(i) % order).orderBy(i).rowsBetween(W.unboundedPreceding, 0)
    return NdArray(a.df.select(*a.axes, F.sum("v").over(w).alias("v")), a.dims)


def runprod(a: NdArray, axis: int = 0) -> NdArray:
    """Running product, from logarithms, signs and zeros."""
    parts = [prefix(a.map(f), axis, F.sum, lambda x, y: x + y) for f in (lambda v: F.log(F.when(v == 0, 1.0).otherwise(F.abs(v))), lambda v: (v < 0).cast("int"), lambda v: (v == 0).cast("int"))]
    df = parts[0].df.join(parts[1].df.withColumnRenamed("v", "s"), a.axes).join(parts[2].df.withColumnRenamed("v", "z"), a.axes)
    return NdArray(df.select(*a.axes, F.when(F.col("z") > 0, 0.0).otherwise(F.exp("v") * F.when(F.col("s") % 2 == 1, -1.0).otherwise(1.0)).alias("v")), a.dims)


def runmax_all(a: NdArray, axis: int = 0) -> NdArray:
    """Largest of all cells so far."""
    return prefix(a, axis, F.max, F.greatest)


def runcum(a: NdArray, width: int, axis: int = 0, partial_width: bool = False) -> NdArray:
    """Sum of the last `width` cells; with partial_width the first cells have what there is, else 0."""
    out = windowed(a, axis, width - 1, 0, lambda v, w: F.struct(F.sum(v).over(w).alias("s"), F.count(v).over(w).alias("n")))
    full = F.col("v.n") == width
    return NdArray(out.df.select(*a.axes, (F.col("v.s") if partial_width else F.when(full, F.col("v.s")).otherwise(0.0)).alias("v")), a.dims)


def smooth(a: NdArray, width: int, axis: int = 0, partial_width: bool = True) -> NdArray:
    """Boxcar mean; at the edges the window shrinks, or (partial_width False) the nearest whole window's mean is taken."""
    half = width // 2
    after = width - 1 - half
    out = windowed(a, axis, half, after, lambda v, w: F.avg(v).over(w))
    if partial_width:
        return out
    i, n = a.axes[a.axis(axis)], a.dims[a.axis(axis)]
    place = F.greatest(F.lit(half), F.least(F.lit(n - 1 - after), F.col(i))).cast("bigint")
    whole = out.df.withColumnRenamed("v", "__v").withColumnRenamed(i, "__i")
    df = a.df.withColumn("__i", place).join(whole, [*a.others(axis), "__i"])
    return NdArray(df.select(*a.axes, F.col("__v").alias("v")), a.dims)


def ksmooth(a: NdArray, kernel: list[float], axis: int = 0, normalise: bool = False) -> NdArray:
    """Convolution with a kernel of odd size; beyond the edges there is nothing."""
    half = len(kernel) // 2
    df, _ = tiled(a, axis, half, half)
    i = a.axes[a.axis(axis)]
    w = W.partitionBy(*a.others(axis), "__tile").orderBy(i)

    def near(k: int) -> Column:
        d = k - half
        return F.lag("v", -d).over(w) if d < 0 else F.lead("v", d).over(w) if d else F.col("v")

    terms = [(float(c), near(k)) for k, c in enumerate(kernel) if c]
    total = sum((F.coalesce(v, F.lit(0.0)) * c for c, v in terms), F.lit(0.0))
    if normalise:
        total = total / sum((F.when(v.isNotNull(), c).otherwise(0.0) for c, v in terms), F.lit(0.0))
    return NdArray(own(df.withColumn("__r", total), i, half, half).select(*a.axes, F.col("__r").alias("v")), a.dims)


def gauss_kernel(fwhm: float) -> list[float]:
    s = fwhm / math.sqrt(8 * math.log(2))
    half = max(1, math.ceil(4 * s))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / s) ** 2)
    return (k / k.sum()).tolist()


def gsmooth(a: NdArray, fwhm: float, axis: int = 0) -> NdArray:
    """Gaussian smoothing; at the edges the kernel is made whole again."""
    return ksmooth(a, gauss_kernel(fwhm), axis, True)


def bsmooth(a: NdArray, width: int, axis: int = 0) -> NdArray:
    """Two-element averaging, width * width / 2 times, as one binomial kernel of about that width."""
    n = max(2, width * width // 2 // 2 * 2)
    row = np.array([1.0])
    for _ in range(n):
        row = np.convolve(row, [0.5, 0.5])
    keep = row > 1e-12
    return ksmooth(a, row[keep].tolist(), axis, True)


def _recursive(x: np.ndarray, scale: float) -> np.ndarray:
    """y[0] = x[0], y[i] = x[i] (1 - d) + y[i - 1] d with d = exp(-1 / scale)."""
    d = math.exp(-1 / scale) if scale > 0 else 0.0
    out, y = np.empty(len(x)), x[0] if len(x) else 0.0
    for k, v in enumerate(x.tolist()):
        y = v * (1 - d) + y * d
        out[k] = y
    return out


def esmooth1(a: NdArray, scale: float, axis: int = 0) -> NdArray:
    """Exponential smoothing from the start."""
    return along_axis(a, axis, lambda x: _recursive(x.astype(float), scale))


def esmooth2(a: NdArray, scale: float, axis: int = 0) -> NdArray:
    """Exponential smoothing from both ends."""
    return along_axis(a, axis, lambda x: _recursive(_recursive(x.astype(float), scale)[::-1], scale)[::-1])


def esmooth(a: NdArray, scale: float, axis: int = 0) -> NdArray:
    return esmooth1(a, scale, axis)


def differ(a: NdArray, order: int = 1, axis: int = 0, central: bool = False, circular: bool = False) -> NdArray:
    """x[i] - x[i - n], n = |order|. The first n cells: 0, or copied if order < 0; circular: against the last ones.

    central: (x[i + n] - x[i - n]), ends 0.
    """
    n, i = abs(order), a.axes[a.axis(axis)]
    if circular:
        from lattica.operators.shape import shift

        return a.zip(shift(a, [n if k == a.axis(axis) else 0 for k in range(a.ndim)]), lambda x, y: x - y)
    df, _ = tiled(a, axis, n, n if central else 0)
    w = W.partitionBy(*a.others(axis), "__tile").orderBy(i)
    if central:
        d = F.coalesce(F.lead("v", n).over(w) - F.lag("v", n).over(w), F.lit(0).cast(a.dtype))
    else:
        d = F.coalesce(F.col("v") - F.lag("v", n).over(w), F.col("v") if order < 0 else F.lit(0).cast(a.dtype))
    return NdArray(own(df.withColumn("__r", d), i, n, n if central else 0).select(*a.axes, F.col("__r").alias("v")), a.dims)


def unmod(a: NdArray, period: float, axis: int = 0) -> NdArray:
    """Jumps of more than half a period between neighbours taken out by adding whole periods."""
    step = differ(a, 1, axis)
    turns = step.map(lambda d: -F.round(d / period))
    return a.zip(runsum(turns, axis), lambda v, k: v + k * period)


def hypot_axis(a: NdArray, axis: int):
    """Root of the sum of squares along an axis."""
    return a.df.groupBy(*a.others(axis)).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def despike(a: NdArray, frac: float = 0.25, level: float = 7.0, width: int = 5, rounds: int = 1, axis: int = 0) -> NdArray:
    """Cells above `level` times the spread of their neighbourhood and `frac` above its mean get the neighbourhood's mean."""
    for _ in range(rounds):
        half = width // 2
        stats = windowed(a, axis, half, half, lambda v, w: F.struct(v.alias("x"), F.avg(v).over(w).alias("m"), F.stddev_pop(v).over(w).alias("s"), F.count(v).over(w).alias("n")))
        x, m, s, n = (F.col(f"v.{c}") for c in "xmsn")
        around = F.when(n > 1, (m * n - x) / (n - 1)).otherwise(x)
        rest = F.sqrt(F.greatest(F.lit(0.0), (s * s + m * m) * n - x * x) / F.greatest(n - 1, F.lit(1)) - around * around)
        spike = (n > 1) & (x - around > frac * F.abs(around)) & (x - around > level * rest)
        a = NdArray(stats.df.select(*a.axes, F.when(spike, around).otherwise(x).alias("v")), a.dims)
    return a


def bisect(a: NdArray, value: float, axis: int = 0):
    """Places where the line through the cells has the value: index columns and place."""
    i = a.axes[a.axis(axis)]
    df, _ = tiled(a, axis, 0, 1)
    w = W.partitionBy(*a.others(axis), "__tile").orderBy(i)
    df = own(df.withColumn("__n", F.lead("v").over(w)), i, 0, 1)
    hit = (F.col("v") == value) | ((F.col("v") - value) * (F.col("__n") - value) < 0)
    return df.where(hit).select(*a.axes, (F.col(i) + F.when(F.col("v") == value, 0.0).otherwise((value - F.col("v")) / (F.col("__n") - F.col("v")))).alias("place"))
