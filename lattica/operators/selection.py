"""Selection, ordering, lookup and local extremes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.ndarray import NdArray, own, prefix, tiled, windowed, with_row_index
from lattica.operators.windows import differ


def sieve(a: NdArray, condition: Column | None = None) -> DataFrame:
    """The cells where the condition (on v and the index columns) holds; without one, where v is not 0.

    No passing cell gives no row.
    """
    return a.df.where(F.col("v") != 0 if condition is None else condition)


def sort(a: NdArray, axis: int | None = None) -> NdArray:
    """Sorted copy, along an axis or as one line; NaN comes last."""
    if axis is None:
        return NdArray(with_row_index(a.df.select("v"), [F.col("v")]).select("i0", "v"), (int(np.prod(a.dims)),))
    w = W.partitionBy(*a.others(axis)).orderBy("v")
    i = a.axes[a.axis(axis)]
    return NdArray(a.df.select(*a.others(axis), (F.row_number().over(w) - 1).cast("bigint").alias(i), "v").select(*a.axes, "v"), a.dims)


def index(a: NdArray, axis: int = 0) -> NdArray:
    """Along an axis, the positions of the elements in ascending order (ties by position)."""
    i = a.axes[a.axis(axis)]
    w = W.partitionBy(*a.others(axis)).orderBy("v", i)
    return NdArray(a.df.select(*a.others(axis), (F.row_number().over(w) - 1).cast("bigint").alias("__r"), F.col(i).alias("v")).withColumnRenamed("__r", i).select(*a.axes, "v"), a.dims)


def rank(a: NdArray, axis: int = 0) -> NdArray:
    """Along an axis, the place of each element in ascending order (ties by position)."""
    w = W.partitionBy(*a.others(axis)).orderBy("v", a.axes[a.axis(axis)])
    return NdArray(a.df.select(*a.axes, (F.row_number().over(w) - 1).cast("bigint").alias("v")), a.dims)


def replace(df: DataFrame, column: str, table: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """`df` with values listed in `source` replaced by their `target`."""
    t = table.groupBy(F.col(source).alias("__s")).agg(F.min(target).alias("__t"))
    return df.join(t, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__t", column)).drop("__s", "__t")


def tolookup(df: DataFrame, column: str, tolerance: float = 0) -> tuple[DataFrame, DataFrame]:
    """The unique values with their index (i0, value), and `df` with `lookup` in place of the values.

    With a tolerance, values in order that are no further apart than it are one, named by the least.
    """
    unique = with_row_index(df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct(), [F.col("value")]).select("i0", "value")
    if not tolerance:
        return unique, df.join(unique.withColumnsRenamed({"value": column, "i0": "lookup"}), column, "left").drop(column)
    size = int(unique.count())
    steps = NdArray(unique.withColumnRenamed("value", "v"), (size,))
    far = differ(steps, -1).with_index(lambda v, i: ((i == 0) | (v > tolerance)).cast("bigint"))
    group = prefix(far, 0, F.sum, lambda x, y: x + y).df.select("i0", (F.col("v") - 1).alias("lookup"))
    named = unique.join(group, "i0")
    least = named.groupBy(F.col("lookup").alias("i0")).agg(F.min("value").alias("value"))
    return least, df.join(named.select(F.col("value").alias(column), "lookup"), column, "left").drop(column)


def multisieve(x: DataFrame, value: str, place: str, y: DataFrame, key: str) -> DataFrame:
    """(key, place) for each place of x whose value equals a key of y, one row each; `ends` in `multisieve_ends`."""
    return y.select(F.col(key)).distinct().join(x.select(F.col(value).alias("__v"), F.col(place)), F.col(key) == F.col("__v")).select(key, place)


def multisieve_ends(found: DataFrame, key: str) -> DataFrame:
    """(key, n) of the places found for each key."""
    return found.groupBy(key).agg(F.count("*").alias("n"))


def _order_filter(a: NdArray, axis: int, width: int, pick) -> NdArray:
    half = width // 2
    return windowed(a, axis, half, width - 1 - half, pick)


def maxfilter(a: NdArray, axis: int = 0, width: int = 3) -> NdArray:
    """Running maximum; the window shrinks at the edges."""
    return _order_filter(a, axis, width, lambda v, w: F.max(v).over(w))


def minfilter(a: NdArray, axis: int = 0, width: int = 3) -> NdArray:
    return _order_filter(a, axis, width, lambda v, w: F.min(v).over(w))


def ordfilter(a: NdArray, axis: int = 0, width: int = 3, order: float = 0.5) -> NdArray:
    """Running order statistic (0 least, 0.5 median, 1 largest)."""
    return _order_filter(a, axis, width, lambda v, w: F.percentile(v, F.lit(float(order))).over(w))


def medfilter(a: NdArray, axis: int = 0, width: int = 3) -> NdArray:
    return ordfilter(a, axis, width, 0.5)


def runord(a: NdArray, width: int, order: int, axis: int = 0) -> NdArray:
    """The order-th (from 0) of the window's values in ascending order."""
    return _order_filter(a, axis, width, lambda v, w: F.get(F.sort_array(F.collect_list(v).over(w)), F.lit(order)))


def runmax(a: NdArray, width: int, axis: int = 0) -> NdArray:
    return maxfilter(a, axis, width)


def runmin(a: NdArray, width: int, axis: int = 0) -> NdArray:
    return minfilter(a, axis, width)


def _extremes(a: NdArray, sign: int, axis: int) -> DataFrame:
    df, _ = tiled(a, axis, 1, 1)
    i = a.axes[a.axis(axis)]
    w = W.partitionBy(*a.others(axis), "__tile").orderBy(i)
    df = df.withColumns({"__l": F.lag("v").over(w), "__r": F.lead("v").over(w)})
    return own(df, i, 1, 1).where((sign * (F.col("v") - F.col("__l")) > 0) & (sign * (F.col("v") - F.col("__r")) >= 0))


def find_max(a: NdArray, axis: int = 0, sign: int = 1, subgrid: bool = False) -> DataFrame:
    """Local maxima along an axis: the index columns, v, and with subgrid the parabola's place and value."""
    found = _extremes(a, sign, axis)
    if not subgrid:
        return found.select(*a.axes, "v")
    i, curve = a.axes[a.axis(axis)], F.col("__l") - 2 * F.col("v") + F.col("__r")
    shift = (F.col("__l") - F.col("__r")) / (2 * curve)
    return found.select(*a.axes, "v", (F.col(i) + shift).alias("place"), (F.col("v") - (F.col("__l") - F.col("__r")) * shift / 4).alias("peak"))


def find_min(a: NdArray, axis: int = 0, subgrid: bool = False) -> DataFrame:
    return find_max(a, axis, -1, subgrid)


def find_extreme(a: NdArray, axis: int = 0) -> DataFrame:
    return find_max(a, axis).withColumn("sign", F.lit(1)).union(find_min(a, axis).withColumn("sign", F.lit(-1)))


def find_maxloc(a: NdArray, axis: int = 0, subgrid: bool = False) -> DataFrame:
    return find_max(a, axis, 1, subgrid).select(*a.axes, *(["place"] if subgrid else []))


def find_minloc(a: NdArray, axis: int = 0, subgrid: bool = False) -> DataFrame:
    return find_min(a, axis, subgrid).select(*a.axes, *(["place"] if subgrid else []))


def find_extremeloc(a: NdArray, axis: int = 0) -> DataFrame:
    return find_extreme(a, axis).select(*a.axes, "sign")


def getmin9(nine: np.ndarray) -> tuple[float, float]:
    """Sub-pixel place of the least of a 3 x 3 array, by a quadratic surface; from the middle."""
    n = np.asarray(nine, float)
    gx, gy = (n[2, 1] - n[0, 1]) / 2, (n[1, 2] - n[1, 0]) / 2
    xx, yy = n[2, 1] - 2 * n[1, 1] + n[0, 1], n[1, 2] - 2 * n[1, 1] + n[1, 0]
    xy = (n[2, 2] - n[2, 0] - n[0, 2] + n[0, 0]) / 4
    det = xx * yy - xy * xy
    return ((xy * gy - yy * gx) / det, (xy * gx - xx * gy) / det) if det else (0.0, 0.0)


def local_walk(image: np.ndarray, start: Sequence[int], sign: int = 1) -> tuple[tuple[int, ...], float]:
    """Place and value of the local maximum (sign 1) or minimum (-1) that the steepest walk from `start` reaches."""
    a, at = sign * np.asarray(image, float), tuple(start)
    while True:
        box = tuple(slice(max(0, p - 1), p + 2) for p in at)
        part = a[box]
        best = np.unravel_index(int(part.argmax()), part.shape)
        to = tuple(int(s.start + b) for s, b in zip(box, best, strict=True))
        if a[to] <= a[at]:
            return at, float(sign * a[at])
        at = to


def local_max(image, start):
    return local_walk(image, start, 1)[1]


def local_maxloc(image, start):
    return local_walk(image, start, 1)[0]


def local_min(image, start):
    return local_walk(image, start, -1)[1]


def local_minloc(image, start):
    return local_walk(image, start, -1)[0]
