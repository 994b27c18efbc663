"""Construction, types, dimensions, subscripts and rearrangement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lattica.ndarray import NdArray
from lattica.operators.elementwise import to_byte, wrapped

# Element type names and the Spark types that hold them.
TYPES = {"byte": "smallint", "uint8": "smallint", "word": "smallint", "int16": "smallint", "int": "smallint", "long": "int", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "string": "string"}


def convert(v: Column, kind: str) -> Column:
    """A value as another element type; whole types cut the fraction and wrap."""
    if kind in ("byte", "uint8"):
        return to_byte(v)
    if kind in ("word", "int16", "int"):
        return wrapped(v, 16).cast("smallint")
    if kind in ("long", "int32"):
        return wrapped(v, 32).cast("int")
    if kind in ("cfloat", "cdouble"):
        part = kind[1:]
        return F.struct(v.cast(part).alias("re"), F.lit(0.0).cast(part).alias("im"))
    return v.cast(TYPES[kind])


def array(spark: SparkSession, kind: str, *dims: int) -> NdArray:
    """An array of zeros of an element type."""
    if kind in ("cfloat", "cdouble"):
        a = NdArray.full(spark, dims)
        return a.map(lambda v: convert(v, kind))
    return NdArray.full(spark, dims, 0, TYPES[kind])


def indgen(a: NdArray, axis: int | None = None) -> NdArray:
    """Each cell's number (the first axis runs fastest), or its coordinate along an axis."""
    if axis is not None:
        return NdArray(a.df.select(*a.axes, F.col(a.axes[a.axis(axis)]).alias("v")), a.dims)
    return NdArray(a.df.select(*a.axes, linear(a).alias("v")), a.dims)


def linear(a: NdArray) -> Column:
    out, step = F.lit(0).cast("bigint"), 1
    for c, d in zip(a.axes, a.dims, strict=True):
        out, step = out + F.col(c) * step, step * d
    return out


def redim(a: NdArray, *dims: int) -> NdArray:
    """The same elements, in order, with other dimensions."""
    if np.prod(dims) != np.prod(a.dims):
        raise ValueError(f"{a.dims} has another number of elements than {dims}")
    n, cols, rest = linear(a), [], F.col("__n")
    for k, d in enumerate(dims):
        cols.append((rest % d).cast("bigint").alias(f"i{k}"))
        rest = F.floor(rest / d)
    return NdArray(a.df.select(n.alias("__n"), "v").select(*cols, "v"), tuple(dims))


def roll(a: NdArray, order: Sequence[int]) -> NdArray:
    """Axes in another order: new axis k is old axis order[k]."""
    return NdArray(a.df.select(*(F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)), "v"), tuple(a.dims[o] for o in order))


def transpose(a: NdArray) -> NdArray:
    return roll(a, list(range(a.ndim))[::-1])


def reverse(a: NdArray, *axes: int) -> NdArray:
    """Cells in opposite order along the axes (none named: all)."""
    turn = {a.axis(k) for k in (axes or range(a.ndim))}
    return NdArray(a.df.select(*((F.lit(a.dims[k] - 1) - F.col(c) if k in turn else F.col(c)).cast("bigint").alias(c) for k, c in enumerate(a.axes)), "v"), a.dims)


def reorder(a: NdArray, way: int) -> NdArray:
    """One of the eight symmetries of an image: bit 2 swaps the axes first, bit 0 and 1 then reverse axis 0 and 1."""
    b = transpose(a) if way & 4 else a
    turn = [k for k in (0, 1) if way >> k & 1]
    return reverse(b, *turn) if turn else b


def shift(a: NdArray, by: Sequence[int], blank: float | None = None) -> NdArray:
    """Cells moved along the axes, around the end or with `blank` where nothing came."""
    moved = [(F.col(c) + s).alias(c) for c, s in zip(a.axes, by, strict=True)]
    if blank is None:
        return NdArray(a.df.select(*(F.pmod(m, F.lit(d)).cast("bigint").alias(c) for m, d, c in zip(moved, a.dims, a.axes, strict=True)), "v"), a.dims)
    near = a.df.select(*moved, F.col("v").alias("__v"))
    return NdArray(a.df.select(*a.axes).join(near, a.axes, "left").select(*a.axes, F.coalesce("__v", F.lit(blank)).alias("v")), a.dims)


def concat(a: NdArray, b: NdArray) -> NdArray:
    """b after a along the last axis."""
    last = a.axes[-1]
    if a.dims[:-1] != b.dims[:-1]:
        raise ValueError(f"dimensions {a.dims} and {b.dims}")
    return NdArray(a.df.unionByName(b.df.withColumn(last, F.col(last) + a.dims[-1])), (*a.dims[:-1], a.dims[-1] + b.dims[-1]))


def stack(*arrays: NdArray) -> NdArray:
    """Arrays of one shape along a new last axis."""
    n = arrays[0].ndim
    out = None
    for k, x in enumerate(arrays):
        part = x.df.withColumn(f"i{n}", F.lit(k).cast("bigint")).select(*x.axes, f"i{n}", "v")
        out = part if out is None else out.unionByName(part)
    return NdArray(out, (*arrays[0].dims, len(arrays)))


def insert(a: NdArray, part: NdArray, at: Sequence[int]) -> NdArray:
    """a with `part` written over it from the coordinates `at`."""
    new = part.df.select(*((F.col(c) + s).cast("bigint").alias(c) for c, s in zip(part.axes, at, strict=True)), F.col("v").alias("__v"))
    return NdArray(a.df.join(new, a.axes, "left").select(*a.axes, F.coalesce("__v", "v").alias("v")), a.dims)


def subscript(a: NdArray, *parts: int | slice | Sequence[int] | str) -> NdArray:
    """General indexing, a part for each axis.

    A number takes one coordinate and drops the axis; a slice (first, one past the last) keeps a range;
    a list picks coordinates in its order; "+" adds up along the axis and drops it.
    """
    df, keep, dims, summed = a.df, [], [], False
    for k, p in enumerate(parts):
        c, d = a.axes[k], a.dims[k]
        if isinstance(p, str):
            summed = True
        elif isinstance(p, int):
            df = df.where(F.col(c) == (p if p >= 0 else d + p))
        elif isinstance(p, slice):
            lo, hi, _ = p.indices(d)
            df = df.where((F.col(c) >= lo) & (F.col(c) < hi)).withColumn(c, F.col(c) - lo)
            keep.append(c)
            dims.append(max(0, hi - lo))
        else:
            picks = a.df.sparkSession.createDataFrame([(int(x), j) for j, x in enumerate(p)], f"{c} bigint, __to bigint")
            df = df.join(F.broadcast(picks) if len(p) <= 100_000 else picks, c).withColumn(c, F.col("__to")).drop("__to")
            keep.append(c)
            dims.append(len(p))
    if summed:
        df = df.groupBy(*keep).agg(F.sum("v").alias("v"))
    return NdArray(df.select(*(F.col(c).alias(f"i{j}") for j, c in enumerate(keep)), "v"), tuple(dims))


def compress(a: NdArray, *factors: int) -> NdArray:
    """Means of blocks; cells beyond the last whole block are left out."""
    f = factors if len(factors) == a.ndim else factors * a.ndim
    dims = tuple(d // k for d, k in zip(a.dims, f, strict=True))
    df = a.df
    for c, d, k in zip(a.axes, dims, f, strict=True):
        df = df.where(F.col(c) < d * k)
    return NdArray(df.groupBy(*(F.floor(F.col(c) / k).cast("bigint").alias(c) for c, k in zip(a.axes, f, strict=True))).agg(F.avg("v").alias("v")), dims)


def expand(a: NdArray, *factors: int) -> NdArray:
    """Each cell repeated by whole factors (nearest)."""
    df = a.df
    for c, k in zip(a.axes, factors, strict=True):
        df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(c, F.col(c) * k + F.col("__o")).drop("__o")
    return NdArray(df.select(*a.axes, "v"), tuple(d * k for d, k in zip(a.dims, factors, strict=True)))


def expand_linear(a: NdArray, factor: int, axis: int = 0) -> NdArray:
    """Enlarged along an axis with linear interpolation; the last cell is held."""
    c = a.axes[a.axis(axis)]
    after = a.df.select(*a.others(axis), (F.col(c) - 1).alias(c), F.col("v").alias("__next"))
    df = a.df.join(after, a.axes, "left").withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    v = F.col("v") + (F.coalesce("__next", "v") - F.col("v")) * F.col("__o") / factor
    df = df.withColumn("v", v).withColumn(c, F.col(c) * factor + F.col("__o"))
    return NdArray(df.select(*a.axes, "v"), tuple(d * factor if k == a.axis(axis) else d for k, d in enumerate(a.dims)))


def distarr(spark: SparkSession, dims: Sequence[int], center: Sequence[float] | None = None) -> NdArray:
    """Distance of each cell to a center (default: the middle)."""
    center = center or [(d - 1) / 2 for d in dims]
    return NdArray.full(spark, dims, lambda ix: F.sqrt(sum(((i - c) * (i - c) for i, c in zip(ix, center, strict=True)), F.lit(0.0))))


def swaphalf(a: NdArray) -> NdArray:
    """Halves of each axis exchanged."""
    return NdArray(a.df.select(*(F.pmod(F.col(c) + d // 2, F.lit(d)).cast("bigint").alias(c) for c, d in zip(a.axes, a.dims, strict=True)), "v"), a.dims)


def dimen(a: NdArray, axis: int | None = None):
    return a.dims if axis is None else a.dims[a.axis(axis)]


def num_dim(a: NdArray) -> int:
    return a.ndim


def num_elem(a: NdArray, axes: Sequence[int] | None = None) -> int:
    return int(np.prod([a.dims[k] for k in axes] if axes else a.dims))


def mdiagonal(a: NdArray) -> NdArray:
    """Square matrix with a 1-D array on the diagonal."""
    n = a.dims[0]
    cells = NdArray.full(a.df.sparkSession, (n, n))
    on = a.df.select("i0", F.col("i0").alias("i1"), F.col("v").alias("__v"))
    return NdArray(cells.df.join(on, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("__v", F.lit(0.0)).alias("v")), (n, n))


def reinterpret(values: np.ndarray, dtype: str) -> np.ndarray:
    """The same memory as another element type (whole arrays of bytes; on a worker, in a kernel)."""
    return np.frombuffer(np.ascontiguousarray(values).tobytes(), dtype)


def type_name(a: NdArray) -> str:
    return next((k for k, v in TYPES.items() if v == a.dtype), a.dtype)


def is_array(x) -> bool:
    return isinstance(x, NdArray)


def is_scalar(x) -> bool:
    return isinstance(x, int | float | complex)


def is_string(x) -> bool:
    return isinstance(x, str) or isinstance(x, NdArray) and x.dtype == "string"
