"""Dense n-dimensional arrays as long-form DataFrames: one row for each cell, index columns i0, i1, ... and v.

No operator relies on the order of rows.  Windows along an axis are computed in tiles with the rows that
a tile needs from its neighbours, so that one long axis is not one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.plans.lineage import cut

#: Cells of a tile along an axis, at least.
TILE = 65_536


@dataclass(frozen=True)
class NdArray:
    """`df` has the columns i0 .. i{ndim-1} (bigint) and v; `dims` are the lengths of the axes."""

    df: DataFrame
    dims: tuple[int, ...]

    @staticmethod
    def of(spark: SparkSession, values, dtype: str | None = None) -> NdArray:
        """A small array from driver values; the first axis is axis 0."""
        a = np.asarray(values)
        grid = np.indices(a.shape).reshape(a.ndim, -1)
        frame = pd.DataFrame({**{f"i{k}": grid[k].astype(np.int64) for k in range(a.ndim)}, "v": a.ravel()})
        df = spark.createDataFrame(frame)
        return NdArray(df.withColumn("v", F.col("v").cast(dtype)) if dtype else df, a.shape)

    @staticmethod
    def full(spark: SparkSession, dims: Sequence[int], value: Callable[[list[Column]], Column] | float = 0, dtype: str = "double") -> NdArray:
        """An array with `value` (a number, or an expression of the index columns) in each cell."""
        n = reduce(lambda a, b: a * b, dims, 1)
        df = spark.range(n)
        cols, rest = [], F.col("id")
        for k, d in enumerate(dims):  # the first axis runs fastest
            cols.append((rest % d).cast("bigint").alias(f"i{k}"))
            rest = F.floor(rest / d).cast("bigint")
        df = df.select(*cols)
        v = value([F.col(f"i{k}") for k in range(len(dims))]) if callable(value) else F.lit(value)
        return NdArray(df.withColumn("v", v.cast(dtype)), tuple(dims))

    @staticmethod
    def from_table(df: DataFrame, index: Sequence[str | Column], value: str | Column, dims: Sequence[int] | None = None) -> NdArray:
        """A table's column as an array, by its index columns; `dims` default to the largest index plus one."""
        cols = [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(f"i{k}") for k, c in enumerate(index)]
        out = df.select(*cols, (F.col(value) if isinstance(value, str) else value).alias("v"))
        if dims is None:
            dims = tuple(int(x or 0) for x in out.agg(*(F.max(f"i{k}") + 1 for k in range(len(cols)))).first())
        return NdArray(out, tuple(dims))

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    def others(self, axis: int) -> list[str]:
        return [c for k, c in enumerate(self.axes) if k != self.axis(axis)]

    def axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise ValueError(f"axis {axis} of an array with {self.ndim} dimensions")
        return axis % self.ndim

    def map(self, fn: Callable[[Column], Column]) -> NdArray:
        """The array with fn(v) in each cell."""
        return NdArray(self.df.select(*self.axes, fn(F.col("v")).alias("v")), self.dims)

    def with_index(self, fn: Callable[..., Column]) -> NdArray:
        """The array with fn(v, i0, i1, ...) in each cell."""
        return NdArray(self.df.select(*self.axes, fn(F.col("v"), *map(F.col, self.axes)).alias("v")), self.dims)

    def zip(self, other: NdArray, fn: Callable[[Column, Column], Column]) -> NdArray:
        """fn(v, w) cell by cell; dimensions must agree."""
        if self.dims != other.dims:
            raise ValueError(f"dimensions {self.dims} and {other.dims}")
        right = other.df.withColumnRenamed("v", "w")
        return NdArray(self.df.join(right, self.axes).select(*self.axes, fn(F.col("v"), F.col("w")).alias("v")), self.dims)

    def numpy(self) -> np.ndarray:
        """The array on the driver; for results that are known to be small."""
        rows = self.df.toPandas()
        out = np.full(self.dims, None, object) if rows["v"].dtype == object else np.zeros(self.dims, rows["v"].dtype)
        out[tuple(rows[c].to_numpy() for c in self.axes)] = rows["v"].to_numpy()
        return out


def tiled(a: NdArray, axis: int, before: int, after: int) -> tuple[DataFrame, Callable[..., object]]:
    """Rows dealt in tiles along `axis` with the neighbours a window of (before, after) cells needs, and window(lo, hi).

    A row goes to the tile of each cell whose window holds it.  Drop the guests with `own`.
    """
    i = a.axes[a.axis(axis)]
    size = max(TILE, 4 * (before + after))
    tile = F.floor(F.col(i) / size)
    first, last = F.floor((F.col(i) - after) / size), F.floor((F.col(i) + before) / size)
    df = a.df.withColumn("__tile", F.explode(F.when(first == last, F.array(tile)).otherwise(F.sequence(first, last)))) if before or after else a.df.withColumn("__tile", tile)
    spec = W.partitionBy(*a.others(axis), "__tile").orderBy(i)
    return df, lambda lo, hi: spec.rangeBetween(lo, hi)


def own(df: DataFrame, i: str, before: int, after: int) -> DataFrame:
    size = max(TILE, 4 * (before + after))
    return df.where(F.col("__tile") == F.floor(F.col(i) / size))


def windowed(a: NdArray, axis: int, before: int, after: int, fn: Callable[[Column, object], Column]) -> NdArray:
    """fn(v, window) in each cell, the window holding the cells up to `before` before and `after` after along `axis`."""
    df, window = tiled(a, axis, before, after)
    i = a.axes[a.axis(axis)]
    out = df.withColumn("__r", fn(F.col("v"), window(-before, after)))
    return NdArray(own(out, i, before, after).select(*a.axes, F.col("__r").alias("v")), a.dims)


def prefix(a: NdArray, axis: int, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> NdArray:
    """Running folds along `axis`: within tiles, then with the fold of all tiles before.

    `fold` is an aggregate that can be taken of its own results (sum, max, min), `join` puts two folds together.
    """
    i = a.axes[a.axis(axis)]
    others = a.others(axis)
    df = a.df.withColumn("__tile", F.floor(F.col(i) / TILE))
    inner = W.partitionBy(*others, "__tile").orderBy(i).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__r", fold(F.col("v")).over(inner))
    if a.dims[a.axis(axis)] <= TILE:
        return NdArray(df.select(*a.axes, F.col("__r").alias("v")), a.dims)
    ends = a.df.groupBy(*others, F.floor(F.col(i) / TILE).alias("__tile")).agg(fold(F.col("v")).alias("v"))
    outer = W.partitionBy(*others).orderBy("__tile").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__before", fold(F.col("v")).over(outer)).drop("v")
    out = df.join(ends, [*others, "__tile"], "left")
    return NdArray(out.select(*a.axes, F.when(F.col("__before").isNull(), F.col("__r")).otherwise(join(F.col("__before"), F.col("__r"))).alias("v")), a.dims)


def along_lines(a: NdArray, axis: int, kernel: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]], length: int | None = None, dtype: str = "double", fill: bool = False) -> NdArray:
    """kernel(lines, at) for lines along `axis` that have equally many cells, a line in each row, `at` their other indices.

    It gives a line for each.  Lines are dealt to parts of about TILE cells and read in order as they come, so that a
    task holds a batch or one line.  With `fill`, lines have all places of the axis, 0 where there is no cell.
    """
    k = a.axis(axis)
    i, others, size = a.axes[k], a.others(axis), a.dims[k]
    fields = StructType.fromDDL(", ".join([*(f"{c} bigint" for c in others), f"{i} bigint", f"v {dtype}"]))
    schema = to_arrow_schema(fields)

    def starts(t) -> np.ndarray:
        """Rows, but the first, where a line begins."""
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in others:
            x, null = t.column(c).fill_null(0).to_numpy(zero_copy_only=False), t.column(c).is_null().to_numpy(zero_copy_only=False)
            new |= (x[1:] != x[:-1]) | (null[1:] != null[:-1])
        return np.flatnonzero(new) + 1

    def results(pieces: list[pa.RecordBatch]):
        t = pa.Table.from_batches(pieces).combine_chunks()
        first = np.concatenate([[0], starts(t)])
        sizes = np.diff(np.append(first, t.num_rows))
        v, place = t.column("v").to_numpy(), t.column(i).to_numpy()
        at = np.stack([t.column(c).fill_null(0).to_numpy()[first] for c in others], 1) if others else np.zeros((1, 0), np.int64)
        if fill:
            whole = np.zeros((len(first), size), v.dtype)
            whole[np.repeat(np.arange(len(first)), sizes), place] = v
            groups = [(np.arange(len(first)), whole)]
        else:
            groups = [(x := np.flatnonzero(sizes == n), v[first[x][:, None] + np.arange(n)]) for n in np.unique(sizes)]
        for which, lines in groups:
            out = kernel(lines, at[which])
            n = np.array([len(x) for x in out])
            row = pa.array(np.repeat(first[which], n))
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            values = pa.array(np.concatenate(list(out)), from_pandas=True).cast(schema.field("v").type)
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(row).cast(pa.int64()) for c in others), pa.array(index, pa.int64()), values], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]):
        held = []  # the line that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts(batch)
            if held and not len(new) and all(held[0].column(c)[0].as_py() == batch.column(c)[0].as_py() for c in others):
                held.append(batch)
                continue
            last = int(new[-1]) if len(new) else 0
            if held or last:
                yield from results([*held, *([batch.slice(0, last)] if last else [])])
            held = [batch.slice(last)]
        if held:
            yield from results(held)

    parts = max(1, -(-math.prod(a.dims) // TILE)) if others else 1
    df = a.df.select(*a.axes, "v").repartition(parts, *others).sortWithinPartitions(*others, F.col(i).asc_nulls_last())
    dims = tuple(length if length is not None and d == k else n for d, n in enumerate(a.dims))
    return NdArray(df.mapInArrow(run, fields).select(*a.axes, "v"), dims)


def along_axis(a: NdArray, axis: int, kernel: Callable[[np.ndarray], np.ndarray], length: int | None = None, dtype: str = "double") -> NdArray:
    """kernel(values along `axis`) for each line of the array; a line must fit a task.

    For kernels that no window can express (recursion, spectra, splines).
    """
    return along_lines(a, axis, lambda lines, at: [np.asarray(kernel(x)) for x in lines], length, dtype)


def frames(a: NdArray, kernel: Callable[[np.ndarray], np.ndarray], dims: tuple[int, int] | None = None, dtype: str = "double") -> NdArray:
    """kernel(image) for each plane of axes 0 and 1; a plane is one group, so it must fit a task."""
    others, shape = a.axes[2:], a.dims[:2]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(shape, frame["v"].dtype)
        image[frame["i0"].to_numpy(), frame["i1"].to_numpy()] = frame["v"].to_numpy()
        out = np.asarray(kernel(image))
        x, y = np.indices(out.shape).reshape(2, -1)
        return pd.DataFrame({"i0": x, "i1": y, **{c: np.repeat(frame[c].iloc[0], out.size) for c in others}, "v": out.ravel()})

    schema = ", ".join([*(f"{c} bigint" for c in a.axes), f"v {dtype}"])
    return NdArray(a.df.groupBy(*others).applyInPandas(run, schema), (*(dims or shape), *a.dims[2:]))


def patches(a: NdArray, reach: Sequence[tuple[int, int]], kernel: Callable[[np.ndarray, tuple[int, int], np.ndarray], np.ndarray], dtype: str = "double") -> NdArray:
    """kernel(part, first, grid) for patches of about TILE cells of each plane of axes 0 and 1.

    `grid` has the indices of the patch's cells (2, n, m), `part` the cells that they need, from `first` on: on each
    axis those from reach[0] before to reach[1] after a cell, the edge standing for what lies past it.
    """
    others, dims = a.axes[2:], a.dims[:2]
    width = max(1, min(dims[1], math.isqrt(TILE)))
    sides = (max(1, TILE // width), width)
    counts = [-(-d // s) for d, s in zip(dims, sides, strict=True)]

    def needed_by(i: Column, n: int, size: int, count: int, lo: int, hi: int) -> Column:
        """The patches that need index i."""
        first = F.when(i == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((i - hi) / size))).cast("bigint")
        last = F.when(i == n - 1, count - 1).otherwise(F.least(F.lit(count - 1), F.floor((i - lo) / size))).cast("bigint")
        return F.when(first <= last, F.sequence(first, last))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        start = [int(frame[c].iloc[0]) * s for c, s in zip(("__p0", "__p1"), sides, strict=True)]
        stop = [min(x + s, d) for x, s, d in zip(start, sides, dims, strict=True)]
        first = tuple(min(max(x + lo, 0), d - 1) for x, d, (lo, _) in zip(start, dims, reach, strict=True))
        end = [min(max(x - 1 + hi, 0), d - 1) + 1 for x, d, (_, hi) in zip(stop, dims, reach, strict=True)]
        cells = frame[frame["i0"] >= 0]
        part = np.zeros([y - x for x, y in zip(first, end, strict=True)], frame["v"].dtype)
        inside = ((cells["i0"] < end[0]) & (cells["i1"] < end[1])).to_numpy()  # the last patch may be cut
        part[cells["i0"].to_numpy()[inside] - first[0], cells["i1"].to_numpy()[inside] - first[1]] = cells["v"].to_numpy()[inside]
        grid = np.stack(np.meshgrid(*(np.arange(x, y) for x, y in zip(start, stop, strict=True)), indexing="ij"))
        out = np.asarray(kernel(part, first, grid))
        return pd.DataFrame({"i0": grid[0].ravel(), "i1": grid[1].ravel(), **{c: np.repeat(frame[c].iloc[0], out.size) for c in others}, "v": out.ravel()})

    at = [needed_by(F.col(f"i{k}"), dims[k], sides[k], counts[k], *reach[k]).alias(f"__p{k}") for k in (0, 1)]
    sent = a.df.select(*a.axes, "v", at[0], at[1]).withColumn("__p0", F.explode("__p0")).withColumn("__p1", F.explode("__p1"))
    # A row for each patch, so that one without cells is there too.
    planes = a.df.select(*others).distinct() if others else a.df.limit(1).select(F.lit(0).alias("__plane"))
    every = planes.crossJoin(a.df.sparkSession.range(counts[0] * counts[1]))
    every = every.select(F.lit(-1).cast("bigint").alias("i0"), F.lit(-1).cast("bigint").alias("i1"), *others, F.lit(0).cast(a.dtype).alias("v"), F.floor(F.col("id") / max(1, counts[1])).alias("__p0"), (F.col("id") % max(1, counts[1])).alias("__p1"))
    schema = ", ".join([*(f"{c} bigint" for c in a.axes), f"v {dtype}"])
    return NdArray(sent.union(every).groupBy(*others, "__p0", "__p1").applyInPandas(run, schema), a.dims)


def with_row_index(df: DataFrame, order: Iterable[Column], name: str = "i0") -> DataFrame:
    """`df` with the rank of each row in `order` (from 0), without bringing all rows to one task.

    Ranges are sorted apart; the sizes of the ranges, one number each, come to the driver.
    """
    order = list(order)
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = {r[0]: r[1] for r in ranged.groupBy("__p").count().collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    at = F.from_json(F.lit(str(offsets)), "array<bigint>")
    return ranged.withColumn(name, F.get(at, F.col("__p")) + F.col("__n")).drop("__p", "__n")
