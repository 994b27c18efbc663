"""Reductions over axes or classes, histograms, order statistics, lookups and equivalence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.ndarray import TILE, NdArray
from lattica.plans.lineage import cut

NAN = float("nan")
#: Cells of the second array of `outer` in a row, and the parts that the first one is dealt to where there are more.
OUTER_CELLS, OUTER_PARTS = 65_536, 64
#: Pairs whose classes a task of `equivalence` finds in memory, and the roots of such classes that are broadcast, at most.
PAIRS, BROADCAST_ROOTS = 2_000_000, 100_000


def _nan(v: Column) -> Column:
    return F.isnan(v.cast("double"))


def reduce_axes(a: NdArray, axes: Sequence[int] | int | None, keepdims: bool, *aggs: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """Aggregates over `axes` (None: all), by the index columns that remain; with keepdims the others are 0."""
    gone = set(range(a.ndim)) if axes is None else {a.axis(k) for k in ([axes] if isinstance(axes, int) else axes)}
    rest = [c for k, c in enumerate(a.axes) if k not in gone]
    out = a.df.groupBy(*rest, *keep).agg(*aggs)
    if not keepdims:
        return out
    zero = [F.lit(0).cast("bigint").alias(a.axes[k]) if k in gone else F.col(a.axes[k]) for k in range(a.ndim)]
    return out.select(*zero, *(c for c in out.columns if c not in rest))


def _values(omitnans: bool) -> Column:
    v = F.col("v").cast("double")
    return F.when(~F.isnan(v), v) if omitnans else v


def total(a: NdArray, axes=None, power: int = 1, keepdims: bool = False, omitnans: bool = False) -> DataFrame:
    """Sum of v^power; column v."""
    v = _values(omitnans)
    return reduce_axes(a, axes, keepdims, F.sum(v if power == 1 else F.pow(v, F.lit(power))).alias("v"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: Column, weight: Column | None = None, power: int = 1) -> DataFrame:
    x = value if power == 1 else F.pow(value, F.lit(power))
    return df.groupBy(*by).agg((F.avg(x) if weight is None else F.sum(weight * x) / F.sum(weight)).alias("v"))


def mean(a: NdArray, axes=None, power: int = 1, keepdims: bool = False, omitnans: bool = False) -> DataFrame:
    v = _values(omitnans)
    return reduce_axes(a, axes, keepdims, F.avg(v if power == 1 else F.pow(v, F.lit(power))).alias("v"))


def _sample(population: bool, pop: Column, samp: Column) -> Column:
    """Sample statistics of one value are 0."""
    return pop if population else F.coalesce(samp, F.when(F.count("v") == 1, 0.0))


def variance(a: NdArray, axes=None, population: bool = False, keepdims: bool = False, omitnans: bool = False) -> DataFrame:
    v = _values(omitnans)
    return reduce_axes(a, axes, keepdims, _sample(population, F.var_pop(v), F.var_samp(v)).alias("v"))


def sdev(a: NdArray, axes=None, population: bool = False, keepdims: bool = False, omitnans: bool = False) -> DataFrame:
    v = _values(omitnans)
    return reduce_axes(a, axes, keepdims, _sample(population, F.stddev_pop(v), F.stddev_samp(v)).alias("v"))


def by_class(df: DataFrame, cls: Column, value: Column, population: bool = False) -> DataFrame:
    """n, total, mean, variance and sdev of `value` for each integer class."""
    v = value.cast("double")
    n = F.count(v)
    var = F.var_pop(v) if population else F.when(n == 1, 0.0).otherwise(F.var_samp(v))
    return df.groupBy(cls.alias("class")).agg(n.alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), var.alias("variance"), F.sqrt(var).alias("sdev"))


def covariance(df: DataFrame, by: Sequence[str], x: Column, y: Column, weight: Column | None = None, population: bool = False) -> DataFrame:
    if weight is None:
        return df.groupBy(*by).agg((F.covar_pop(x, y) if population else F.covar_samp(x, y)).alias("v"))
    w = F.sum(weight)
    return df.groupBy(*by).agg((F.sum(weight * x * y) / w - F.sum(weight * x) / w * F.sum(weight * y) / w).alias("v"))


def crosscorr(df: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("v"))


def maximum(a: NdArray, axes=None, keepdims: bool = False) -> DataFrame:
    """Largest element; NaN is passed over."""
    return reduce_axes(a, axes, keepdims, F.max(F.when(~_nan(F.col("v")), F.col("v"))).alias("v"))


def minimum(a: NdArray, axes=None, keepdims: bool = False) -> DataFrame:
    return reduce_axes(a, axes, keepdims, F.min(F.when(~_nan(F.col("v")), F.col("v"))).alias("v"))


def _place(a: NdArray, axes, keepdims: bool, sign: int) -> DataFrame:
    gone = [a.axes[k] for k in (range(a.ndim) if axes is None else sorted({a.axis(k) for k in ([axes] if isinstance(axes, int) else axes)}))]
    best = F.min(F.struct((F.when(~_nan(F.col("v")), F.col("v") * -sign)).isNull().alias("null"), (F.col("v") * -sign).alias("v"), *gone))
    out = reduce_axes(a, axes, keepdims, best.alias("b"))
    return out.select(*(c for c in out.columns if c != "b"), *(F.col(f"b.{g}").alias(f"at_{g}") for g in gone))


def maxloc(a: NdArray, axes=None, keepdims: bool = False) -> DataFrame:
    """Where the largest element is (the first such place): columns at_i*."""
    return _place(a, axes, keepdims, 1)


def minloc(a: NdArray, axes=None, keepdims: bool = False) -> DataFrame:
    return _place(a, axes, keepdims, -1)


def psum(df: DataFrame, by: Sequence[str], value: Column, coords: Sequence[Column], powers: Sequence[int], normalise: bool = False) -> DataFrame:
    """Sum of value times the coordinates to given powers, by class; normalised: divided by the sum of value."""
    term = value
    for c, p in zip(coords, powers, strict=True):
        term = term * F.pow(c, F.lit(p))
    s = F.sum(term)
    return df.groupBy(*by).agg((s / F.sum(value) if normalise else s).alias("v"))


def hist(df: DataFrame, value: Column, first: int | None = 0) -> DataFrame:
    """(i0, v): how often each whole value from `first` (None: the least) to the largest occurs, zeros included."""
    counts = df.where(value.isNotNull()).groupBy(F.floor(value).cast("bigint").alias("i0")).agg(F.count("*").alias("v"))
    lo, hi = counts.agg(F.min("i0"), F.max("i0")).first()
    if hi is None:
        return counts
    lo = lo if first is None else first
    counts = counts.where(F.col("i0") >= lo)
    return df.sparkSession.range(lo, hi + 1).select(F.col("id").alias("i0")).join(counts, "i0", "left").select("i0", F.coalesce("v", F.lit(0)).alias("v"))


def histr(df: DataFrame, value: Column, first: int | None = 0) -> DataFrame:
    """Running histogram, the last being 1. Counts add up within tiles of values, and the sums of the tiles before are added."""
    h = cut(hist(df, value, first).withColumn("__tile", F.floor(F.col("i0") / TILE)))
    sums = h.groupBy("__tile").agg(F.sum("v").alias("__n"))
    sums = sums.select("__tile", (F.sum("__n").over(W.orderBy("__tile")) - F.col("__n")).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("__all"))
    w = W.partitionBy("__tile").orderBy("i0")
    return h.join(sums, "__tile").select("i0", ((F.col("__before") + F.sum("v").over(w)) / F.col("__all")).alias("v"))


def distr(df: DataFrame, bin_: Column, value: Column, bins: int) -> DataFrame:
    """(i0, v): value added up in bins 0 .. bins - 1, zeros included; other bins are passed over."""
    sums = df.where(bin_.between(0, bins - 1)).groupBy(bin_.cast("bigint").alias("i0")).agg(F.sum(value).alias("v"))
    return df.sparkSession.range(bins).select(F.col("id").alias("i0")).join(sums, "i0", "left").select("i0", F.coalesce("v", F.lit(0.0)).alias("v"))


def _quantile_of_all(df: DataFrame, order: float) -> DataFrame:
    """The element of column v at order * (n - 1), interpolated, as one row; null without values.

    Equal values are folded first; counts are summed up within ranges of values, and the sums of the ranges before
    are added, so that no task has all values.
    """
    counts = df.where("v is not null").groupBy(F.col("v").cast("double").alias("v")).agg(F.count("*").alias("__c"))
    ranged = cut(counts.repartitionByRange("v").withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__c").alias("__n"))
    n = sums.agg(F.sum("__n")).first()[0] or 0
    place = order * max(0, n - 1)
    lo, hi = math.floor(place), math.ceil(place)
    before = sums.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    upto = F.col("__before") + F.sum("__c").over(W.partitionBy("__part").orderBy("v"))
    ends = ranged.join(F.broadcast(before), "__part").withColumn("__upto", upto)  # `before` has a row for each range
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col("v")))
    ends = ends.agg(at(lo).alias("__lo"), at(hi).alias("__hi"))
    return ends.select(F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise((hi - place) * F.col("__lo") + (place - lo) * F.col("__hi")).alias("v"))


def quantile(a: NdArray, order: float, axes=None, keepdims: bool = False) -> DataFrame:
    """Element at order * (n - 1), interpolated; of whole numbers the increment is cut. Over all axes no task has all cells."""
    whole = lambda x: F.floor(x).cast(a.dtype) if a.dtype in ("tinyint", "smallint", "int", "bigint") else x
    if axes is None or len({a.axis(k) for k in ([axes] if isinstance(axes, int) else axes)}) == a.ndim:
        zeros = [F.lit(0).cast("bigint").alias(c) for c in a.axes] if keepdims else []
        return _quantile_of_all(a.df, float(order)).select(*zeros, whole(F.col("v")).alias("v"))
    return reduce_axes(a, axes, keepdims, whole(F.percentile(F.col("v"), F.lit(float(order)))).alias("v"))


def median(a: NdArray, axes=None, keepdims: bool = False) -> DataFrame:
    return quantile(a, 0.5, axes, keepdims)


def match(targets: DataFrame, target: str, keys: DataFrame, key: str, place: str) -> DataFrame:
    """`targets` with v: the least place of the target among the keys, or -1."""
    first = keys.groupBy(F.col(key).alias("__k")).agg(F.min(place).alias("__p"))
    return targets.join(first, F.col(target) == F.col("__k"), "left").withColumn("v", F.coalesce("__p", F.lit(-1))).drop("__k", "__p")


def find(keys: DataFrame, key: str, data: DataFrame, value: str, place: str, offset: int = 0) -> DataFrame:
    """`keys` with v: the first place at or after `offset` where the data equal the key, or -1."""
    return match(keys, key, data.where(F.col(place) >= offset), value, place)


def find_at_or_past(keys: DataFrame, key: str, data: DataFrame, value: str, place: str) -> DataFrame:
    """`keys` with v: the first place of ascending data at or past the key, or -1.

    Keys and data are merged by value in ranges; a key takes the next data place in its range, or else the
    first of the ranges after it.
    """
    both = data.select(F.col(value).cast("double").alias("__x"), F.lit(1).alias("__side"), F.col(place).alias("__p"), F.lit(None).cast(keys.schema[key].dataType).alias("__key"))
    both = both.union(keys.select(F.col(key).cast("double"), F.lit(0), F.lit(None).cast("bigint"), F.col(key)))
    ranged = cut(both.repartitionByRange("__x").withColumn("__part", F.spark_partition_id()))
    ends = ranged.groupBy("__part").agg(F.min("__p").alias("__first")).withColumn("__next", F.min("__first").over(W.orderBy("__part").rowsBetween(1, W.unboundedFollowing)))
    w = W.partitionBy("__part").orderBy(F.desc("__x"), F.desc("__side")).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("__at", F.min("__p").over(w)).where("__side = 0").join(F.broadcast(ends), "__part")
    return placed.select(F.col("__key").alias(key), F.coalesce("__at", "__next", F.lit(-1)).cast("bigint").alias("v"))


def findspans(a: NdArray) -> DataFrame:
    """(start, length) of each run of non-zero cells of a 1-D array.

    A start is a non-zero cell after a zero one; the n-th start goes with the n-th end. Ranks are ranks of
    starts and ends only.
    """
    on = a.df.where("v != 0").select("i0")
    before, after = on.select((F.col("i0") + 1).alias("i0")), on.select((F.col("i0") - 1).alias("i0"))
    starts, ends = on.join(before, "i0", "left_anti"), on.join(after, "i0", "left_anti")
    pairs = starts.select("i0", F.lit(0).alias("end")).union(ends.select("i0", F.lit(1)))
    tile = F.floor(F.col("i0") / 1_000_000)
    w = W.partitionBy("tile").orderBy(F.desc("i0"), F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    marked = pairs.withColumn("tile", tile).withColumn("stop", F.min(F.when(F.col("end") == 1, F.col("i0"))).over(w))
    # A run may pass the end of its tile: the first end of the tiles after it.
    firsts = marked.groupBy("tile").agg(F.min(F.when(F.col("end") == 1, F.col("i0"))).alias("first"))
    firsts = firsts.select("tile", F.min("first").over(W.orderBy("tile").rowsBetween(1, W.unboundedFollowing)).alias("next"))
    return marked.where("end = 0").join(firsts, "tile", "left").select(F.col("i0").alias("start"), (F.coalesce("stop", "next") - F.col("i0") + 1).alias("length"))


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the pairs (a, b), in order, and the smallest member of the class of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        x, y = x[x < y], y[x < y]
        if not len(x):
            return nodes, nodes[up]
        np.minimum.at(up, y, x)
        while ((far := up[up]) != up).any():
            up = far


def _stars(links: DataFrame) -> DataFrame:
    """(node, root) of the classes within the links (a, b) that a task meets together, at most PAIRS of them."""
    most = PAIRS

    def run(batches):
        def rows(nodes, roots):
            for k in range(0, len(nodes), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 65_536]), pa.array(roots[k : k + 65_536])], names=["node", "root"])

        a, b, n = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                x, y = (batch.column(c).slice(k, most).to_numpy(zero_copy_only=False) for c in (0, 1))
                a, b, n = [*a, x], [*b, y], n + len(x)
                if n < most:
                    continue
                nodes, roots = _least(np.concatenate(a), np.concatenate(b))
                a, b, n = [nodes], [roots], len(nodes)
                if n > most // 2:
                    yield from rows(nodes, roots)
                    a, b, n = [], [], 0
        if n:
            yield from rows(*_least(np.concatenate(a), np.concatenate(b)))

    return links.mapInArrow(run, "node bigint, root bigint")


def _rounds(links: DataFrame) -> DataFrame:
    """(node, root) of whole classes.

    Each round hooks every element's class to its smallest neighbour's and halves the paths; rounds are
    written to the shared checkpoint folder.
    """
    both = cut(links.union(links.select("b", "a")).dropDuplicates())
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        new = label.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(new.join(jump, "root").select("node", F.least("root", "far").alias("root")))
        changed = new.join(label.withColumnRenamed("root", "old"), "node").where("root != old").limit(1).count()
        label = new
        if not changed:
            return label


def _classes(stars: DataFrame, before: int | None = None) -> DataFrame:
    """(node, root) of whole classes from those of parts: a node joins its least root, its roots are linked in turn."""
    w = W.partitionBy("node").orderBy("root")
    met = cut(stars.select("node", "root", F.first("root").over(w).alias("least"), F.row_number().over(w).alias("k")))
    own = met.where("k = 1").select("node", "least")
    rest = cut(_stars(met.where("root != least").select("least", "root")))
    n = rest.count()
    if not n:
        return own.withColumnRenamed("least", "root")
    if n <= PAIRS // 2:
        tops = _stars(rest.coalesce(1))
    elif before is None or n <= before // 2:
        tops = _classes(rest, n)
    else:  # the parts have little in common
        tops = _rounds(rest.toDF("a", "b"))
    tops = tops.toDF("least", "top")
    out = own.join(F.broadcast(tops) if n <= BROADCAST_ROOTS else tops, "least", "left")
    return out.select("node", F.coalesce("top", "least").alias("root"))


def equivalence(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest member of each element's class, for whole numbers related in pairs.

    Tasks find the classes of the pairs that they read, and only what links these is shuffled.
    """
    links = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    kind = links.union(links.select("b", "a")).schema["a"].dataType
    out = _classes(_stars(links.where("a is not null and b is not null").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))))
    return out.select(F.col("node").cast(kind), F.col("root").cast(kind))


def commonfactors(values: list[float], tolerance: float, most: int = 100) -> list[list[int]]:
    """Groups of indices of values that are near whole multiples of their smallest member."""
    left, out = sorted(range(len(values)), key=lambda k: values[k]), []
    while left:
        base = values[left[0]]
        group = [k for k in left if base and abs(values[k] / base - round(values[k] / base)) <= tolerance and round(values[k] / base) <= most] or [left[0]]
        out.append(group)
        left = [k for k in left if k not in group]
    return out


def mproduct(a: NdArray, b: NdArray) -> NdArray:
    """Matrix product over the last axis of a and the first of b (both with two axes)."""
    if a.dims[1] != b.dims[0]:
        raise ValueError(f"dimensions {a.dims} and {b.dims}")
    right = b.df.select(F.col("i0").alias("__k"), F.col("i1").alias("__j"), F.col("v").alias("__w"))
    out = a.df.join(right, F.col("i1") == F.col("__k")).groupBy("i0", F.col("__j").alias("i1")).agg(F.sum(F.col("v") * F.col("__w")).alias("v"))
    return NdArray(out, (a.dims[0], b.dims[1]))


def outer(a: NdArray, b: NdArray) -> NdArray:
    """Products of each pair of cells of two 1-D arrays.

    b is cut to rows of OUTER_CELLS cells.  One such row is broadcast; more are dealt to parts by cells of a, so that
    neither a part of a nor one of b is a task of its own.
    """
    rows = b.df.groupBy(F.floor(F.col("i0") / OUTER_CELLS).alias("__row")).agg(F.sort_array(F.collect_list(F.struct("i0", "v"))).alias("r"))
    n = -(-b.dims[0] // OUTER_CELLS)
    if n <= 1:
        out = a.df.withColumn("__row", F.lit(0).cast("bigint")).join(F.broadcast(rows), "__row")
    else:
        left = a.df.withColumn("__part", F.pmod(F.xxhash64("i0"), F.lit(OUTER_PARTS))).withColumn("__row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        out = left.join(rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(OUTER_PARTS - 1).cast("bigint")))), ["__row", "__part"])
    out = out.select("i0", F.col("v").alias("x"), F.explode("r").alias("e"))
    return NdArray(out.select("i0", F.col("e.i0").alias("i1"), (F.col("x") * F.col("e.v")).alias("v")), (a.dims[0], b.dims[0]))
