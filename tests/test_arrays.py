"""Array operators on small literal arrays, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import lattica.ndarray as nd
from lattica.ndarray import NdArray
from lattica.operators import elementwise as el
from lattica.operators import fitting as fit
from lattica.operators import images as im
from lattica.operators import reductions as red
from lattica.operators import selection as sel
from lattica.operators import shape as sh
from lattica.operators import spectral as sp
from lattica.operators import windows as win


@pytest.fixture(scope="module")
def line(spark):
    return NdArray.of(spark, np.random.RandomState(1).rand(50) * 10)


@pytest.fixture(scope="module")
def image(spark):
    return NdArray.of(spark, np.random.RandomState(2).rand(9, 7))


@pytest.fixture
def small_tiles(monkeypatch):
    """Windows and prefixes in tiles of eight cells."""
    monkeypatch.setattr(nd, "TILE", 8)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("left,right", [((97, 13, 47), (2, 16, 5)), ((44, 11, 3), (11, 11, 11)), ((7, 7, 7), (20, 7, 5))])
def test_whole_number_operators(spark, left, right):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True))], "i int, a bigint, b bigint")
    ops = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "idiv": lambda a, b: a // b, "fmod": lambda a, b: a % b, "bit_and": lambda a, b: a & b, "bit_or": lambda a, b: a | b, "bit_xor": lambda a, b: a ^ b, "larger": max, "smaller": min, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b, "smod": lambda a, b: a % b - b if 2 * (a % b) > b else a % b, "power": lambda a, b: float(a) ** b}
    got = df.select("i", *(getattr(el, n)(F.col("a"), F.col("b")).alias(n) for n in ops)).orderBy("i").collect()
    for n, op in ops.items():
        assert [r[n] for r in got] == pytest.approx([op(a, b) + 0 for a, b in zip(left, right, strict=True)]), n


def test_division_by_zero_and_signs(spark):
    assert value(spark, el.idiv(F.lit(-7), F.lit(2))) == -3
    assert value(spark, el.fdiv(F.lit(-7), F.lit(2))) == -4
    assert value(spark, el.idiv(F.lit(7), F.lit(0))) is None
    assert value(spark, el.smod(F.lit(-3), F.lit(7))) == -3
    assert value(spark, el.quotient_remainder(F.lit(-7), F.lit(2))) == (-4, 1)
    assert value(spark, el.fdiv(F.lit(-7.5), F.lit(2.0))) == -4


@pytest.mark.parametrize("b", [1, 7, -3])
def test_quotients_of_large_whole_numbers(spark, b):
    for a in (2**60 + 1, -(2**60) - 1, 2**53 + 3):
        x, y = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")
        assert value(spark, el.idiv(x, y)) == (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
        assert value(spark, el.fdiv(x, y, whole=True)) == a // b
        assert value(spark, el.quotient_remainder(x, y)) == ((a - a % abs(b)) // b, a % abs(b))
        if b > 0:
            assert value(spark, el.sdiv(x, y) * y + el.smod(x, y)) == a


def test_nan_rules(spark):
    nan = float("nan")
    assert math.isnan(value(spark, el.larger(F.lit(nan), F.lit(1.0))))
    a = NdArray.of(spark, [1.0, nan, 3.0])
    assert red.maximum(a).first()["v"] == 3.0
    assert red.mean(a, omitnans=True).first()["v"] == 2.0
    assert math.isnan(red.total(a).first()["v"])


def test_wrapping_conversions(spark):
    assert value(spark, sh.convert(F.lit(300.7), "byte")) == 44
    assert value(spark, sh.convert(F.lit(-1), "byte")) == 255
    assert value(spark, sh.convert(F.lit(40000), "int16")) == -25536
    assert value(spark, el.swab(F.lit(0x1234), 2)) == 0x3412


def test_axes_of_a_3d_array(spark):
    x = np.arange(24).reshape(3, 4, 2, order="F")
    a = NdArray.of(spark, x)
    t = red.total(a, 1, keepdims=True)
    assert {(r["i0"], r["i2"]): r["v"] for r in t.collect()} == {(i, k): x[i, :, k].sum() for i in range(3) for k in range(2)}
    assert red.total(a, [0, 2]).count() == 4
    assert (sh.redim(a, 6, 4).numpy() == x.reshape(6, 4, order="F")).all()
    assert (sh.roll(a, [2, 0, 1]).numpy() == x.transpose(2, 0, 1)).all()
    assert (sh.indgen(a).numpy() == x).all()
    with pytest.raises(ValueError):
        sh.redim(a, 5, 5)
    with pytest.raises(ValueError):
        a.axis(3)


def test_statistics_of_one_value(spark):
    a = NdArray.of(spark, [5.0])
    assert red.variance(a).first()["v"] == 0.0
    assert red.sdev(a, population=True).first()["v"] == 0.0


def test_subscripts(image):
    x = image.numpy()
    assert np.allclose(sh.subscript(image, slice(2, 5), [6, 0]).numpy(), x[2:5][:, [6, 0]])
    assert np.allclose(sh.subscript(image, 3, slice(0, 7)).numpy(), x[3])
    assert np.allclose(sh.subscript(image, "+", slice(0, 7)).numpy(), x.sum(axis=0))


@pytest.mark.parametrize("way", range(8))
def test_reorder_is_undone(image, way):
    x = sh.reorder(image, way).numpy()
    y = image.numpy().T if way & 4 else image.numpy()
    assert np.allclose(x, y[:: -1 if way & 1 else 1, :: -1 if way & 2 else 1])


def test_windows_do_not_depend_on_tiles(line, small_tiles):
    x = line.numpy()
    assert np.allclose(win.runsum(line).numpy(), np.cumsum(x))
    assert np.allclose(win.runmax_all(line).numpy(), np.maximum.accumulate(x))
    assert np.allclose(win.runprod(line).numpy(), np.cumprod(x))
    assert np.allclose(win.smooth(line, 5).numpy(), [x[max(0, i - 2) : i + 3].mean() for i in range(50)])
    assert np.allclose(sel.medfilter(line, 0, 3).numpy(), [np.median(x[max(0, i - 1) : i + 2]) for i in range(50)])
    assert np.allclose(win.differ(line, 2).numpy()[2:], x[2:] - x[:-2])
    assert np.allclose(win.ksmooth(line, [0.25, 0.5, 0.25]).numpy(), np.convolve(x, [0.25, 0.5, 0.25], "same"))
    k = np.array(win.gauss_kernel(3.0))
    assert np.allclose(win.gsmooth(line, 3.0).numpy(), np.convolve(x, k, "same") / np.convolve(np.ones(50), k, "same"))
    assert np.allclose(sel.runord(line, 3, 0).numpy(), [np.sort(x[max(0, i - 1) : i + 2])[0] for i in range(50)])
    assert sorted(r["i0"] for r in sel.find_max(line).collect()) == [i for i in range(1, 49) if x[i] > x[i - 1] and x[i] >= x[i + 1]]


def test_runcum_and_esmooth(line):
    x = line.numpy()
    assert np.allclose(win.runcum(line, 4).numpy(), [x[i - 3 : i + 1].sum() if i >= 3 else 0 for i in range(50)])
    y = win.esmooth1(line, 3.0).numpy()
    d = math.exp(-1 / 3)
    assert y[1] == pytest.approx(x[1] * (1 - d) + x[0] * d)


def test_despike_takes_out_a_spike(spark):
    x = np.ones(30) + 0.01 * np.sin(np.arange(30))
    x[12] = 50
    y = win.despike(NdArray.of(spark, x)).numpy()
    assert abs(y[12] - 1) < 0.1 and np.allclose(np.delete(y, 12), np.delete(x, 12))


def test_sort_index_rank(line):
    x = line.numpy()
    assert np.allclose(sel.sort(line).numpy(), np.sort(x))
    assert (sel.index(line).numpy() == np.argsort(x, kind="stable")).all()
    assert (sel.rank(line).numpy() == np.argsort(np.argsort(x, kind="stable"))).all()


def test_lookups(spark):
    data = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 3.0, 7.0])], "place bigint, value double")
    keys = spark.createDataFrame([(0.5,), (3.0,), (4.0,), (9.0,)], "k double")
    assert {r["k"]: r["v"] for r in red.match(keys, "k", data, "value", "place").collect()} == {0.5: -1, 3.0: 1, 4.0: -1, 9.0: -1}
    assert {r["k"]: r["v"] for r in red.find_at_or_past(keys, "k", data, "value", "place").collect()} == {0.5: 0, 3.0: 1, 4.0: 3, 9.0: -1}
    unique, looked = sel.tolookup(data, "value")
    assert [r["value"] for r in unique.orderBy("i0").collect()] == [1.0, 3.0, 7.0]
    assert sorted((r["place"], r["lookup"]) for r in looked.collect()) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_lookup_with_tolerance(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 5.0, 1.2, 9.0, 1.4, 5.1])], "k int, x double")
    least, looked = sel.tolookup(df, "x", 0.3)
    assert [r["value"] for r in least.orderBy("i0").collect()] == [1.0, 5.0, 9.0]
    assert [r["lookup"] for r in looked.orderBy("k").collect()] == [0, 1, 0, 2, 0, 1]


def test_spans(spark):
    a = NdArray.of(spark, [0, 1, 1, 0, 0, 1, 0, 1, 1, 1])
    assert sorted(map(tuple, red.findspans(a).collect())) == [(1, 2), (5, 1), (7, 3)]


def test_equivalence(spark):
    pairs = spark.createDataFrame([(9, 8), (8, 7), (1, 2), (2, 3), (3, 4), (4, 5), (20, 20)], "a bigint, b bigint")
    assert dict(map(tuple, red.equivalence(pairs).collect())) == {9: 7, 8: 7, 7: 7, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 20}


def test_products(spark):
    x, y = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    assert np.allclose(red.mproduct(NdArray.of(spark, x), NdArray.of(spark, y)).numpy(), x @ y)
    u, v = NdArray.of(spark, [1.0, 2.0]), NdArray.of(spark, [3.0, 4.0, 5.0])
    assert np.allclose(red.outer(u, v).numpy(), np.outer([1, 2], [3, 4, 5]))
    assert np.allclose(sh.mdiagonal(u).numpy(), np.diag([1.0, 2.0]))


def test_fits_and_splines():
    x = np.linspace(0, 6, 13)
    y = np.sin(x)
    at = np.linspace(0, 6, 50)
    assert np.abs(fit.cspline(x, y, at) - np.sin(at)).max() < 5e-3
    assert np.abs(fit.akima(x, y, at) - np.sin(at)).max() < 2e-2
    assert np.allclose(fit.cspline(x, y, x), y) and np.allclose(fit.monotone_interpolate(x, y, x), y) and np.allclose(fit.tension_spline(x, y, x, 2.0), y)
    assert np.abs(fit.cspline_integral(x, y, at) - (1 - np.cos(at))).max() < 5e-3
    up = fit.monotone_interpolate([0, 1, 2, 3], [0, 0.1, 5, 5.1], np.linspace(0, 3, 100))
    assert (np.diff(up) >= -1e-12).all()
    assert np.allclose(fit.cspline_find(x, y, 0.5), [math.asin(0.5), math.pi - math.asin(0.5)], atol=5e-3)
    assert [s for _, _, s in fit.cspline_extremes(x, y)] == [1, -1]
    model = lambda t, p: p[0] * np.exp(-p[1] * t)
    p, chi = fit.fit(model, x, model(x, [2.0, 0.7]), [1.0, 1.0])
    assert np.allclose(p, [2.0, 0.7], atol=1e-5) and chi < 1e-10
    p, _ = fit.fit_genetic(model, x, model(x, [2.0, 0.7]), [0, 0], [5, 5], generations=20)
    assert np.allclose(p, [2.0, 0.7], atol=1e-4)
    a, b = fit.tension_curve([0, 1, 1, 0], [0, 0, 1, 1], 9, 1.0, closed=True)
    assert abs(a[0] - a[-1]) < 1e-9 and abs(b[0] - b[-1]) < 1e-9


def test_polynomials_and_polate(spark, line):
    x = line.numpy()
    c = fit.pit(line.df, F.col("i0"), F.col("v"), 2)
    assert np.allclose(c, np.polyfit(np.arange(50), x, 2)[::-1])
    assert np.allclose(fit.detrend(line, 2).numpy(), x - np.polyval(c[::-1], np.arange(50)))
    table = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (3.0, 0.0)], "x double, y double")
    points = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (4.0,)], "p double")
    assert {r["p"]: r["v"] for r in fit.polate(table, "x", "y", points, "p").collect()} == {-1.0: -10.0, 0.5: 5.0, 2.0: 5.0, 4.0: -5.0}
    r = np.random.RandomState(8)
    kx, ky, at = np.sort(r.rand(60)), r.randn(60), np.r_[r.rand(300) * 1.4 - 0.2, np.full(40, 0.5)]
    many = spark.createDataFrame([(float(p), k) for k, p in enumerate(at)] + [(None, -1), (float("nan"), -2)], "x double, part int")
    got = {g["part"]: g["v"] for g in fit.polate(spark.createDataFrame(list(zip(kx.tolist(), ky.tolist(), strict=True)), "x double, y double"), "x", "y", many, "x").collect()}
    piece = np.clip(np.searchsorted(kx, at, "right") - 1, 0, 58)
    want = ky[piece] + (at - kx[piece]) * (ky[piece + 1] - ky[piece]) / (kx[piece + 1] - kx[piece])
    assert len(got) == len(at) and np.allclose([got[k] for k in range(len(at))], want)
    assert fit.polate(table.limit(1), "x", "y", points, "p").collect() == [] and fit.polate(table.where("false"), "x", "y", points, "p").collect() == []


def test_spectra(line):
    x = line.numpy()
    assert np.allclose(sp.fftb(sp.fft(line)).numpy(), x)
    assert np.allclose(sp.fftshift(line, 1.0).numpy()[1:], x[:-1], atol=1)
    assert sp.power(line).numpy().sum() == pytest.approx((x**2).mean(), rel=0.05)
    s, c = sp.sc(x)
    assert np.allclose(sp.scb(s, c, 50), x)
    assert len(sp.welch(x, 16)) == 9
    m = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]])
    assert np.allclose(m @ sp.dsolve(*sp.decomp(m), np.array([1.0, 2, 3])), [1, 2, 3])
    assert np.allclose(sp.eigenvalues(m), sorted(np.linalg.eigvalsh(m), reverse=True))


def test_images(spark, image):
    x = image.numpy()
    pad = np.pad(x > 0.7, 1)
    want = np.max([pad[i : i + 9, j : j + 7] for i in range(3) for j in range(3)], axis=0)
    assert (im.dilate(image.map(lambda v: (v > 0.7).cast("int"))).numpy() == want).all()
    lap = im.laplace2d(image)
    assert np.allclose(im.antilaplace2d(lap).numpy(), x - x.mean(), atol=1e-8)
    marks = NdArray.of(spark, np.array([[1, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]]))
    found = im.area(marks, diagonal=False).numpy()
    assert (found == np.array([[1, 1, 0, 0], [0, 0, 0, 11], [3, 0, 0, 11]])).all()
    kinds = sorted(r["kind"] for r in im.areaconnect(im.area(marks), NdArray.of(spark, np.array([[5, 6, 0, 0], [0, 0, 0, 0], [0, 0, 7, 0]]))).collect())
    assert kinds == ["appear", "disappear", "disappear", "split", "split"]
    ends = im.basin(NdArray.of(spark, np.array([[3.0, 2, 1, 2, 0.5]]))).numpy()
    assert ends.tolist() == [[2, 2, 2, 4, 4]]
    assert np.allclose(im.compose(im.decompose_median(x, 2)), x)
    p = np.random.RandomState(3).rand(32, 32)
    assert np.allclose(im.subshift(p, np.roll(p, (3, -2), (0, 1))), (3, -2), atol=0.2)
    assert np.allclose(im.shift3(image, 0.0, 0.0).numpy(), x)
    assert np.allclose(im.regrid(image, np.full((2, 2), 1.5), np.full((2, 2), 2.0)).numpy(), (x[1, 2] + x[2, 2]) / 2)


def test_walks_and_minimum():
    z = -np.hypot(*(np.indices((9, 9)) - np.array([6, 2])[:, None, None]))
    assert sel.local_maxloc(z, (0, 8)) == (6, 2) and sel.local_max(z, (0, 8)) == 0
    g = np.indices((3, 3)) - 1.0
    assert np.allclose(sel.getmin9((g[0] - 0.2) ** 2 + (g[1] + 0.1) ** 2), (0.2, -0.1))


def test_quantile_of_all_cells_and_running_histogram_in_tiles(spark, monkeypatch):
    x = np.r_[np.full(300, 7.5), np.random.RandomState(3).randn(200) * 10]
    a = NdArray(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(500, None)], "i0 bigint, v double"), (501,))
    for order in (0.0, 0.1, 0.37, 0.5, 1.0):
        assert np.isclose(red.quantile(a, order).first()["v"], np.quantile(x, order))
    assert np.isclose(red.median(a, 0, True).first()["v"], 7.5) and red.median(a, 0, True).columns == ["i0", "v"]
    empty = NdArray(a.df.where("false"), (0,))
    assert red.median(empty).collect()[0]["v"] is None
    ints = spark.createDataFrame([(k, k % 50) for k in range(400)], "i0 bigint, v int")
    assert red.quantile(NdArray(ints, (400,)), 0.5).first()["v"] == 24
    monkeypatch.setattr(red, "TILE", 7)
    got = [r["v"] for r in red.histr(ints, F.col("v") + 3).orderBy("i0").collect()]
    assert np.allclose(got, np.cumsum(np.bincount(np.arange(400) % 50 + 3)) / 400)
    assert red.histr(ints.where("false"), F.col("v")).collect() == []


def test_outer_in_rows(spark, monkeypatch):
    x, y = np.arange(1.0, 12), np.arange(3.0, 20)
    a, b = (NdArray(spark.createDataFrame([(k, float(v)) for k, v in enumerate(z)], "i0 bigint, v double"), (len(z),)) for z in (x, y))
    assert np.array_equal(red.outer(a, b).numpy(), np.outer(x, y))
    monkeypatch.setattr(red, "OUTER_CELLS", 5)
    assert red.outer(a, b).df.count() == len(x) * len(y) and np.array_equal(red.outer(a, b).numpy(), np.outer(x, y))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_antilaplace_holds_lines_not_planes(spark, small_tiles):
    x = np.random.RandomState(3).rand(23, 6)
    a = NdArray.of(spark, x)
    small_batches(spark, 5)
    try:
        out = im.antilaplace2d(im.laplace2d(a))
        assert "SinglePartition" not in plan(out.df)
        assert out.df.rdd.getNumPartitions() == -(-x.size // 8)
        assert np.allclose(out.numpy(), x - x.mean(), atol=1e-8)
        gaps = NdArray(a.df.where("i0 != 4 and not (i0 = 2 and i1 = 3)"), a.dims)
        full = NdArray(a.df.withColumn("v", F.expr("case when i0 = 4 or (i0 = 2 and i1 = 3) then 0 else v end")), a.dims)
        assert np.allclose(im.antilaplace2d(gaps).numpy(), im.antilaplace2d(full).numpy())
    finally:
        small_batches(spark, 10_000)


def test_lines_are_read_in_batches(spark, small_tiles):
    x = np.random.RandomState(4).rand(11, 6, 3)
    a = NdArray.of(spark, x)
    small_batches(spark, 7)
    try:
        for axis in range(3):
            f = sp.fft(a, axis)
            assert "FlatMapGroups" not in plan(f.df) and f.df.rdd.getNumPartitions() == -(-x.size // 8)
            assert np.allclose(f.numpy(), np.apply_along_axis(sp.fft_real, axis, x))
            assert np.allclose(sp.fftb(f, axis).numpy(), x)
        ragged = NdArray(a.df.where("i2 = 0 and i1 < 2 + i0 % 3").select(F.when(F.col("i0") != 5, F.col("i0")).alias("i0"), "i1", F.when(F.col("i0") != 7, F.col("v")).alias("v")), (11, 6))
        got = {r[0]: r[1] for r in nd.along_axis(ragged, 1, lambda v: [v.sum()], 1).df.select("i0", "v").collect()}
        assert got.keys() == {None, *range(11)} - {5} and got.pop(7) is None
        assert all(v == pytest.approx(x[5 if k is None else k, : 2 + (5 if k is None else k) % 3, 0].sum()) for k, v in got.items())
    finally:
        small_batches(spark, 10_000)


def test_shift3_holds_patches_not_planes(spark, small_tiles):
    x = np.random.RandomState(5).rand(13, 7)
    a = NdArray.of(spark, x)
    for d in ((0.5, -0.25), (-4.0, 3.75), (40.0, -1e3)):
        grid = [g - s for g, s in zip(np.indices(x.shape), d)]
        out = im.shift3(a, *d)
        assert "hashpartitioning(__p0" in plan(out.df)
        assert (out.numpy() == im._sample(x, *grid, 3)).all() and out.df.count() == x.size
    gaps = NdArray(a.df.where("i0 < 1 or i0 > 9"), a.dims)
    y = np.where((np.arange(13) < 1) | (np.arange(13) > 9), 1, 0)[:, None] * x
    assert (im.shift3(gaps, 0.5, -0.25).numpy() == im._sample(y, np.indices(x.shape)[0] - 0.5, np.indices(x.shape)[1] + 0.25, 3)).all()
    assert im.shift3(gaps, 0.5, -0.25).df.count() == x.size


def classes(pairs):
    root = {n: n for p in pairs for n in p}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for p, q in pairs:
        p, q = sorted((top(p), top(q)))
        root[q] = p
    return {n: top(n) for n in root}


@pytest.mark.parametrize("most", [4, 40, 400])
def test_equivalence_of_parts(spark, monkeypatch, most):
    monkeypatch.setattr(red, "PAIRS", most)
    monkeypatch.setattr(red, "BROADCAST_ROOTS", most // 8)
    rng = np.random.RandomState(6)
    pairs = [(int(p), int(q)) for p, q in rng.randint(0, 200, (150, 2))] + [(300 + k, 301 + k) for k in range(40)] + [(400, 400), (500, 450), (500, 451), (500, 449), (500, 450)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*map(lambda p: (int(p[0]), int(p[1])), pairs), (600, None), (None, 601)], "a int, b bigint").repartition(5)
    got = red.equivalence(df)
    assert got.dtypes == [("node", "bigint"), ("root", "bigint")]
    rows = list(map(tuple, got.collect()))
    assert dict(rows) == classes([tuple(p) for p in pairs]) and len(rows) == len(dict(rows))


def test_equivalence_of_pairs_that_lie_together_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(red, "PAIRS", 100)
    monkeypatch.setattr(red, "_rounds", None)
    pairs = [(k // 20 * 1000 + k % 3, k // 20 * 1000 + k % 20) for k in range(4000)]
    assert dict(map(tuple, red.equivalence(spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(3)).collect())) == classes(pairs)
    assert not red.equivalence(spark.createDataFrame([], "a bigint, b bigint")).count()
