"""Raw file arrays, vectors and merged lookups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import vectors as v
from lattica.ndarray import NdArray
from lattica.operators import elementwise as el
from lattica.sources import rawarrays


@pytest.mark.parametrize("dtype", ["uint8", "int16", "int32", "int64", "float32", "float64", "complex64"])
def test_file_array_of_a_raw_file(spark, tmp_path, dtype):
    a = (np.arange(60) % 100).astype(rawarrays.TYPES[dtype])
    (tmp_path / "a.raw").write_bytes(b"\0" * (5 * a.itemsize) + a.tobytes())
    got = rawarrays.file_array(spark, str(tmp_path / "a.raw"), dtype, (4, 15), 5 * a.itemsize)
    cells = {(r["i0"], r["i1"]): r["v"] for r in got.df.collect()}
    assert len(cells) == 60
    for i, j in np.ndindex(4, 15):
        x = cells[i, j]
        assert (complex(x["re"], x["im"]) if dtype.startswith("complex") else x) == a[i + 4 * j]
    with pytest.raises(ValueError):
        rawarrays.file_array(spark, str(tmp_path / "a.raw"), "float64", (4,), 3)


def test_written_array_is_read(spark):
    x = np.random.RandomState(1).randn(70, 90)
    path = rawarrays.scratch(spark)
    rawarrays.write_array(NdArray.of(spark, x), path)
    assert np.array_equal(rawarrays.dblfarr(spark, path, (70, 90)).numpy(), x)


def test_rotations_undo_each_other(spark):
    p, r = v.vec(1, 2, 3), v.ry(F.lit(0.3), v.turn_x(F.lit(1.1)))
    row = spark.range(1).select(v.trxp(r, v.rxp(r, p)).alias("x"), v.rxr(v.tr(r), r).alias("i"), v.pn(v.zp()).alias("z")).first()
    assert row["x"] == pytest.approx([1, 2, 3]) and np.allclose(row["i"], np.eye(3)) and row["z"] == [0, 0, 0]


def test_floor_division_of_large_whole_numbers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(a, b) for a in (big, -big, 7, -7) for b in (2, -2, 3)], "a bigint, b bigint")
    for r in df.select("a", "b", el.fmod(F.col("a"), F.col("b")).alias("m")).collect():
        assert r["m"] == r["a"] % r["b"]
