"""Functions, sources and the session."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import astronomy as astro
from lattica.functions import dates, sofa, special
from lattica.functions import random as rnd
from lattica.functions import strings as st
from lattica.ndarray import NdArray
from lattica.plans.session import Workspace
from lattica.sources import files, fits, fz


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_special_functions():
    assert special.bessel_j(0, 1.0) == pytest.approx(0.7651976865579666) and special.bessel_j(3, 10.0) == pytest.approx(0.05837937930518675)
    assert special.bessel_y(0, np.array(1.0)) == pytest.approx(0.08825696421567698, abs=1e-9)
    assert special.bessel_y(1, np.array(2.0)) == pytest.approx(-0.1070324315409375, abs=1e-8)
    assert special.bessel_i(0, 1.0) == pytest.approx(1.2660658777520082) and special.bessel_k(0, 1.0) == pytest.approx(0.42102443824070834, rel=1e-6)
    assert special.gamma(np.array([0.5, 5.0, -0.5])) == pytest.approx([math.sqrt(math.pi), 24, -2 * math.sqrt(math.pi)])
    assert special.chi2(3.841458820694124, 1) == pytest.approx(0.95) and special.student(2.015048372669157, 5) == pytest.approx(0.95)
    assert special.fratio(4.0, 2, 10) == pytest.approx(1 - (1 + 2 * 4 / 10) ** -5) and special.ibeta(0.5, 2, 2) == pytest.approx(0.5)
    assert special.ncchi2(4.0, 3, 0.0) == pytest.approx(float(special.chi2(4.0, 3)))
    assert special.voigt(1e-3, 0.0) == pytest.approx(math.exp(1e-6) * math.erfc(1e-3), rel=1e-6)
    assert special.legendre(2, 0.5) == pytest.approx(-0.125) and special.next235(7) == 8


def test_special_column(spark):
    df = spark.range(5).select(special.column(special.erf, F.col("id") / 2).alias("v"), F.col("id"))
    assert {r["id"]: r["v"] for r in df.collect()} == pytest.approx({k: math.erf(k / 2) for k in range(5)})


def test_strings(spark):
    s = F.lit("hello, world ")
    assert one(spark, st.strpos(s, "o")) == 4 and one(spark, st.strpos(s, "o", 5)) == 8 and one(spark, st.strpos(s, "z")) == -1
    assert one(spark, st.strcount(s, "l")) == 3 and one(spark, st.strtrim(s)) == "hello, world" and one(spark, st.strloc(s, "wor")) == "world "
    assert one(spark, st.strskp(s, ", ")) == "world " and one(spark, st.strpbrk(s, "wx")) == "world " and one(spark, st.skipc(s, "he")) == "llo, world "
    assert one(spark, st.strreplace(s, "l", "L", 2)) == "heLLo, world " and one(spark, st.strtok(s, ", ")) == ["hello", "world"]
    assert one(spark, st.regex(s, "(w)(o)")) == ["wo", "w", "o"] and one(spark, st.regex(s, "q")) is None
    assert one(spark, st.strtol(F.lit(" -ff"), 16)) == -255 and one(spark, st.istring(F.lit(42), 5, True)) == "00042"
    assert tuple(one(spark, st.sscanf(F.lit("a 12 3.5"), "%s %d %f"))) == ("a", 12, 3.5)


def test_calendars(spark):
    d = lambda *x: map(F.lit, x)
    assert one(spark, dates.common_to_jdn(*d(1582, 10, 15))) == 2299161 == one(spark, dates.common_to_jdn(*d(1582, 10, 4))) + 1
    for f, g in ((dates.gregorian_to_jdn, dates.jdn_to_gregorian), (dates.julian_to_jdn, dates.jdn_to_julian), (dates.islamic_to_jdn, dates.jdn_to_islamic), (dates.egyptian_to_jdn, dates.jdn_to_egyptian)):
        df = spark.range(2400000, 2403000, 7).select("id", g(F.col("id")).alias("g"))
        assert df.where(f(F.col("g.year"), F.col("g.month"), F.col("g.day")) != F.col("id")).count() == 0
    assert one(spark, dates.islamic_to_jdn(*d(1, 1, 1))) == 1948440 and dates.hebrew_to_jdn(5784, 7, 1) == 2460204 and dates.hebrew_to_jdn(5785, 7, 1) == 2460587
    assert tuple(one(spark, dates.jdn_to_mayan(F.lit(2456283)))) == (13, 0, 0, 0, 0) and one(spark, dates.mayan_to_jdn(*d(13, 0, 0, 0, 0))) == 2456283
    assert dates.latin_date(2023, 3, 15) == "Idibus Martias" and dates.latin_date(2023, 3, 14) == "pridie Idus Martias" and dates.latin_date(2023, 1, 30) == "a.d. III Kalendas Februarias"
    assert tuple(one(spark, dates.easter(F.lit(2024)))) == (3, 31)
    assert one(spark, dates.jd(F.lit("2000-01-01 12:00:00").cast("timestamp"))) == 2451545.0
    assert one(spark, dates.leap_seconds(F.lit("2020-01-01").cast("timestamp"))) == 37


def test_astronomy(spark):
    df = spark.createDataFrame([(float(m),) for m in np.linspace(-6, 6, 25)], "m double")
    for e in (0.0, 0.5, 0.97):
        got = astro.kepler(df, "m", e, "x", "eccentric", 10).collect()
        assert all(abs(math.remainder(r["x"] - e * math.sin(r["x"]) - r["m"], 2 * math.pi)) < 1e-9 for r in got)
    r = np.linalg.norm(astro.planet("earth", np.array([2451545.0])), axis=0)
    assert r[0] == pytest.approx(0.9833, abs=1e-3)
    s = one(spark, astro.solar_disk(F.lit(2448908.5)))
    assert (s["p"], s["b"], s["l"]) == pytest.approx((26.27, 5.99, 238.63), abs=0.03)
    assert one(spark, astro.sidereal_time(F.lit(2446895.5))) == pytest.approx(math.radians(197.693195), abs=1e-6)
    p = [2, 0, 3, 1]
    assert astro.permutation(4, astro.permutation_number(p)) == p and astro.permutation_distance([0, 1, 2], [2, 1, 0]) == 3


def test_standards():
    assert sofa.cal2jd(2003, 6, 1) == (2400000.5, 52791.0) and sofa.jd2cal(2400000.5, 50123.9999)[:3] == (1996, 2, 10)
    assert sofa.era00(2400000.5, 54388.0) == pytest.approx(0.4022837240028158, abs=1e-10)
    assert sofa.gmst06(2400000.5, 53736.0, 2400000.5, 53736.0) == pytest.approx(1.754174971870091, abs=1e-9)
    assert sofa.gmst82(2400000.5, 53736.0) == pytest.approx(1.754174981860675, abs=1e-9)
    assert sofa.obl06(2400000.5, 54388.0) == pytest.approx(0.4090749229387258, abs=1e-12)
    assert sofa.obl80(2400000.5, 54388.0) == pytest.approx(0.4090751347643816, abs=1e-12)
    assert sofa.dat(2017, 9, 1) == 37 and sofa.dat(2003, 6, 1) == 32
    assert sofa.fundamental("l", 0.8) == pytest.approx(5.132369751108684, abs=1e-9)
    assert sofa.gc2gd(1, sofa.gd2gc(1, 3.1, -0.5, 2500.0)) == pytest.approx((3.1, -0.5, 2500.0), abs=1e-6)
    assert sofa.gd2gc(1, 3.1, -0.5, 2500.0) == pytest.approx((-5599000.5577049947, 233011.67223479203, -3040909.4706983363), abs=1e-3)
    v = np.array([0.1, -0.4, 0.7])
    assert np.allclose(sofa.rm2v(sofa.rv2m(v)), v)
    p, d = sofa.s2pv(-3.21, 0.123, 0.456, -7.8e-6, 9.01e-6, -1.23e-5)
    assert np.allclose(sofa.pv2s(p, d), (-3.21 + 2 * math.pi, 0.123, 0.456, -7.8e-6, 9.01e-6, -1.23e-5))
    a, b = sofa.utctai(2453750.5, 0.892100694)
    assert b == pytest.approx(0.8924826384444444) and sofa.taiutc(a, b)[1] == pytest.approx(0.892100694)
    assert sofa.tcgtt(*sofa.tttcg(2453750.5, 0.892482639))[1] == pytest.approx(0.892482639, abs=1e-12)
    assert np.allclose(sofa.pmat06(2400000.5, 50123.9999) @ sofa.pmat06(2400000.5, 50123.9999).T, np.eye(3))


def test_standards_with_nutation():
    """Published values, within the accuracy of the leading terms."""
    assert sofa.nut80(2400000.5, 53736.0) == pytest.approx((-0.9643658353226563658e-5, 0.4060051006879713322e-4), abs=5e-8)
    assert sofa.gst94(2400000.5, 53736.0) == pytest.approx(1.754166136020645203, abs=5e-8)
    assert sofa.pb06(2400000.5, 50123.9999) == pytest.approx((-0.5092634016326478238e-3, -0.3602772060566044413e-3, -0.3779735537167811177e-3), abs=1e-9)
    assert sofa.xys06a(2400000.5, 53736.0) == pytest.approx((0.5791308482835292617e-3, 0.4020580099454020310e-4, -0.1220032294164579896e-7), abs=1e-7)
    assert sofa.eo06a(2400000.5, 53736.0) == pytest.approx(-0.1332882371941833644e-2, abs=1e-7)
    assert sofa.dtdb(2448939.5, 0.123) == pytest.approx(-0.1280368005936998991e-2, abs=1e-5)
    assert np.allclose(sofa.pnm06a(2400000.5, 50123.9999)[0], (0.9999995832794205484, 0.8372382772630962111e-3, 0.3639684771140623099e-3), atol=1e-7)
    assert sofa.c2t06a(2400000.5, 53736.0, 2400000.5, 53736.0, 2.55060238e-7, 1.860359247e-6)[0] == pytest.approx((-0.1810332128305897282, 0.9834769806938592296, 0.6555550962998436505e-4), abs=1e-7)
    assert sofa.prec76(2400000.5, 33282.0, 2400000.5, 51544.0)[0] == pytest.approx(0.5588961642000161243e-2, abs=1e-14)
    star = (1.0, 0.5, 1e-5, -2e-5, 0.3, 20.0)
    assert sofa.pvstar(*sofa.starpv(*star)) == pytest.approx(star)


def test_surface_curve():
    from lattica.operators.directions import curve_to_polar, polar_to_curve, project_map

    for lon, lat in ((0.3, 0.2), (2.5, -1.1), (-2.0, 0.7)):
        got = curve_to_polar(float(polar_to_curve(np.array(lon), np.array(lat))))
        assert got == pytest.approx((lon, lat), abs=1e-4)
    assert np.isnan(project_map(np.ones((8, 5)), np.inf, 0.0, 9)[0, 0]) and project_map(np.ones((8, 5)), np.inf, 0.0, 9)[4, 4] == pytest.approx(1.0)


def test_random_is_repeatable(spark):
    a, b = rnd.randomu(spark, 7, 2000).numpy(), rnd.randomu(spark, 7, 2000).numpy()
    assert (a == b).all() and abs(a.mean() - 0.5) < 0.03 and len(set(a)) == 2000
    n = rnd.randomn(spark, 7, 4000).numpy()
    assert abs(n.mean()) < 0.06 and abs(n.std() - 1) < 0.05
    x = NdArray.of(spark, np.arange(100))
    assert sorted(rnd.shuffled(x, 3).numpy()) == list(range(100))


def test_array_files(spark, tmp_path):
    a = np.arange(24, dtype=np.int32).reshape(2, 3, 4) ** 2
    for coded in (False, True):
        (tmp_path / "a.fz").write_bytes(fz.pack(a, "head " * 100, coded))
        assert np.array_equal(fz.unpack((tmp_path / "a.fz").read_bytes())[0], a)
        assert np.array_equal(fz.load(spark, str(tmp_path / "a.fz")).numpy(), a)
    assert fz.heads(spark, str(tmp_path)).first()["dims"] == [2, 3, 4]
    assert files.file_types(spark, str(tmp_path)).first()["type"] == "array"
    (tmp_path / "b.fits").write_bytes(fits.pack(a.astype(np.int16), {"OBJECT": "it's", "BZERO": 1.0}))
    got, head = fits.unpack((tmp_path / "b.fits").read_bytes())
    assert np.allclose(got, a.astype(np.int16) + 1) and head["OBJECT"] == "it's"
    assert fits.read(spark, str(tmp_path / "b.fits")).count() == 24
    assert np.array_equal(files.unpack_pnm(files.pack_pnm(a[0].astype(np.uint8))), a[0].astype(np.uint8))


def test_text_and_stores(spark, tmp_path):
    (tmp_path / "n.txt").write_text("1 2.5\n3, x 4\n")
    assert sorted(r["v"] for r in files.read_numbers(spark, str(tmp_path / "n.txt")).collect()) == [1, 2.5, 3, 4]
    (tmp_path / "f.txt").write_text("a 1 2.5\nbad\n")
    assert {tuple(r) for r in files.read_format(spark, str(tmp_path / "f.txt"), "%s %d %f").collect()} == {("a", 1, 2.5), (None, None, None)}
    a = NdArray.of(spark, np.arange(6.0).reshape(2, 3))
    files.store({"a": a}, str(tmp_path / "s"))
    assert np.array_equal(files.restore(spark, str(tmp_path / "s"))["a"].numpy(), a.numpy())


def test_workspace(spark):
    w = Workspace(spark)
    w.set("x", NdArray.of(spark, [1.0, 2.0, 3.0]))
    w.default("x", 5)
    assert w.eval("1 + 2") == 3 and w.execute("select sum(v) as s from x").first()["s"] == 6.0
    assert w.on_cells("x", "v * 2 + i0").numpy().tolist() == [2.0, 5.0, 8.0]
    w.push("x")
    w.set("x", 4)
    w.pop()
    assert isinstance(w.get("x"), NdArray) and w.describe()[0][1] == "array"
    w.define("twice", lambda v: 2.0 * float(v))
    assert w.execute("select twice(2.5) as t").first()["t"] == 5.0
    w.delete("x")
    assert not w.defined("x")


def test_tumbling_windows_on_a_stream(spark, tmp_path):
    from lattica.streaming.windows import tumbling

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", f"k{m % 2}", 1.5) for h in range(4) for m in range(0, 60, 10)]
    t = spark.createDataFrame(rows, "ts string, key string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    query = tumbling(stream, "ts", "key", "value").writeStream.outputMode("append").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got, want = ({tuple(r) for r in df.collect()} for df in (spark.table("tumbled"), tumbling(t, "ts", "key", "value")))
    assert got and got <= want
