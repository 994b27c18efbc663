"""Registered queries against their SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lattica import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, duck, name):
    a, b = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if pd.api.types.is_numeric_dtype(a[c]):
            assert (a[c].astype(float) - b[c].astype(float)).abs().max() <= 2e-3 or len(a) == 0, c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Embeddings, suppliers and events with more rows and keys than the ranges of the SQL."""
    d = tmp_path_factory.mktemp("whole")
    x = np.random.RandomState(7).randn(230, 64)
    pd.DataFrame({"vec_id": range(230), "embedding": list(x)}).to_parquet(d / "embeddings.parquet")
    pd.DataFrame({"s_suppkey": range(1, 81)}).to_parquet(d / "supplier.parquet")
    pd.DataFrame({"event_id": range(600), "user_id": [k * 7 % 300 for k in range(600)], "value": [0.5 * k for k in range(600)]}).to_parquet(d / "events.parquet")
    return str(d), x


def image(df):
    return df.toPandas().pivot(index="i0", columns="i1", values="v").to_numpy(float)


def test_queries_over_whole_arrays(spark, tables):
    d, x = tables
    power = np.abs(np.fft.rfft(x, axis=1) / 64) ** 2 * np.r_[1, np.full(32, 2.0)]
    assert np.allclose(image(q.QUERIES["power_spectrum_whole"](spark, d)), power, atol=2e-6)
    assert np.allclose(image(q.QUERIES["poisson_solved_whole"](spark, d)), x - x.mean(), atol=2e-4)
    assert q.QUERIES["shifted_image"](spark, d).count() == x.size
    n = Counter(k * 7 % 300 for k in range(600))
    assert dict(map(tuple, q.QUERIES["multisieved_whole"](spark, d).collect())) == {k: n[k] for k in range(1, 81) if n[k]}
    low = image(q.QUERIES["basins"](spark, d)).astype(int)
    pad = np.pad(x, 1, constant_values=np.inf)
    assert low.shape == x.shape
    for i, j in np.ndindex(x.shape):
        a, b = i, j
        while True:
            near = pad[a : a + 3, b : b + 3]
            da, db = np.unravel_index(near.argmin(), (3, 3))
            if (da, db) == (1, 1):
                break
            a, b = a + da - 1, b + db - 1
        assert low[i, j] == a + b * len(x)


def test_distr_has_a_bin_for_every_user(spark, tables):
    want = [sum(0.5 * k for k in range(600) if k * 7 % 300 == b) for b in range(300)]
    assert [v for _, v in sorted(map(tuple, q.QUERIES["distr_value"](spark, tables[0]).collect()))] == pytest.approx(want)


def test_equivalence_classes_over_whole_keys(spark, tmp_path):
    order, part = [k // 3 for k in range(900)], [(k // 3) // 40 * 50 + k % 7 for k in range(900)]
    pd.DataFrame({"l_orderkey": order, "l_partkey": part}).to_parquet(tmp_path / "lineitem.parquet")
    root = {n: n for o, p in zip(order, part) for n in (2 * o, 2 * p + 1)}
    while True:
        old = dict(root)
        for o, p in zip(order, part):
            root[2 * o] = root[2 * p + 1] = min(root[2 * o], root[2 * p + 1])
        if old == root:
            break
    assert dict(map(tuple, q.QUERIES["equivalence_classes_whole"](spark, str(tmp_path)).collect())) == root
