import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import statistics as st


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 400
    x1, x2, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 30, n)
    y = 0.5 * x1 - 0.2 * x2 + rng.normal(size=30)[g] * 0.3 + rng.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x1, x2, g, y))], "i int, x1 double, x2 double, g int, y double").cache()
    return df, x1, x2, g, y


def test_ols_and_clustered_errors(data):
    df, x1, x2, g, y = data
    x = np.stack((x1, x2, np.ones(len(y))), 1)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = y - x @ beta
    se = np.sqrt(np.diag(inv) * (u @ u) / (len(y) - 3))
    s = np.stack([(x[g == k] * u[g == k][:, None]).sum(0) for k in range(30)])
    cse = np.sqrt(np.diag(inv @ s.T @ s @ inv))
    for got, errors in ((st.ols(df, "y", ["x1", "x2"]), se), (st.ols(df, "y", ["x1", "x2"], "g"), cse)):
        assert all(abs(got[k][0] - b) < 1e-9 and abs(got[k][1] - e) < 1e-9 for k, b, e in zip(("x1", "x2", "const"), beta, errors))
    assert math.isnan(st.ols(df.limit(0), "y", ["x1"])["x1"][0])


def test_slope_pool_and_means(data):
    df, x1, _, g, y = data
    (r,) = st.slopes(df, "x1", "y").collect()
    b, se = st.ols(df, "y", ["x1"])["x1"]
    assert abs(r.slope - b) < 1e-9 and abs(r.se - se) < 1e-9
    p = st.pooled(df.sparkSession.createDataFrame([(1.0, 0.5), (3.0, 1.0), (9.0, 0.0)], "e double, s double"), "e", "s").first()
    assert (p.k, round(p.pooled, 9), round(p.q, 9)) == (2, 1.4, 3.2)
    m = st.clustered_mean(df, "y", "g").first()
    u = np.array([(y[g == k] - y.mean()).sum() for k in range(30)])
    assert abs(m["mean"] - y.mean()) < 1e-9 and abs(m.se - math.sqrt((u * u).sum()) / len(y)) < 1e-9
    ci = st.bootstrap_mean(df, "y", replicates=300).first()
    assert ci.lo < y.mean() < ci.hi and abs((ci.hi - ci.lo) / 3.92 - y.std() / 20) < 0.012


def test_ranks_and_auc(spark):
    rnd = random.Random(1)
    rows = [(i, float(rnd.randrange(30)), rnd.random() < 0.4) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s double, y boolean")
    want = {i: k for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert {r.i: r["rank"] for r in st.ranks(df, [F.col("s"), F.col("i")], buckets=8).collect()} == want
    pos = sum(y for *_, y in rows)
    r = st.auc(df, F.col("s"), F.col("y"), [F.col("i")]).first()
    assert abs(r.auc - (sum(want[i] for i, _, y in rows if y) - pos * (pos + 1) / 2) / (pos * (500 - pos))) < 1e-12
    assert st.auc(df.limit(0), F.col("s"), F.col("y"), [F.col("i")]).first().auc is None
    assert sum(r.n for r in st.deciles(df, "s", "y").collect()) == 500


def test_small_formulas(spark):
    assert st.sign_test(9, 10) == pytest.approx(22 / 1024) and st.sign_test(5, 10) == 1.0 and st.sign_test(0, 0) == 1.0
    z, mde = spark.range(1).select(*st.proportion_test(F.lit(100.0), F.lit(0.6), F.lit(100.0), F.lit(0.5))).first()
    assert z == pytest.approx(0.1 / math.sqrt(0.55 * 0.45 * 0.02)) and mde == pytest.approx(2.8 * math.sqrt(0.55 * 0.45 * 0.02))


def test_best_lag_and_controls(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=60)
    x = spark.createDataFrame([("k", i, float(a)) for i, a in enumerate(v)], "key string, t int, v double")
    y = spark.createDataFrame([("k", i + 3, float(a)) for i, a in enumerate(v)] + [("flat", i, 1.0) for i in range(60)], "key string, t int, v double")
    assert [(r.key, r.lag) for r in st.best_lag(x, y, list(range(-5, 6)), 20).collect()] == [("k", 3)]
    wanted = spark.createDataFrame([("d1", f"w{i}", float(i)) for i in range(3)], "day string, symbol string, size double")
    pool = spark.createDataFrame([("d1", f"p{i}", float(i)) for i in range(10)] + [("d1", "w0", 0.0)], "day string, symbol string, size double")
    got = st.matched_controls(wanted, pool, nearest=4).collect()
    assert len(got) == 3 == len({r.control for r in got}) and all(r.control.startswith("p") for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, st.matched_controls(wanted, pool, nearest=4).collect()))


def test_clustered_slopes_equal_the_regression(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(x), float(2 * x + rng.normal() + g), k) for k in (0, 1) for g in range(12) for x in rng.normal(size=7)]
    df = spark.createDataFrame(rows, "g int, x double, y double, k int")
    for k in (0, 1):
        want = st.ols(df.where(f"k = {k}"), "y", ["x"], "g")["x"]
        got = st.clustered_slopes(df, "x", "y", "g", ["k"]).where(f"k = {k}").first()
        assert got.n == 84 and abs(got.slope - want[0]) < 1e-9 and abs(got.se - want[1]) < 1e-9
    none = st.clustered_slopes(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, None, 1.0)], "g int, x double, y double"), "x", "y", "g").first()
    assert none.n == 2 and none.slope is None and none.se is None
    assert st.clustered_slopes(df.limit(0), "x", "y", "g").count() == 0
