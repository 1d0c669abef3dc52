"""Queries of all pairs: as their SQL has them, and without shuffling pairs x sessions."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pytest

from compare import rows
from orrery.operators.comovement import _exact, _pairwise, latest_blocked
from orrery.operators.graphs import latest_snapshot
from orrery.plans import propagation, relations


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """300 symbols over 140 sessions with gaps, late starts, repeated rows and prices that stand still; S1 and S2 follow S0."""
    rng = np.random.default_rng(7)
    n, m = 140, 300
    r = rng.normal(0, 0.01, (n, m)) + rng.normal(0, 0.004, (n, 1))
    r[1:, 1] = r[:-1, 0] + rng.normal(0, 0.001, n - 1)
    r[1:, 2] = r[:-1, 1] + rng.normal(0, 0.001, n - 1)
    r[:, 3], r[:, 4] = 0.0, r[:, 5]
    close = 100 * np.cumprod(1 + r, axis=0)
    there = rng.random((n, m)) < 0.95
    there[:120, 10:14] = there[:134, 14:18] = False
    day = [date(2024, 5, 6) + timedelta(days=i) for i in range(n)]
    bars = [(f"S{k}", day[i], float(close[i, k]) if (i * m + k) % 97 else None) for i in range(n) for k in range(m) if there[i, k]] + [("s7 ", day[9], 90.0)]
    out = tmp_path_factory.mktemp("pairs")
    spark.createDataFrame(bars, "symbol string, date date, close double").write.parquet(str(out / "bar.parquet"))
    return str(out), len(bars)


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    all_ = sc.statusStore().executorList(False)
    return sum(all_.apply(k).totalShuffleWrite() for k in range(all_.size()))


def compared(spark, market, module, name):
    """Bytes shuffled per bar by a query, of which the result equals its SQL's."""
    root, n = market
    db = duckdb.connect()
    rest = ", ".join(f"NULL::DOUBLE AS {c}" for c in "timestamp open high low volume trade_count dollar_vol ingested_at".split())
    db.execute(f"CREATE VIEW bar AS SELECT symbol, date, close, {rest} FROM '{root}/bar.parquet/*.parquet'")
    cur = db.execute(module.ORACLE[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    before = shuffled(spark)
    got = module.QUERIES[name](spark, root)
    found = rows(got.columns, got.collect())
    assert found == rows(names, want) and want and want[0][0]
    return (shuffled(spark) - before) / n


def test_chains_shuffle_series_and_not_pairs(spark, market):
    assert compared(spark, market, propagation, "e9_chains") < 150


def test_snapshots_shuffle_series_and_not_pairs(spark, market):
    assert compared(spark, market, relations, "g3_snapshot") < 100


def test_latest_snapshots_of_blocks_equal_those_of_all_pairs(spark):
    """Symbols that have their last edge in an earlier snapshot, far or near, keep all edges of it and no others."""
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, (60, 40))
    r[:20, 1], r[20:40, 3], r[40:, 5] = r[:20, 0], -r[20:40, 2], r[40:, 4]
    r[20:, :2] = r[40:, 2] = np.nan
    r[rng.random(r.shape) < 0.2] = np.nan
    data = [(f"S{k:02d}", 7 + i, None if np.isnan(v) else float(v)) for (i, k), v in np.ndenumerate(r)]
    w = spark.createDataFrame(data, "symbol string, i int, r double")
    days = [date(2024, m, 1) for m in (1, 2, 3)]
    parts = [(d, 7 + 20 * n, 27 + 20 * n) for n, d in enumerate(days)]
    every = []
    for d, lo, hi in parts:
        c = _pairwise(r[lo - 7 : hi - 7].T, r[lo - 7 : hi - 7].T)
        every += [(f"S{a:02d}", f"S{b:02d}", float(c[a, b]), d) for a in range(40) for b in range(a + 1, 40) if abs(c[a, b]) >= 0.55]
    asked = spark.createDataFrame([(f"S{k:02d}", days[-1]) for k in range(40)], "symbol string, day date")
    key = lambda e: sorted((x.symbol, x.as_of, x.other, round(x["corr"], 9)) for x in latest_snapshot(e, asked).collect())
    want = key(spark.createDataFrame(every, "a string, b string, corr double, as_of date"))
    assert {x[1] for x in want} == set(days)
    for block in (512, 6):
        got = latest_blocked(w, parts, first=7, width=60, least=0.55, block=block)
        assert key(got) == want and got.count() < len(every)


def test_pairs_that_vary_little_in_common_keep_their_digits():
    x = np.array([[9e5, 0.01, 0.0100001, 0.0099999, 0.01], [np.nan, 0.02, 0.0200003, 0.0199996, 0.02], [0.1, 0.1, 0.1, np.nan, 0.1]])
    c = _pairwise(x, x)
    want = np.corrcoef(x[0, 1:] - 0.01, x[1, 1:] - 0.02)[0, 1]
    assert abs(c[0, 1] - want) < 1e-9 and abs(c[1, 0] - want) < 1e-9 and np.isnan(c[2]).all() and abs(_exact(x[:1], x[1:2])[0] - want) < 1e-9
