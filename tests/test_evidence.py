from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import evidence as ev
from orrery.operators.comovement import edges, edges_blocked, lagged, lagged_blocked
from orrery.operators.panel import closes, panel, session_ends
from orrery.operators.shocks import scan
from orrery.sources.synthetic import universe

BARS = "symbol string, d date, c double"


def long(frame: pd.DataFrame):
    return [(s, d.date(), None if pd.isna(v) else float(v)) for s in frame for d, v in frame[s].items()]


def to_panel(spark, frame):
    prices = closes(spark.createDataFrame(long(frame), BARS), symbol=F.col("symbol"), day=F.col("d"), price=F.col("c"))
    return panel(prices).cache()


def market():
    frame, when = universe()
    return frame, {k: d for k, (d, _) in when.items()}


def test_golden_verdicts(spark):
    frame, when = market()
    p = to_panel(spark, frame)
    cands = spark.createDataFrame([(k, s, "down" if s == "SYNE" else "up", d, None) for k, (s, d) in enumerate(when.items())], "cid int, symbol string, direction string, as_of date, origin_leader string")
    out = ev.run(cands, p, spark.createDataFrame([], "symbol string"))
    got = [tuple(r)[3:] for r in ev.golden(cands, out["assessments"]).collect()]
    assert got == [
        ("corroborated", "2.000000", 16, 0),
        ("contradicted", "2.000000", 0, 20),
        ("neutral", "0.000000", 0, 0),
        ("neutral", "2.000000", 10, 10),
        ("corroborated", "2.000000", 20, 0),
        ("no_assessment", "0.000000", 0, 0),
    ]
    assert [r.error for r in out["placed"].where("symbol = 'SYNF'").collect()] == ["insufficient history"]
    # A batch gives what its parts give, and the same candidate both ways is judged each way.
    both = spark.createDataFrame([(1, "SYNA", "up", when["SYNA"], "SYNB"), (2, "SYNA", "down", when["SYNA"], None)], cands.schema)
    two = ev.run(both, p, cands.select("symbol"))
    assert {r.cid: r.verdict for r in two["assessments"].collect()} == {1: "corroborated", 2: "contradicted"}
    assert [r.description for r in two["descriptions"].collect()] == ["SYNA has moved " + two["descriptions"].first().description.split("moved ")[1]]
    assert ev.detail(two["evidence"], both).where("detail LIKE '%bloc of%'").count() == two["evidence"].count()
    assert ev.golden_diff(ev.golden(cands, out["assessments"]), ev.golden(cands, out["assessments"])).count() == 0


def series(n=90, gaps=True):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 0.01, n)
    cols = {f"S{k}": f * (k % 3) + rng.normal(0, 0.01, n) for k in range(9)}
    frame = 50 * (1 + pd.DataFrame(cols, index=pd.date_range("2024-01-01", periods=n, freq="B"))).cumprod()
    frame["DUP"], frame["FLAT"] = frame["S1"], 7.0
    frame.loc[frame.index[40], "S2"] *= 30
    if gaps:
        frame.loc[frame.index[20:23], "S4"] = np.nan
        frame.loc[frame.index[:70], "S5"] = np.nan
    return frame


def test_returns_are_on_the_grid(spark):
    frame = series()
    p = to_panel(spark, frame)
    want = frame.pct_change(fill_method=None)
    got = {(r.symbol, r.i): r.r for r in p.collect() if r.r is not None}
    assert got.keys() == {(s, i) for s in want for i in range(len(want)) if not np.isnan(want[s].iat[i])}
    assert all(abs(v - want[s].iat[i]) < 1e-12 for (s, i), v in got.items())
    days = spark.createDataFrame([(date(2024, 1, 7),), (date(2024, 1, 2),), (date(2023, 1, 1),), (date(2023, 1, 1),)], "as_of date")
    assert sorted(tuple(e) for e in session_ends(days, p).collect()) == [(date(2023, 1, 1), 0, 0, 90), (date(2024, 1, 2), 2, 1, 90), (date(2024, 1, 7), 5, 5, 90)]


@pytest.mark.parametrize("block", [None, 4, 100])
def test_comovement_equals_pandas(spark, block):
    frame, trail, ti = series(), 60, 80
    p = to_panel(spark, frame)
    window = p.where((F.col("i") >= ti - trail) & (F.col("i") < ti)).select("symbol", "i", "r")
    got = edges(window, trail=trail, min_abs_corr=0.2) if block is None else edges_blocked(window, first=ti - trail, trail=trail, min_abs_corr=0.2, block=block)
    r = frame.pct_change(fill_method=None).iloc[ti - trail : ti]
    ok = r.where(r.abs() <= 10)
    corr = ok.corr()
    names = sorted(frame.columns)
    want = {(a, b): (corr.loc[a, b], int((ok[a].notna() & ok[b].notna()).sum())) for i, a in enumerate(names) for b in names[i + 1 :] if abs(corr.loc[a, b]) >= 0.2}
    rows = {(e.a, e.b): e for e in got.collect()}
    assert rows.keys() == want.keys()
    assert all(abs(rows[k].corr - c) < 1e-9 and rows[k].n_sessions == n for k, (c, n) in want.items())
    assert {k for k, e in rows.items() if e.flag} == {("DUP", "S1")}
    assert all(e.ci_low <= e.corr + 1e-9 and e.corr <= e.ci_high + 1e-9 for e in rows.values())


@pytest.mark.parametrize("block", [3, 100])
def test_lagged_products_equal_the_join(spark, block):
    p = to_panel(spark, series())
    z = p.select("symbol", "i", F.coalesce("r", F.lit(0.0)).alias("z"))
    want = {(r.lag, r.x, r.y): r["corr"] for r in lagged(z, [1, 3]).collect() if abs(r["corr"]) >= 1e-5}
    got = {(r.lag, r.x, r.y): r["corr"] for r in lagged_blocked(z, [1, 3], first=0, width=90, least=1e-5, block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        edges(spark.createDataFrame([], "symbol string, i int, r double"), trail=10, min_abs_corr=float("nan"))


def test_scan_uses_a_disjoint_baseline(spark):
    frame = series(gaps=False)
    frame.loc[frame.index[80] :, "S3"] *= 1.5
    p = to_panel(spark, frame)
    day = frame.index[80].date()
    days = session_ends(spark.createDataFrame([(day,)], "as_of date"), p)
    got = {r.symbol: r.z for r in scan(p, days).collect()}
    r = frame["S3"].pct_change(fill_method=None)
    assert abs(got["S3"] - r.iloc[78:81].sum() / (r.iloc[18:78].std() * 3**0.5)) < 1e-9
    last = days.withColumn("ti", F.col("n"))
    assert scan(p, last).count() == 0
