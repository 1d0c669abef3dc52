from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.panel import closes, panel
from orrery.operators.perspectives import analyse, day_trade, quant


def test_quant_splits_the_window(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.01, 61)
    series = {"C": base, "STABLE": base + rng.normal(0, 1e-4, 61), "FLIP": np.where(np.arange(61) < 30, base, -base)}
    start = date(2024, 1, 1)
    rows = [(s, start + timedelta(i), float(v)) for s, r in series.items() for i, v in enumerate(100 * np.cumprod(1 + r))]
    p = panel(closes(spark.createDataFrame(rows, "symbol string, d date, c double"), symbol=F.col("symbol"), day=F.col("d"), price=F.col("c")))
    cands = spark.createDataFrame([(1, "C", 61)], "cid int, symbol string, tx int")
    edges = spark.createDataFrame([(1, "STABLE", 0.9), (1, "FLIP", 0.2)], "cid int, leader string, corr double")
    sic = spark.createDataFrame([("C", "3674"), ("STABLE", "3600"), ("FLIP", None)], "symbol string, sic string")
    pmi = spark.createDataFrame([("C", "FLIP", 1.2)], "a string, b string, pmi double")
    r = quant(cands, edges, p, trail=60, sic=sic, pmi=pmi, excluded=spark.createDataFrame([("C",)], "symbol string")).first()
    assert (r.n_edges, r.duplicate_count, r.split_half_sign_agree_pct, r.sector_match_pct, r.comention_weak, r.comention_strong, r.candidate_is_fund) == (2, 0, 50.0, 50.0, 0, 1, True)
    assert r.split_half_min_abs > 0.9
    bare = quant(cands, edges.limit(0), p).first()
    assert (bare.n_edges, bare.median_ci_width, bare.sector_match_pct, bare.comention_weak) == (0, None, None, None)


@pytest.mark.parametrize("kind, ratio", [("gap", 1.0), ("range", 0.0), ("flat", None)])
def test_gap_ratio(spark, kind, ratio):
    rows = []
    for i in range(11):
        c = 100.0 + (i % 3 if kind != "flat" else 0)
        span = 1.0 if kind == "range" else 0.0
        prior = 100.0 + ((i - 1) % 3 if kind != "flat" else 0)
        rows.append(("C", date(2024, 1, 1) + timedelta(i), i, prior if kind == "range" else c, c + span, c, c, 1e6 * (i + 1), 10 * i))
    bars = spark.createDataFrame(rows, "symbol string, d date, t int, open double, high double, low double, close double, dollar_vol double, trade_count long")
    cands = spark.createDataFrame([(1, "C", date(2024, 1, 11)), (2, "NONE", date(2024, 1, 11))], "cid int, symbol string, as_of date")
    got = {r.cid: r for r in day_trade(cands, bars, trail=5).collect()}
    assert (got[1].n_sessions, got[1].median_dollar_vol, got[1].median_trade_count) == (5, 8e6, 70.0)
    assert (got[1].gap_ratio is None) == (ratio is None) and (ratio is None or abs(got[1].gap_ratio - ratio) < 1e-9)
    assert (got[2].n_sessions, got[2].gap_ratio) == (0, None)


def test_analysts_are_capped_and_every_row_comes_back(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(6)], "cid int, good boolean")
    assert {r.status for r in analyse(df).collect()} == {"not_run"}
    out = analyse(df, F.when(F.col("good"), "fine"), rank=F.col("cid"), cap=3)
    assert {r.cid: r.status for r in out.collect()} == {5: "error", 4: "ok", 3: "error", 2: "not_run", 1: "not_run", 0: "not_run"}
