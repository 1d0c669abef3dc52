from datetime import date, datetime, timedelta

import numpy as np
import pytest

from orrery.operators import statistics as st
from orrery.plans import propagation
from orrery.plans.tests_of_relations import QUERIES


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Eight symbols over 240 sessions, of which S1 follows S0 by 3 sessions, S2 follows S1 by 10, and the others nothing."""
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.01, (240, 8))
    r[3:, 1] = r[:-3, 0] + rng.normal(0, 0.001, 237)
    r[10:, 2] = r[:-10, 1] + rng.normal(0, 0.001, 230)
    close = 100 * np.cumprod(1 + r, axis=0)
    day = [date(2024, 1, 1) + timedelta(days=i) for i in range(240)]
    out = tmp_path_factory.mktemp("market")
    spark.createDataFrame([(f"S{k}", day[i], float(close[i, k])) for i in range(240) for k in range(8)], "symbol string, date date, close double").write.parquet(str(out / "bar.parquet"))
    return str(out)


def test_every_lag_is_held_against_shuffled_sessions(spark, market):
    got = {r.lag: r for r in QUERIES["e8_lag_matrix"](spark, market, top=1).collect()}
    assert sorted(got) == [1, 2, 3, 5, 10] and all(r.n == 1 for r in got.values())
    assert got[3].mean_second > 0.9 and got[10].mean_second > 0.9 and got[3].n_agree == got[10].n_agree == 1 and got[3].p == 0.5
    many = {r.lag: r for r in QUERIES["e8_lag_matrix"](spark, market).collect()}
    assert {r.n for r in many.values()} == {56} and not any(r.holds for r in many.values())


def test_chains_of_two_different_lags_are_held_against_random_pairs(spark, tmp_path):
    rng = np.random.default_rng(6)
    r = rng.normal(0, 0.01, (240, 12))
    r[1:, 1] = r[:-1, 0] + rng.normal(0, 0.001, 239)
    r[2:, 2] = r[:-2, 1] + rng.normal(0, 0.001, 238)
    close = 100 * np.cumprod(1 + r, axis=0)
    spark.createDataFrame([(f"S{k}", date(2024, 1, 1) + timedelta(days=i), float(close[i, k])) for i in range(240) for k in range(12)], "symbol string, date date, close double").write.parquet(str(tmp_path / "bar.parquet"))
    got = {r.kind: r for r in propagation.QUERIES["e9_lag_chains"](spark, str(tmp_path), top=1).collect()}
    assert got["chain"].n == got["chain"].n_agree == got["random"].n == 1 and got["chain"].mean_second > 0.9 and got["chain"].p == 0.5
    wide = {r.kind: r for r in propagation.QUERIES["e9_lag_chains"](spark, str(tmp_path)).collect()}
    assert wide["chain"].n == wide["random"].n == 12 * 11 * 10 and wide["chain"].mean_second < 0.2


def test_moves_of_three_sessions_over_sixty(spark, tmp_path):
    """S0 moves in three small steps, none of them a shock of its own, after 62 and more quiet sessions."""
    r = np.where(np.arange(120)[:, None] % 2, 0.01, -0.01) * np.array([1, 1, -1, -1])
    r[81:84, 0] = 0.015
    close = 100 * np.cumprod(1 + r, axis=0)
    spark.createDataFrame([(f"S{k}", date(2024, 1, 1) + timedelta(days=i), float(close[i, k])) for i in range(120) for k in range(4)], "symbol string, date date, close double").write.parquet(str(tmp_path / "bar.parquet"))
    edges = [(k, f"S{k}", "S0", "20", date(2023, 1, 1), "manual", "", datetime(2023, 1, 2)) for k in (1, 2)]
    spark.createDataFrame(edges, "edge_id long, supplier string, customer string, pct_revenue string, filing_date date, confidence string, passage string, ingested_at timestamp").write.parquet(str(tmp_path / "supply_edge.parquet"))
    got = [(x.symbol, x.i) for x in propagation.moves_after(spark, str(tmp_path)).collect()]
    assert got == [("S0", 83)]
    assert "S0" not in {x.symbol for x in propagation.shocks_after(spark, str(tmp_path)).where("i BETWEEN 81 AND 83").collect()}
    assert {(x.hop, x.h, x.n) for x in propagation.QUERIES["e10_hop_horizons"](spark, str(tmp_path)).collect()} == {(1, h, 2) for h in (1, 2, 3, 5, 10)}


def test_binomial_greater():
    assert st.binomial_greater(0, 5) == 1 and st.binomial_greater(5, 5) == 1 / 32 and st.binomial_greater(3, 4) == 5 / 16 and st.binomial_greater(0, 0) == 1
