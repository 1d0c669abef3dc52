"""A made-up market whose verdicts are known beforehand."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Sessions, first day, deviation of a day's returns, size of a shock, and seed (fixed values).
SESSIONS, FIRST, VOL, SHOCK, SEED = 100, "2026-01-05", 0.015, 0.10, 20260906
#: Each candidate with the session it is judged at, its direction, and which way its two blocs are shocked (fixed values).
CANDIDATES = {
    "SYNA": (80, "up", (1, 1)),
    "SYNB": (80, "up", (-1, -1)),
    "SYNC": (80, "up", (0, 0)),
    "SYND": (80, "up", (1, -1)),
    "SYNE": (80, "down", (-1, -1)),
    "SYNF": (30, "up", (0, 0)),
}


def universe() -> tuple[pd.DataFrame, dict[str, tuple[date, str]]]:
    """(closes, {candidate: (day, direction)}): six candidates with two blocs of ten symbols each that follow its factors, and 40 others.

    The draws' order is part of the recipe. A candidate itself doesn't move on its day.
    """
    rng = np.random.default_rng(SEED)
    days = pd.date_range(FIRST, periods=SESSIONS, freq="B")
    r: dict[str, np.ndarray] = {}
    for name in CANDIDATES:
        factors = [rng.normal(0, VOL, SESSIONS) for _ in "XY"]
        r[name] = 0.6 * factors[0] + 0.6 * factors[1] + rng.normal(0, VOL * 0.3, SESSIONS)
        for bloc, factor in zip("XY", factors):
            r.update({f"{name}{bloc}{j:02d}": factor + rng.normal(0, VOL * 0.25, SESSIONS) for j in range(10)})
    r.update({f"BG{j:02d}": rng.normal(0, VOL, SESSIONS) for j in range(40)})
    for name, (at, _, signs) in CANDIDATES.items():
        for bloc, sign in zip("XY", signs):
            for j in range(10):
                r[f"{name}{bloc}{j:02d}"][at] += SHOCK * sign
        r[name][at] = 0.0
    return 100 * (1 + pd.DataFrame(r, index=days)).cumprod(), {k: (days[at].date(), way) for k, (at, way, _) in CANDIDATES.items()}


def synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """((symbol, d, c), (cid, symbol, direction, as_of, origin_leader)): the same as tables."""
    closes, when = universe()
    rows = [(s, d.date(), float(v)) for s in closes for d, v in closes[s].items()]
    cands = [(k, s, way, d, None) for k, (s, (d, way)) in enumerate(when.items())]
    return spark.createDataFrame(rows, "symbol string, d date, c double"), spark.createDataFrame(cands, "cid int, symbol string, direction string, as_of date, origin_leader string")
