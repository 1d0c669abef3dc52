"""Moves in units of their own trailing volatility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(recent: Column, baseline: Column, window: int) -> Column:
    """Aggregate: the sum of ``recent`` (0 if all are null) over the deviation of ``baseline`` times the root of ``window``; null where that is 0 or unknown."""
    return F.try_divide(F.coalesce(F.sum(recent), F.lit(0.0)), F.stddev_samp(baseline) * math.sqrt(window))


def scan(p: DataFrame, days: DataFrame, *, trail: int = 60, move_win: int = 3, sigma: float = 2.0) -> DataFrame:
    """(as_of, symbol, z): symbols shocked as of each date in ``days`` (as_of, ti, n), all symbols of the panel tried.

    The baseline of ``trail`` sessions ends before the ``move_win`` recent ones
    begin. Dates at or after the last session and dates with too little history
    give nothing.
    """
    ok = days.where((F.col("ti") < F.col("n")) & (F.col("ti") >= move_win + trail))
    at = ok.select("as_of", "ti", F.explode(F.sequence(F.col("ti") - move_win - trail, F.col("ti") - 1)).alias("i"))
    recent = F.col("i") >= F.col("ti") - move_win
    z = standardised(F.when(recent, F.col("r")), F.when(~recent, F.col("r")), move_win)
    return p.join(at, "i").groupBy("as_of", "symbol").agg(z.alias("z")).where(F.abs("z") >= sigma)
