"""Session-indexed return panels, kept long.

A session is a distinct date on which anything traded; sessions are numbered
from 0. A return exists only if the symbol also has a price in the session
right before, on the common grid. Two trailing windows of w sessions are used:
the *inclusive* one ends with the session of (or last before) a date, the
*exclusive* one ends right before it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closes(bars: DataFrame, *, symbol: Column, day: Column, price: Column) -> DataFrame:
    """(symbol, d, c): one price per symbol and date, the mean of repeated rows; days without any price keep a null one."""
    rows = bars.select(symbol.alias("symbol"), day.alias("d"), price.cast("double").alias("c"))
    return rows.where("symbol IS NOT NULL AND d IS NOT NULL").groupBy("symbol", "d").agg(F.avg("c").alias("c"))


def sessions(prices: DataFrame) -> DataFrame:
    """(d, i): the session dates in order. One task sorts the distinct dates, of which a calendar has few."""
    return prices.select("d").distinct().withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)


def panel(prices: DataFrame) -> DataFrame:
    """(symbol, i, d, c, r): prices with session numbers and returns on the grid."""
    w = Window.partitionBy("symbol").orderBy("i")
    before = F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("c").over(w))
    return prices.join(F.broadcast(sessions(prices)), "d").select("symbol", "i", "d", "c", (F.try_divide("c", before) - 1).alias("r"))


def session_ends(days: DataFrame, p: DataFrame) -> DataFrame:
    """(as_of, ti, tx, n) for the distinct dates in ``days`` (as_of).

    ``ti`` sessions are on or before the date, the end of the inclusive window;
    ``tx`` are before it, the end of the exclusive one; ``n`` there are in all.
    """
    s = p.select("d", "i").distinct()
    ends = days.select("as_of").distinct().join(F.broadcast(s), F.col("d") <= F.col("as_of"), "left").groupBy("as_of")  # a calendar is small
    return ends.agg(F.count("d").cast("int").alias("ti"), F.count_if(F.col("d") < F.col("as_of")).cast("int").alias("tx")).withColumn("n", s.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar())


def pinned_split(p: DataFrame, start: date, *, before: int | None = None, last: date | None = None) -> tuple[DataFrame, DataFrame]:
    """``p`` before ``start`` and from then on, or a ValueError.

    ``start`` must lie within the data and be a session: splitting at the next
    one would shift the split unseen. ``before`` and ``last``, if given, pin how
    many sessions the first part has and which is its last, so that history
    changed underneath is noticed too.
    """
    at = p.select("d").distinct().agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_if(F.col("d") == start).alias("there"), F.count_if(F.col("d") < start).alias("n"), F.max(F.when(F.col("d") < start, F.col("d"))).alias("last")).first()
    if at.lo is None or not at.lo <= start <= at.hi:
        raise ValueError(f"{start} is outside the data ({at.lo} to {at.hi})")
    if not at.there:
        raise ValueError(f"{start} is no session")
    if before is not None and at.n != before:
        raise ValueError(f"{at.n} sessions before {start}, not {before}")
    if last is not None and at["last"] != last:
        raise ValueError(f"the last session before {start} is {at['last']}, not {last}")
    return p.where(F.col("d") < start), p.where(F.col("d") >= start)


def log_returns(p: DataFrame) -> DataFrame:
    """(symbol, i, lr): logarithmic returns on the grid."""
    w = Window.partitionBy("symbol").orderBy("i")
    before = F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("c").over(w))
    return p.select("symbol", "i", (F.log("c") - F.log(before)).alias("lr"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over rows in which both are there; null where either is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
