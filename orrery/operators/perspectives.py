"""Deterministic second looks at a candidate: quality of its correlations, and how it trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.comovement import fisher
from orrery.operators.panel import correlation

#: Co-mention scores from here on are strong.
PMI_STRONG = 1.1172
NOT_MEASURABLE = {"spread": "no quotes", "slippage": "no fills", "borrow": "no borrow rates"}


def quant(cands: DataFrame, edges: DataFrame, p: DataFrame, *, trail: int = 60, excluded: DataFrame | None = None, sic: DataFrame | None = None, pmi: DataFrame | None = None) -> DataFrame:
    """(cid, n_edges, median_ci_width, duplicate_count, split_half_sign_agree_pct, split_half_min_abs, candidate_is_fund, sector_match_pct, comention_weak, comention_strong).

    Windows are exclusive. Without ``sic`` (symbol, sic) or ``pmi`` (a, b, pmi)
    what they tell is null: not measured, rather than measured as zero.
    """
    half = trail // 2
    lo, hi = fisher(F.col("corr"), F.lit(trail))
    e = edges.join(cands.select("cid", "symbol", "tx"), "cid").select("cid", "symbol", "leader", "corr", "tx", (hi - lo).alias("width"))
    grid = e.select("cid", "symbol", "leader", "width", "tx", F.explode(F.sequence(F.col("tx") - trail, F.col("tx") - 1)).alias("i"))
    rows = grid.join(p.select("symbol", "i", F.col("r").alias("rc")), ["symbol", "i"], "left").join(p.select(F.col("symbol").alias("leader"), "i", F.col("r").alias("rl")), ["leader", "i"], "left")
    first = F.col("i") < F.col("tx") - trail + half
    part = lambda when: correlation(F.when(when, F.col("rc")), F.when(when, F.col("rl")))
    each = rows.groupBy("cid", "symbol", "leader", "width").agg((F.count_if(F.col("rc") == F.col("rl")) / trail > 0.5).alias("dup"), part(first).alias("h1"), part(~first).alias("h2"))
    agree = F.coalesce(F.signum("h1") == F.signum("h2"), F.lit(False))
    if sic is not None:
        known = sic.select("symbol", "sic").where("sic IS NOT NULL")
        each = each.join(known.withColumnRenamed("sic", "own_sic"), "symbol", "left").join(known.select(F.col("symbol").alias("leader"), "sic"), "leader", "left")
    else:
        each = each.withColumns({"own_sic": F.lit(None).cast("string"), "sic": F.lit(None).cast("string")})
    if pmi is not None:
        both = pmi.select("a", "b", "pmi").unionByName(pmi.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi"))
        each = each.join(both.select(F.col("a").alias("symbol"), F.col("b").alias("leader"), "pmi"), ["symbol", "leader"], "left")
    else:
        each = each.withColumn("pmi", F.lit(None).cast("double"))
    same = F.coalesce(F.substring("sic", 1, 2) == F.substring("own_sic", 1, 2), F.lit(False)).cast("int")
    least = F.when(F.col("h1").isNotNull() & F.col("h2").isNotNull(), F.least(F.abs("h1"), F.abs("h2")))
    out = each.groupBy("cid").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.median("width").alias("median_ci_width"),
        F.count_if("dup").alias("duplicate_count"),
        (F.avg(agree.cast("int")) * 100).alias("split_half_sign_agree_pct"),
        F.median(least).alias("split_half_min_abs"),
        F.when(F.max("own_sic").isNotNull(), F.avg(same) * 100).alias("sector_match_pct"),
        F.count_if(F.col("pmi") < PMI_STRONG).alias("weak"),
        F.count_if(F.col("pmi") >= PMI_STRONG).alias("strong"),
    )
    fund = cands.join(excluded.select("symbol").distinct().withColumn("fund", F.lit(True)), "symbol", "left") if excluded is not None else cands.withColumn("fund", F.lit(False))
    counted = lambda c: F.coalesce(F.col(c), F.lit(0)) if pmi is not None else F.lit(None).cast("long")
    return fund.select("cid", F.coalesce("fund", F.lit(False)).alias("candidate_is_fund")).join(out, "cid", "left").select(
        "cid", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "median_ci_width", F.coalesce("duplicate_count", F.lit(0)).alias("duplicate_count"), "split_half_sign_agree_pct", "split_half_min_abs", "candidate_is_fund", "sector_match_pct", counted("weak").alias("comention_weak"), counted("strong").alias("comention_strong")
    )


def day_trade(cands: DataFrame, bars: DataFrame, *, trail: int = 60) -> DataFrame:
    """(cid, n_sessions, median_dollar_vol, median_trade_count, gap_ratio) over the last ``trail`` bars before each candidate's date.

    ``bars`` has symbol, d, t (orders a symbol's bars), open, high, low, close,
    dollar_vol and trade_count. The gap uses the true prior close; the ratio is
    of gaps in gaps and intraday ranges, null where both are 0.
    """
    b = bars.withColumn("prior", F.lag("close").over(Window.partitionBy("symbol").orderBy("t")))
    rows = cands.select("cid", "symbol", "as_of").join(b, "symbol").where(F.col("d") < F.col("as_of"))
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy(F.col("t").desc()))).where(F.col("k") <= trail)
    gap, span = F.abs(F.col("open") - F.col("prior")), F.abs(F.col("high") - F.col("low"))
    g, s = F.coalesce(F.sum(gap), F.lit(0.0)), F.coalesce(F.sum(span), F.lit(0.0))
    out = last.groupBy("cid").agg(F.count(F.lit(1)).alias("n_sessions"), F.median("dollar_vol").alias("median_dollar_vol"), F.median("trade_count").alias("median_trade_count"), F.try_divide(g, g + s).alias("gap_ratio"))
    return cands.select("cid").join(out, "cid", "left").withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))


def analyse(perspectives: DataFrame, classify: Column | None = None, *, rank: Column | None = None, cap: int = 20) -> DataFrame:
    """``perspectives`` with ``status`` and ``note``: what an analyst says of the first ``cap`` of them by ``rank``.

    ``classify`` is any column expression, such as a vectorised UDF; rows it
    returns null for have the status error, rows beyond the cap and all rows
    without an analyst not_run.
    """
    if classify is None:
        return perspectives.withColumns({"status": F.lit("not_run"), "note": F.lit(None).cast("string")})
    # The first of each task go on, and of those the first: no task sees them all.
    first = perspectives.select("cid", (rank if rank is not None else F.lit(None).cast("double")).alias("rank")).orderBy(F.col("rank").desc_nulls_last(), "cid").limit(cap)
    picked = F.broadcast(first.select("cid"))
    noted = perspectives.join(picked, "cid", "left_semi").withColumn("note", classify)
    rest = perspectives.join(picked, "cid", "left_anti").withColumn("note", F.lit(None).cast("string")).withColumn("status", F.lit("not_run"))
    return noted.withColumn("status", F.when(F.col("note").isNotNull(), "ok").otherwise("error")).unionByName(rest)
