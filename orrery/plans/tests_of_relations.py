"""Composite analyses: do the relationships hold out of sample, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import statistics as st
from orrery.operators.comovement import lagged_pearson, parts_blocked
from orrery.operators.panel import correlation
from orrery.plans.market import CORR, PANEL, bar_panel, bars
from orrery.plans.relations import _SUPPLY, supply_edges
from orrery.sources.durable import durable
from orrery.sources.tables import table


def split_pairs(spark, sf_dir) -> DataFrame:
    """(a, b, c1, c2): correlation of every pair in the first and the second half of all sessions."""
    p = durable(bar_panel(spark, sf_dir))
    n = (p.agg(F.max("i")).first()[0] or 0) + 1
    both = parts_blocked(p.select("symbol", "i", "r"), [(0, n // 2), (n // 2, n)], first=0, width=n)
    pairs = both.select("a", "b", F.col("c")[0].alias("c1"), F.col("c")[1].alias("c2"))
    return pairs.where("c1 IS NOT NULL AND c2 IS NOT NULL").withColumns({"c1": F.round("c1", 9), "c2": F.round("c2", 9)})


def excess(spark, sf_dir) -> DataFrame:
    p = bar_panel(spark, sf_dir).where("r IS NOT NULL")
    return p.select("symbol", "i", "d", (F.col("r") - F.avg("r").over(Window.partitionBy("i"))).alias("x"))


def a26_bands(spark, sf_dir):
    """How second-half correlation follows first-half correlation, by band of its size."""
    p = split_pairs(spark, sf_dir)
    band = F.when(F.abs("c1") >= 0.3, "0.3+").when(F.abs("c1") >= 0.2, "0.2-0.3").when(F.abs("c1") >= 0.1, "0.1-0.2").otherwise("0-0.1")
    return p.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.signum("c1") == F.signum("c2")).cast("int")), 7).alias("agree"), F.round(F.avg(F.abs("c2")), 7).alias("mean_abs_second"))


def a27_auc(spark, sf_dir):
    """How well the size of first-half correlation ranks pairs whose sign holds."""
    out = st.auc(split_pairs(spark, sf_dir), F.abs("c1"), F.signum("c1") == F.signum("c2"), [F.col("a"), F.col("b")])
    return out.select(F.round("auc", 8).alias("auc"), "n_pos", "n_neg")


def a28_deciles(spark, sf_dir):
    p = split_pairs(spark, sf_dir).select(F.abs("c1").alias("s"), (F.signum("c1") == F.signum("c2")).alias("y"))
    return st.deciles(durable(p), "s", "y").select("bin", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), "n", F.round("rate", 7).alias("rate"))


def a30_clustered_mean(spark, sf_dir):
    """Mean next-session excess return after excess moves of 5 % and more, with errors clustered by session."""
    e = excess(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("i")
    nxt = F.when(F.lead("i").over(w) == F.col("i") + 1, F.lead("x").over(w))
    out = st.clustered_mean(e.withColumn("y", nxt).where(F.abs("x") >= 0.05), "y", "i")
    return out.select(F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"), "n", "n_clusters")


def chain_moves(spark, sf_dir) -> DataFrame:
    """(src, dst, i, d, x, y): a customer's excess return and its supplier's in the next session, once the edge is known."""
    e = durable(excess(spark, sf_dir))
    first = supply_edges(spark, sf_dir).groupBy("src", "dst").agg(F.min("day").alias("first")).where("src <> dst")
    cust = e.select(F.col("symbol").alias("dst"), "i", "d", "x")
    supp = e.select(F.col("symbol").alias("src"), (F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    return first.join(cust, "dst").where(F.col("d") >= F.col("first")).join(supp, ["src", "i"])


def e5_chain_lag(spark, sf_dir):
    """Slope of suppliers' next-session excess return on their customer's, per customer with 2 suppliers or more."""
    m = chain_moves(spark, sf_dir)
    wide = m.groupBy("dst").agg(F.countDistinct("src").alias("k")).where("k >= 2")
    return st.slopes(m.join(wide, "dst"), "x", "y", ["dst"]).select("dst", "n", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def e6_pooled_lag(spark, sf_dir):
    """The same by year over all chains, pooled by inverse variance."""
    by_year = st.slopes(chain_moves(spark, sf_dir).withColumn("year", F.year("d")), "x", "y", ["year"])
    out = st.pooled(by_year, "slope", "se")
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("pooled", "se", "q", "i2")])


def e5_chain_years(spark, sf_dir):
    """The slopes of e5 by year over customers with 2 suppliers or more, pooled by inverse variance, with their heterogeneity."""
    m = durable(chain_moves(spark, sf_dir))
    wide = m.groupBy("dst").agg(F.countDistinct("src").alias("k")).where("k >= 2")
    by_year = st.slopes(m.join(wide, "dst", "left_semi").withColumn("year", F.year("d")), "x", "y", ["year"])
    return st.pooled(by_year, "slope", "se").select("k", *[F.round(c, 6).alias(c) for c in ("pooled", "se", "q", "i2")])


def e6_wide_lag(spark, sf_dir, least=2):
    """Slope of suppliers' next-session excess return over customers with ``least`` suppliers or more, with errors clustered by session.

    The published analysis takes 3, which no customer of the test tables has.
    """
    m = durable(chain_moves(spark, sf_dir))
    wide = m.groupBy("dst").agg(F.countDistinct("src").alias("k")).where(F.col("k") >= least)
    fit = st.clustered_slopes(m.join(wide, "dst", "left_semi"), "x", "y", "i")
    return fit.select("n", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def e8_lagged_signs(spark, sf_dir, top=200):
    """Whether the ``top`` lagged correlations of the first half keep their sign in the second."""
    p = durable(bar_panel(spark, sf_dir).select("symbol", "i", "r"))
    n = (p.agg(F.max("i")).first()[0] or 0) + 1
    second = p.where(F.col("i") >= n // 2)
    best = durable(lagged_pearson(p, [1, 2, 5], first=0, width=n, top=top, upto=n // 2).select("lag", "x", "y", F.col("c").alias("c1")))
    later = lagged_pairs(best.select("x", "y", "lag"), second).select("lag", "x", "y", F.col("c").alias("c2"))
    out = best.join(later, ["lag", "x", "y"], "left")
    return out.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("c1") == F.signum("c2")).alias("n_agree"), F.round(F.avg(F.abs("c1")), 7).alias("mean_first"), F.round(F.avg(F.abs("c2")), 7).alias("mean_second"))


#: Lags in sessions of the lag matrix.
LAGS = (1, 2, 3, 5, 10)


def lagged_pairs(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """(x, y, lag, c, n): correlation of x with y ``lag`` sessions later in ``p`` (symbol, i, r), for the distinct ``pairs`` (x, y, lag) with such sessions."""
    x = pairs.join(p.select(F.col("symbol").alias("x"), "i", F.col("r").alias("rx")), "x")
    y = p.select(F.col("symbol").alias("y"), F.col("i").alias("j"), F.col("r").alias("ry"))
    both = x.withColumn("j", F.col("i") + F.col("lag")).join(y, ["y", "j"])
    return both.groupBy("x", "y", "lag").agg(F.round(correlation(F.col("rx"), F.col("ry")), 9).alias("c"), F.count(F.col("rx") + F.col("ry")).alias("n"))


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    """The panel (symbol, i, r) of the first and of the second half of all sessions, and the session where this begins."""
    p = durable(bar_panel(spark, sf_dir).select("symbol", "i", "r"))
    half = ((p.agg(F.max("i")).first()[0] or 0) + 1) // 2
    return p.where(F.col("i") < half), p.where(F.col("i") >= half), half


def e8_lag_matrix(spark, sf_dir, top=1000):
    """Whether the ``top`` correlations of the first half at each lag keep their sign in the second, against the second with its sessions shuffled.

    ``p`` is that of as many agreeing signs or more by chance. ``holds`` is the
    rule for structure: 60 % agree, with a mean of 0.03 and more and p under 0.01,
    and the shuffled sessions stay more than 2 points behind.
    """
    first, second, half = halves(spark, sf_dir)
    best = durable(lagged_pearson(first, list(LAGS), first=0, width=half, top=top).select("x", "y", "lag", F.col("c").alias("c1")))
    place = second.select("i").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.col("i").cast("string")), "i")))  # a calendar is small
    shuffled = second.join(F.broadcast(place), "i").select("symbol", F.col("k").alias("i"), "r")
    pairs = best.select("x", "y", "lag")
    out = best.join(lagged_pairs(pairs, second).select("x", "y", "lag", F.col("c").alias("c2")), ["x", "y", "lag"], "left")
    out = out.join(lagged_pairs(pairs, shuffled).select("x", "y", "lag", F.col("c").alias("c0")), ["x", "y", "lag"], "left")
    same = lambda c: F.count_if(F.signum("c1") == F.signum(c))
    per = out.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), same("c2").alias("n_agree"), same("c0").alias("n_shuffled"), F.round(F.avg(F.abs("c1")), 7).alias("mean_first"), F.round(F.avg(F.abs("c2")), 7).alias("mean_second"))
    rows = [(*r, round(st.binomial_greater(r.n_agree, r.n), 9)) for r in per.collect()]  # one a lag
    out = spark.createDataFrame(rows, "lag int, n long, n_agree long, n_shuffled long, mean_first double, mean_second double, p double")
    holds = (10 * F.col("n_agree") >= 6 * F.col("n")) & (F.col("mean_second") >= 0.03) & (F.col("p") < 0.01) & (50 * F.col("n_shuffled") < 50 * F.col("n_agree") - F.col("n"))
    return out.withColumn("holds", F.coalesce(holds, F.lit(False)))


def e4_horizons(spark, sf_dir):
    """Excess returns compounded over blocks of 2, 5 and 10 sessions after a move of 2 deviations, by its sign."""
    e = durable(excess(spark, sf_dir))
    out = None
    for h in (2, 5, 10):
        b = e.groupBy("symbol", F.floor(F.col("i") / h).cast("int").alias("blk")).agg(F.sum("x").alias("x"))
        w = Window.partitionBy("symbol").orderBy("blk")
        nxt = F.when(F.lead("blk").over(w) == F.col("blk") + 1, F.lead("x").over(w))
        s = F.stddev_samp("x").over(Window.partitionBy("symbol"))
        m = b.withColumn("y", nxt).withColumn("s", s).where(F.abs("x") >= 2 * F.col("s")).where("y IS NOT NULL")
        r = m.groupBy((F.col("x") > 0).alias("up")).agg(F.lit(h).alias("h"), F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("mean_next"))
        out = r if out is None else out.unionByName(r)
    return out


def e14_intraday_lag(spark, sf_dir):
    """For each kind of event the lag in hours, up to 6 either way, at which its count follows purchases most closely."""
    ev = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    by = ev.groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    x = by.where("event_type = 'purchase'").select("t", "v")
    y = by.where("event_type <> 'purchase'").select(F.col("event_type").alias("key"), "t", "v")
    return st.best_lag(x, y, list(range(-6, 7)), 12).select(F.col("key").alias("event_type"), "lag", F.round("corr", 7).alias("corr"), "n")


def a19_first_events(spark, sf_dir):
    """Each user's first event of a kind, and the day of their first event of any."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return e.withColumns({"k": k, "first": first}).where("k = 1").select("user_id", "event_type", "event_id", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.get_json_object("props", "$.k").cast("long").alias("k_value"))


def e15_round_trips(spark, sf_dir):
    """Gains of users who bought and later clicked the same item: value-weighted entry against exit, by item class."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), "event_type", F.col("value").alias("px"), (F.col("event_id") % 5 + 1).alias("qty"), "ts")
    side = lambda kind, p: e.where(F.col("event_type") == kind).groupBy("user_id", "item").agg((F.sum(F.col("px") * F.col("qty")) / F.sum("qty")).alias(f"{p}_px"), F.sum("qty").alias(f"{p}_qty"), F.min("ts").alias(f"{p}_first"), F.max("ts").alias(f"{p}_last"))
    j = side("purchase", "in").join(side("click", "out"), ["user_id", "item"])
    qty = F.least("in_qty", "out_qty")
    pnl = (F.col("out_px") - F.col("in_px")) * qty
    t = j.select(F.floor(F.col("item") / 10).alias("item_class"), pnl.alias("pnl"), (F.col("out_px") / F.col("in_px") - 1).alias("ret"))
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") <= 0, F.col("pnl")))
    return t.groupBy("item_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 7).alias("win_rate"), F.round(F.try_divide(win, -loss), 6).alias("payoff"))


def a37_concentration(spark, sf_dir):
    """The share of each symbol's dollar volume that its 10 largest days make up."""
    b = bars(spark, sf_dir).groupBy("symbol", "date").agg(F.max("dollar_vol").alias("v"))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("v").desc_nulls_last(), "date"))
    return b.withColumn("k", k).groupBy("symbol").agg(F.round(F.try_divide(F.sum(F.when(F.col("k") <= 10, F.col("v"))), F.sum("v")), 8).alias("top10_share"), F.round(F.min(F.log10("v")), 7).alias("min_log_volume"))


def a43_labels(spark, sf_dir):
    return table(spark, sf_dir, "filing_mention").groupBy(F.coalesce(F.lower(F.trim("relation")), F.lit("")).alias("relation"), F.coalesce(F.lower(F.trim("confidence")), F.lit("")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filer_ticker").alias("n_filers"))


_FUNCS = (a19_first_events, a26_bands, a27_auc, a28_deciles, a30_clustered_mean, a37_concentration, a43_labels, e4_horizons, e5_chain_lag, e6_pooled_lag, e5_chain_years, e6_wide_lag, e8_lag_matrix, e8_lagged_signs, e14_intraday_lag, e15_round_trips)
QUERIES = {f.__name__: f for f in _FUNCS}

_PAIRS = f"""{PANEL}, hf AS (SELECT (max(i) + 1) // 2 AS h FROM p),
sp AS (SELECT * FROM (SELECT x.symbol AS a, y.symbol AS b, round({CORR.format(x='CASE WHEN x.i < h THEN x.r END', y='CASE WHEN x.i < h THEN y.r END')}, 9) AS c1, round({CORR.format(x='CASE WHEN x.i >= h THEN x.r END', y='CASE WHEN x.i >= h THEN y.r END')}, 9) AS c2
  FROM p x JOIN p y ON x.i = y.i AND x.symbol < y.symbol, hf GROUP BY ALL) WHERE c1 IS NOT NULL AND c2 IS NOT NULL)"""
_PAIRS = _PAIRS.replace(", hf GROUP BY ALL", " JOIN hf ON true GROUP BY ALL")
_EX = f"{PANEL}, ex AS (SELECT symbol, i, d, r - avg(r) OVER (PARTITION BY i) AS x FROM p WHERE r IS NOT NULL)"
_CHAIN = f"""{_EX}, {_SUPPLY}, fe AS (SELECT src, dst, min(day) AS first FROM sup WHERE src <> dst GROUP BY ALL),
cm AS (SELECT src, dst, c.i, c.d, c.x, s.x AS y FROM fe JOIN ex c ON c.symbol = dst AND c.d >= first JOIN ex s ON s.symbol = src AND s.i = c.i + 1)"""
_SLOPE = "count(*) AS n, covar_pop(y, x) / nullif(var_pop(x), 0) AS slope, CASE WHEN count(*) > 2 THEN sqrt(greatest((var_pop(y) * count(*) - (covar_pop(y, x) / nullif(var_pop(x), 0)) ** 2 * var_pop(x) * count(*)) / (count(*) - 2) / nullif(var_pop(x) * count(*), 0), 0)) END AS se"
ORACLE = {
    "a19_first_events": "SELECT user_id, event_type, event_id, strftime(first, '%Y-%m-%d') AS first_day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY user_id) AS first FROM events WHERE user_id IS NOT NULL) WHERE k = 1",
    "a26_bands": f"WITH {_PAIRS} SELECT CASE WHEN abs(c1) >= 0.3 THEN '0.3+' WHEN abs(c1) >= 0.2 THEN '0.2-0.3' WHEN abs(c1) >= 0.1 THEN '0.1-0.2' ELSE '0-0.1' END AS band, count(*) AS n, round(avg(CASE WHEN sign(c1) = sign(c2) THEN 1 ELSE 0 END), 7) AS agree, round(avg(abs(c2)), 7) AS mean_abs_second FROM sp GROUP BY 1",
    "a27_auc": f"WITH {_PAIRS}, r AS (SELECT CASE WHEN sign(c1) = sign(c2) THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY abs(c1), a, b) AS k FROM sp) SELECT round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM r",
    "a28_deciles": f"WITH {_PAIRS}, t AS (SELECT abs(c1) AS s, sign(c1) = sign(c2) AS y FROM sp), q AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM t), u AS (SELECT s, y, len(list_filter(q, lambda e: s >= e)) AS bin FROM t, q) SELECT CAST(bin AS INTEGER) AS bin, round(min(s), 8) AS lo, round(max(s), 8) AS hi, count(*) AS n, round(avg(CASE WHEN y THEN 1 ELSE 0 END), 7) AS rate FROM u GROUP BY bin",
    "a30_clustered_mean": f"WITH {_EX}, t AS (SELECT a.i, b.x AS y FROM ex a JOIN ex b ON b.symbol = a.symbol AND b.i = a.i + 1 WHERE abs(a.x) >= 0.05), g AS (SELECT i, sum(y - (SELECT avg(y) FROM t)) AS u, sum(y) AS s, count(*) AS k FROM t GROUP BY i) SELECT round(sum(s) / sum(k), 9) AS mean, round(sqrt(sum(u * u)) / sum(k), 9) AS se, coalesce(CAST(sum(k) AS BIGINT), 0) AS n, count(*) AS n_clusters FROM g",
    "a37_concentration": "WITH b AS (SELECT upper(trim(symbol)) AS symbol, date, max(dollar_vol) AS v FROM bar GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC NULLS LAST, date) AS k FROM b) SELECT symbol, round(sum(v) FILTER (WHERE k <= 10) / nullif(sum(v), 0), 8) AS top10_share, round(min(log10(v)), 7) AS min_log_volume FROM k GROUP BY 1",
    "a43_labels": "SELECT coalesce(lower(trim(relation)), '') AS relation, coalesce(lower(trim(confidence)), '') AS confidence, count(*) AS n, count(DISTINCT filer_ticker) AS n_filers FROM filing_mention GROUP BY ALL",
    "e4_horizons": " UNION ALL ".join(
        f"SELECT up, CAST({h} AS INTEGER) AS h, count(*) AS n, round(avg(y), 8) AS mean_next FROM (WITH {_EX}, bl AS (SELECT symbol, i // {h} AS blk, sum(x) AS x FROM ex GROUP BY ALL), s AS (SELECT *, stddev_samp(x) OVER (PARTITION BY symbol) AS s FROM bl) SELECT a.x > 0 AS up, b2.x AS y FROM s a JOIN bl b2 ON b2.symbol = a.symbol AND b2.blk = a.blk + 1 WHERE abs(a.x) >= 2 * a.s) GROUP BY up" for h in (2, 5, 10)
    ),
    "e5_chain_lag": f"WITH {_CHAIN} SELECT dst, n, round(slope, 7) AS slope, round(se, 7) AS se FROM (SELECT dst, {_SLOPE} FROM cm WHERE dst IN (SELECT dst FROM cm GROUP BY dst HAVING count(DISTINCT src) >= 2) GROUP BY dst)",
    "e6_pooled_lag": f"WITH {_CHAIN}, y AS (SELECT year(d) AS yr, {_SLOPE} FROM cm GROUP BY 1), w AS (SELECT slope AS e, 1 / (se * se) AS w FROM y WHERE se > 0), t AS (SELECT count(*) AS k, sum(w * e) / sum(w) AS pooled, sqrt(1 / sum(w)) AS se, sum(w * e * e) - sum(w * e) ** 2 / sum(w) AS q FROM w) SELECT k, round(pooled, 6) AS pooled, round(se, 6) AS se, round(q, 6) AS q, round(greatest(0.0, (q - (k - 1)) / nullif(q, 0) * 100), 6) AS i2 FROM t",
    "e8_lagged_signs": f"""WITH {PANEL}, hf AS (SELECT (max(i) + 1) // 2 AS h FROM p), c AS (SELECT lag, x.symbol AS x, y.symbol AS y, round({CORR.format(x='CASE WHEN y.i < h THEN x.r END', y='CASE WHEN y.i < h THEN y.r END')}, 9) AS c1, round({CORR.format(x='CASE WHEN x.i >= h THEN x.r END', y='CASE WHEN x.i >= h THEN y.r END')}, 9) AS c2
  FROM p x JOIN (SELECT unnest([1, 2, 5]) AS lag) l ON true JOIN p y ON y.i = x.i + lag AND y.symbol <> x.symbol JOIN hf ON true GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY abs(c1) DESC NULLS LAST, x, y) AS k FROM c)
SELECT lag, count(*) AS n, count(*) FILTER (WHERE sign(c1) = sign(c2)) AS n_agree, round(avg(abs(c1)), 7) AS mean_first, round(avg(abs(c2)), 7) AS mean_second FROM k WHERE k <= 200 GROUP BY lag""",
    "e8_lag_matrix": f"""WITH {PANEL}, hf AS (SELECT (max(i) + 1) // 2 AS h FROM p), l AS (SELECT unnest([1, 2, 3, 5, 10]) AS lag),
c1 AS (SELECT lag, x.symbol AS x, y.symbol AS y, round({CORR.format(x='x.r', y='y.r')}, 9) AS c1 FROM p x JOIN l ON true JOIN p y ON y.i = x.i + lag AND y.symbol <> x.symbol JOIN hf ON y.i < h GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY abs(c1) DESC NULLS LAST, x, y) AS k FROM c1) WHERE k <= 1000),
s AS (SELECT p.* FROM p JOIN hf ON i >= h), pl AS (SELECT i, row_number() OVER (ORDER BY md5(CAST(i AS VARCHAR)), i) AS k FROM (SELECT DISTINCT i FROM s)), sh AS (SELECT symbol, k AS i, r FROM s JOIN pl USING (i)),
c2 AS (SELECT lag, x, y, round({CORR.format(x='a.r', y='b.r')}, 9) AS c2 FROM k JOIN s a ON a.symbol = x JOIN s b ON b.symbol = y AND b.i = a.i + lag GROUP BY ALL),
c0 AS (SELECT lag, x, y, round({CORR.format(x='a.r', y='b.r')}, 9) AS c0 FROM k JOIN sh a ON a.symbol = x JOIN sh b ON b.symbol = y AND b.i = a.i + lag GROUP BY ALL),
g AS (SELECT lag, count(*) AS n, count(*) FILTER (WHERE sign(c1) = sign(c2)) AS n_agree, count(*) FILTER (WHERE sign(c1) = sign(c0)) AS n_shuffled, round(avg(abs(c1)), 7) AS mean_first, round(avg(abs(c2)), 7) AS mean_second FROM k LEFT JOIN c2 USING (lag, x, y) LEFT JOIN c0 USING (lag, x, y) GROUP BY lag),
t AS (SELECT *, round(list_sum(list_transform(generate_series(n_agree, n), lambda m: exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) - n * ln(2)))), 9) AS p FROM g)
SELECT *, coalesce(10 * n_agree >= 6 * n AND mean_second >= 0.03 AND p < 0.01 AND 50 * n_shuffled < 50 * n_agree - n, false) AS holds FROM t""",
    "e14_intraday_lag": """WITH b AS (SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS v FROM events WHERE ts IS NOT NULL GROUP BY ALL),
c AS (SELECT y.key, lag, covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0) AS corr, count(*) AS n FROM b x JOIN (SELECT unnest(generate_series(-6, 6)) AS lag) l ON true JOIN b y ON y.t = x.t + lag AND y.key <> 'purchase' WHERE x.key = 'purchase' GROUP BY ALL)
SELECT key AS event_type, CAST(lag AS INTEGER) AS lag, round(corr, 7) AS corr, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(abs(corr), 12) DESC, lag) AS k FROM c WHERE n >= 12 AND corr IS NOT NULL) WHERE k = 1""",
    "e15_round_trips": """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, event_type, value AS px, event_id % 5 + 1 AS qty FROM events),
g AS (SELECT user_id, item, event_type, sum(px * qty) / sum(qty) AS px, sum(qty) AS qty FROM e GROUP BY ALL), j AS (SELECT a.item // 10 AS item_class, (b.px - a.px) * least(a.qty, b.qty) AS pnl FROM g a JOIN g b ON a.user_id = b.user_id AND a.item = b.item AND a.event_type = 'purchase' AND b.event_type = 'click')
SELECT item_class, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 7) AS win_rate, round(avg(pnl) FILTER (WHERE pnl > 0) / nullif(-avg(pnl) FILTER (WHERE pnl <= 0), 0), 6) AS payoff FROM j GROUP BY 1""",
}
ORACLE["e5_chain_years"] = ORACLE["e6_pooled_lag"].replace("FROM cm GROUP BY 1", "FROM cm WHERE dst IN (SELECT dst FROM cm GROUP BY dst HAVING count(DISTINCT src) >= 2) GROUP BY 1")
ORACLE["e6_wide_lag"] = f"""WITH {_CHAIN}, w AS (SELECT * FROM cm WHERE x IS NOT NULL AND y IS NOT NULL AND dst IN (SELECT dst FROM cm GROUP BY dst HAVING count(DISTINCT src) >= 2)),
f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / nullif(var_pop(x), 0) AS b, var_pop(x) * count(*) AS sxx FROM w),
g AS (SELECT i, sum((x - mx) * (y - my - b * (x - mx))) AS u FROM w, f GROUP BY i) SELECT n, round(any_value(b), 7) AS slope, round(sqrt(sum(u * u)) / nullif(any_value(sxx), 0), 7) AS se FROM f, g GROUP BY n"""
