"""Queries that choose: who is left out and why, who comes first, and pairs of a real and a control value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import norm_symbol
from orrery.operators import evidence as ev
from orrery.operators import records as rec
from orrery.operators import statistics as st
from orrery.operators.panel import panel, session_ends
from orrery.operators.perspectives import PMI_STRONG, analyse, quant
from orrery.plans import market
from orrery.plans.market import _ENDS, _NEAR, CAND, PANEL, TRAIL, bar_panel, bars, candidates
from orrery.plans.relations import _TAGS, _pmi_sql, dated_tags, pmi_edges
from orrery.sources.durable import durable
from orrery.sources.synthetic import synthetic
from orrery.sources.tables import table


def f8_short_histories(spark, sf_dir):
    """Dates of filings that fewer than 60 sessions lead up to, as errors, one for each filer."""
    m = table(spark, sf_dir, "filing_mention").select(norm_symbol(F.col("filer_ticker")).alias("symbol"), F.col("filing_date").alias("as_of")).where("symbol IS NOT NULL AND as_of IS NOT NULL").distinct()
    e = m.join(session_ends(m, durable(bar_panel(spark, sf_dir))).select("as_of", "ti"), "as_of").where(F.col("ti") < TRAIL)
    day = F.date_format("as_of", "yyyy-MM-dd")
    return e.select("symbol", day.alias("day"), F.format_string("%s: only %d sessions up to %s, need %d", "symbol", F.col("ti").cast("int"), day, F.lit(TRAIL)).alias("error"))


def j5_vector_counts(spark, sf_dir):
    """How many documents there are, how many vectors, and how many documents lack one."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lack = rec.missing(d, v, F.col("doc_id"), F.col("vec_id")).agg(F.count(F.lit(1)).alias("n_missing"))
    return lack.select(d.agg(F.countDistinct("doc_id").alias("n")).scalar().alias("n"), v.agg(F.countDistinct("vec_id").alias("n")).scalar().alias("n_existing"), "n_missing")


def j6_uncovered(spark, sf_dir):
    """Symbols of supply edges that no bar is there for, left to fetch."""
    e = table(spark, sf_dir, "supply_edge")
    ends = e.select(norm_symbol(F.col("supplier")).alias("symbol")).union(e.select(norm_symbol(F.col("customer"))))
    return rec.missing(ends, bars(spark, sf_dir), F.col("symbol"), F.col("symbol")).withColumnRenamed("key", "symbol")


def j11_pairs(spark, sf_dir) -> DataFrame:
    """(month, symbol, control, real, other): each symbol's deviation of returns in a month beside that of the symbol next to it in dollar volume."""
    vol = bars(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "symbol").agg(F.median("dollar_vol").alias("size")).where("size IS NOT NULL AND symbol IS NOT NULL")
    dev = bar_panel(spark, sf_dir).groupBy(F.date_format("d", "yyyy-MM").alias("month"), "symbol").agg(F.stddev_samp("r").alias("dev")).where("dev IS NOT NULL")
    both = durable(vol.join(dev, ["month", "symbol"]))
    w = Window.partitionBy("month").orderBy(F.col("size").desc(), "symbol")
    near = both.select("month", "symbol", F.lead("symbol").over(w).alias("control")).where("control IS NOT NULL")
    real, other = both.select("month", "symbol", F.col("dev").alias("real")), both.select("month", F.col("symbol").alias("control"), F.col("dev").alias("other"))
    return near.join(real, ["month", "symbol"]).join(other, ["month", "control"])


def j11_real_and_control(spark, sf_dir):
    return j11_pairs(spark, sf_dir).select("month", "symbol", "control", F.round("real", 8).alias("real"), F.round("other", 8).alias("other"))


def a35_sign_test(spark, sf_dir):
    """Whether the real value of such pairs is larger more often than the control's, by a two-sided sign test over each quarter."""
    d = F.round("real", 10) - F.round("other", 10)
    q = F.concat(F.substring("month", 1, 4), F.lit("Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("string"))
    per = j11_pairs(spark, sf_dir).groupBy(q.alias("quarter")).agg(F.count_if(d > 0).alias("n_up"), F.count_if(d < 0).alias("n_down"))
    rows = [(r.quarter, r.n_up, r.n_down, round(st.sign_test(r.n_up, r.n_up + r.n_down), 6)) for r in per.collect()]  # one a quarter
    return spark.createDataFrame(rows, "quarter string, n_up long, n_down long, p double")


def a13_comention_counts(spark, sf_dir):
    """How many of each candidate's neighbours are weak and strong co-mentions; neighbours that are none are neither."""
    out, p = market._run(spark, sf_dir)
    q = quant(out["placed"], out["edges"], p, trail=TRAIL, pmi=pmi_edges(dated_tags(spark, sf_dir), min_pair=2, min_freq=2))
    return q.select("cid", "comention_weak", "comention_strong")


def t7_top_followers(spark, sf_dir, top=5):
    """The ``top`` followers of each shocked leader by their correlation's size."""
    f = market.g5_followers(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("origin_leader").orderBy(F.abs("corr").desc(), "follower"))
    return f.withColumn("rank", k).where(F.col("rank") <= top)


def t8_analysed(spark, sf_dir, cap=4):
    """Day-trading perspectives with a note on the ``cap`` with the largest gaps; those without a measure come last, and those beyond the cap aren't run."""
    note = F.when(F.col("n_sessions") >= 30, F.format_string("%d sessions", F.col("n_sessions").cast("int")))
    return analyse(market.n8_day_trade(spark, sf_dir), note, rank=F.col("gap_ratio"), cap=cap).select("cid", "status", "note")


def t13_first_candidates(spark, sf_dir, n=10):
    """The first ``n`` candidates by date and symbol."""
    c = candidates(spark, sf_dir, durable(bar_panel(spark, sf_dir)))
    return c.orderBy("as_of", "symbol").limit(n).select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "direction")


def e14_lead_lag(spark, sf_dir):
    """For each kind of event the lag in hours, up to 30 either way and over 120 hours or more, at which its count follows purchases most closely, and at which purchases follow it."""
    ev = table(spark, sf_dir, "events").where("ts IS NOT NULL")
    by = durable(ev.groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v")))
    x, y = by.where("event_type = 'purchase'").select("t", "v"), by.where("event_type <> 'purchase'").select(F.col("event_type").alias("key"), "t", "v")
    lags = list(range(-30, 31))
    there = st.best_lag(x, y, lags, 120, signed=True)
    keys = y.select("key").distinct()
    back = st.best_lag(y, x.crossJoin(F.broadcast(keys)), lags, 120, signed=True)  # kinds of events are few
    return there.join(back.select("key", F.col("lag").alias("rev_lag"), F.col("corr").alias("rev")), "key").select(F.col("key").alias("event_type"), "lag", F.round("corr", 7).alias("corr"), "n", "rev_lag", F.round("rev", 7).alias("rev_corr"))


def s17_synthetic_verdicts(spark, sf_dir):
    """Verdicts on the made-up market, whose blocs of ten move with their candidate, against it, or apart."""
    prices, c = synthetic(spark)
    out = ev.run(c, durable(panel(prices)), spark.createDataFrame([], "symbol string"))
    return ev.golden(c, out["assessments"]).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


_FUNCS = (s17_synthetic_verdicts, f8_short_histories, j5_vector_counts, j6_uncovered, j11_real_and_control, a35_sign_test, a13_comention_counts, t7_top_followers, t8_analysed, t13_first_candidates, e14_lead_lag)
QUERIES = {f.__name__: f for f in _FUNCS}
_PAIRS = f"""WITH {PANEL}, v AS (SELECT strftime(date, '%Y-%m') AS month, symbol, median(dollar_vol) AS size FROM b WHERE symbol <> '' GROUP BY ALL HAVING median(dollar_vol) IS NOT NULL),
dv AS (SELECT strftime(d, '%Y-%m') AS month, symbol, stddev_samp(r) AS dev FROM p GROUP BY ALL HAVING stddev_samp(r) IS NOT NULL), bo AS (SELECT * FROM v JOIN dv USING (month, symbol)),
pr AS (SELECT month, symbol, dev AS real, lead(symbol) OVER w AS control, lead(dev) OVER w AS other FROM bo WINDOW w AS (PARTITION BY month ORDER BY size DESC, symbol))"""
ORACLE = {
    # Known from how the market is made.
    "s17_synthetic_verdicts": """SELECT * FROM (VALUES ('SYNA', '2026-04-27', 'up', 'corroborated', '2.000000', 16, 0), ('SYNB', '2026-04-27', 'up', 'contradicted', '2.000000', 0, 20), ('SYNC', '2026-04-27', 'up', 'neutral', '0.000000', 0, 0),
  ('SYND', '2026-04-27', 'up', 'neutral', '2.000000', 10, 10), ('SYNE', '2026-04-27', 'down', 'corroborated', '2.000000', 20, 0), ('SYNF', '2026-02-16', 'up', 'no_assessment', '0.000000', 0, 0)) v(symbol, as_of, direction, verdict, effective_evidence, n_supporting, n_contradicting)""",
    "f8_short_histories": f"WITH {_ENDS} SELECT symbol, strftime(d, '%Y-%m-%d') AS day, format('{{}}: only {{}} sessions up to {{}}, need 60', symbol, ti, d) AS error FROM ends JOIN (SELECT DISTINCT upper(trim(filer_ticker)) AS symbol, filing_date AS d FROM filing_mention WHERE trim(filer_ticker) <> '') USING (d) WHERE ti < 60",
    "j5_vector_counts": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_existing, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing",
    "j6_uncovered": "SELECT upper(trim(supplier)) AS symbol FROM supply_edge WHERE trim(supplier) <> '' UNION SELECT upper(trim(customer)) FROM supply_edge WHERE trim(customer) <> '' EXCEPT SELECT upper(trim(symbol)) FROM bar",
    "j11_real_and_control": f"{_PAIRS} SELECT month, symbol, control, round(real, 8) AS real, round(other, 8) AS other FROM pr WHERE control IS NOT NULL",
    "a35_sign_test": f"""{_PAIRS}, s AS (SELECT month[1:4] || 'Q' || CAST(CAST(ceil(CAST(month[6:7] AS INTEGER) / 3.0) AS INTEGER) AS VARCHAR) AS quarter, count(*) FILTER (WHERE round(real, 10) > round(other, 10)) AS n_up, count(*) FILTER (WHERE round(real, 10) < round(other, 10)) AS n_down FROM pr WHERE control IS NOT NULL GROUP BY 1)
SELECT quarter, n_up, n_down, round(CASE WHEN n_up + n_down = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n_up, n_down) + 1), lambda i: exp(lgamma(n_up + n_down + 1) - lgamma(i + 1) - lgamma(n_up + n_down - i + 1) - (n_up + n_down) * ln(2))))) END, 6) AS p FROM s""",
    "a13_comention_counts": f"""WITH {_TAGS}, {_pmi_sql(pair=2, freq=2)}, {_NEAR}, bw AS (SELECT a, b, pmi FROM pmi UNION ALL SELECT b, a, pmi FROM pmi)
SELECT cand.cid, count(*) FILTER (WHERE pmi < {PMI_STRONG}) AS comention_weak, count(*) FILTER (WHERE pmi >= {PMI_STRONG}) AS comention_strong FROM cand LEFT JOIN near USING (cid) LEFT JOIN bw ON bw.a = cand.cid AND bw.b = near.leader GROUP BY cand.cid""",
    "t7_top_followers": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin_leader ORDER BY abs(corr) DESC, follower) AS rank FROM ({market.ORACLE['g5_followers']})) WHERE rank <= 5",
    "t8_analysed": f"WITH d AS ({market.ORACLE['n8_day_trade']}), k AS (SELECT *, row_number() OVER (ORDER BY gap_ratio DESC NULLS LAST, cid) <= 4 AS ran FROM d), t AS (SELECT cid, ran, CASE WHEN ran AND n_sessions >= 30 THEN format('{{}} sessions', n_sessions) END AS note FROM k) SELECT cid, CASE WHEN NOT ran THEN 'not_run' WHEN note IS NULL THEN 'error' ELSE 'ok' END AS status, note FROM t",
    "t13_first_candidates": f"WITH {CAND} SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, direction FROM cand ORDER BY cand.as_of, symbol LIMIT 10",
    "e14_lead_lag": """WITH h AS (SELECT event_type AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, CAST(count(*) AS DOUBLE) AS v FROM events WHERE ts IS NOT NULL GROUP BY ALL), l AS (SELECT unnest(range(-30, 31)) AS lag),
c AS (SELECT y.k, lag, corr(x.v, y.v) AS c, count(*) AS n FROM h x, l, h y WHERE x.k = 'purchase' AND y.k <> 'purchase' AND y.t = x.t + lag GROUP BY ALL HAVING count(*) >= 120 AND isfinite(corr(x.v, y.v))),
r AS (SELECT k, lag, c, n, row_number() OVER (PARTITION BY k ORDER BY round(c, 12) DESC, lag) AS a, row_number() OVER (PARTITION BY k ORDER BY round(c, 12) DESC, -lag) AS z FROM c)
SELECT k AS event_type, max(lag) FILTER (WHERE a = 1) AS lag, round(max(c) FILTER (WHERE a = 1), 7) AS corr, max(n) FILTER (WHERE a = 1) AS n, max(-lag) FILTER (WHERE z = 1) AS rev_lag, round(max(c) FILTER (WHERE z = 1), 7) AS rev_corr FROM r GROUP BY k""",
}
