"""Price queries: panels, co-movement, candidates, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.columns import norm_symbol
from orrery.operators import evidence as ev
from orrery.operators.comovement import edges_blocked, lagged_blocked
from orrery.operators.panel import closes, log_returns, panel, session_ends
from orrery.operators.perspectives import day_trade, quant
from orrery.operators.shocks import scan
from orrery.sources.durable import durable
from orrery.sources.tables import table

TRAIL = 60


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bar").withColumn("symbol", norm_symbol(F.col("symbol")))


def bar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(closes(bars(spark, sf_dir), symbol=F.col("symbol"), day=F.col("date"), price=F.col("close")))


def _last_window(p: DataFrame, trail: int) -> tuple[DataFrame, int]:
    """The window that ends before the last session, and its first session."""
    last = p.agg(F.max("i")).first()[0] or 0  # one number
    return p.where((F.col("i") >= last - trail) & (F.col("i") < last)).select("symbol", "i", "r"), last - trail


def _liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = bars(spark, sf_dir).groupBy("symbol").agg(F.median("dollar_vol").alias("m"))
    return med.withColumn("q", F.ntile(4).over(Window.orderBy(F.col("m").desc(), "symbol")))


def candidates(spark: SparkSession, sf_dir: str, p: DataFrame) -> DataFrame:
    """(cid, symbol, direction, as_of, origin_leader): the most liquid quarter of the symbols, each on the day of its largest move."""
    n = p.agg((F.max("i") + 1).alias("n")).scalar()
    moved = p.join(_liquid(spark, sf_dir).where("q = 1").select("symbol"), "symbol", "left_semi").where(F.col("r").isNotNull() & (F.col("i") >= 65) & (F.col("i") <= n - 2))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs("r").desc(), "i"))
    big = moved.withColumn("k", k).where("k = 1")
    return big.select(F.col("symbol").alias("cid"), "symbol", F.when(F.col("r") > 0, "up").otherwise("down").alias("direction"), F.col("d").alias("as_of"), F.lit(None).cast("string").alias("origin_leader"))


def _run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    p = durable(bar_panel(spark, sf_dir))
    return ev.run(candidates(spark, sf_dir, p), p, spark.createDataFrame([], "symbol string"), trail=TRAIL), p


def _r(*cols: str, digits: int = 8) -> list:
    return [F.round(c, digits).alias(c) for c in cols]


def s1_bar_scan(spark, sf_dir):
    """Bars of a closed range of dates; the range reaches the scan."""
    return table(spark, sf_dir, "bar").where(F.col("date").between("2024-11-01", "2024-11-30")).select("symbol", "date", "close", "volume")


def s2_closes_panel(spark, sf_dir):
    return bar_panel(spark, sf_dir).select("symbol", F.date_format("d", "yyyy-MM-dd").alias("day"), "i", F.round("c", 6).alias("close"), F.round("r", 8).alias("ret"))


def s5_liquid_symbols(spark, sf_dir):
    """Symbols with a median dollar volume of at least 10 million, and listed ones tagged in the news."""
    med = bars(spark, sf_dir).groupBy("symbol").agg(F.median("dollar_vol").alias("m"))
    tagged = table(spark, sf_dir, "news_symbol").select(norm_symbol(F.col("symbol")).alias("symbol"))
    listed = table(spark, sf_dir, "company_ref").select(F.col("ticker").alias("symbol"))
    return med.where("m >= 10000000").select("symbol").unionByName(tagged.join(listed, "symbol", "left_semi")).distinct()


def s6_listing_filter(spark, sf_dir):
    ref = table(spark, sf_dir, "company_ref")
    return ref.where(F.col("exchange").isin("NYSE", "NASDAQ", "ARCA") & ~F.col("ticker").contains(".") & ~F.col("ticker").contains("/")).select("ticker", "exchange")


def s7_most_liquid(spark, sf_dir, n=50):
    """The ``n`` most liquid symbols that are no funds."""
    funds = table(spark, sf_dir, "company_ref").where(is_fund(F.col("title"))).select(F.col("ticker").alias("symbol"))
    med = bars(spark, sf_dir).groupBy("symbol").agg(F.median("dollar_vol").alias("m")).join(funds, "symbol", "left_anti")
    return med.orderBy(F.col("m").desc_nulls_last(), "symbol").limit(n).select("symbol", F.round("m", 0).alias("median_dollar_vol"))


#: What names a fund, and what a leveraged or inverse one; only both together name the latter (fixed values).
FUND = r"(?i)\b(etfs?|etns?|trusts?|funds?|shares?|proshares|direxion|microsectors|graniteshares|tidal|themes|tradr|defiance)\b"
LEVERAGE = r"(?i)(\b\d+(\.\d+)?x\b|-\d+(\.\d+)?x\b|\bbull\b|\bbear\b|\bultra\w*\b|\binverse\b|\bleveraged\b|\bshort\b)"


def is_fund(name):
    """Whether a name is a fund's; a null one isn't."""
    return F.coalesce(name.rlike(FUND), F.lit(False))


def is_leveraged(name):
    """Whether a name is that of a leveraged or inverse fund."""
    return is_fund(name) & F.coalesce(name.rlike(LEVERAGE), F.lit(False))


def p2_log_returns(spark, sf_dir):
    return log_returns(bar_panel(spark, sf_dir)).where("lr IS NOT NULL").select("symbol", "i", F.round("lr", 8).alias("log_ret"))


def p4_window_ends(spark, sf_dir):
    """Where the inclusive and the exclusive window end for every filing date."""
    days = table(spark, sf_dir, "filing_mention").select(F.col("filing_date").alias("as_of")).where("as_of IS NOT NULL")
    return session_ends(days, bar_panel(spark, sf_dir)).select(F.date_format("as_of", "yyyy-MM-dd").alias("day"), *[F.col(c).cast("long").alias(c) for c in ("ti", "tx", "n")])


def p7_session_available(spark, sf_dir):
    """Whether a window of 60 sessions can be had before every date on which something was filed, or why not."""
    days = table(spark, sf_dir, "filing_mention").select(F.col("filing_date").alias("as_of")).where("as_of IS NOT NULL")
    p = bar_panel(spark, sf_dir)
    last = p.agg(F.max("d").alias("d")).scalar()
    e = session_ends(days, p).withColumn("last", last)
    day = F.date_format("as_of", "yyyy-MM-dd")
    why = F.when(F.col("ti") == F.col("tx"), F.format_string("%s not found in data (last session available: %s)", day, F.date_format("last", "yyyy-MM-dd"))).when(F.col("tx") < TRAIL, F.format_string("only %d sessions precede %s, need %d", "tx", day, F.lit(TRAIL))).otherwise("")
    return e.select(day.alias("day"), (why == "").alias("ok"), why.alias("reason"))


def p10_coverage(spark, sf_dir):
    """Symbols with returns in at least 90 % of all sessions."""
    p = bar_panel(spark, sf_dir)
    n = p.agg((F.max("i") + 1).alias("n")).scalar()
    return p.groupBy("symbol").agg(F.count("r").alias("n_returns")).where(F.col("n_returns") >= 0.9 * n)


def p16_funds(spark, sf_dir):
    """Names that are funds, and leveraged or inverse ones among them: those of listed companies, now and formerly, and of parties in filings."""
    ref = table(spark, sf_dir, "company_ref")
    names = ref.select(F.col("title").alias("name")).unionByName(ref.select(F.col("former_title").alias("name"))).unionByName(table(spark, sf_dir, "filing_mention").select(F.col("counterparty").alias("name")))
    # Names of companies with words that funds' names have, each read as a fund's as well.
    as_fund = names.where("name IS NOT NULL").distinct().select("name", F.explode(F.array(F.lit(""), F.lit(" ETF"), F.lit(" 2x Shares"), F.lit(" Bear"), F.lit(" -1.5x ETN"))).alias("more"))
    n = F.concat("name", "more")
    return as_fund.select(n.alias("name"), is_fund(n).alias("is_fund"), is_leveraged(n).alias("is_leveraged"))


def j2_comovement(spark, sf_dir):
    """Co-movement edges over the last 60 sessions before the last."""
    return j2_comovement_blocked(spark, sf_dir)


def j2_comovement_blocked(spark, sf_dir):
    """Co-movement edges over the last 60 sessions before the last, by products of blocks."""
    w, first = _last_window(durable(bar_panel(spark, sf_dir)), TRAIL)
    return edges_blocked(w, first=first, trail=TRAIL, min_abs_corr=0.3).select("a", "b", *_r("corr"), "n_sessions", *_r("ci_low", "ci_high", digits=7), "flag")


def a5_market_scan(spark, sf_dir):
    """Shocked symbols at the end of each month that has another session after it."""
    p = durable(bar_panel(spark, sf_dir))
    days = p.groupBy(F.trunc("d", "month").alias("m")).agg(F.max("d").alias("as_of")).select("as_of")
    return scan(p, session_ends(days, p)).select(F.date_format("as_of", "yyyy-MM-dd").alias("day"), "symbol", F.round("z", 7).alias("z"))


def g5_followers(spark, sf_dir):
    """Candidates that follow each shocked leader of the second last session by co-movement over 120 sessions."""
    p = durable(bar_panel(spark, sf_dir))
    last = p.agg(F.max("i")).first()[0] or 0
    day = p.where(F.col("i") == last - 1).select(F.col("d").alias("as_of")).distinct()
    leaders = scan(p, session_ends(day, p), trail=120)
    w = p.where((F.col("i") >= last - 121) & (F.col("i") < last - 1)).select("symbol", "i", "r")
    e = durable(edges_blocked(w, first=last - 121, trail=120, min_abs_corr=0.1))
    both = e.select("a", "b", "corr").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    up = (F.col("z") > 0) == (F.col("corr") > 0)
    return leaders.join(both, F.col("symbol") == F.col("a")).select(F.col("b").alias("follower"), F.when(up, "up").otherwise("down").alias("direction"), F.col("a").alias("origin_leader"), *_r("corr"))


def n2_neighbourhood(spark, sf_dir):
    out, _ = _run(spark, sf_dir)
    return out["edges"].select("cid", "leader", "rank", *_r("corr", "beta", digits=7))


def n4_leader_state(spark, sf_dir):
    out, _ = _run(spark, sf_dir)
    return out["moves"].select("cid", "symbol", *_r("move", "z", digits=7))


def n6_evidence(spark, sf_dir):
    out, _ = _run(spark, sf_dir)
    return out["evidence"].select("cid", "symbol", "bloc", F.bround("weight", 4).alias("weight"), "supports")


def n10_verdicts(spark, sf_dir):
    """Verdicts on the most liquid symbols' largest moves."""
    out, _ = _run(spark, sf_dir)
    return out["assessments"].select("symbol", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "direction", "verdict", "effective_evidence", "n_supporting", "n_contradicting", "neighbours")


def latest_sic(spark, sf_dir):
    """(symbol, sic): the version with the latest valid_from, then known_at, then version_id."""
    v = table(spark, sf_dir, "sic_history").select(norm_symbol(F.col("symbol")).alias("symbol"), F.struct("valid_from", "known_at", "version_id", "sic").alias("v"))
    return v.groupBy("symbol").agg(F.max("v").alias("v")).select("symbol", "v.sic")


def n7_quant(spark, sf_dir):
    """Confidence, split-half agreement and sector match of each candidate's correlations."""
    out, p = _run(spark, sf_dir)
    q = quant(out["placed"], out["edges"], p, trail=TRAIL, sic=latest_sic(spark, sf_dir))
    return q.select("cid", "n_edges", *_r("median_ci_width", "split_half_sign_agree_pct", "split_half_min_abs", "sector_match_pct", digits=6), "duplicate_count")


def n8_day_trade(spark, sf_dir):
    """Liquidity and gap share of each candidate over its last 60 bars."""
    p = durable(bar_panel(spark, sf_dir))
    b = bars(spark, sf_dir).select("symbol", F.col("date").alias("d"), F.struct("timestamp", "ingested_at").alias("t"), "open", "high", "low", "close", "dollar_vol", "trade_count")
    out = day_trade(candidates(spark, sf_dir, p), b, trail=TRAIL)
    return out.select("cid", "n_sessions", *_r("median_dollar_vol", "median_trade_count", digits=3), *_r("gap_ratio", digits=7))


def a22_market_excess(spark, sf_dir):
    """Returns less the mean of all symbols in that session."""
    p = bar_panel(spark, sf_dir).where("r IS NOT NULL")
    return p.select("symbol", "i", F.round(F.col("r") - F.avg("r").over(Window.partitionBy("i")), 8).alias("excess"))


def _standardised(p: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol")
    z = F.coalesce(F.try_divide(F.col("r") - F.avg("r").over(w), F.stddev_pop("r").over(w)), F.lit(0.0))
    return p.select("symbol", "i", z.alias("z"))


def a25_lagged_blocked(spark, sf_dir):
    """Correlation of every pair at lags of 1, 2 and 5 sessions, of 0.25 and more, by products of blocks."""
    p = durable(bar_panel(spark, sf_dir))
    n = (p.agg(F.max("i")).first()[0] or 0) + 1
    return lagged_blocked(_standardised(p), [1, 2, 5], first=0, width=n, least=0.25).select("lag", "x", "y", *_r("corr", digits=7))


def a25_lagged(spark, sf_dir):
    """The same under its first name."""
    return a25_lagged_blocked(spark, sf_dir)


def a25_lagged_all(spark, sf_dir):
    """The same at lags of 1, 2, 3, 5 and 10 sessions."""
    p = durable(bar_panel(spark, sf_dir))
    n = (p.agg(F.max("i")).first()[0] or 0) + 1
    return lagged_blocked(_standardised(p), [1, 2, 3, 5, 10], first=0, width=n, least=0.25).select("lag", "x", "y", *_r("corr", digits=7))


def w3_rolling_sigma(spark, sf_dir):
    """Deviation over the last 20 rows where all of them have returns."""
    return _rolling_sigma(spark, sf_dir, 20)


def w3_rolling_sigma_60(spark, sf_dir):
    """The same over the last 60."""
    return _rolling_sigma(spark, sf_dir, 60)


def _rolling_sigma(spark, sf_dir, rows: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(1 - rows, 0)
    p = bar_panel(spark, sf_dir).withColumn("n", F.count("r").over(w)).withColumn("sigma", F.stddev_samp("r").over(w))
    return p.where(F.col("n") == rows).select("symbol", "i", F.round("sigma", 8).alias("sigma"))


def w4_forward_sum(spark, sf_dir):
    """The sum of returns over the next 5 sessions, where all of them are there."""
    w = Window.partitionBy("symbol").orderBy("i").rangeBetween(1, 5)
    p = bar_panel(spark, sf_dir).withColumn("n", F.count("r").over(w)).withColumn("fwd", F.sum("r").over(w))
    return p.where("n = 5").select("symbol", "i", F.round("fwd", 8).alias("fwd"))


def w8_blocks(spark, sf_dir):
    """Returns compounded over blocks of 5 sessions that don't overlap."""
    p = bar_panel(spark, sf_dir).where("r > -1")
    return p.groupBy("symbol", F.floor(F.col("i") / 5).alias("block")).agg(F.round(F.exp(F.sum(F.log1p("r"))) - 1, 8).alias("ret"), F.count(F.lit(1)).alias("n"))


def e20_default_as_of(spark, sf_dir):
    return bar_panel(spark, sf_dir).agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("as_of"), F.countDistinct("d").alias("n_sessions"), F.countDistinct("symbol").alias("n_symbols"))


_FUNCS = (
    s1_bar_scan, s2_closes_panel, s5_liquid_symbols, s6_listing_filter, s7_most_liquid, p2_log_returns, p4_window_ends, p7_session_available, p10_coverage, p16_funds, j2_comovement, j2_comovement_blocked,
    a5_market_scan, g5_followers, n2_neighbourhood, n4_leader_state, n6_evidence, n10_verdicts, n7_quant, n8_day_trade, a22_market_excess, a25_lagged_all, a25_lagged, a25_lagged_blocked, w3_rolling_sigma_60, w3_rolling_sigma, w4_forward_sum, w8_blocks, e20_default_as_of,
)
#: Names of data-preparation problems are pN_...; these are the survey's, so P becomes f (filter).
QUERIES = {("f" + f.__name__[1:] if f.__name__[0] == "p" else f.__name__): f for f in _FUNCS}

BAR = """b AS (SELECT upper(trim(symbol)) AS symbol, date, timestamp AS ts, open, high, low, close, volume, trade_count, dollar_vol, ingested_at FROM bar)"""
PANEL = f"""{BAR},
closes AS (SELECT symbol, date AS d, avg(close) AS c FROM b WHERE symbol <> '' AND date IS NOT NULL GROUP BY ALL),
sess AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM closes)),
px AS (SELECT symbol, i, d, c FROM closes JOIN sess USING (d)),
p AS (SELECT x.symbol, x.i, x.d, x.c, x.c / nullif(y.c, 0) - 1 AS r, y.c AS c0 FROM px x LEFT JOIN px y ON y.symbol = x.symbol AND y.i = x.i - 1),
ns AS (SELECT count(*) AS n FROM sess)"""
CORR = "covar_pop(CASE WHEN {y} IS NOT NULL THEN {x} END, CASE WHEN {x} IS NOT NULL THEN {y} END) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"
_LIQ = "liq AS (SELECT symbol, ntile(4) OVER (ORDER BY m DESC, symbol) AS q FROM (SELECT symbol, median(dollar_vol) AS m FROM b GROUP BY 1))"
CAND = f"""{PANEL}, {_LIQ},
cand AS (SELECT symbol AS cid, symbol, d AS as_of, i, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, i) AS k FROM p WHERE r IS NOT NULL AND i >= 65 AND i <= (SELECT n FROM ns) - 2 AND symbol IN (SELECT symbol FROM liq WHERE q = 1)) WHERE k = 1)"""
_NEAR = f"""{CAND},
grid AS (SELECT cid, symbol, i + 1 AS ti, unnest(generate_series(i - 59, i)) AS j FROM cand),
own AS (SELECT g.*, p.r AS rc FROM grid g LEFT JOIN p ON p.symbol = g.symbol AND p.i = g.j),
stat AS (SELECT cid, p.symbol AS leader, {CORR.format(x='rc', y='r')} AS corr, count(r) AS n, stddev_samp(r) AS sl FROM own JOIN p ON p.i = j WHERE p.symbol NOT IN (SELECT symbol FROM cand) GROUP BY ALL),
sig AS (SELECT cid, stddev_samp(rc) AS sc FROM own GROUP BY cid),
near AS (SELECT * FROM (SELECT cid, leader, corr, corr * sl / nullif(sc, 0) AS beta, row_number() OVER (PARTITION BY cid ORDER BY round(abs(corr), 12) DESC, leader) AS rank FROM stat JOIN sig USING (cid) WHERE n >= 48 AND corr IS NOT NULL) WHERE rank <= 20)"""
_MOVES = f"""{_NEAR},
want AS (SELECT cid, leader AS s FROM near UNION SELECT cid, cid FROM near),
moves AS (SELECT * FROM (SELECT w.cid, w.s AS symbol, coalesce(sum(r) FILTER (WHERE j >= ti - 3), 0) AS move, coalesce(sum(r) FILTER (WHERE j >= ti - 3), 0) / nullif(stddev_samp(r) * sqrt(3), 0) AS z
  FROM want w JOIN grid g ON g.cid = w.cid JOIN p ON p.symbol = w.s AND p.i = g.j GROUP BY ALL) WHERE z IS NOT NULL AND (abs(z) >= 2 OR symbol = cid))"""
_EVID = f"""{_MOVES},
mv AS (SELECT m.* FROM moves m JOIN near n ON n.cid = m.cid AND n.leader = m.symbol),
mr AS (SELECT mv.cid, mv.symbol, j, r FROM mv JOIN grid g ON g.cid = mv.cid JOIN p ON p.symbol = mv.symbol AND p.i = j),
rho AS (SELECT x.cid, x.symbol AS a, y.symbol AS b2, abs({CORR.format(x='x.r', y='y.r')}) AS rho FROM mr x JOIN mr y ON x.cid = y.cid AND x.j = y.j GROUP BY ALL),
bloc AS (SELECT cid, a AS symbol, greatest(count(*) FILTER (WHERE CASE WHEN a = b2 AND rho IS NOT NULL THEN 1 ELSE rho END >= 0.7), 1) AS bloc FROM rho GROUP BY ALL),
evid AS (SELECT mv.cid, mv.symbol, z, bloc, 1.0 / bloc AS weight, (z * (CASE WHEN direction = 'up' THEN 1 ELSE -1 END) > 0) AND coalesce(abs((SELECT z FROM moves o WHERE o.cid = mv.cid AND o.symbol = mv.cid)), 0) < abs(z) AS supports
  FROM mv JOIN bloc USING (cid, symbol) JOIN cand USING (cid))"""
_ENDS = f"""{PANEL}, days AS (SELECT DISTINCT filing_date AS d FROM filing_mention WHERE filing_date IS NOT NULL),
ends AS (SELECT d, (SELECT count(*) FROM sess s WHERE s.d <= days.d) AS ti, (SELECT count(*) FROM sess s WHERE s.d < days.d) AS tx, (SELECT n FROM ns) AS n FROM days)"""
_EDGES = f"""{PANEL}, win AS (SELECT symbol, i, r FROM p, ns WHERE i >= n - 61 AND i < n - 1),
e AS (SELECT x.symbol AS a, y.symbol AS b, {CORR.format(x='CASE WHEN abs(x.r) <= 10 THEN x.r END', y='CASE WHEN abs(y.r) <= 10 THEN y.r END')} AS corr, count(*) FILTER (WHERE abs(x.r) <= 10 AND abs(y.r) <= 10) AS n_sessions, count(*) FILTER (WHERE x.r = y.r) / 60.0 AS same
  FROM win x JOIN win y ON x.i = y.i AND x.symbol < y.symbol GROUP BY ALL)
SELECT a, b, round(corr, 8) AS corr, n_sessions, CASE WHEN n_sessions > 3 THEN round(tanh(atanh(least(greatest(corr, -(1 - 1e-15)), 1 - 1e-15)) - 1.96 / sqrt(n_sessions - 3)), 7) END AS ci_low,
  CASE WHEN n_sessions > 3 THEN round(tanh(atanh(least(greatest(corr, -(1 - 1e-15)), 1 - 1e-15)) + 1.96 / sqrt(n_sessions - 3)), 7) END AS ci_high, CASE WHEN same > 0.5 THEN 'duplicate_series' END AS flag FROM e WHERE abs(corr) >= 0.3"""
SCAN = """scan AS (SELECT symbol, day, sum0 / nullif(sd * sqrt(3), 0) AS z FROM (
  SELECT p.symbol, a.d AS day, coalesce(sum(r) FILTER (WHERE p.i >= a.ti - 3), 0) AS sum0, stddev_samp(r) FILTER (WHERE p.i < a.ti - 3) AS sd FROM p JOIN pit a ON p.i BETWEEN a.ti - 3 - {trail} AND a.ti - 1 GROUP BY ALL))"""

_FUND_SQL = r"(?i)\b(etfs?|etns?|trusts?|funds?|shares?|proshares|direxion|microsectors|graniteshares|tidal|themes|tradr|defiance)\b"
_LEVERAGE_SQL = r"(?i)(\b[0-9]+([.][0-9]+)?x\b|-[0-9]+([.][0-9]+)?x\b|\b(bull|bear|inverse|leveraged|short)\b|\bultra[0-9a-z_]*\b)"
ORACLE = {
    "s1_bar_scan": "SELECT symbol, date, close, volume FROM bar WHERE date BETWEEN DATE '2024-11-01' AND DATE '2024-11-30'",
    "s2_closes_panel": f"WITH {PANEL} SELECT symbol, strftime(d, '%Y-%m-%d') AS day, i, round(c, 6) AS close, round(r, 8) AS ret FROM p",
    "s5_liquid_symbols": f"WITH {BAR} SELECT symbol FROM b GROUP BY 1 HAVING median(dollar_vol) >= 10000000 UNION SELECT upper(trim(symbol)) FROM news_symbol WHERE upper(trim(symbol)) IN (SELECT ticker FROM company_ref)",
    "s6_listing_filter": "SELECT ticker, exchange FROM company_ref WHERE exchange IN ('NYSE', 'NASDAQ', 'ARCA') AND ticker NOT LIKE '%.%' AND ticker NOT LIKE '%/%'",
    "s7_most_liquid": rf"WITH {BAR} SELECT symbol, round(median(dollar_vol), 0) AS median_dollar_vol FROM b WHERE symbol NOT IN (SELECT ticker FROM company_ref WHERE regexp_matches(title, '{_FUND_SQL}')) GROUP BY 1 ORDER BY median(dollar_vol) DESC NULLS LAST, symbol LIMIT 50",
    "f2_log_returns": f"WITH {PANEL} SELECT symbol, i, round(ln(c) - ln(c0), 8) AS log_ret FROM p WHERE c IS NOT NULL AND c0 IS NOT NULL",
    "f4_window_ends": f"WITH {_ENDS} SELECT strftime(d, '%Y-%m-%d') AS day, ti, tx, n FROM ends",
    "f7_session_available": f"WITH {_ENDS}, w AS (SELECT d, CASE WHEN ti = tx THEN format('{{}} not found in data (last session available: {{}})', d, (SELECT max(d) FROM sess)) WHEN tx < 60 THEN format('only {{}} sessions precede {{}}, need 60', tx, d) ELSE '' END AS reason FROM ends) SELECT strftime(d, '%Y-%m-%d') AS day, reason = '' AS ok, reason FROM w",
    "f10_coverage": f"WITH {PANEL} SELECT symbol, count(r) AS n_returns FROM p GROUP BY 1 HAVING count(r) >= 0.9 * (SELECT n FROM ns)",
    "f16_funds": rf"WITH n AS (SELECT title AS name FROM company_ref UNION SELECT former_title FROM company_ref UNION SELECT counterparty FROM filing_mention), x AS (SELECT name || more AS name FROM n, (SELECT unnest(['', ' ETF', ' 2x Shares', ' Bear', ' -1.5x ETN']) AS more) WHERE name IS NOT NULL) SELECT name, regexp_matches(name, '{_FUND_SQL}') AS is_fund, regexp_matches(name, '{_FUND_SQL}') AND regexp_matches(name, '{_LEVERAGE_SQL}') AS is_leveraged FROM x",
    "j2_comovement": f"WITH {_EDGES}",
    "j2_comovement_blocked": f"WITH {_EDGES}",
    "a5_market_scan": f"WITH {PANEL}, pit AS (SELECT max(d) AS d, max(i) + 1 AS ti FROM sess GROUP BY date_trunc('month', d) HAVING max(i) + 1 < (SELECT n FROM ns) AND max(i) + 1 >= 63), {SCAN.format(trail=60)} SELECT strftime(day, '%Y-%m-%d') AS day, symbol, round(z, 7) AS z FROM scan WHERE abs(z) >= 2",
    "g5_followers": f"""WITH {PANEL}, pit AS (SELECT d, i + 1 AS ti FROM sess WHERE i = (SELECT n FROM ns) - 2 AND i + 1 >= 123), {SCAN.format(trail=120)},
win AS (SELECT symbol, i, CASE WHEN abs(r) <= 10 THEN r END AS r FROM p, ns WHERE i >= n - 122 AND i < n - 2),
e AS (SELECT x.symbol AS a, y.symbol AS b, {CORR.format(x='x.r', y='y.r')} AS corr FROM win x JOIN win y ON x.i = y.i AND x.symbol <> y.symbol GROUP BY ALL)
SELECT b AS follower, CASE WHEN (z > 0) = (corr > 0) THEN 'up' ELSE 'down' END AS direction, a AS origin_leader, round(corr, 8) AS corr FROM scan JOIN e ON e.a = symbol WHERE abs(z) >= 2 AND abs(corr) >= 0.1""",
    "n2_neighbourhood": f"WITH {_NEAR} SELECT cid, leader, rank, round(corr, 7) AS corr, round(beta, 7) AS beta FROM near",
    "n4_leader_state": f"WITH {_MOVES} SELECT cid, symbol, round(move, 7) AS move, round(z, 7) AS z FROM moves",
    "n6_evidence": f"WITH {_EVID} SELECT cid, symbol, bloc, round_even(weight, 4) AS weight, supports FROM evid",
    "n10_verdicts": f"""WITH {_EVID}, s AS (SELECT cid, round_even(sum(weight), 3) AS eff, sum(CASE WHEN supports THEN CAST(round_even(weight, 4) AS DECIMAL(12,4)) ELSE 0 END) AS pro, sum(CASE WHEN supports THEN 0 ELSE CAST(round_even(weight, 4) AS DECIMAL(12,4)) END) AS con,
  count(*) FILTER (WHERE supports) AS np, count(*) FILTER (WHERE NOT supports) AS nc FROM evid GROUP BY cid)
SELECT c.symbol, strftime(as_of, '%Y-%m-%d') AS as_of, direction, CASE WHEN coalesce(eff, 0) < 1 THEN 'neutral' WHEN pro > con THEN 'corroborated' WHEN con > pro THEN 'contradicted' ELSE 'neutral' END AS verdict, coalesce(eff, 0.0) AS effective_evidence,
  coalesce(np, 0) AS n_supporting, coalesce(nc, 0) AS n_contradicting, k.neighbours FROM cand c JOIN (SELECT cid, count(*) AS neighbours FROM near GROUP BY 1) k USING (cid) LEFT JOIN s USING (cid)""",
    "n7_quant": f"""WITH {_NEAR}, sic AS (SELECT symbol, sic FROM (SELECT upper(trim(symbol)) AS symbol, sic, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY valid_from DESC, known_at DESC, version_id DESC) AS k FROM sic_history) WHERE k = 1),
g2 AS (SELECT n.cid, n.leader, n.corr, c.i AS tx, unnest(generate_series(c.i - 60, c.i - 1)) AS j FROM near n JOIN cand c USING (cid)),
h AS (SELECT g2.cid, g2.leader, any_value(corr) AS corr, count(*) FILTER (WHERE x.r = y.r) / 60.0 > 0.5 AS dup, {CORR.format(x='CASE WHEN j < tx - 30 THEN x.r END', y='CASE WHEN j < tx - 30 THEN y.r END')} AS h1, {CORR.format(x='CASE WHEN j >= tx - 30 THEN x.r END', y='CASE WHEN j >= tx - 30 THEN y.r END')} AS h2
  FROM g2 LEFT JOIN p x ON x.symbol = g2.cid AND x.i = j LEFT JOIN p y ON y.symbol = g2.leader AND y.i = j GROUP BY g2.cid, g2.leader),
q AS (SELECT h.*, tanh(atanh(least(greatest(corr, -(1 - 1e-15)), 1 - 1e-15)) + 1.96 / sqrt(57)) - tanh(atanh(least(greatest(corr, -(1 - 1e-15)), 1 - 1e-15)) - 1.96 / sqrt(57)) AS width, so.sic AS own_sic, sl.sic AS sic FROM h LEFT JOIN sic so ON so.symbol = cid LEFT JOIN sic sl ON sl.symbol = leader)
SELECT cand.cid, count(leader) AS n_edges, round(median(width), 6) AS median_ci_width, count(*) FILTER (WHERE dup) AS duplicate_count, round(avg(CASE WHEN leader IS NULL THEN NULL WHEN sign(h1) = sign(h2) THEN 1 ELSE 0 END) * 100, 6) AS split_half_sign_agree_pct,
  round(median(CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN least(abs(h1), abs(h2)) END), 6) AS split_half_min_abs, CASE WHEN max(own_sic) IS NOT NULL THEN round(avg(CASE WHEN leader IS NULL THEN NULL WHEN sic[1:2] = own_sic[1:2] THEN 1 ELSE 0 END) * 100, 6) END AS sector_match_pct
FROM cand LEFT JOIN q USING (cid) GROUP BY cand.cid""",
    "n8_day_trade": f"""WITH {CAND}, g AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts, ingested_at) AS prior FROM b),
w AS (SELECT * FROM (SELECT cid, g.*, row_number() OVER (PARTITION BY cid ORDER BY ts DESC, ingested_at DESC) AS k FROM cand JOIN g USING (symbol) WHERE g.date < as_of) WHERE k <= 60)
SELECT cid, count(w.symbol) AS n_sessions, round(median(dollar_vol), 3) AS median_dollar_vol, round(median(trade_count), 3) AS median_trade_count, round(sum(abs(open - prior)) / nullif(sum(abs(open - prior)) + sum(abs(high - low)), 0), 7) AS gap_ratio FROM cand LEFT JOIN w USING (cid) GROUP BY cid""",
    "a22_market_excess": f"WITH {PANEL} SELECT symbol, i, round(r - avg(r) OVER (PARTITION BY i), 8) AS excess FROM p WHERE r IS NOT NULL",
    "a25_lagged": f"""WITH {PANEL}, z AS (SELECT symbol, i, coalesce((r - avg(r) OVER (PARTITION BY symbol)) / nullif(stddev_pop(r) OVER (PARTITION BY symbol), 0), 0) AS z FROM p)
SELECT lag, x.symbol AS x, y.symbol AS y, round(sum(x.z * y.z) / count(*), 7) AS corr FROM z x JOIN (SELECT unnest([1, 2, 5]) AS lag) l ON true JOIN z y ON y.i = x.i + lag AND y.symbol <> x.symbol GROUP BY ALL HAVING abs(sum(x.z * y.z) / count(*)) >= 0.25""",
    "w3_rolling_sigma": f"WITH {PANEL}, t AS (SELECT symbol, i, count(r) OVER w AS n, stddev_samp(r) OVER w AS s FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)) SELECT symbol, i, round(s, 8) AS sigma FROM t WHERE n = 20",
    "w4_forward_sum": f"WITH {PANEL} SELECT x.symbol, x.i, round(sum(y.r), 8) AS fwd FROM p x JOIN p y ON y.symbol = x.symbol AND y.i BETWEEN x.i + 1 AND x.i + 5 GROUP BY ALL HAVING count(y.r) = 5",
    "w8_blocks": f"WITH {PANEL} SELECT symbol, i // 5 AS block, round(exp(sum(ln(1 + r))) - 1, 8) AS ret, count(*) AS n FROM p WHERE r > -1 GROUP BY ALL",
    "e20_default_as_of": f"WITH {PANEL} SELECT strftime(max(d), '%Y-%m-%d') AS as_of, count(DISTINCT d) AS n_sessions, count(DISTINCT symbol) AS n_symbols FROM p",
}
ORACLE["a25_lagged_blocked"] = ORACLE["a25_lagged"]
ORACLE["w3_rolling_sigma_60"] = ORACLE["w3_rolling_sigma"].replace("ROWS 19 PRECEDING", "ROWS 59 PRECEDING").replace("n = 20", "n = 60")
ORACLE["a25_lagged_all"] = ORACLE["a25_lagged"].replace("[1, 2, 5]", "[1, 2, 3, 5, 10]")
_VERDICT = f"""{_EVID}, sm AS (SELECT cid, round_even(sum(weight), 3) AS eff, sum(CASE WHEN supports THEN CAST(round_even(weight, 4) AS DECIMAL(12,4)) ELSE 0 END) AS pro, sum(CASE WHEN supports THEN 0 ELSE CAST(round_even(weight, 4) AS DECIMAL(12,4)) END) AS con,
  count(*) FILTER (WHERE supports) AS np, count(*) FILTER (WHERE NOT supports) AS nc FROM evid GROUP BY cid),
vd AS (SELECT c.*, CASE WHEN coalesce(eff, 0) < 1 THEN 'neutral' WHEN pro > con THEN 'corroborated' WHEN con > pro THEN 'contradicted' ELSE 'neutral' END AS verdict, coalesce(eff, 0.0) AS eff, coalesce(np, 0) AS np, coalesce(nc, 0) AS nc FROM cand c JOIN (SELECT DISTINCT cid FROM near) USING (cid) LEFT JOIN sm USING (cid))"""
