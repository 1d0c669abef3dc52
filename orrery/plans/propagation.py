"""Composite analyses of how moves travel: along hops, chains, co-mentions, and over horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import evidence as ev
from orrery.operators import statistics as st
from orrery.operators.comovement import lagged_pearson
from orrery.operators.panel import pinned_split
from orrery.plans.market import CORR, PANEL, _MOVES, _VERDICT, bar_panel, candidates
from orrery.plans.relations import _SUPPLY, _TAGS, _pmi_sql, dated_tags, pmi_edges, supply_edges
from orrery.plans.tests_of_relations import _EX, _SLOPE, excess, halves, lagged_pairs
from orrery.sources.durable import durable


def hop_map(edges: DataFrame) -> DataFrame:
    """(lead, member, hop, since): suppliers one and two steps behind each customer, and since when the whole way is known.

    A member of the first step is none of the second, nor is the lead itself;
    of several ways the one known earliest counts.
    """
    e = edges.groupBy("src", "dst").agg(F.min("day").alias("day")).where("src <> dst")
    one = e.select(F.col("dst").alias("lead"), F.col("src").alias("member"), F.lit(1).alias("hop"), F.col("day").alias("since"))
    two = one.join(e.select(F.col("dst").alias("member"), F.col("src").alias("far"), "day"), "member").where("far <> lead")
    two = two.groupBy("lead", F.col("far").alias("member")).agg(F.min(F.greatest("since", "day")).alias("since")).join(one.select("lead", "member"), ["lead", "member"], "left_anti")
    return one.unionByName(two.select("lead", "member", F.lit(2).alias("hop"), "since"))


def j9_hop_map(spark, sf_dir):
    return hop_map(durable(supply_edges(spark, sf_dir))).select("lead", "member", "hop", F.date_format("since", "yyyy-MM-dd").alias("since"))


def shocks_after(spark, sf_dir, sigma: float = 2.0, window: int = 20) -> DataFrame:
    """(symbol, i, d, x, z): excess returns of ``sigma`` and more deviations of the ``window`` sessions before."""
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(-window, -1)
    e = excess(spark, sf_dir).withColumn("n", F.count("x").over(w)).withColumn("s", F.stddev_samp("x").over(w))
    # A deviation under a thousandth is a symbol that hardly trades.
    return e.where((F.col("n") == window) & (F.col("s") >= 1e-3)).withColumn("z", F.col("x") / F.col("s")).where(F.abs("z") >= sigma).select("symbol", "i", "d", "x", "z")


def moves_after(spark, sf_dir, sigma: float = 2.0, move: int = 3, trail: int = 60) -> DataFrame:
    """(symbol, i, d, x, z): excess returns over ``move`` sessions up to i of ``sigma`` and more deviations of the ``trail`` sessions before these.

    All sessions of both windows must have returns. Moves end every ``move``
    sessions, so that none is counted twice.
    """
    w = Window.partitionBy("symbol").orderBy("i")
    recent, before = w.rangeBetween(1 - move, 0), w.rangeBetween(1 - move - trail, -move)
    e = excess(spark, sf_dir).withColumns({"m": F.sum("x").over(recent), "k": F.count("x").over(recent), "n": F.count("x").over(before), "s": F.stddev_samp("x").over(before)})
    z = F.col("x") / (F.col("s") * F.sqrt(F.lit(float(move))))
    e = e.where((F.col("k") == move) & (F.col("n") == trail) & (F.col("s") >= 1e-3) & (F.col("i") % move == move - 1)).withColumn("x", F.col("m"))
    return e.withColumn("z", z).where(F.abs("z") >= sigma).select("symbol", "i", "d", "x", "z")


def _hop_rows(spark, sf_dir, shocks=shocks_after, horizons=(1, 5)) -> DataFrame:
    """(lead, member, hop, h, i, x, y): a lead's shock and the sum of a member's excess returns over the next h sessions."""
    m = durable(hop_map(durable(supply_edges(spark, sf_dir))))
    s = shocks(spark, sf_dir).withColumnRenamed("symbol", "lead")
    e = excess(spark, sf_dir).select(F.col("symbol").alias("member"), F.col("i").alias("j"), F.col("x").alias("y"))
    hit = m.join(s, "lead").where(F.col("since") <= F.col("d")).select("lead", "member", "hop", "i", "x", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    j = hit.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("h")))).join(e, ["member", "j"])
    return j.groupBy("lead", "member", "hop", "h", "i", "x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).where("n = h")


def e10_hop_horizon(spark, sf_dir):
    """Slope of suppliers' returns over 1 and 5 sessions on their customer's shock, by hops away."""
    return st.slopes(_hop_rows(spark, sf_dir), "x", "y", ["hop", "h"]).select("hop", "h", "n", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def e10_hop_horizons(spark, sf_dir):
    """Slope of suppliers' returns over 1, 2, 3, 5 and 10 sessions on their customer's move of 3 sessions, by hops away."""
    rows = _hop_rows(spark, sf_dir, moves_after, (1, 2, 3, 5, 10))
    return st.slopes(rows, "x", "y", ["hop", "h"]).select("hop", "h", "n", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def e10_interaction(spark, sf_dir):
    """Regression of those returns on shock, hop, and both, with errors clustered by session."""
    r = durable(_hop_rows(spark, sf_dir).where("h = 5").withColumn("second", (F.col("hop") - 1).cast("double")).withColumn("x_second", F.col("x") * F.col("second")))
    fit = st.ols(r, "y", ["x", "second", "x_second"], "i")
    return spark.createDataFrame([(k, *map(float, v)) for k, v in fit.items()], "term string, coef double, se double")


def e1_threshold_test(spark, sf_dir):
    """Whether neighbours that moved 2 deviations while the candidate stayed under 0.5 foretell its next 10 sessions."""
    p = durable(bar_panel(spark, sf_dir))
    out = ev.run(candidates(spark, sf_dir, p), p, spark.createDataFrame([], "symbol string"))
    z = out["moves"].join(out["placed"].select("cid", F.col("symbol").alias("own"), "ti", "direction"), "cid")
    f = z.groupBy("cid", "own", "ti", "direction").agg(F.max(F.when(F.col("symbol") != F.col("own"), F.abs("z"))).alias("near"), F.max(F.when(F.col("symbol") == F.col("own"), F.abs("z"))).alias("mine"))
    fwd = p.select(F.col("symbol").alias("own"), "i", "r")
    y = f.join(fwd, "own").where((F.col("i") >= F.col("ti")) & (F.col("i") < F.col("ti") + 10)).groupBy("cid", "near", "mine", "direction").agg(F.sum("r").alias("fwd"))
    flag = F.coalesce((F.col("near") >= 2) & (F.col("mine") < 0.5), F.lit(False))
    won = (F.col("fwd") > 0) == (F.col("direction") == "up")
    g = y.select(flag.alias("f"), won.cast("double").alias("w"))
    a = g.agg(F.count_if("f").alias("n1"), F.avg(F.when(F.col("f"), F.col("w"))).alias("p1"), F.count_if(~F.col("f")).alias("n0"), F.avg(F.when(~F.col("f"), F.col("w"))).alias("p0"))
    zt, mde = st.proportion_test(F.expr("nullif(n1, 0)").cast("double"), F.col("p1"), F.expr("nullif(n0, 0)").cast("double"), F.col("p0"))
    return a.select("n1", F.round("p1", 8).alias("p1"), "n0", F.round("p0", 8).alias("p0"), F.round(zt, 6).alias("z"), F.round(mde, 8).alias("least_detectable"))


def _verdict_rows(spark, sf_dir) -> DataFrame:
    """(cid, as_of, verdict, h, s): each candidate's excess return over the next h sessions, signed by its direction."""
    p = durable(bar_panel(spark, sf_dir))
    out = ev.run(candidates(spark, sf_dir, p), p, spark.createDataFrame([], "symbol string"))
    a = out["assessments"].select("cid", "symbol", "as_of", "direction", "verdict").join(out["placed"].select("cid", "ti"), "cid")
    e = excess(spark, sf_dir).select("symbol", "i", "x")
    h = a.withColumn("h", F.explode(F.array(*map(F.lit, (2, 5, 10, 21)))))
    y = h.join(e, "symbol").where((F.col("i") >= F.col("ti")) & (F.col("i") < F.col("ti") + F.col("h"))).groupBy("cid", "as_of", "verdict", "direction", "h").agg(F.sum("x").alias("x"))
    return y.select("cid", "as_of", "verdict", "h", F.when(F.col("direction") == "up", F.col("x")).otherwise(-F.col("x")).alias("s"))


def e3_verdict_returns(spark, sf_dir):
    """Mean excess return over 2, 5, 10 and 21 sessions after each verdict, signed by the candidate's direction."""
    return _verdict_rows(spark, sf_dir).groupBy("verdict", "h").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 8).alias("mean_excess"))


def e3_verdict_gap(spark, sf_dir):
    """How much more corroborated candidates return than contradicted ones over 2, 5, 10 and 21 sessions, signed by their direction, with errors clustered by date."""
    rows = _verdict_rows(spark, sf_dir).where(F.col("verdict").isin("corroborated", "contradicted"))
    rows = rows.withColumn("yes", (F.col("verdict") == "corroborated").cast("double"))
    fit = st.clustered_slopes(rows, "yes", "s", "as_of", ["h"])
    return fit.select("h", "n", F.round("slope", 8).alias("gap"), F.round("se", 8).alias("se"), F.round(F.try_divide(F.col("slope"), F.when(F.col("se") > 1e-9, F.col("se"))), 4).alias("z"))


def month_pmi(tags: DataFrame, months: DataFrame, *, min_pair: int, min_freq: int) -> DataFrame:
    """(m, a, b, pmi): scores as they stood at the start of each month of ``months`` (m), by articles of before."""
    t = durable(tags.select("article_id", "symbol", "day"))
    pairs = t.select("article_id", F.col("symbol").alias("a"), "day").join(t.select("article_id", F.col("symbol").alias("b")), "article_id").where("a < b")
    total = t.select("article_id", "day").distinct()
    # Counts by month of the article first; each start of a month then sums the months before it.
    def until(df: DataFrame, *keys: str, name: str) -> DataFrame:
        n = df.groupBy(*keys, F.trunc("day", "month").alias("own")).agg(F.count(F.lit(1)).alias("n"))
        return n.join(F.broadcast(months), F.col("own") < F.col("m")).groupBy("m", *keys).agg(F.sum("n").cast("double").alias(name))

    ab = until(pairs, "a", "b", name="n_ab").where(F.col("n_ab") >= min_pair)
    one = durable(until(t, "symbol", name="n").where(F.col("n") >= min_freq))
    all_ = until(total, name="total")
    j = ab.join(one.select("m", F.col("symbol").alias("a"), F.col("n").alias("n_a")), ["m", "a"]).join(one.select("m", F.col("symbol").alias("b"), F.col("n").alias("n_b")), ["m", "b"]).join(F.broadcast(all_), "m")
    return j.select("m", "a", "b", F.round(F.log(F.col("n_ab") * F.col("total") / (F.col("n_a") * F.col("n_b"))), 4).alias("pmi"))


def _months(spark, sf_dir) -> DataFrame:
    return bar_panel(spark, sf_dir).select(F.trunc("d", "month").alias("m")).distinct()


def j18_month_pmi(spark, sf_dir):
    """Co-mention scores frozen at the start of every month with sessions."""
    out = month_pmi(dated_tags(spark, sf_dir), _months(spark, sf_dir), min_pair=5, min_freq=10)
    return out.select(F.date_format("m", "yyyy-MM-dd").alias("month"), "a", "b", "pmi")


def _comention_rows(spark, sf_dir) -> DataFrame:
    """(symbol, i, year, x, y): the mean excess return of a symbol's 20 best co-mention partners of that month, and its own in the next session."""
    s = durable(month_pmi(dated_tags(spark, sf_dir), _months(spark, sf_dir), min_pair=5, min_freq=10))
    both = s.select("m", F.col("a").alias("symbol"), F.col("b").alias("partner"), "pmi").unionByName(s.select("m", F.col("b").alias("symbol"), F.col("a").alias("partner"), "pmi"))
    k = F.row_number().over(Window.partitionBy("m", "symbol").orderBy(F.col("pmi").desc(), "partner"))
    best = both.withColumn("k", k).where("k <= 20")
    e = durable(excess(spark, sf_dir))
    x = best.join(e.select(F.col("symbol").alias("partner"), "i", F.trunc("d", "month").alias("m"), "x"), ["m", "partner"]).groupBy("symbol", "i").agg(F.avg("x").alias("x"))
    y = e.select("symbol", (F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    year = e.select("i", F.year("d").alias("year")).distinct()
    return x.join(y, ["symbol", "i"]).join(year, "i")


def e7_comention_lead(spark, sf_dir):
    """Slope of a symbol's next-session excess return on the mean of its 20 best co-mention partners of that month."""
    return st.slopes(_comention_rows(spark, sf_dir), "x", "y").select("n", F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"))


def e7_comention_years(spark, sf_dir):
    """The same by year, pooled by inverse variance, with their heterogeneity."""
    out = st.pooled(st.slopes(_comention_rows(spark, sf_dir), "x", "y", ["year"]), "slope", "se")
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("pooled", "se", "q", "i2")])


def e9_chains(spark, sf_dir, top=100):
    """Chains x, y, z of the strongest one-session correlations of the first half, and how x leads z by two in the second."""
    first, second, half = halves(spark, sf_dir)
    legs = durable(lagged_pearson(first, [1], first=0, width=half, top=top, min_n=30, block=512).where("c IS NOT NULL"))
    chains = durable(legs.select("x", "y", F.col("c").alias("c1")).join(legs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("c").alias("c2")), "y").where("z <> x"))
    # Only the chains' own ends are asked for in the second half.
    pairs = chains.select("x", F.col("z").alias("y"), F.lit(2).alias("lag")).distinct()
    later = lagged_pairs(pairs, second).where("n >= 30 AND c IS NOT NULL").select("x", F.col("y").alias("z"), F.col("c").alias("c3"))
    return chains.join(later, ["x", "z"]).agg(F.count(F.lit(1)).alias("n_chains"), F.count_if(F.signum(F.col("c1") * F.col("c2")) == F.signum("c3")).alias("n_agree"), F.round(F.avg(F.abs("c3")), 7).alias("mean_abs"))


def _draw(k, salt: str):
    """A number of 32 bits that ``k`` gives."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), k.cast("string"))), 1, 8), 16, 10).cast("long")


def e9_lag_chains(spark, sf_dir, top=300):
    """Whether x leads z by three sessions alike in both halves, for chains of the ``top`` links x, y at lag 1 and y, z at lag 2 of the first, and for as many random pairs.

    ``p`` is that of as many agreeing signs of chains or more by chance. Pairs
    without a correlation in both halves (30 sessions at least) aren't tested.
    """
    first, second, half = halves(spark, sf_dir)
    legs = durable(lagged_pearson(first, [1, 2], first=0, width=half, top=top, min_n=30).where("c IS NOT NULL"))
    one, two = legs.where("lag = 1").select("x", "y"), legs.where("lag = 2").select(F.col("x").alias("y"), F.col("y").alias("z"))
    chains = one.join(two, "y").where("z <> x").select(F.lit("chain").alias("kind"), "x", F.col("z").alias("y"))
    names = first.union(second).where("r IS NOT NULL").select("symbol").distinct().withColumn("at", F.row_number().over(Window.orderBy("symbol")) - 1)  # a list of symbols is small
    m = names.agg(F.count(F.lit(1)).alias("m")).first()[0]
    n = chains.count()
    k = F.col("id")
    at = F.pmod(_draw(k, "x"), F.lit(max(m, 1)))
    draws = spark.range(n if m > 1 else 0).select(at.alias("at"), F.pmod(at + 1 + F.pmod(_draw(k, "z"), F.lit(max(m - 1, 1))), F.lit(max(m, 1))).alias("to"))
    random = draws.join(names.withColumnRenamed("symbol", "x"), "at").join(names.select(F.col("at").alias("to"), F.col("symbol").alias("y")), "to").select(F.lit("random").alias("kind"), "x", "y")
    both = durable(chains.unionByName(random).withColumn("lag", F.lit(3)))
    pairs = both.select("x", "y", "lag").distinct()
    c = lambda p, name: lagged_pairs(pairs, p).where("n >= 30").select("x", "y", F.col("c").alias(name))
    t = both.join(c(first, "c1"), ["x", "y"], "left").join(c(second, "c2"), ["x", "y"], "left")
    ok = F.col("c1").isNotNull() & F.col("c2").isNotNull()
    per = t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_tested"), F.count_if(F.signum("c1") == F.signum("c2")).alias("n_agree"), F.round(F.avg(F.when(ok, F.abs("c1"))), 7).alias("mean_first"), F.round(F.avg(F.when(ok, F.abs("c2"))), 7).alias("mean_second"))
    rows = [(*r, round(st.binomial_greater(r.n_agree, r.n_tested), 9)) for r in per.collect()]  # two
    return spark.createDataFrame(rows, "kind string, n long, n_tested long, n_agree long, mean_first double, mean_second double, p double")


def e11_shock_partners(spark, sf_dir):
    """Next-session excess return, signed by the shock, of suppliers of shocked customers against that of all others that day."""
    return _partners(spark, sf_dir, shocks_after(spark, sf_dir))


def e11_move_partners(spark, sf_dir):
    """The same after moves of 3 sessions."""
    return _partners(spark, sf_dir, moves_after(spark, sf_dir))


def _partners(spark, sf_dir, s: DataFrame) -> DataFrame:
    first = supply_edges(spark, sf_dir).groupBy("src", "dst").agg(F.min("day").alias("first")).where("src <> dst")
    e = durable(excess(spark, sf_dir))
    nxt = e.select("symbol", (F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    hit = s.select(F.col("symbol").alias("dst"), "i", "d", F.signum("z").alias("sg")).join(first, "dst").where(F.col("first") <= F.col("d"))
    part = hit.join(nxt.withColumnRenamed("symbol", "src"), ["src", "i"]).groupBy("i", "dst", "sg").agg(F.avg("y").alias("yp"))
    every = nxt.groupBy("i").agg(F.avg("y").alias("ya"))
    d = part.join(every, "i").select("i", (F.col("sg") * (F.col("yp") - F.col("ya"))).alias("diff"))
    return st.clustered_mean(d, "diff", "i").select(F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"), "n", "n_clusters")


def w7_growth(spark, sf_dir):
    """What 1 put into each symbol at its first return has become by each session."""
    w = Window.partitionBy("symbol").orderBy("i")
    return bar_panel(spark, sf_dir).where("r > -1").select("symbol", "i", F.round(F.exp(F.sum(F.log1p("r")).over(w)), 6).alias("growth"))


def f17_liquid_sigma(spark, sf_dir):
    """Symbols whose returns deviate by a thousandth and more."""
    return bar_panel(spark, sf_dir).groupBy("symbol").agg(F.stddev_samp("r").alias("s")).where("s >= 1e-3").select("symbol", F.round("s", 8).alias("sigma"))


def f18_split(spark, sf_dir):
    """Sessions and returns before and from the first session of the second half of 2024 on, or an error if the data can't be split there."""
    p = durable(bar_panel(spark, sf_dir))
    start = p.where(F.col("d") >= "2024-07-01").agg(F.min("d")).first()[0]
    first, second = pinned_split(p, start)
    part = lambda df, name: df.agg(F.lit(name).alias("part"), F.countDistinct("i").alias("n_sessions"), F.count("r").alias("n_returns"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"))
    return part(first, "discovery").unionByName(part(second, "validation")).where("n_sessions > 0")


_FUNCS = (j9_hop_map, e10_hop_horizon, e10_hop_horizons, e10_interaction, e1_threshold_test, e3_verdict_returns, e3_verdict_gap, j18_month_pmi, e7_comention_lead, e7_comention_years, e9_chains, e9_lag_chains, e11_shock_partners, e11_move_partners, w7_growth, f17_liquid_sigma, f18_split)
QUERIES = {f.__name__: f for f in _FUNCS}
_HOP = """fe AS (SELECT src, dst, min(day) AS day FROM sup WHERE src <> dst GROUP BY ALL), h1 AS (SELECT dst AS lead, src AS member, 1 AS hop, day AS since FROM fe),
h2 AS (SELECT h1.lead, fe.src AS member, 2 AS hop, min(greatest(h1.since, fe.day)) AS since FROM h1 JOIN fe ON fe.dst = h1.member AND fe.src <> h1.lead WHERE NOT EXISTS (SELECT 1 FROM h1 q WHERE q.lead = h1.lead AND q.member = fe.src) GROUP BY ALL),
hop AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""
_SHOCK = """sh AS (SELECT symbol, i, d, x, x / s AS z FROM (SELECT *, count(x) OVER w AS n, stddev_samp(x) OVER w AS s FROM ex WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE n = 20 AND s >= 1e-3 AND abs(x / s) >= 2)"""
_MOVE = """sh AS (SELECT symbol, i, d, m AS x, m / (s * sqrt(3)) AS z FROM (SELECT *, sum(x) OVER v AS m, count(x) OVER v AS k, count(x) OVER w AS n, stddev_samp(x) OVER w AS s FROM ex
  WINDOW v AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN 62 PRECEDING AND 3 PRECEDING)) WHERE k = 3 AND n = 60 AND s >= 1e-3 AND i % 3 = 2 AND abs(m / (s * sqrt(3))) >= 2)"""
_MONTH = """mo AS (SELECT DISTINCT date_trunc('month', d) AS m FROM sess),
one AS (SELECT m, symbol, CAST(count(*) AS DOUBLE) AS n FROM dt JOIN mo ON day < m GROUP BY ALL HAVING count(*) >= 10), tot AS (SELECT m, CAST(count(DISTINCT article_id) AS DOUBLE) AS t FROM dt JOIN mo ON day < m GROUP BY ALL),
ab AS (SELECT m, x.symbol AS a, y.symbol AS b, CAST(count(*) AS DOUBLE) AS n FROM dt x JOIN dt y ON x.article_id = y.article_id AND x.symbol < y.symbol JOIN mo ON x.day < m GROUP BY ALL HAVING count(*) >= 5),
mp AS (SELECT m, a, b, round(ln(ab.n * t / (oa.n * ob.n)), 4) AS pmi FROM ab JOIN one oa USING (m) JOIN one ob USING (m) JOIN tot USING (m) WHERE oa.symbol = a AND ob.symbol = b)"""
_SL = "count(*) AS n, round(covar_pop(y, x) / nullif(var_pop(x), 0), 7) AS slope, CASE WHEN count(*) > 2 THEN round(sqrt(greatest((var_pop(y) * count(*) - (covar_pop(y, x) / nullif(var_pop(x), 0)) ** 2 * var_pop(x) * count(*)) / (count(*) - 2) / nullif(var_pop(x) * count(*), 0), 0)), 7) END AS se"
ORACLE = {
    "j9_hop_map": f"WITH {_SUPPLY}, {_HOP} SELECT lead, member, CAST(hop AS INTEGER) AS hop, strftime(since, '%Y-%m-%d') AS since FROM hop",
    "e10_hop_horizon": f"""WITH {_EX}, {_SUPPLY}, {_HOP}, {_SHOCK}, r AS (SELECT lead, member, hop, h, s.i, s.x, sum(e.x) AS y FROM hop JOIN sh s ON s.symbol = lead AND since <= s.d JOIN (SELECT unnest([1, 5]) AS h) k ON true JOIN ex e ON e.symbol = member AND e.i BETWEEN s.i + 1 AND s.i + h GROUP BY ALL HAVING count(*) = h)
SELECT CAST(hop AS INTEGER) AS hop, h, {_SL} FROM r GROUP BY hop, h""",
    "j18_month_pmi": f"WITH {_TAGS}, {PANEL}, {_MONTH} SELECT strftime(m, '%Y-%m-%d') AS month, a, b, pmi FROM mp",
    "e7_comention_lead": f"""WITH {_TAGS}, {_EX}, {_MONTH}, bw AS (SELECT m, a AS symbol, b AS partner, pmi FROM mp UNION ALL SELECT m, b, a, pmi FROM mp), bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, symbol ORDER BY pmi DESC, partner) AS k FROM bw) WHERE k <= 20),
x AS (SELECT bt.symbol, e.i, avg(e.x) AS x FROM bt JOIN ex e ON e.symbol = partner AND date_trunc('month', e.d) = m GROUP BY ALL), t AS (SELECT x.x, e.x AS y FROM x JOIN ex e ON e.symbol = x.symbol AND e.i = x.i + 1) SELECT {_SL} FROM t""",
    "e9_chains": f"""WITH {PANEL}, hf AS (SELECT (max(i) + 1) // 2 AS h FROM p), l1 AS (SELECT x.symbol AS x, y.symbol AS y, round({CORR.format(x='x.r', y='y.r')}, 9) AS c FROM p x JOIN p y ON y.i = x.i + 1 AND y.symbol <> x.symbol JOIN hf ON x.i < h AND y.i < h GROUP BY ALL HAVING count(x.r + y.r) >= 30),
lg AS (SELECT * FROM l1 WHERE c IS NOT NULL ORDER BY abs(c) DESC, x, y LIMIT 100), l2 AS (SELECT x.symbol AS x, y.symbol AS z, round({CORR.format(x='x.r', y='y.r')}, 9) AS c FROM p x JOIN p y ON y.i = x.i + 2 AND y.symbol <> x.symbol JOIN hf ON x.i >= h AND y.i >= h GROUP BY ALL HAVING count(x.r + y.r) >= 30)
SELECT count(*) AS n_chains, count(*) FILTER (WHERE sign(a.c * b.c) = sign(l2.c)) AS n_agree, round(avg(abs(l2.c)), 7) AS mean_abs FROM lg a JOIN lg b ON b.x = a.y AND b.y <> a.x JOIN l2 ON l2.x = a.x AND l2.z = b.y AND l2.c IS NOT NULL""",
    "e9_lag_chains": f"""WITH {PANEL}, hf AS (SELECT (max(i) + 1) // 2 AS h FROM p), f AS (SELECT p.* FROM p JOIN hf ON i < h), s AS (SELECT p.* FROM p JOIN hf ON i >= h),
l AS (SELECT lag, x.symbol AS x, y.symbol AS y, round({CORR.format(x='x.r', y='y.r')}, 9) AS c FROM f x JOIN (SELECT unnest([1, 2]) AS lag) l ON true JOIN f y ON y.i = x.i + lag AND y.symbol <> x.symbol GROUP BY ALL HAVING count(x.r + y.r) >= 30),
lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lag ORDER BY abs(c) DESC, x, y) AS k FROM l WHERE c IS NOT NULL) WHERE k <= 300),
ch AS (SELECT a.x, b.y FROM lg a JOIN lg b ON a.lag = 1 AND b.lag = 2 AND b.x = a.y AND b.y <> a.x), nm AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS a, count(*) OVER () AS m FROM (SELECT DISTINCT symbol FROM p WHERE r IS NOT NULL)),
d AS (SELECT k, CAST('0x' || md5('x' || k)[1:8] AS BIGINT) AS u, CAST('0x' || md5('z' || k)[1:8] AS BIGINT) AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM ch))) AS k)),
rd AS (SELECT a.symbol AS x, b.symbol AS y FROM d JOIN nm a ON a.a = u % a.m JOIN nm b ON b.a = (u % b.m + 1 + v % (b.m - 1)) % b.m),
al AS (SELECT 'chain' AS kind, * FROM ch UNION ALL SELECT 'random', * FROM rd), pr AS (SELECT DISTINCT x, y FROM al),
{", ".join(f"c{k} AS (SELECT pr.x, pr.y, round({CORR.format(x='a.r', y='b.r')}, 9) AS c{k} FROM pr JOIN {t} a ON a.symbol = pr.x JOIN {t} b ON b.symbol = pr.y AND b.i = a.i + 3 GROUP BY ALL HAVING count(a.r + b.r) >= 30)" for k, t in ((1, "f"), (2, "s")))},
g AS (SELECT kind, count(*) AS n, count(c1 + c2) AS n_tested, count(*) FILTER (WHERE sign(c1) = sign(c2)) AS n_agree, round(avg(CASE WHEN c2 IS NOT NULL THEN abs(c1) END), 7) AS mean_first, round(avg(CASE WHEN c1 IS NOT NULL THEN abs(c2) END), 7) AS mean_second FROM al LEFT JOIN c1 USING (x, y) LEFT JOIN c2 USING (x, y) GROUP BY kind)
SELECT *, round(list_sum(list_transform(generate_series(n_agree, n_tested), lambda m: exp(lgamma(n_tested + 1) - lgamma(m + 1) - lgamma(n_tested - m + 1) - n_tested * ln(2)))), 9) AS p FROM g""",
    "e11_shock_partners": f"""WITH {_EX}, {_SUPPLY}, {_SHOCK}, fe AS (SELECT src, dst, min(day) AS first FROM sup WHERE src <> dst GROUP BY ALL), pt AS (SELECT s.i, dst, sign(z) AS sg, avg(e.x) AS yp FROM sh s JOIN fe ON dst = s.symbol AND first <= s.d JOIN ex e ON e.symbol = src AND e.i = s.i + 1 GROUP BY ALL),
al AS (SELECT i - 1 AS i, avg(x) AS ya FROM ex GROUP BY 1), t AS (SELECT i, sg * (yp - ya) AS diff FROM pt JOIN al USING (i)), g AS (SELECT i, sum(diff - (SELECT avg(diff) FROM t)) AS u, sum(diff) AS s, count(*) AS k FROM t GROUP BY i)
SELECT round(sum(s) / sum(k), 8) AS mean, round(sqrt(sum(u * u)) / sum(k), 8) AS se, coalesce(CAST(sum(k) AS BIGINT), 0) AS n, count(*) AS n_clusters FROM g""",
    "w7_growth": f"WITH {PANEL} SELECT symbol, i, round(exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY i)), 6) AS growth FROM p WHERE r > -1",
    "f17_liquid_sigma": f"WITH {PANEL} SELECT symbol, round(stddev_samp(r), 8) AS sigma FROM p GROUP BY 1 HAVING stddev_samp(r) >= 1e-3",
    "f18_split": f"WITH {PANEL}, cut AS (SELECT min(d) AS d0 FROM sess WHERE d >= DATE '2024-07-01') SELECT part, count(DISTINCT i) AS n_sessions, count(r) AS n_returns, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM (SELECT p.*, CASE WHEN d < d0 THEN 'discovery' ELSE 'validation' END AS part FROM p, cut) GROUP BY part",
    "e3_verdict_returns": f"""WITH {_VERDICT}, ex AS (SELECT symbol, i, r - avg(r) OVER (PARTITION BY i) AS x FROM p WHERE r IS NOT NULL),
y AS (SELECT vd.cid, verdict, direction, h, sum(x) AS x FROM vd JOIN (SELECT unnest([2, 5, 10, 21]) AS h) k ON true JOIN ex ON ex.symbol = vd.symbol AND ex.i > vd.i AND ex.i <= vd.i + h GROUP BY ALL)
SELECT verdict, h, count(*) AS n, round(avg(CASE WHEN direction = 'up' THEN x ELSE -x END), 8) AS mean_excess FROM y GROUP BY ALL""",
}
ORACLE["e10_hop_horizons"] = ORACLE["e10_hop_horizon"].replace(_SHOCK, _MOVE).replace("unnest([1, 5])", "unnest([1, 2, 3, 5, 10])")
ORACLE["e11_move_partners"] = ORACLE["e11_shock_partners"].replace(_SHOCK, _MOVE)
ORACLE["e1_threshold_test"] = f"""WITH {_MOVES}, f AS (SELECT cid, max(abs(z)) FILTER (WHERE symbol <> cid) AS near_, max(abs(z)) FILTER (WHERE symbol = cid) AS mine FROM moves GROUP BY cid),
y AS (SELECT f.cid, near_, mine, direction, sum(p.r) AS fwd FROM f JOIN cand USING (cid) JOIN p ON p.symbol = cand.cid AND p.i > cand.i AND p.i <= cand.i + 10 GROUP BY ALL),
g AS (SELECT coalesce(near_ >= 2 AND mine < 0.5, false) AS f, CAST((fwd > 0) = (direction = 'up') AS DOUBLE) AS w FROM y),
a AS (SELECT count(*) FILTER (WHERE f) AS n1, avg(w) FILTER (WHERE f) AS p1, count(*) FILTER (WHERE NOT f) AS n0, avg(w) FILTER (WHERE NOT f) AS p0 FROM g), bb AS (SELECT *, (n1 * p1 + n0 * p0) / (n1 + n0) AS q FROM a), ss AS (SELECT *, sqrt(q * (1 - q) * (1.0 / nullif(n1, 0) + 1.0 / nullif(n0, 0))) AS s FROM bb)
SELECT n1, round(p1, 8) AS p1, n0, round(p0, 8) AS p0, round((p1 - p0) / nullif(s, 0), 6) AS z, round(2.8 * s, 8) AS least_detectable FROM ss"""
ORACLE["e7_comention_years"] = ORACLE["e7_comention_lead"].replace("t AS (SELECT x.x, e.x AS y FROM", "t AS (SELECT x.x, e.x AS y, (SELECT year(d) FROM sess WHERE sess.i = x.i) AS yr FROM").replace(
    f"SELECT {_SL} FROM t",
    f"yy AS (SELECT yr, {_SLOPE} FROM t GROUP BY 1), pw AS (SELECT slope AS e, 1 / (se * se) AS w FROM yy WHERE se > 0), po AS (SELECT count(*) AS k, sum(w * e) / sum(w) AS pooled, sqrt(1 / sum(w)) AS se, sum(w * e * e) - sum(w * e) ** 2 / sum(w) AS q FROM pw) SELECT k, round(pooled, 6) AS pooled, round(se, 6) AS se, round(q, 6) AS q, round(greatest(0.0, (q - (k - 1)) / nullif(q, 0) * 100), 6) AS i2 FROM po",
)
ORACLE["e7_comention_years"] = ORACLE["e7_comention_years"].replace(") yy AS (", "), yy AS (")
ORACLE["e3_verdict_gap"] = ORACLE["e3_verdict_returns"].split("y AS (SELECT vd.cid")[0] + """y AS (SELECT vd.cid, vd.as_of, verdict, direction, h, sum(x) AS x FROM vd JOIN (SELECT unnest([2, 5, 10, 21]) AS h) k ON true JOIN ex ON ex.symbol = vd.symbol AND ex.i > vd.i AND ex.i <= vd.i + h WHERE verdict IN ('corroborated', 'contradicted') GROUP BY ALL),
r AS (SELECT h, as_of, CASE WHEN verdict = 'corroborated' THEN 1.0 ELSE 0.0 END AS v, CASE WHEN direction = 'up' THEN x ELSE -x END AS w FROM y),
ft AS (SELECT h, count(*) AS n, avg(v) AS mv, avg(w) AS mw, covar_pop(v, w) / nullif(var_pop(v), 0) AS gap, var_pop(v) * count(*) AS svv FROM r GROUP BY h),
gs AS (SELECT h, as_of, sum((v - mv) * (w - mw - gap * (v - mv))) AS u FROM r JOIN ft USING (h) GROUP BY ALL), er AS (SELECT h, sqrt(sum(u * u)) AS su FROM gs GROUP BY h)
SELECT h, n, round(gap, 8) AS gap, round(su / nullif(svv, 0), 8) AS se, round(gap / CASE WHEN su / nullif(svv, 0) > 1e-9 THEN su / svv END, 4) AS z FROM ft JOIN er USING (h)"""
