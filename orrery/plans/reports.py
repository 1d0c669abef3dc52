"""Reports put together from the other queries' steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import evidence as ev
from orrery.operators import statistics as st
from orrery.operators.comovement import parts_blocked
from orrery.operators.graphs import hops, two_hop
from orrery.plans.market import _MOVES, bar_panel, bars, candidates, latest_sic
from orrery.plans.relations import dated_tags, pmi_edges, supply_edges
from orrery.plans.tests_of_relations import split_pairs
from orrery.sources.durable import durable


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    p = durable(bar_panel(spark, sf_dir))
    c = durable(candidates(spark, sf_dir, p))
    return p, c, ev.run(c, p, spark.createDataFrame([], "symbol string"))


def e2_median_split(spark, sf_dir):
    """Whether candidates that lag their neighbours more than the median does go their way over the next 2 sessions."""
    p, _, out = _run(spark, sf_dir)
    z = out["moves"].join(out["placed"].select("cid", F.col("symbol").alias("own"), "ti", "direction"), "cid")
    own = F.col("symbol") == F.col("own")
    f = z.groupBy("cid", "own", "ti", "direction").agg((F.max(F.when(~own, F.abs("z"))) - F.max(F.when(own, F.abs("z")))).alias("score"))
    fwd = p.select(F.col("symbol").alias("own"), "i", "r")
    y = f.join(fwd, "own").where((F.col("i") >= F.col("ti")) & (F.col("i") < F.col("ti") + 2)).groupBy("cid", "score", "direction").agg(F.sum("r").alias("fwd"))
    y = durable(y.where("score IS NOT NULL").withColumn("won", ((F.col("fwd") > 0) == (F.col("direction") == "up")).cast("double")))
    m = y.agg(F.percentile("score", 0.5).alias("m")).scalar()
    high = F.col("score") > F.col("m")
    g = y.withColumn("m", m).agg(F.count_if(high).alias("n_high"), F.avg(F.when(high, F.col("won"))).alias("p_high"), F.count_if(~high).alias("n_low"), F.avg(F.when(~high, F.col("won"))).alias("p_low"))
    z, mde = st.proportion_test(F.expr("nullif(n_high, 0)").cast("double"), F.col("p_high"), F.expr("nullif(n_low, 0)").cast("double"), F.col("p_low"))
    return g.select("n_high", F.round("p_high", 8).alias("p_high"), "n_low", F.round("p_low", 8).alias("p_low"), F.round(z, 6).alias("z"), F.round(mde, 8).alias("least_detectable"))


def e13_feature_auc(spark, sf_dir):
    """How well features of the first half rank pairs whose correlation keeps its sign, and stays at 0.1 and more, in the second."""
    p = durable(bar_panel(spark, sf_dir))
    half = ((p.agg(F.max("i")).first()[0] or 0) + 1) // 2
    part = (half + 3) // 4 or 1
    some = parts_blocked(p.where(F.col("i") < half).select("symbol", "i", "r"), [(min(k * part, half), min((k + 1) * part, half)) for k in range(4)], first=0, width=max(half, 1))
    quarters = some.select("a", "b", *[F.col("c")[k].alias(f"q{k}") for k in range(4)])
    v = bars(spark, sf_dir).groupBy("symbol").agg(F.log10(F.median("dollar_vol")).alias("v"))
    sic = latest_sic(spark, sf_dir).where("sic IS NOT NULL").select("symbol", F.substring("sic", 1, 2).alias("s"))
    end = lambda df, c, n: df.select(F.col("symbol").alias(c), F.col(df.columns[1]).alias(n))
    t = split_pairs(spark, sf_dir).join(quarters, ["a", "b"]).join(end(v, "a", "va"), "a", "left").join(end(v, "b", "vb"), "b", "left").join(end(sic, "a", "sa"), "a", "left").join(end(sic, "b", "sb"), "b", "left")
    agree = sum((F.coalesce(F.signum(f"q{k}") == F.signum("c1"), F.lit(False)).cast("double") for k in range(4)), F.lit(0.0))
    weak = F.least(*[F.abs(f"q{k}") for k in range(4)])
    t = durable(t.select("a", "b", ((F.signum("c1") == F.signum("c2")) & (F.abs("c2") >= 0.1)).alias("y"), F.abs("c1").alias("size"), agree.alias("quarters_agree"), weak.alias("weakest_quarter"), F.least("va", "vb").alias("liquidity"), F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)).cast("double").alias("same_industry")))
    out = None
    for f in ("size", "quarters_agree", "weakest_quarter", "liquidity", "same_industry"):
        r = st.auc(t, F.col(f), F.col("y"), [F.col("a"), F.col("b")]).withColumn("feature", F.lit(f))
        out = r if out is None else out.unionByName(r)
    return out.select("feature", "auc", "n_pos", "n_neg")


def a42_random_control(spark, sf_dir, n=200):
    """Sign agreement between halves of ``n`` pairs drawn by a hash, to hold chosen pairs against."""
    s = split_pairs(spark, sf_dir)
    k = s.orderBy(F.xxhash64("a", "b", F.lit(7)), "a", "b").limit(n)
    return k.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("c1") == F.signum("c2")).alias("n_agree"))


def e19_details(spark, sf_dir):
    """Every piece of evidence in words."""
    _, c, out = _run(spark, sf_dir)
    return ev.detail(out["evidence"], c).select("cid", "symbol", "supports", "detail")


def e21_showcase(spark, sf_dir):
    """For each candidate on one list: its verdict, suppliers up to two steps back, and symbols two co-mentions away."""
    _, c, out = _run(spark, sf_dir)
    verdict = out["assessments"].select("cid", F.lit("verdict").alias("kind"), F.col("verdict").alias("item"), F.col("rationale").alias("detail"))
    start = c.select(F.col("cid").alias("sid"), F.col("symbol").alias("start"), "as_of")
    paths = hops(start, supply_edges(spark, sf_dir)).select(F.col("sid").alias("cid"), F.lit("supply").alias("kind"), F.col("node").alias("item"), F.array_join(F.reverse("path"), ">").alias("detail")).distinct()
    e = durable(pmi_edges(dated_tags(spark, sf_dir)))
    far = two_hop(e, c.select("symbol"), floor=1.0, before=F.to_date(F.lit("2024-12-31")))
    k = F.row_number().over(Window.partitionBy("start").orderBy(F.col("score").desc(), "node", "via"))
    far = far.withColumn("k", k).where("k <= 7").select(F.col("start").alias("cid"), F.lit("two co-mentions away").alias("kind"), F.col("node").alias("item"), F.format_string("by way of %s, %.4f", "via", "score").alias("detail"))
    return verdict.unionByName(paths).unionByName(far)


_FUNCS = (a42_random_control, e2_median_split, e13_feature_auc, e19_details, e21_showcase)
QUERIES = {f.__name__: f for f in _FUNCS}
ORACLE = {
    "e2_median_split": f"""WITH {_MOVES}, f AS (SELECT cid, max(abs(z)) FILTER (WHERE symbol <> cid) - max(abs(z)) FILTER (WHERE symbol = cid) AS score FROM moves GROUP BY cid),
y AS (SELECT f.cid, score, CAST((sum(p.r) > 0) = (any_value(direction) = 'up') AS DOUBLE) AS won FROM f JOIN cand USING (cid) JOIN p ON p.symbol = cand.cid AND p.i > cand.i AND p.i <= cand.i + 2 WHERE score IS NOT NULL GROUP BY f.cid, score),
m AS (SELECT quantile_cont(score, 0.5) AS m FROM y), a AS (SELECT count(*) FILTER (WHERE score > m) AS n_high, avg(won) FILTER (WHERE score > m) AS p_high, count(*) FILTER (WHERE NOT score > m) AS n_low, avg(won) FILTER (WHERE NOT score > m) AS p_low FROM y, m),
bb AS (SELECT *, (n_high * p_high + n_low * p_low) / (n_high + n_low) AS q FROM a), ss AS (SELECT *, sqrt(q * (1 - q) * (1.0 / nullif(n_high, 0) + 1.0 / nullif(n_low, 0))) AS s FROM bb)
SELECT n_high, round(p_high, 8) AS p_high, n_low, round(p_low, 8) AS p_low, round((p_high - p_low) / nullif(s, 0), 6) AS z, round(2.8 * s, 8) AS least_detectable FROM ss""",
}
