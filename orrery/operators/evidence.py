"""From candidates to verdicts: one plan for a whole batch.

A candidate is (cid, symbol, direction, as_of) with an optional origin_leader.
Its neighbourhood are the symbols most correlated with it over the inclusive
window; neighbours that moved far are evidence for or against its direction,
and neighbours that move together count as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.comovement import near_blocked
from orrery.operators.panel import correlation, session_ends
from orrery.operators.shocks import standardised
from orrery.sources.durable import durable


def placed(candidates: DataFrame, p: DataFrame, trail: int = 60) -> DataFrame:
    """``candidates`` with ``ti`` (end of the inclusive window) and ``error``: null, or why there is no neighbourhood."""
    known = p.select(F.col("symbol").alias("s")).distinct()
    c = candidates.join(session_ends(candidates, p), "as_of").join(known, F.col("symbol") == F.col("s"), "left")
    error = F.when((F.col("ti") == F.col("n")) | F.col("s").isNull(), "no session or no bars").when(F.col("ti") < trail, "insufficient history")
    return c.withColumn("error", error).drop("s")


def neighbourhood(cands: DataFrame, p: DataFrame, excluded: DataFrame, *, trail: int = 60, topk: int = 20) -> DataFrame:
    """(cid, leader, lagger, rank, corr, beta): the ``topk`` symbols by absolute correlation with each placed candidate.

    The candidate itself, all candidates and the symbols of ``excluded`` (symbol)
    are never neighbours, nor are symbols with returns in under 80 % of the window.
    """
    ok = cands.where("error IS NULL").select(F.col("cid").cast("string").alias("cid"), "symbol", "ti")
    away = excluded.select("symbol").unionByName(cands.select("symbol")).distinct().withColumn("away", F.lit(True))
    # One session's moves of all symbols say nothing of who is in the pool, so it is told with each symbol.
    values = p.select("symbol", "i", "r").join(away, "symbol", "left").select("symbol", "i", "r", F.col("away").isNull().alias("pool"))
    some = near_blocked(ok, values, trail=trail, topk=topk, least_n=0.8 * trail)
    best = Window.partitionBy("cid").orderBy(F.round(F.abs("corr"), 12).desc(), "leader")
    top = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= topk)
    top = top.join(ok.select("cid", F.col("symbol").alias("lagger")), "cid").withColumn("cid", F.col("cid").cast(cands.schema["cid"].dataType))
    return top.select("cid", "leader", "lagger", "rank", "corr", F.try_divide(F.col("corr") * F.nanvl("sl", F.lit(None).cast("double")), F.nanvl("sc", F.lit(None).cast("double"))).alias("beta"))


def leader_state(cands: DataFrame, edges: DataFrame, p: DataFrame, *, trail: int = 60, move_win: int = 3, sigma: float = 2.0) -> DataFrame:
    """(cid, symbol, move, z): how far leaders moved, where at least ``sigma``, and how far the candidate did, whatever it was.

    Here the baseline overlaps the recent window.
    """
    wanted = edges.select("cid", F.col("leader").alias("symbol")).unionByName(edges.select("cid", F.col("lagger").alias("symbol"))).distinct()
    grid = cands.join(edges.select("cid").distinct(), "cid", "left_semi").select("cid", "ti", F.col("symbol").alias("own"), F.explode(F.sequence(F.col("ti") - trail, F.col("ti") - 1)).alias("i"))
    rows = grid.join(wanted, "cid").join(p.select("symbol", "i", "r"), ["symbol", "i"])
    recent = F.when(F.col("i") >= F.col("ti") - move_win, F.col("r"))
    z = rows.groupBy("cid", "symbol", (F.col("symbol") == F.col("own")).alias("is_own")).agg(F.coalesce(F.sum(recent), F.lit(0.0)).alias("move"), standardised(recent, F.col("r"), move_win).alias("z"))
    return z.where(F.col("z").isNotNull() & ((F.abs("z") >= sigma) | F.col("is_own"))).select("cid", "symbol", "move", "z")


def fuse(cands: DataFrame, edges: DataFrame, moves: DataFrame, p: DataFrame, *, trail: int = 60, cluster_rho: float = 0.7) -> DataFrame:
    """(cid, symbol, z, cand_z, bloc, weight, supports): the evidence of each mover among a candidate's leaders.

    A mover's weight is one over its bloc: the movers, itself included, with
    which it correlates at ``cluster_rho`` or more.
    """
    movers = edges.select("cid", F.col("leader").alias("symbol")).distinct().join(moves, ["cid", "symbol"])
    ends = cands.select("cid", "ti")
    grid = movers.join(ends, "cid").select("cid", "symbol", F.explode(F.sequence(F.col("ti") - trail, F.col("ti") - 1)).alias("i"))
    rows = grid.join(p.select("symbol", "i", "r"), ["symbol", "i"])
    x = rows.select("cid", "i", F.col("symbol").alias("a"), F.col("r").alias("ra"))
    y = rows.select("cid", "i", F.col("symbol").alias("b"), F.col("r").alias("rb"))
    # Each candidate has at most topk movers, so this is a bounded number of pairs.
    rho = x.join(y, ["cid", "i"]).groupBy("cid", "a", "b").agg(F.abs(correlation(F.col("ra"), F.col("rb"))).alias("rho"))
    own = F.when(F.col("a") == F.col("b"), F.when(F.col("rho").isNotNull(), 1.0)).otherwise(F.col("rho"))
    blocs = rho.groupBy("cid", F.col("a").alias("symbol")).agg(F.greatest(F.count_if(own >= cluster_rho), F.lit(1)).alias("bloc"))
    cand_z = cands.select("cid", "symbol").join(moves.select("cid", "symbol", F.col("z").alias("cand_z")), ["cid", "symbol"], "left").select("cid", F.coalesce("cand_z", F.lit(0.0)).alias("cand_z"))
    want = cands.select("cid", F.when(F.col("direction") == "up", 1.0).otherwise(-1.0).alias("want"))
    out = movers.join(blocs, ["cid", "symbol"]).join(cand_z, "cid").join(want, "cid")
    supports = (F.col("z") * F.col("want") > 0) & (F.abs("cand_z") < F.abs("z"))
    return out.select("cid", "symbol", "z", "cand_z", "bloc", (1 / F.col("bloc")).alias("weight"), supports.alias("supports"))


def detail(evidence: DataFrame, cands: DataFrame) -> DataFrame:
    """``evidence`` with a sentence for each."""
    text = F.format_string("%s moved %+.2fσ while %s moved %+.2fσ; bloc of %d", "symbol", "z", "own", "cand_z", "bloc")
    return evidence.join(cands.select("cid", F.col("symbol").alias("own")), "cid").withColumn("detail", text).drop("own")


def assess(cands: DataFrame, edges: DataFrame, evidence: DataFrame, *, min_effective: float = 1.0) -> DataFrame:
    """(cid, symbol, as_of, direction, verdict, effective_evidence, n_supporting, n_contradicting, neighbours, rationale).

    Candidates that no neighbourhood reached are left out. Sums compare rounded
    weights, exactly; effective evidence sums unrounded ones.
    """
    w = F.bround("weight", 4).cast("decimal(12,4)")
    sums = evidence.groupBy("cid").agg(
        F.bround(F.sum("weight"), 3).alias("eff"),
        F.sum(F.when(F.col("supports"), w).otherwise(0)).alias("pro"),
        F.sum(F.when(F.col("supports"), 0).otherwise(w)).alias("con"),
        F.count_if("supports").alias("n_pro"),
        F.count_if(~F.col("supports")).alias("n_con"),
    )
    near = edges.groupBy("cid").agg(F.count(F.lit(1)).alias("neighbours"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    c = cands.join(near, "cid").join(sums, "cid", "left")
    eff = F.coalesce("eff", F.lit(0.0))
    verdict = F.when((eff < min_effective) | (none("n_pro") + none("n_con") == 0), "neutral").when(F.col("pro") > F.col("con"), "corroborated").when(F.col("con") > F.col("pro"), "contradicted").otherwise("neutral")
    why = F.format_string(
        "%d neighbours moved with and %d against it: %.2f independent observations, %.2f for and %.2f against. Not calibrated.", none("n_pro"), none("n_con"), eff, none("pro").cast("double"), none("con").cast("double")
    )
    return c.select("cid", "symbol", "as_of", "direction", verdict.alias("verdict"), eff.alias("effective_evidence"), none("n_pro").alias("n_supporting"), none("n_con").alias("n_contradicting"), F.lit(0.0).alias("odds_adjustment"), "neighbours", why.alias("rationale"))


def describe(cands: DataFrame, moves: DataFrame) -> DataFrame:
    """(cid, description) for candidates with an origin_leader and a move of their own."""
    own = cands.where("origin_leader IS NOT NULL").join(moves.select("cid", "symbol", "z"), ["cid", "symbol"])
    x = F.when(F.col("direction") == "up", F.col("z")).otherwise(-F.col("z"))
    text = F.format_string("%s has moved %+.2fσ %s the thesis; surfaced by %s.", "symbol", x, F.when(x >= 0, "toward").otherwise("against"), "origin_leader")
    return own.select("cid", text.alias("description"))


def run(candidates: DataFrame, p: DataFrame, excluded: DataFrame, *, trail: int = 60, topk: int = 20, move_win: int = 3, sigma: float = 2.0, cluster_rho: float = 0.7, supply: DataFrame | None = None) -> dict[str, DataFrame]:
    """All steps for a batch of candidates: placed, edges, moves, evidence, assessments, descriptions.

    ``supply`` may add edges (cid, leader, lagger) of other kinds; only edges
    that end in the candidate make evidence, but all make neighbours' moves.
    """
    # Each step is used by several later ones and holds a few rows a candidate: written once, read often.
    cands = durable(placed(candidates, p, trail))
    near = durable(neighbourhood(cands, p, excluded, trail=trail, topk=topk))
    all_edges = near.select("cid", "leader", "lagger")
    if supply is not None:
        all_edges = all_edges.unionByName(supply.select("cid", "leader", "lagger"))
    mine = all_edges.join(cands.select("cid", F.col("symbol").alias("lagger")), ["cid", "lagger"], "left_semi")
    moves = durable(leader_state(cands, all_edges, p, trail=trail, move_win=move_win, sigma=sigma))
    evidence = durable(fuse(cands, mine, moves, p, trail=trail, cluster_rho=cluster_rho))
    return {"placed": cands, "edges": near, "moves": moves, "evidence": evidence, "assessments": assess(cands, mine, evidence), "descriptions": describe(cands, moves)}


def golden(candidates: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row for every candidate, those without an assessment as ``no_assessment``, in total order of all columns."""
    a = assessments.select("cid", "verdict", F.col("effective_evidence").alias("eff"), "n_supporting", "n_contradicting")
    out = candidates.join(a, "cid", "left").select(
        "symbol", "as_of", "direction", F.coalesce("verdict", F.lit("no_assessment")).alias("verdict"), F.format_string("%.6f", F.coalesce("eff", F.lit(0.0))).alias("effective_evidence"), F.coalesce("n_supporting", F.lit(0)).alias("n_supporting"), F.coalesce("n_contradicting", F.lit(0)).alias("n_contradicting")
    )
    return out.orderBy(*out.columns)


def golden_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, ...): rows of either that the other lacks, counting repeats, compared as strings."""
    text = lambda df: df.select([F.col(c).cast("string").alias(c) for c in left.columns])
    a, b = text(left), text(right)
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))
