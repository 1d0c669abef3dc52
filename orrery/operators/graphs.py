"""Dated graphs as edge tables: traversal, snapshots, components, spanning trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.durable import durable


def hops(starts: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(sid, start, node, depth, path, share, filed): ways back from ``starts`` (sid, start, as_of) along ``edges`` (src, dst, day, share).

    Every edge of a way must be known by the start's date, which is the same as
    leaving later edges out before each step. An edge is used once in a way;
    nodes may come again. ``share`` and ``filed`` are the last edge's.
    """
    e = edges.select("src", "dst", "day", "share")
    at = starts.select("sid", "start", "as_of", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("date").alias("filed"), F.array().cast("array<string>").alias("used"))
    out = None
    for _ in range(max_hops):
        key = F.concat_ws(">", "src", "dst", "day")
        step = at.join(e.withColumnRenamed("share", "s"), F.col("node") == F.col("dst")).where((F.col("day") <= F.col("as_of")) & ~F.array_contains("used", key))
        at = step.select("sid", "start", "as_of", F.col("src").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("src")).alias("path"), F.col("s").alias("share"), F.col("day").alias("filed"), F.array_append("used", key).alias("used"))
        out = at if out is None else out.unionByName(at)
    return out.drop("used", "as_of")


def laggers(starts: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(sid, leader, lagger, lag_days, beta): each node reached, at its least depth, with the largest share there (none counts as 0)."""
    share = F.coalesce("share", F.lit(0.0))
    best = Window.partitionBy("sid", "start", "node").orderBy("depth", share.desc(), F.col("path").cast("string"))
    one = hops(starts, edges, max_hops).withColumn("k", F.row_number().over(best)).where("k = 1")
    return one.select("sid", F.col("start").alias("leader"), F.col("node").alias("lagger"), F.col("depth").alias("lag_days"), (share / 100).alias("beta"))


def shown_ways(starts: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(sid, start, node, depth, path, share, filed): the way that is shown to each node: among the shortest that with the largest last share (none counts as 0), then the latest filing."""
    best = Window.partitionBy("sid", "start", "node").orderBy("depth", F.coalesce("share", F.lit(0.0)).desc(), F.col("filed").desc(), F.array_join("path", ">"))
    return hops(starts, edges, max_hops).withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Undirected edges (a, b, ...) from either end."""
    return edges.select("a", "b", *extra).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *extra))


def two_hop(edges: DataFrame, starts: DataFrame, *, floor: float, before: Column) -> DataFrame:
    """(start, via, node, score): undirected ways of exactly two edges (a, b, pmi, first_seen), scored by the weaker one.

    Both edges need ``floor`` and to be seen by ``before``; the start and its
    direct neighbours are no targets.
    """
    e = both_ways(edges.where((F.col("pmi") >= floor) & (F.col("first_seen") <= before)), "pmi")
    one = starts.select(F.col("symbol").alias("a")).distinct().join(e, "a").select(F.col("a").alias("start"), F.col("b").alias("via"), F.col("pmi").alias("p1"))
    two = one.join(e.select(F.col("a").alias("via"), F.col("b").alias("node"), F.col("pmi").alias("p2")), "via").where("node <> start")
    away = two.join(one.select("start", F.col("via").alias("node")), ["start", "node"], "left_anti")
    return away.select("start", "via", "node", F.least("p1", "p2").alias("score"))


def latest_snapshot(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """For (symbol, day) in ``asked`` the edges (a, b, corr, as_of) of that symbol's latest snapshot by the day; snapshots never mix."""
    own = both_ways(edges, "corr", "as_of").withColumnRenamed("a", "symbol")
    when = own.select("symbol", "as_of").distinct().join(asked, "symbol").where(F.col("as_of") <= F.col("day")).groupBy("symbol", "day").agg(F.max("as_of").alias("as_of"))
    return when.join(own, ["symbol", "as_of"]).select("symbol", "day", "as_of", F.col("b").alias("other"), "corr")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.countDistinct("b").alias("degree")).withColumnRenamed("a", "symbol")


def spanning_forest(edges: DataFrame, group: str) -> DataFrame:
    """(group, a, b, weight) of each group's maximum spanning forest; ``edges`` has the group, a, b and weight.

    Meant for many small graphs, such as one a leader with some tens of
    followers: each is a task's work, by sorting edges and joining components.
    """

    def forest(f: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep = []
        f = f.assign(neg=-f["weight"]).sort_values(["neg", "a", "b"], kind="stable")
        for k, (a, b) in enumerate(zip(f["a"], f["b"])):
            if (x := find(a)) != (y := find(b)):
                root[x] = y
                keep.append(k)
        return f.iloc[keep][[group, "a", "b", "weight"]]

    kind = edges.schema[group].dataType.simpleString()
    return edges.select(group, "a", "b", "weight").groupBy(group).applyInPandas(forest, f"`{group}` {kind}, a string, b string, weight double")


def forest_by_rounds(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the maximum spanning forest of one graph of any size; ``edges`` has a, b and weight.

    In each round every component takes its best edge out (Boruvka), by weight,
    then by name, so that no two are equal; components joined that way become
    one. Their number halves at least, so rounds are the logarithm of the nodes.
    No task holds the graph. Repeated edges count once, with the larger weight;
    edges with a null end and from a node to itself don't count.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    open_ = durable(ends.groupBy("a", "b").agg(F.max("weight").alias("weight")).withColumns({"x": F.col("a"), "y": F.col("b")}))
    forest = None
    while not open_.isEmpty():
        best = F.struct((-F.col("weight")).alias("w"), "a", "b")
        out = open_.select(F.col("x").alias("c"), F.col("y").alias("to"), best.alias("e")).unionByName(open_.select(F.col("y").alias("c"), F.col("x").alias("to"), best.alias("e")))
        taken = durable(out.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e", "m.to"))
        own = taken.select("e.a", "e.b", (-F.col("e.w")).alias("weight")).distinct()
        forest = own if forest is None else forest.unionByName(own)
        # Components that took the same edge point at each other: the lesser name of the two leads.
        back = taken.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = durable(taken.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")))
        while True:  # whoever leads one's leader, until nothing changes
            up = root.select(F.col("c").alias("p"), F.col("p").alias("q"))
            new = durable(root.join(up, "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            root = new.select("c", "p")
            if new.where("moved").isEmpty():
                break
        lead = lambda c: root.select(F.col("c").alias(c), F.col("p").alias(f"{c}_"))
        open_ = durable(open_.join(lead("x"), "x").join(lead("y"), "y").where("x_ <> y_").select("a", "b", "weight", F.col("x_").alias("x"), F.col("y_").alias("y")))
    return ends.limit(0) if forest is None else forest
