import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from orrery.functions.vectors import search
from orrery.operators.graphs import degrees, hops, laggers, forest_by_rounds, latest_snapshot, spanning_forest, two_hop

D = date.fromisoformat


def supply(spark):
    rows = [("MID1", "TOP1", D("2023-06-01"), 20.0), ("BOT1", "MID1", D("2024-01-15"), 15.0), ("MID1", "TOP1", D("2023-07-01"), 5.0), ("TOP1", "BOT1", D("2023-01-01"), None)]
    return spark.createDataFrame(rows, "src string, dst string, day date, share double")


def reach(spark, day, n=2):
    start = spark.createDataFrame([(1, "TOP1", D(day))], "sid int, start string, as_of date")
    return {(r.lagger, r.lag_days, r.beta) for r in laggers(start, supply(spark), n).collect()}


def test_hops_are_bounded_and_every_edge_is_dated(spark):
    assert reach(spark, "2023-05-01") == set()
    assert reach(spark, "2023-12-31") == {("MID1", 1, 0.2)}
    assert reach(spark, "2024-01-15") == {("MID1", 1, 0.2), ("BOT1", 2, 0.15)}
    assert reach(spark, "2024-06-01", 1) == {("MID1", 1, 0.2)}
    # Nodes may come again, edges may not.
    assert ("TOP1", 3, 0.0) in reach(spark, "2024-06-01", 3)
    start = spark.createDataFrame([(1, "TOP1", D("2024-06-01"))], "sid int, start string, as_of date")
    assert {">".join(r.path) for r in hops(start, supply(spark)).where("depth = 2").collect()} == {"TOP1>MID1>BOT1"}


def test_two_hop_leaves_out_neighbours(spark):
    d = D("2023-01-01")
    e = spark.createDataFrame([("A", "B", 2.0, d), ("B", "C", 1.5, d), ("A", "D", 2.0, d), ("B", "D", 2.0, d), ("C", "E", 0.5, d), ("B", "F", 3.0, D("2025-01-01"))], "a string, b string, pmi double, first_seen date")
    got = {(r.start, r.via, r.node, r.score) for r in two_hop(e, spark.createDataFrame([("A",)], "symbol string"), floor=1.0, before=F.lit(D("2024-01-01"))).collect()}
    assert got == {("A", "B", "C", 1.5)}
    assert {(r.symbol, r.degree) for r in degrees(e.limit(2)).collect()} == {("A", 1), ("B", 2), ("C", 1)}


def test_snapshots_never_mix(spark):
    e = spark.createDataFrame([("A", "B", 0.9, D("2024-01-01")), ("A", "C", 0.8, D("2024-01-01")), ("B", "A", 0.7, D("2024-03-01")), ("A", "C", 0.6, D("2024-06-01"))], "a string, b string, corr double, as_of date")
    asked = spark.createDataFrame([("A", D("2024-04-01")), ("C", D("2024-04-01")), ("A", D("2023-01-01"))], "symbol string, day date")
    assert {(r.symbol, r.other, r.corr) for r in latest_snapshot(e, asked).collect()} == {("A", "B", 0.7), ("C", "A", 0.8)}


def test_spanning_forest(spark):
    e = spark.createDataFrame([(1, "A", "B", 0.9), (1, "B", "C", 0.8), (1, "A", "C", 0.7), (1, "D", "E", 0.1), (2, "A", "C", 0.5)], "g int, a string, b string, weight double")
    assert {(r.g, r.a, r.b) for r in spanning_forest(e, "g").collect()} == {(1, "A", "B"), (1, "B", "C"), (1, "D", "E"), (2, "A", "C")}
    assert spanning_forest(e.limit(0), "g").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_by_rounds_equals_sorting_edges(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(60)]
    pairs = {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(150)}
    e = spark.createDataFrame([(1, a, b, rnd.choice([0.1, 0.2, 0.5, 0.9])) for a, b in pairs], "g int, a string, b string, weight double")
    want = {(r.a, r.b, r.weight) for r in spanning_forest(e, "g").collect()}
    assert {(r.a, r.b, r.weight) for r in forest_by_rounds(e.drop("g")).collect()} == want
    twice = e.drop("g").unionByName(e.drop("g").limit(30)).unionByName(spark.createDataFrame([("x", "x", 9.0), ("y", None, 9.0)], "a string, b string, weight double"))
    assert {(r.a, r.b, r.weight) for r in forest_by_rounds(twice).collect()} == want
    assert forest_by_rounds(e.drop("g").limit(0)).count() == 0


def test_vector_search_is_exact_and_prefilters(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], D("2025-06-01")), (2, [0.9, 0.1], D("2025-06-15")), (3, [0.0, 1.0], D("2025-06-01")), (4, [0.0, 0.0], D("2025-06-01")), (5, None, D("2025-06-01"))], "id long, vec array<double>, day date")
    q = spark.createDataFrame([(7, [1.0, 0.0], D("2025-06-15")), (8, [0.0, 2.0], D("2026-01-01"))], "qid long, qvec array<double>, until date")
    for block in (1 << 20, 100):
        got = [(r.qid, r.id, r["rank"]) for r in search(q, c, k=2, match=F.col("day") < F.col("until"), block_bytes=block).orderBy("qid", "rank").collect()]
        assert got == [(7, 1, 1), (7, 3, 2), (8, 3, 1), (8, 2, 2)]
