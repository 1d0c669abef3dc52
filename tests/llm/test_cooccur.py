import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import cooccur
from orrery.llm.cooccur import cooccurrence
from orrery.llm.q_pairs import QUERIES


def brute(rows, max_basket=None):
    baskets = {}
    for b, i, *_ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    kept = [s for s in baskets.values() if max_basket is None or len(s) <= max_basket]
    one = Counter(i for s in kept for i in s)
    two = Counter(p for s in kept for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (n, one[a], one[b], len(kept)) for (a, b), n in two.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "basket long, item string, n long, items string")
    return cooccurrence(df, basket=F.col("basket"), item=F.col("item"), **kw).collect()


@pytest.mark.parametrize("block, max_basket", [(3, None), (128, None), (3, 9), (128, 5)])
def test_equals_brute_force(spark, block, max_basket):
    rnd = random.Random(block)
    rows = [(rnd.randrange(60) if rnd.random() < 0.7 else 1000, f"i{int(rnd.paretovariate(0.6)) % 70}", 1, "x") for _ in range(800)]
    rows += [(None, "a", 1, "x"), (1, None, 1, "x"), (5000, "alone", 1, "x")]
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in run(spark, rows, block=block, max_basket=max_basket)}
    assert got == brute(rows, max_basket)


@pytest.mark.parametrize("max_basket", [None, 9, 40])
def test_hot_baskets_go_their_own_way(spark, monkeypatch, max_basket):
    monkeypatch.setattr(cooccur, "HOT_ITEMS", 20)
    rows = [(1, f"i{i}", 1, "x") for i in range(60)] + [(b, f"i{i}", 1, "x") for b in range(2, 9) for i in range(b, b + 6)]
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in run(spark, rows, block=5, max_basket=max_basket)}
    assert got == brute(rows, max_basket)


def test_scores_and_min_count(spark):
    rows = [(b, i, 0, "") for b, items in enumerate(["ab", "ab", "ac", "d"]) for i in items]
    (r,) = run(spark, rows, min_count=2)
    assert (r.item_a, r.item_b, r.n_ab) == ("a", "b", 2) and abs(r.lift - 2 * 4 / (3 * 2)) < 1e-12 and abs(r.pmi - math.log(r.lift)) < 1e-12


def test_empty(spark):
    assert run(spark, []) == []


def test_association_of_all_pairs_has_rare_ones(spark, tmp_path):
    rows = [(b, i) for b, items in enumerate(["ab", "ab", "ab", "ab", "cd", "e"]) for i in items]
    spark.createDataFrame(rows, "article_id long, symbol string").write.parquet(str(tmp_path / "news_symbol.parquet"))
    got = {(r.symbol_a, r.symbol_b): (r.n_ab, r.lift) for r in QUERIES["p4_association_all"](spark, str(tmp_path)).collect()}
    assert got == {("A", "B"): (4, 1.5), ("C", "D"): (1, 6.0)}
