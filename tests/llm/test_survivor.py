import itertools
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.survivor import Bundle, branch_and_bound, survivors

SCHEMA = "k string, id long, a string, sa int, b string, sb int, g string, total int"


def bundles():
    one = lambda n: Bundle(n, F.col(n).isNotNull(), F.col(f"s{n}") / 100, [], F.col(n))
    return [one("a"), one("b")]


def brute(rows, rules):
    """The best total of each group over all choices of values that fit the rules."""
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == k]
        pos = {"a": 2, "b": 4}
        best = {n: {} for n in pos}
        for r in own:
            for n, i in pos.items():
                if r[i] is not None and (r[i + 1] is not None):
                    best[n][r[i]] = max(best[n].get(r[i], (-1, -1)), (r[i + 1], r[1]))

        def fits(c):
            for d, y in rules:
                cand = [((r[pos[y] + 1], r[1]), r[pos[y]]) for r in own if r[pos[d]] == c[d] and c[d] is not None and r[pos[y]] is not None]
                if cand and c[y] != max(cand)[1]:
                    return False
            return True

        choices = [dict(zip(pos, c)) for c in itertools.product([*best["a"], None], [*best["b"], None])]
        out[k] = max(sum(best[n][c[n]][0] / 100 if c[n] else 0 for n in pos) for c in choices if fits(c))
    return out


@pytest.mark.parametrize("rules", [[], [("a", "b")], [("a", "b"), ("b", "a")]])
@pytest.mark.parametrize("shortlist", [1, 4])
def test_totals_equal_exhaustive_search(spark, rules, shortlist):
    rnd = random.Random(len(rules))
    rows = []
    for i in range(400):
        k = "big" if rnd.random() < 0.4 else f"k{rnd.randrange(40)}"
        rows.append((k, i, rnd.choice([None, *"abcdefghij"]), rnd.randrange(1, 90), rnd.choice([None, *"uvwxyz"]), rnd.randrange(1, 90), "x", 1))
    got = survivors(spark.createDataFrame(rows, SCHEMA), ["k"], "id", bundles(), rules=rules, shortlist=shortlist)
    got = {r.k: r.total for r in got.collect()}
    want = brute(rows, rules)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_conflict_is_resolved_towards_the_better_sum():
    c = lambda i, s, v, need=None: {"id": i, "score": s, "value": v, "need": [need]}
    lists = [[c(1, 0.9, "x", "p"), c(2, 0.8, "y", "q")], [c(3, 0.9, "q"), c(4, 0.2, "p")]]
    choice, total, root = branch_and_bound(lists, [(0, 1)], [1, 1])
    assert [x["id"] for x in choice] == [2, 3] and not root and abs(total - 1.7) < 1e-9
    assert branch_and_bound([[], []], [(0, 1)], [1, 1]) == ([None, None], 0.0, True)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, 1, "a", 5, "u", 5, "", 0), ("k", 2, None, 5, None, 5, "", 0), ("k", 2, None, 5, None, 5, "", 0), ("t", 3, "a", 5, "u", 5, "", 0), ("t", 4, "b", 5, "u", 5, "", 0)]
    got = {r.k: (r.a_id, r.a, r.b_id, r.b) for r in survivors(spark.createDataFrame(rows, SCHEMA), ["k"], "id", bundles(), min_rows=2).collect()}
    assert got == {"k": (0, None, 0, None), "t": (4, "b", 4, "u")}
    assert survivors(spark.createDataFrame([], SCHEMA), ["k"], "id", bundles()).count() == 0
    assert survivors(spark.createDataFrame([], SCHEMA), ["k"], "id", bundles(), rules=[("a", "b")]).count() == 0


def test_very_long_values(spark):
    rows = [("k", i, "x" * (200_000 + i), 5 + i, "u", 5, "", 0) for i in range(3)]
    (r,) = survivors(spark.createDataFrame(rows, SCHEMA), ["k"], "id", bundles(), rules=[("a", "b")]).collect()
    assert (r.a_id, len(r.a)) == (2, 200_002)


@pytest.mark.parametrize("rules", [[(0, 1)], [(1, 0), (2, 0)], [(0, 2), (1, 2)], [(0, 1), (1, 2), (2, 0)], []])
def test_search_equals_trying_everything(rules):
    rnd = random.Random(str(rules))
    for _ in range(200):
        lists = []
        for b in range(3):
            own = [{"id": 10 * b + k, "score": rnd.choice([0.125, 0.25, 0.5, 0.75]), "value": f"{b}{k}", "need": [rnd.choice([None, *(f"{y}{j}" for j in range(4))]) if d == b else None for d, y in rules]} for k in range(rnd.randrange(5))]
            lists.append(sorted(own, key=lambda c: -c["score"]))
        weights = [rnd.choice([0.5, 1.0, 2.0]) for _ in range(3)]
        fit = lambda c: all(c[d] is None or c[d]["need"][r] is None or (c[y] is not None and c[y]["value"] == c[d]["need"][r]) for r, (d, y) in enumerate(rules))
        tops = [(sum(w * x["score"] for w, x in zip(weights, c) if x), c) for c in itertools.product(*[[*own, None] for own in lists]) if fit(c)]
        most = max(t for t, _ in tops)
        choice, total, _ = branch_and_bound(lists, rules, weights)
        assert abs(total - most) < 1e-9 and tuple(choice) == next(c for t, c in tops if abs(t - total) < 1e-9)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_large_conflict_ends(order):
    """Dates and passages that each demand another share, in any order of bundles."""
    at = {b: k for k, b in enumerate(order)}
    n = 10_000
    share = [{"id": k, "score": 1 - k / (2 * n), "value": f"p{k}", "need": [None, None]} for k in range(n)]
    date = [{"id": k, "score": 1 - k / (2 * n), "value": f"d{k}", "need": [f"p{n - 1 - k}", None]} for k in range(n)]
    text = [{"id": k, "score": 1 - k / (2 * n), "value": f"t{k}", "need": [None, f"p{(7 * k + 3) % n}"]} for k in range(n)]
    lists = [[share, date, text][b] for b in order]
    choice, total, _ = branch_and_bound(lists, [(at[1], at[0]), (at[2], at[0])], [1, 1, 1])
    demand = {f"p{(7 * k + 3) % n}": k for k in range(n)}
    # By share: all three, or the share with nothing that demands another; or a date or passage with its share.
    best = max(3 - (k + (n - 1 - k) + demand[f"p{k}"]) / (2 * n) for k in range(n))
    assert abs(total - best) < 1e-9
