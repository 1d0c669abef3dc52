import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.segtree import build_trees, correct_trees, leaves_of, range_sums, rolling, trailing, _rollup

SCHEMA = "symbol string, date date, close double, ingested_at timestamp, shard int, lo int"
START = date(2019, 12, 20)


def bars(seed, days=700):
    rnd = random.Random(seed)
    rows = []
    for s in ("A", "B", "C"):
        for d in range(days):
            if (s == "C" and 60 < d < 640) or rnd.random() < 0.3:
                continue
            for n in range(rnd.choice([1, 1, 2])):
                close = None if rnd.random() < 0.1 else round(rnd.uniform(1, 99), 2)
                rows.append((s, START + timedelta(d), close, datetime(2022, 1, 1) + timedelta(hours=len(rows)), 1, 1))
    return rows


def brute(rows, windows):
    last = {}
    for s, d, c, t, *_ in rows:
        if (s, d) not in last or last[s, d][0] < t:
            last[s, d] = (t, c)
    out = {}
    for s in {s for s, _ in last}:
        days = sorted(d for x, d in last if x == s)
        for i in range((days[-1] - days[0]).days + 1):
            d = days[0] + timedelta(i)
            for w in windows:
                v = [last[s, d - timedelta(j)][1] for j in range(w) if (s, d - timedelta(j)) in last]
                v = [x for x in v if x is not None]
                out[s, d, w] = (round(sum(v), 6), len(v))
    return out


def result(df, windows):
    return {(r.k, r.day, w): (round(r[f"sum_{w}"], 6), r[f"count_{w}"]) for r in df.collect() for w in windows}


def args():
    return dict(key=F.col("symbol"), day=F.col("date"), value=F.col("close"), latest=F.col("ingested_at"))


@pytest.mark.parametrize("windows", [(7, 30), (1, 2, 45)])
def test_rolling_equals_brute_force(spark, windows):
    rows = bars(1)
    got = rolling(spark.createDataFrame(rows, SCHEMA), windows=windows, **args())
    assert result(got, windows) == brute(rows, windows)
    assert all((r.avg_2 is None) == (r.count_2 == 0) for r in got.collect()) if 2 in windows else True


def test_corrections_touch_ancestors_and_equal_a_rebuild(spark):
    rows = bars(2)
    rnd = random.Random(3)
    trees = build_trees(leaves_of(spark.createDataFrame(rows, SCHEMA), **args()), (7, 30))
    keys = sorted({(s, d) for s, d, *_ in rows})
    late = [(s, d, None if rnd.random() < 0.2 else 50.0, datetime(2030, 1, 1), 1, 1) for s, d in rnd.sample(keys, 40)]
    fix = spark.createDataFrame([(s, (d - date(1970, 1, 1)).days, c) for s, d, c, *_ in late], "k string, d int, v double")
    fixed = correct_trees(trees, fix, (7, 30))
    assert result(trailing(fixed, (7, 30)), (7, 30)) == brute(rows + late, (7, 30))
    one = correct_trees(trees, fix.limit(1), (7, 30))
    was, now = ({(r.k, r.shard): r.counts + r.sums for r in t.collect()} for t in (trees, one))
    changed = [sum(a != b for a, b in zip(was[k], now[k])) for k in was]
    assert 0 < max(changed) <= 2 * 10 and sum(c > 0 for c in changed) <= 2


@pytest.mark.parametrize("windows", [(7, 30), (1,)])
def test_corrections_extend_the_calendar(spark, windows):
    rows = bars(5)
    days = sorted({d for _, d, *_ in rows})
    early = [r for r in rows if days[len(days) // 3] <= r[1] <= days[len(days) // 2]]
    far = [("A", days[-1] + timedelta(days=900), 7.0, datetime(2031, 1, 1), 1, 1), ("A", days[0] - timedelta(days=700), None, datetime(2031, 1, 1), 1, 1), ("NEW", days[0], 3.0, datetime(2031, 1, 1), 1, 1)]
    late = [r for r in rows if r not in early] + far
    df = lambda x: leaves_of(spark.createDataFrame(x, SCHEMA), **args())
    fixed = correct_trees(build_trees(df(early), windows), df(late), windows)
    assert result(trailing(fixed, windows), windows) == brute(early + late, windows)


def test_node_sums():
    t = np.zeros((2, 16), np.int64)
    t[:, 8:] = np.arange(16).reshape(2, 8)
    _rollup(t)
    for lo in range(8):
        for hi in range(lo, 9):
            assert range_sums(t, np.array([lo]), np.array([hi]))[:, 0].tolist() == t[:, 8 + lo : 8 + hi].sum(1).tolist()


def test_empty_nulls_and_single_rows(spark):
    assert rolling(spark.createDataFrame([], SCHEMA), **args()).count() == 0
    rows = [(None, START, 1.0, None, 1, 1), ("A", None, 1.0, None, 1, 1), ("A", START, None, None, 1, 1), ("A", START, 2.0, None, 1, 1)]
    assert [tuple(r)[:4] for r in rolling(spark.createDataFrame(rows, SCHEMA), **args()).collect()] == [("A", START, 2.0, 1)]
    with pytest.raises(ValueError):
        rolling(spark.createDataFrame([], SCHEMA), windows=(0,), **args())
