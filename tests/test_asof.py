import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.operators.asof import asof_versions

EV = "k string, at timestamp, id long, slice int, version_id_ string"
VE = "k string, version_id long, sic string, valid_from date, known_at timestamp, salt int"


def join(spark, events, versions, **kw):
    return asof_versions(
        spark.createDataFrame(events, EV),
        spark.createDataFrame(versions, VE),
        event_key=F.col("k"),
        event_time=F.col("at"),
        event_cols=["id"],
        version_key=F.col("k"),
        valid_from=F.col("valid_from"),
        known_at=F.col("known_at"),
        version_id="version_id",
        version_cols=["sic"],
        **kw,
    )


def brute(events, versions):
    out = []
    for k, at, i, *_ in events:
        best = None
        for vk, vid, sic, vf, ka, _ in versions:
            if None in (k, at, vk, vf, ka) or vk != k or ka > at or datetime.combine(vf, datetime.min.time()) > at:
                continue
            best = max(best or (vf, ka, vid, sic), (vf, ka, vid, sic))
        out.append((i, best[2] if best else None, best[3] if best else None))
    return sorted(out, key=str)


def random_case(n_events, n_versions, seed):
    rnd = random.Random(seed)
    start = datetime(2020, 1, 1)
    keys = ["HOT"] * 6 + ["A", "B", None]
    at = lambda: start + timedelta(hours=rnd.randrange(24 * 300))
    events = [(rnd.choice(keys), at() if rnd.random() > 0.05 else None, i, 1, "x") for i in range(n_events)]
    versions = [
        (rnd.choice(keys), i, rnd.choice(["10", "20", None]), at().date() if rnd.random() > 0.1 else None, at() if rnd.random() > 0.1 else None, 7)
        for i in range(n_versions)
    ]
    return events + events[:5], versions + versions[:3]


@pytest.mark.parametrize("shard_rows", [7, 60, 10**6])
def test_equals_brute_force_however_it_is_sharded(spark, shard_rows):
    events, versions = random_case(400, 60, shard_rows)
    got = [tuple(r) for r in join(spark, events, versions, how="left", shard_rows=shard_rows).collect()]
    assert sorted(got, key=str) == brute(events, versions)
    inner = [tuple(r) for r in join(spark, events, versions, shard_rows=shard_rows).collect()]
    assert sorted(inner, key=str) == [r for r in brute(events, versions) if r[1] is not None]


def test_one_day_larger_than_a_shard_is_salted(spark):
    day = datetime(2021, 5, 5)
    events = [("HOT", day, i, 0, "") for i in range(200)]
    versions = [("HOT", 1, "a", date(2021, 1, 1), datetime(2021, 1, 2), 0), ("HOT", 2, "b", date(2021, 5, 5), datetime(2021, 5, 5), 0)]
    got = join(spark, events, versions, shard_rows=10).collect()
    assert len(got) == 200 and {r.version_id for r in got} == {2}


def test_bounds_are_inclusive_and_ties_break_by_id(spark):
    at = datetime(2021, 5, 5, 12)
    versions = [("A", 1, "a", date(2021, 5, 5), at, 0), ("A", 3, "c", date(2021, 5, 5), at, 0), ("A", 2, "b", date(2021, 5, 5), at, 0), ("A", 9, "z", date(2021, 5, 6), datetime(2021, 1, 1), 0)]
    before, on = ("A", at - timedelta(microseconds=1), 1, 0, ""), ("A", at, 2, 0, "")
    assert [tuple(r) for r in join(spark, [before, on], versions).collect()] == [(2, 3, "c")]


def test_empty_tables(spark):
    assert join(spark, [], []).count() == 0
    assert join(spark, [("A", datetime(2021, 1, 1), 1, 0, "")], []).count() == 0
    assert join(spark, [("A", datetime(2021, 1, 1), 1, 0, "")], [], how="left").count() == 1
    with pytest.raises(ValueError):
        join(spark, [], [], how="outer")
