from datetime import datetime, timedelta

import numpy as np

from orrery.plans.nightly import Step, nightly, run_steps


def fail():
    raise ValueError("no")


def test_failures_keep_back_what_depends_on_them():
    done, errors = run_steps([Step("a", lambda: "ok"), Step("b", fail), Step("c", lambda: "ok", ["b"]), Step("d", lambda: "ok", ["c"]), Step("e", lambda: "ok", ["a"])])
    assert done == ["a: ok", "e: ok"] and errors == ["b: no", "c: left out, as b failed", "d: left out, as c failed"]


def test_nightly_runs_again_to_the_same(spark, tmp_path):
    rng = np.random.default_rng(1)
    f = rng.normal(0, 0.01, 40)
    rows = [(s, datetime(2024, 1, 1, 4) + timedelta(i), float(c), 1.0) for s in "ABC" for i, c in enumerate(50 * np.cumprod(1 + f + rng.normal(0, 0.003, 40)))]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double, volume double")
    first = nightly(spark, df, str(tmp_path), trail=30)
    assert first[1] == [] and len(first[0]) == 2
    snap = lambda: sorted((r.a, r.b, round(r["corr"], 9), str(r.as_of)) for r in spark.read.parquet(f"{tmp_path}/moves_with.parquet").collect())
    was = snap()
    assert {r[:2] for r in was} == {("A", "B"), ("A", "C"), ("B", "C")}
    assert nightly(spark, df, str(tmp_path), trail=30) == first and snap() == was
    late = spark.createDataFrame([(s, datetime(2024, 2, 10, 4), 50.0, 1.0) for s in "ABC"], df.schema)
    nightly(spark, late, str(tmp_path), trail=30)
    assert {r[3] for r in snap()} == {"2024-02-09", "2024-02-10"} and set(was) <= set(snap())
    assert nightly(spark, late, str(tmp_path), trail=300)[1][0].startswith("comovement: only 40 sessions")
