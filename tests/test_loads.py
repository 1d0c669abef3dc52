import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orrery.operators import records as rec
from orrery.sources import readers, sinks
from orrery.streaming.bars import SCHEMA, follow

T = datetime.fromisoformat


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_prefers_what_is_fresh_and_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "s string, d int, c double")
    new = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 3.0), ("A", 2, 3.0)], old.schema)
    once = rec.merge_latest(old, new, ["s", "d"])
    assert rows(once) == [("A", 1, 9.0), ("A", 2, 3.0), ("B", 1, 2.0)] == rows(rec.merge_latest(once, new, ["s", "d"]))
    assert rows(rec.insert_new(old, new, ["s", "d"])) == [("A", 2, 3.0)]
    assert rec.watermark(old.limit(0), F.col("d")).first()[0] is None


def test_fields_merge_one_by_one(spark):
    old = spark.createDataFrame([("A", "x", "1"), ("B", "y", None)], "k string, name string, sic string")
    new = spark.createDataFrame([("A", None, 5), ("C", "2", None)], "k string, sic string, n int")
    assert rows(rec.merge_fields(old, new, ["k"])) == [("A", "x", "1", 5), ("B", "y", None, None), ("C", None, "2", None)]
    assert rows(rec.update_from(old, new.select("k", "sic"), ["k"])) == [("A", "x", None), ("B", "y", None)]
    assert rows(rec.missing(old, spark.createDataFrame([(1,)], "k int"), F.col("k"), F.col("k"))) == [("A",), ("B",)]
    acts = spark.createDataFrame([("A", None, None), (None, "O", "N")], "symbol string, old_symbol string, new_symbol string")
    assert rows(rec.split_symbols(acts)) == [("A",), ("N",), ("O",)]


def test_readers(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("ticker,posted_at,direction\nA,2026-04-27 00:00:00+00,up\nB,2026-04-27,down\nC,,up\nD,2026-04-28 1x,up\nE,2026-01-01,\n")
    got = {r.symbol: (r.direction, r.as_of, r.as_of_ts is None) for r in readers.signals(spark, str(p)).collect()}
    assert got == {"A": ("up", date(2026, 4, 27), False), "B": ("down", date(2026, 4, 27), True), "D": ("up", date(2026, 4, 28), True)}
    assert readers.signals(spark, str(p), "2026-04-28").count() == 1
    assert readers.exclusions(spark, str(tmp_path / "none.csv")).count() == 0
    assert readers.bars_between(spark, str(tmp_path / "none"), "2024-01-01", "2024-01-02") is None
    spark.createDataFrame([("A", T("2024-01-01T04:00:00")), ("A", T("2024-01-03T04:00:00"))], "symbol string, timestamp timestamp").write.parquet(str(tmp_path / "b"))
    b = lambda: readers.bars_between(spark, str(tmp_path / "b"), "2024-01-01", "2024-01-02")
    assert b().count() == 1 and readers.first_readable([lambda: None, b]).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.first_readable([lambda: None])
    t = tmp_path / "sub.txt"
    t.write_bytes("cik\tfiled\tname\n1\t20200101\tCaf\xe9\n1\t20210101\tBar\n".encode("latin-1"))
    assert rows(readers.tab_separated(spark, str(t), "cik", "filed")) == [("1", "20210101", "Bar")]
    j = tmp_path / "plan.json"
    j.write_text(json.dumps({"2024-01-02": {"A": {"neighbours": ["B"], "control": ["C", "D"]}}}))
    assert rows(readers.fetch_plan(spark, str(j))) == [("2024-01-02", "A", "control", "C"), ("2024-01-02", "A", "control", "D"), ("2024-01-02", "A", "neighbours", "B")]
    log = spark.createDataFrame([("alert", "t", "x", json.dumps({"action": "BTO", "signal_id": "1", "ticker": "ABC240119C5", "right": "C"})), ("alert", "t", "x", json.dumps({"action": "STC", "signal_id": "1"})), ("alert", "t", "x", "{broken")], "kind string, tenant_id string, occurred_at string, subject string")
    assert rows(readers.audit_log(log, "alert")) == [("t", "x", "1", "ABC", "up")]
    with pytest.raises(RuntimeError):
        readers.jdbc(spark, "t", {})


def test_named_sources_and_bounds():
    made = {"scan": lambda: "all", "leader": lambda s: s}
    assert readers.named("scan", made) == "all" and readers.named("leader:ABC", made) == "ABC"
    for bad in ("other", "leader:a b", "leader:"):
        with pytest.raises(ValueError):
            readers.named(bad, made)
    assert readers.bounded("0.5", 0, 1) == 0.5
    for bad in ("2", "nan", "inf", "x"):
        with pytest.raises(ValueError):
            readers.bounded(bad, 0, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("B", 2), ("A", 1)], "k string, v int")
    path = str(tmp_path / "t")
    sinks.replace_parquet(df, path)
    sinks.replace_parquet(spark.read.parquet(path).where("v = 1"), path)
    assert rows(spark.read.parquet(path)) == [("A", 1)] and len(list(tmp_path.iterdir())) == 1
    snap = str(tmp_path / "snap")
    sinks.replace_snapshots(df, snap, "k")
    sinks.replace_snapshots(spark.createDataFrame([("A", 7)], df.schema), snap, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(snap).collect()) == [("A", 7), ("B", 2)]
    sinks.golden_csv(df, str(tmp_path / "csv"))
    assert [p.read_text() for p in (tmp_path / "csv").glob("*.csv")] == ["k,v\nA,1\nB,2\n"]
    assert rows(sinks.trace_json(df)) == [('{"k":"A","v":1}',), ('{"k":"B","v":2}',)]
    assert list(sinks.server_events([("done", {"n": 1})])) == ['event: done\ndata: {"n": 1}\n\n']
    assert sinks.show(df.orderBy("k")) == "A 1\nB 2"


def test_versions_are_switched_by_a_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.published(spark, path) is None
    for n in range(4):
        sinks.publish(spark.range(n + 1), path)
        assert sinks.published(spark, path).count() == n + 1
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2
    sinks.publish(sinks.published(spark, path).limit(1), path)  # read and written at once
    assert sinks.published(spark, path).count() == 1


def test_only_days_of_a_batch_are_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda r: sinks.merge_days(spark.createDataFrame(r, "s string, t timestamp, c double"), path, ["s", "t"], F.to_date("t"), rec.merge_latest)
    put([("A", T("2024-01-02T05:00:00"), 1.0), ("A", T("2024-01-03T05:00:00"), 2.0)])
    first = sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").glob("*.parquet"))
    put([("A", T("2024-01-03T05:00:00"), 9.0), ("B", T("2024-01-04T05:00:00"), 3.0)])
    put([])
    assert sorted((r.s, r.c) for r in spark.read.parquet(path).collect()) == [("A", 1.0), ("A", 9.0), ("B", 3.0)]
    assert sorted(p.name for p in (tmp_path / "t" / "day=2024-01-02").glob("*.parquet")) == first


def test_stream_merges_files_and_runs_again_without_change(spark, tmp_path):
    inbox, target, mark = (str(tmp_path / x) for x in ("inbox", "target", "mark"))
    put = lambda name, r: spark.createDataFrame(r, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    t1, t2 = T("2024-01-02T05:00:00"), T("2024-01-03T05:00:00")
    put("a", [("A", t1, 1.0, 1.0), ("B", t1, 2.0, 1.0)])
    follow(spark, inbox, target, mark).awaitTermination(120)
    put("b", [("A", t1, 5.0, 1.0), ("A", t2, 3.0, 1.0)])
    for _ in range(2):
        follow(spark, inbox, target, mark).awaitTermination(120)
        assert sorted((r.symbol, r.timestamp, r.close) for r in spark.read.parquet(target).collect()) == [("A", t1, 5.0), ("A", t2, 3.0), ("B", t1, 2.0)]
