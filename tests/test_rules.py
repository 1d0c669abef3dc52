from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.functions import passages
from orrery.operators.graphs import shown_ways
from orrery.operators.panel import pinned_split
from orrery.plans.market import is_fund, is_leveraged
from orrery.plans.mentions import Vocabulary, mentions, short_name

FUNDS = {
    "ProShares Ultra QQQ": (True, True), "Direxion Daily Semiconductor Bull 3X Shares": (True, True), "Barclays ETN+": (True, False), "Global Funds": (True, False),
    "Vanguard Growth ETF": (True, False), "GraniteShares 1.25x Long": (True, True), "Tradr -2x Short Daily": (True, True), "Index Corp": (False, False),
    "Build-A-Bear Workshop": (False, False), "10x Genomics": (False, False), "Ultragenyx Pharmaceutical": (False, False), "Trustmark": (False, False), "Ultra Clean Holdings": (False, False), None: (False, False),
}


def test_names_of_funds(spark):
    df = spark.createDataFrame([(n,) for n in FUNDS], "n string")
    assert {r.n: (r.f, r.x) for r in df.select("n", is_fund(F.col("n")).alias("f"), is_leveraged(F.col("n")).alias("x")).collect()} == FUNDS


def test_split_fails_loudly(spark):
    days = [date(2022, 9, 1), date(2022, 9, 2), date(2022, 9, 6), date(2022, 9, 7)]
    p = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d date, i int")
    first, second = pinned_split(p, days[2], before=2, last=days[1])
    assert [first.count(), second.count()] == [2, 2]
    for start, pins in [(date(2022, 9, 5), {}), (date(2021, 1, 1), {}), (date(2023, 1, 1), {}), (days[2], {"before": 3}), (days[2], {"last": days[0]})]:
        with pytest.raises(ValueError):
            pinned_split(p, start, **pins)
    with pytest.raises(ValueError):
        pinned_split(p.limit(0), days[0])


def test_quotes(spark):
    cases = [
        ("Our ten largest customers accounted for 69% of sales. Direct sales to Acme Inc. accounted for 27.7% of it. More.", "Acme, Inc.", ("Direct sales to Acme Inc. accounted for 27.7% of it", "27.7")),
        ("Customers of 10% or more include Acme, at 12 %.", "Acme", ("Customers of 10% or more include Acme, at 12 %.", "12")),
        ("Acme exceeds 10% or Greater of sales.", "Acme", ("Acme exceeds 10% or Greater of sales.", None)),
        ("The U.S. Treasury and J. Smith buy from Acme. Others do not.", "Acme", ("The U.S. Treasury and J. Smith buy from Acme", None)),
        ("Nobody here.", "Acme", (None, None)), (None, "Acme", (None, None)), ("Acme", None, (None, None)), ("Acme", "  ", (None, None)),
    ]
    df = spark.createDataFrame([(i, p, n) for i, (p, n, _) in enumerate(cases)], "i int, p string, n string")
    got = {r.i: (r.x.says, r.x.pct) for r in df.select("i", passages.disclosure(F.col("p"), F.col("n")).alias("x")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_shown_way_is_short_then_large_then_late(spark):
    d = lambda n: date(2020, 1, 1) + timedelta(n)
    e = spark.createDataFrame([("S", "T", d(1), None), ("S", "M", d(2), 90.0), ("M", "T", d(3), 1.0), ("X", "M", d(4), 5.0), ("X", "N", d(5), 5.0), ("N", "T", d(6), None), ("S", "T", d(9), None)], "src string, dst string, day date, share double")
    start = spark.createDataFrame([("T", "T", d(8))], "sid string, start string, as_of date")
    got = {r.node: (r.depth, ">".join(reversed(r.path)), r.filed) for r in shown_ways(start, e).collect()}
    assert got == {"S": (1, "S>T", d(1)), "M": (1, "M>T", d(3)), "N": (1, "N>T", d(6)), "X": (2, "X>N>T", d(5))}


def test_mentions(spark):
    v = Vocabulary(["Advanced", "Advanced Micro Devices", "Micro", "Acme & Co", "Café Rio"])
    text = "Advanced Micro Devices and Advanced, Micro; Advancedness, Acme & Co. AdvancedMicro Café Rio"
    assert [n for _, n in v.mentions(text)] == ["Advanced Micro Devices", "Advanced", "Micro", "Acme & Co", "Café Rio"]
    assert all(text.startswith(n, at) for at, n in v.mentions(text)) and v.mentions("") == []
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (1, text, 0)], "id long, text string, at int")
    assert mentions(df, ["Micro"]).count() == 4 and mentions(df.limit(0), ["Micro"]).count() == 0 and mentions(df, []).count() == 0
    t = spark.createDataFrame([("Apple Inc.",), ("NVIDIA CORP",), ("Abc, Inc",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(short_name(F.col("t"))).collect()] == ["Apple", "NVIDIA CORP", None, None, None]
