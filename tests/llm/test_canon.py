import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.canon import fits, map_to_canonical, within_one_edit, words
from orrery.llm.q_names import p6_resolved

REF = [
    ("KLV", "Klevendne Industries Company", None, "x"),
    ("SKL", "Siklomzend Laboratories, Inc.", None, "x"),
    ("SKA", "SIKLOMZEND AIRLINES INC.", "Crygivwa Energy Group plc", "x"),
    ("DMN", "Daeman Water Utilities Co.", None, "x"),
    (None, "Nobody Corp.", None, "x"),
    ("EMP", None, None, "x"),
]
CASES = {
    "Klevendne Industries Company": "KLV",
    "KLEVENDNE": "KLV",
    "  Klevéndne\xa0Inds. ": "KLV",
    "Industries, Klevendne": "KLV",
    "Klevendne Industries Canada ULC": "KLV",
    "affiliates of Klevendne Industries": "KLV",
    "Klev-endne Industries": "KLV",
    "Klev endne Industries": "KLV",
    "KlevendneIndustries": "KLV",
    "K1evendne Industries": "KLV",
    "Klevednne Industries": "KLV",
    "Daernan Water Utils": "DMN",
    "NYSE: KLV": "KLV",
    "Listed firm (SKL)": "SKL",
    "Siklomzend Labs": "SKL",
    "Siklomzned Airlines": "SKA",
    "Crygivwa Energy": "SKA",
    "Siklomzend": "UNMATCHED",
    "Klevendne Airlines": "UNMATCHED",
    "Novilzi Industries": "UNMATCHED",
    "various distributors": "UNMATCHED",
    "Industries": "UNMATCHED",
    "": "UNMATCHED",
    "§ 4": "UNMATCHED",
    "word " * 20_000 + "Klevendne Industries": "KLV",
}


@pytest.mark.parametrize("part_rows", [100, 2])
def test_cases(spark, part_rows):
    values = spark.createDataFrame([(v, "x") for v in [*CASES, *CASES, None]], "value string, ref string")
    ref = spark.createDataFrame(REF, "ticker string, title string, former string, value string")
    # Words that describe must be common in a list; a few more entries make them so.
    more = [(f"Z{i}{s[0]}", f"Zq{'abcdefghijklmnop'[i]}rt{s[:3].lower()} {s} Inc", None, "x") for i in range(12) for s in ("Industries", "Laboratories", "Airlines", "Water Utilities", "Energy")]
    ref = ref.unionByName(spark.createDataFrame(more, ref.schema))
    got = {r.value: r.ref for r in map_to_canonical(values, F.col("value"), ref, ident="ticker", names=["title", "former"], prefixes=["NYSE"], part_rows=50 if part_rows == 100 else 20).collect()}
    assert got == CASES


def found(spark, values, entries, **kw):
    ref = spark.createDataFrame(entries, "ticker string, title string")
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.value: (r.ref, r.score) for r in map_to_canonical(df, F.col("v"), ref, ident="ticker", names=["title"], prefixes=["NYSE"], **kw).collect()}


def test_longer_names_win_across_parts(spark):
    entries = [("AAA", "Klevendne Industries"), ("BBB", "Klevendne Industries Motors"), ("CCC", "Motors Zendak")]
    values = ["Klevendne Industries Motors", "Klevendne Industries", "Klevendne Industries Motors Zendak", "x (AAA)", "NYSE: BBB (AAA)"]
    one = found(spark, values, entries)
    assert one["Klevendne Industries Motors"][0] == "BBB" and one["Klevendne Industries"][0] == "AAA"
    assert all(found(spark, values, entries, part_rows=n) == one for n in (1, 2))


def test_parts_of_random_lists_equal_one_pass(spark):
    rnd = random.Random(8)
    stems = ["kladen", "zorvik", "brume", "tessal", "ovin", "quarl", "mirtan", "holvex", "pradi"]
    kinds = ["Industries", "Motors", "Energy", "Labs", "Optics"]
    entries = [(f"T{i}", " ".join([*rnd.sample(stems, rnd.choice([1, 1, 2])), *rnd.sample(kinds, rnd.choice([0, 1, 1, 2]))])) for i in range(40)]
    typo = lambda w: w if rnd.random() < 0.6 else w[: (k := rnd.randrange(1, len(w)))] + rnd.choice(["", "x"]) + w[k + 1 :]
    values = [" ".join(typo(w) for w in (*rnd.sample(stems, rnd.choice([1, 2])), *rnd.sample(kinds, rnd.choice([0, 1, 2])))) for _ in range(150)] + ["(T3)", "NYSE: T7 kladen"]
    one = found(spark, values, entries, common=6)
    assert 20 < sum(r != "UNMATCHED" for r, _ in one.values()) < len(one)
    assert all(found(spark, values, entries, common=6, part_rows=n) == one for n in (7, 25))


@pytest.mark.parametrize("part_rows", [1000, 30])
def test_names_of_common_words_only_are_found(spark, part_rows):
    kinds = ["Industries", "Motors", "Airlines", "Energy", "Optics", "Foods", "Chemicals", "Software", "Devices", "Packaging", "Logistics", "Networks", "Materials"]
    names = [f"{n} {k} Inc" for n in ("Klevendne", "Siklomzend", *(f"{a}{b}rtvun" for a in "bdfg" for b in "aeo")) for k in kinds]
    entries = [(f"T{i}", n) for i, n in enumerate(names)]
    ticker = {n: t for t, n in entries}
    want = {
        "Klevendne Motrs": ticker["Klevendne Motors Inc"],
        "Klevednne Motors Corp.": ticker["Klevendne Motors Inc"],
        "Klevendne Motrs Canada ULC": ticker["Klevendne Motors Inc"],
        "Siklomzend Airlns": ticker["Siklomzend Airlines Inc"],
        "Motrs, Siklomzend": ticker["Siklomzend Motors Inc"],
        "Klevednne": "UNMATCHED",
        "Novilzi Motrs": "UNMATCHED",
        "Klevednne Siklomzend": "UNMATCHED",
    }
    got = found(spark, list(want), entries, part_rows=part_rows)
    assert {v: r for v, (r, _) in got.items()} == want


@pytest.mark.parametrize("part_rows", [1000, 3])
def test_names_in_any_number_of_pieces(spark, part_rows):
    entries = [("KLV", "Klevendnerostimpal Industries"), ("RNR", "Burnhornturnwold Foods")] + [(f"Z{i}", f"Zq{c}rtvu Industries") for i, c in enumerate("abcdefghijklmnop")]
    want = {"Kl ev en dne ro stim pal Industries": "KLV", "kl ev en dne rost impol": "KLV", "Bu rn ho rn tu rn wo ld": "RNR", "ur om tum wo ld": "UNMATCHED"}
    got = found(spark, list(want), entries, part_rows=part_rows)
    assert {v: r for v, (r, _) in got.items()} == want


def test_empty_list_and_values(spark):
    ref = spark.createDataFrame([], "ticker string, title string")
    values = spark.createDataFrame([("a",)], "v string")
    assert map_to_canonical(values, F.col("v"), ref, ident="ticker", names=["title"]).first().ref == "UNMATCHED"
    assert map_to_canonical(values.limit(0), F.col("v"), ref, ident="ticker", names=["title"]).count() == 0


def test_words_and_forms():
    assert words("DríbrefemAerospace N.V. (0ne)") == ["dribrefem", "aerospace", "n", "v", "one"]
    assert within_one_edit("ab", "ba") and within_one_edit("abc", "abcd") and not within_one_edit("abcd", "badc")
    for t, w in [("mtrs", "motors"), ("tech", "technologies"), ("industrial", "industries"), ("optical", "optics"), ("pckg", "packaging"), ("energies", "energy")]:
        assert fits(t, w)
    assert not fits("motors", "optics") and not fits("a", "airlines")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_accuracy_on_mentions_with_a_known_ticker(spark):
    root = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{root}/filing_mention.parquet").join(spark.read.parquet(f"{root}/company_ref.parquet").select(F.col("ticker").alias("cp_ticker")), "cp_ticker")
    found = map_to_canonical(known, F.col("counterparty"), spark.read.parquet(f"{root}/company_ref.parquet"), ident="ticker", names=["title", "former_title"], prefixes=["NYSE", "NASDAQ", "ARCA"])
    both = known.join(found, known["counterparty"] == found["value"])
    assert both.where("ref = cp_ticker").count() >= 0.99 * known.count() > 0
    assert p6_resolved(spark, root).count() == spark.read.parquet(f"{root}/filing_mention.parquet").count()
