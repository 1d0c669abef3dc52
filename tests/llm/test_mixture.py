import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.llm import mixture as mx
from orrery.llm.mixture import allocate, exponential_key, mixture, mixture_of, shares
from orrery.llm.tokens import TOKENIZER, with_token_counts

REC = "src string, id long, size long, weight double, digit int, extra int"
TGT = "src string, share double, cap int, size long"


def mix(spark, recs, targets, **kw):
    df = mixture(spark.createDataFrame(recs, REC), spark.createDataFrame(targets, TGT), **kw)
    return {(r.src, r.id): r.copies for r in df.collect()}


def brute(spark, recs, targets):
    """The same by sorting each source whole."""
    weight = {r[1]: r[3] or 0.0 for r in recs}
    keys = {r.id: (weight[r.id] <= 0, r.key) for r in spark.createDataFrame(recs, REC).select("id", exponential_key(F.col("id"), F.col("weight"), 0).alias("key")).collect()}
    corpus = sum(r[2] or 0 for r in recs)
    out = {}
    for src, share, cap, _ in targets:
        own = sorted((keys[r[1]], r[1], r[2] or 0) for r in recs if r[0] == src and r[1] is not None)
        size = sum(s for *_, s in own)
        if not size:
            continue
        passes = min(int(share * corpus + 1e-6) // size, cap)
        left = 0 if passes == cap else int(share * corpus + 1e-6) - passes * size
        total = 0
        for _, i, s in own:
            total += s
            if n := passes + (total <= left):
                out[src, i] = n
    return out


TARGETS = [("a", 0.5, 9, 1), ("b", 0.2, 2, 1), ("c", 0.3, 1, 1), ("none", 0.0, 3, 1)]


@pytest.mark.parametrize("bits", [10, 2])
def test_equals_sorting_each_source_whole(spark, bits, monkeypatch):
    monkeypatch.setattr(mx, "_BITS", bits)
    rnd = random.Random(bits)
    recs = [(rnd.choice("aaaabccccccccd"), i, rnd.randrange(1, 500), rnd.choice([1e-300, 1e-9, 0.01, 0.5, 1.0, 3.0, 1e12]), 1, 1) for i in range(1500)]
    recs += [("a", 9001, 10, 0.0, 1, 1), ("a", 9002, 10, None, 1, 1), ("b", None, 10, 1.0, 1, 1), (None, 9003, 10, 1.0, 1, 1), ("a", 9004, None, 1.0, 1, 1)]
    got, want = mix(spark, recs, TARGETS), brute(spark, recs, TARGETS)
    assert {k: n for k, n in got.items()} == {k: n for k, n in want.items()}


def test_budget_that_ends_among_records_without_weight(spark):
    recs = [("a", i, 10, 1.0 if i < 50 else 0.0, 1, 1) for i in range(400)] + [("z", 1000, 1000, 1.0, 1, 1)]
    targets = [("a", 0.5, 1, 1)]
    got = mix(spark, recs, targets)
    assert got == brute(spark, recs, targets) and all(("a", i) in got for i in range(50)) and len(got) == 250


def test_complete_passes_come_first_and_caps_hold():
    assert allocate({"a": 100, "b": 10}, 1000, {"a": (0.25, 9), "b": (0.3, 5), "c": (0.45, 1)}) == {"a": (2, 50), "b": (5, 0)}


def test_shares_are_met(spark):
    rnd = random.Random(4)
    recs = [(s, 1000 * k + i, rnd.randrange(50, 150), 1.0, 1, 1) for k, (s, n) in enumerate([("a", 900), ("b", 90), ("c", 9)]) for i in range(n)]
    targets = spark.createDataFrame([("a", 0.6, 1, 1), ("b", 0.3, 5, 1), ("c", 0.1, 3, 1), ("z", 0.0, 1, 1)], TGT)
    m, corpus, capped = mixture_of(spark.createDataFrame(recs, REC), targets)
    by = {r.src: r for r in shares(m, targets, corpus, capped).collect()}
    assert corpus == sum(r[2] for r in recs)
    assert (by["a"].short, by["c"].short, by["z"].short) == ("next record", "cap", "")
    for s, share in (("a", 0.6), ("b", 0.3)):
        assert 0 <= share * corpus - by[s]["size"] <= 151
    assert by["c"].max_copies == 3 and by["c"].records == 9 and (by["z"]["size"], by["z"].actual_share) == (0, 0.0)


def test_heavier_records_come_earlier(spark):
    recs = [("a", i, 1, 4.0 if i % 2 else 1.0, 1, 1) for i in range(4000)]
    got = mix(spark, recs + [("pad", -1, 0, 1.0, 1, 1)], [("a", 0.25, 1, 1)])
    odd = sum(i % 2 for _, i in got)
    assert len(got) == 1000 and abs(odd / 1000 - 0.76) < 0.06


def test_empty_and_repeated(spark):
    assert mix(spark, [], TARGETS) == {} and mix(spark, [("a", 1, 5, 1.0, 1, 1)], []) == {}
    rec = ("a", 1, 5, 1.0, 1, 1)
    assert mix(spark, [rec, rec, ("d", 2, 10, 1.0, 1, 1)], [("a", 0.3, 1, 1), ("a", 0.1, 5, 1)]) == {}
    (k,) = spark.createDataFrame([("a", 1, 1, 1.0, 1, 1)], REC).select(exponential_key(F.col("id"), F.col("weight"), 0)).first()
    assert k > 0 and math.isfinite(k)


def test_token_counts(spark):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    texts = ["", None, "Hello world", "日本語 <|endoftext|> é", "long " * 100_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, text string, t int")
    got = {r.id: r.n_tokens for r in with_token_counts(df, F.col("text"), {"id": F.col("id")}).collect()}
    tok.encode_special_tokens = True
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
