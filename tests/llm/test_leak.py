import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import leak
from orrery.llm.leak import leaked, search, suffix_array, without_leaks, words


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "id long, text string, item_id long")
    t = spark.createDataFrame([(i, t, 1) for i, t in items], "id long, text string, doc_id long")
    return leaked(d, t, doc_id=F.col("id"), doc_text=F.col("text"), item_id=F.col("id"), item_text=F.col("text"), **kw)


def brute(docs, items, n):
    """The longest common run of words of every document and item, where it has n words or more."""
    out = {}
    for d, dt in docs:
        for i, it in items:
            if None in (d, dt, i, it):
                continue
            a, b = words(dt), words(it)
            longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a) - 1, -1, -1):
                for y in range(len(b) - 1, -1, -1):
                    longest[x][y] = longest[x + 1][y + 1] + 1 if a[x] == b[y] else 0
            top = max(map(max, longest))
            if top >= n:
                out[d, i] = top
    return out


@pytest.mark.parametrize("shard_words, part_words", [(500_000, 2_000_000), (40, 60)])
def test_equals_brute_force(spark, shard_words, part_words):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    docs = [(i, text(rnd.randrange(150))) for i in range(40)] + [(90, None), (91, ""), (None, text(80)), (92, "Zz!")]
    items = [(i, text(rnd.randrange(30))) for i in range(12)] + [(50, None), (51, ""), (52, docs[3][1])]
    got = {(r.doc_id, r.item_id): r.n_words for r in run(spark, docs + docs[:3], items + items[:2], min_words=6, shard_words=shard_words, part_words=part_words).collect()}
    assert got == brute(docs, items, 6)


def test_places_case_and_punctuation(spark):
    item = "It is, as SAID before: the quick brown fox (jumps) over the lazy dog today!"
    docs = [(1, "intro words " + item.upper().replace(",", " --") + " more"), (2, "the quick brown fox jumps over the lazy dog today"), (3, "x " * 300_000 + item)]
    got = sorted(map(tuple, run(spark, docs, [(7, item)], min_words=12, shard_words=1000).collect()))
    assert got == [(1, 7, 15, 2, 0), (3, 7, 15, 300_000, 0)]


def test_removal_and_empty(spark):
    docs = [(1, "a b c d"), (2, "x"), (None, "a b c d")]
    d = spark.createDataFrame(docs, "id long, text string")
    hits = run(spark, docs, [(1, "a b c d")], min_words=3)
    assert sorted(map(str, [r.id for r in without_leaks(d, hits, "id").collect()])) == ["2", "None"]
    assert run(spark, [], [(1, "a b c")], min_words=2).count() == 0 and run(spark, docs, [], min_words=2).count() == 0
    with pytest.raises(ValueError):
        run(spark, docs, docs, min_words=0)


def test_suffix_array_and_blocks(monkeypatch):
    rnd = np.random.default_rng(1)
    a = np.append(rnd.integers(0, 3, 300), 0)
    sa = suffix_array(a, 300)
    key = [tuple(a[i : np.append(np.flatnonzero(a[i:] == 0), len(a) - i)[0] + i]) for i in sa]
    assert sorted(sa) == list(np.flatnonzero(a > 0)) and key == sorted(key)
    b = np.array([0, 1, 2, 1, 1, 2, 0, 2, 2, 1, 1, 0])
    whole = sorted(zip(*search(a, b, 2, 6)))
    monkeypatch.setattr(leak, "_BLOCK", 3)
    assert sorted(zip(*search(a, b, 2, 6))) == whole != []


def test_words():
    assert words("Aa_bb-C3 é½ Straße İx 日本語、です") == ["aa", "bb", "c3", "é½", "straße", "i̇x", "日本語", "です"]
