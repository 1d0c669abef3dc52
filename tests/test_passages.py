import pytest
from pyspark.sql import functions as F

from orrery.functions import passages as ps

CASES = [
    ("We compete with Acme Inc. in most markets.", "Acme Inc.", "competitor", None),
    ("Acme Corp. accounted for 12.5% of sales. Others 3%.", "Acme Corporation", "customer", "12.5"),
    ("Others made 40%. Sales to Acme rose.", "Acme", "customer", None),
    ("In 2020 we completed the sale of a unit to Acme, a customer.", "Acme", "corporate_action", None),
    ("We acquired Acme Ltd. in May.", "Acme", "corporate_action", None),
    ("Acme is our sole supplier.", "Acme", "reversed", None),
    ("Parts are supplied by Acme.", "Acme", "reversed", None),
    ("Our customer Acme competes with us.", "Acme", "competitor", None),
    ("Acme opened an office in the U.S. last year.", "Acme", "unstated", None),
    ("Acmeville is a town. A customer left.", "Acme", "unnamed", None),
    ("Škoda represented 7% of revenue.", "Škoda Group", "customer", "7"),
    ("Anything.", "", "unnamed", None),
    ("", "Acme", "unnamed", None),
    (None, "Acme", "unnamed", None),
]


def test_relations(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, *_) in enumerate(CASES)], "i int, p string, c string")
    s = df.withColumn("s", ps.naming_sentence(F.col("p"), F.col("c")))
    got = s.select("i", ps.relation(F.col("s")), ps.percentage(F.col("s"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(r, p) for *_, r, p in CASES]


def test_sentences_keep_abbreviations(spark):
    t = "Acme Inc. and Foo Co. agreed. Made in the U.S. by Bar Ltd. today! Really?"
    (r,) = spark.createDataFrame([(t,)], "t string").select(ps.sentences(F.col("t"))).first()
    assert r == ["Acme Inc. and Foo Co. agreed.", "Made in the U.S. by Bar Ltd. today!", "Really?"]


@pytest.mark.parametrize("text, want", [("Our key customers include Acme", "customer"), ("We compete with Acme, customers include Foo", "unknown"), ("x " * 100 + "competitor" + " x" * 100 + " revenue from Acme", "customer"), ("Acme is big", "unknown")])
def test_proximity(spark, text, want):
    df = spark.createDataFrame([(text, max(0, text.find("Acme")))], "w string, at int")
    assert df.select(ps.proximity_label(F.col("w"), F.col("at"))).first()[0] == want


def test_html_and_quotes(spark):
    df = spark.createDataFrame([("<p>A&nbsp;b&#160;<b>c</b>\n d</p>", "lower")], "h string, s string")
    assert df.select(ps.clean_html(F.col("h")), ps.quotable(F.col("s")), ps.quotable(F.lit("Élan"))).first()[:] == (" A b c d ", False, True)
