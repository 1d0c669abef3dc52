import pytest
from pyspark.sql import functions as F

from orrery.operators.treeagg import rounds, tree_aggregate


@pytest.mark.parametrize("fan_in, chunk_rows, flat_rows", [(2, 80, 1), (2, 80, 40), (16, 1000, 5), (3, 10_000, 9)])
def test_equals_a_plain_group_by(spark, fan_in, chunk_rows, flat_rows):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("chunk"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"),
        F.lit(1).alias("s0"),
    ).repartition(13)
    aggs = {"n": ("count", F.col("v")), "total": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = tree_aggregate(df, ["chunk"], aggs, fan_in=fan_in, chunk_rows=chunk_rows, flat_rows=flat_rows)
    want = df.groupBy("chunk").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_sketch_states_merge(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1000).alias("v")).repartition(9)
    got = {r.k: r.d for r in tree_aggregate(df, ["k"], {"d": ("approx_distinct", F.col("v"))}, fan_in=2, chunk_rows=2000).collect()}
    assert all(abs(n - 500) < 25 for n in got.values()) and len(got) == 2


def test_empty_and_wrong_arguments(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert tree_aggregate(df, ["k"], {"n": ("count", F.col("v"))}).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"n": ("mode", F.col("v"))})
    with pytest.raises(ValueError):
        rounds(10, 1)
    assert [rounds(n, 16) for n in (1, 16, 17, 256, 257)] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("partitions", [4, 8])
def test_rounds_follow_from_the_number_of_chunks(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
        plans = [tree_aggregate(df, ["k"], {"n": ("count", F.col("id"))}, rows=rows, chunk_rows=1000, fan_in=8, flat_rows=2)._jdf.queryExecution().sparkPlan().toString() for rows in (1000, 64_000, 600_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    # Two aggregates a round; the small states are a branch of their own that starts with the first round.
    assert [p.count("HashAggregate") for p in plans] == [2, 6, 10] if partitions == 8 else [2, 6, 10]
