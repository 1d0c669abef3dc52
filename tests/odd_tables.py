"""The smallest test tables made odd: empty, or with rows of nulls, repeated rows and columns named like the operators' own."""

import os

from pyspark.sql import functions as F

from compare import ROOT

NAMES = "bar company_ref documents eval_item filing_mention mix_target news_article news_symbol sic_history supply_edge".split()
OWN = "k t b i n g v x c d e p r s w h o id value rank size src key shard salt slice kind n_tokens digit extra left chunk".split()


def make(spark, root, how):
    for name in NAMES:
        df = spark.read.parquet(f"{ROOT}/{name}.parquet")
        if how == "empty":
            df = df.limit(0)
        else:
            df = df.unionByName(spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema.__class__([f.__class__(f.name, f.dataType, True) for f in df.schema])))
            df = df.withColumns({c: F.lit("clash") for c in OWN if c not in df.columns})
        df.coalesce(2).write.parquet(os.path.join(root, f"{name}.parquet"))
    return str(root)


def rows(df):
    return sorted(map(str, df.collect()))
