"""Exact vector search over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(queries: DataFrame, corpus: DataFrame, *, k: int, on: str | None = None, match: Column | None = None, block_bytes: int = 64 << 20) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best of ``corpus`` (id, vec) for each of ``queries`` (qid, qvec), by cosine, ties by id.

    ``on`` names a column that both sides have and that must be equal; pairs are
    found by it then. ``match`` restricts pairs further before anything is
    scored, such as to documents from before the query's date. The queries are a
    stated set against all rows, taken in blocks of about ``block_bytes`` that are
    broadcast one by one; only the best k of a task and query leave a task.
    """
    unit = lambda v: F.transform(v, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(v, v))))
    q = queries.withColumn("qvec", unit(F.col("qvec")))
    held = queries.agg(F.sum(8 * F.size("qvec") + 64)).first()[0] or 0
    blocks = max(1, -(-held // block_bytes))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        if on is not None:
            pairs = corpus.join(F.broadcast(part), on)
            pairs = pairs if match is None else pairs.where(match)
        else:
            pairs = corpus.join(F.broadcast(part), match if match is not None else F.lit(True))
        best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        scored = pairs.select("qid", "id", F.try_divide(dot(F.col("vec"), F.col("qvec")), F.sqrt(dot(F.col("vec"), F.col("vec")))).alias("score"))
        # Pairs without a score rank last; left out only here, they aren't scored twice.
        top = scored.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) & F.col("score").isNotNull())
        out = top if out is None else out.unionByName(top)
    return out
