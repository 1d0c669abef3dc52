"""Problem 4: symbols tagged together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import norm_symbol
from orrery.llm.cooccur import cooccurrence
from orrery.sources.tables import table


def _wide(c: str):
    return F.col(c).cast("decimal(19,0)")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of symbols that share at least 4 articles of at most 8 symbols, 4 times as many as chance would give; those of more than 4 symbols are cut in two."""
    pairs = cooccurrence(
        table(spark, sf_dir, "news_symbol"), basket=F.col("article_id"), item=norm_symbol(F.col("symbol")), max_basket=8, min_count=4, block=4
    )
    often = _wide("n_ab") * _wide("n_baskets") >= _wide("n_a") * _wide("n_b") * 4
    return pairs.where(often).select(F.col("item_a").alias("symbol_a"), F.col("item_b").alias("symbol_b"))


def _association(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    pairs = cooccurrence(table(spark, sf_dir, "news_symbol"), basket=F.col("article_id"), item=norm_symbol(F.col("symbol")), min_count=min_count)
    return pairs.select(
        F.col("item_a").alias("symbol_a"), F.col("item_b").alias("symbol_b"), "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi")
    )


def p4_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and association of all pairs that share at least 4 articles, articles of any width included."""
    return _association(spark, sf_dir, 4)


def p4_association_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all pairs that share an article."""
    return _association(spark, sf_dir, 1)


QUERIES = {"p4_found": p4_found, "p4_association": p4_association, "p4_association_all": p4_association_all}

_TAGS = """WITH tags AS (SELECT DISTINCT article_id, upper(trim(symbol)) AS symbol FROM news_symbol WHERE article_id IS NOT NULL AND trim(symbol) <> ''),
t AS (SELECT * FROM tags {}),
one AS (SELECT symbol, count(*) AS n FROM t GROUP BY symbol),
ab AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n_ab FROM t a JOIN t b ON a.article_id = b.article_id AND a.symbol < b.symbol GROUP BY ALL HAVING count(*) >= 4),
x AS (SELECT ab.*, oa.n AS n_a, ob.n AS n_b, (SELECT count(DISTINCT article_id) FROM t) AS n_baskets
  FROM ab JOIN one oa ON oa.symbol = symbol_a JOIN one ob ON ob.symbol = symbol_b)"""
ORACLE = {
    "p4_found": _TAGS.format("WHERE article_id IN (SELECT article_id FROM tags GROUP BY article_id HAVING count(*) <= 8)")
    + "SELECT symbol_a, symbol_b FROM x WHERE n_ab * n_baskets >= 4 * n_a * n_b",
    "p4_association": _TAGS.format("")
    + "SELECT *, round(CAST(n_ab AS DOUBLE) * n_baskets / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round(ln(CAST(n_ab AS DOUBLE) * n_baskets / (CAST(n_a AS DOUBLE) * n_b)), 6) AS pmi FROM x",
}
ORACLE["p4_association_all"] = ORACLE["p4_association"].replace(" HAVING count(*) >= 4", "")
