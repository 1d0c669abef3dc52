"""Problem 6: the listed company that a counterparty's name denotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.canon import map_to_canonical
from orrery.sources.tables import table

_EXCHANGES = ("NYSE", "NASDAQ", "ARCA", "AMEX")


def _mapped(spark: SparkSession, sf_dir: str, mentions: DataFrame) -> DataFrame:
    found = map_to_canonical(
        mentions, F.col("counterparty"), table(spark, sf_dir, "company_ref"), ident="ticker", names=["title", "former_title"], prefixes=_EXCHANGES
    )
    return mentions.join(found, mentions["counterparty"] == found["value"], "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention whose cp_ticker is not listed, with the company its counterparty denotes, or UNMATCHED."""
    listed = table(spark, sf_dir, "company_ref").select(F.col("ticker").alias("cp_ticker")).where("cp_ticker IS NOT NULL")
    mentions = table(spark, sf_dir, "filing_mention").select("id", "cp_ticker", "counterparty").join(listed, "cp_ticker", "left_anti")
    out = _mapped(spark, sf_dir, mentions)
    return out.select("id", F.coalesce("ref", F.lit("UNMATCHED")).alias("ref_ticker"))


def p6_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with the listed ticker it has or else the one its name denotes, and how it was found."""
    listed = table(spark, sf_dir, "company_ref").select(F.col("ticker").alias("own")).where("own IS NOT NULL")
    mentions = table(spark, sf_dir, "filing_mention").select("id", "cp_ticker", "counterparty")
    out = _mapped(spark, sf_dir, mentions).join(listed, F.col("cp_ticker") == F.col("own"), "left")
    how = F.when(F.col("own").isNotNull(), "given").when(F.col("ref") == "UNMATCHED", "unmatched").when(F.col("score") > 2, "mention").otherwise("similarity")
    return out.select("id", "counterparty", F.coalesce("own", "ref", F.lit("UNMATCHED")).alias("ref_ticker"), how.alias("how"))


QUERIES = {"p6_found": p6_found, "p6_resolved": p6_resolved}
ORACLE: dict[str, str] = {}
