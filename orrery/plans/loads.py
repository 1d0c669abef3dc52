"""Queries for the incremental loads and duplicate rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import passages
from orrery.operators import records as rec
from orrery.plans import relations
from orrery.plans.market import bars, latest_sic
from orrery.sources.tables import table


def _day_bars(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "date", "close", "ingested_at")
    return rec.best_of_duplicates(b, ["symbol", "date"], [F.col("ingested_at").desc(), F.col("close").desc_nulls_last()])


def n15_merge_bars(spark, sf_dir):
    """Bars of before December 2024 merged with a refetch from mid November on, whose rows win."""
    b = _day_bars(spark, sf_dir).select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day"), "close")
    old = b.where("day < '2024-12-01'")
    fresh = b.where("day >= '2024-11-15'").withColumn("close", F.round(F.col("close") * 1.5, 4))
    return rec.merge_latest(old, fresh, ["symbol", "day"])


def a41_watermark(spark, sf_dir):
    return rec.watermark(table(spark, sf_dir, "bar"), F.date_format("date", "yyyy-MM-dd"))


def j5_missing_vectors(spark, sf_dir):
    """Documents that have no vector, keys compared as text."""
    return rec.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), F.col("doc_id"), F.col("vec_id"))


def k2_insert_new(spark, sf_dir):
    """Articles tagged but not delivered, once each."""
    tags = table(spark, sf_dir, "news_symbol").select(F.col("article_id").alias("id")).where("id IS NOT NULL")
    return rec.insert_new(table(spark, sf_dir, "news_article").select("id"), tags, ["id"])


def k3_coverage(spark, sf_dir):
    """How many articles each symbol has and the last day of one: counts of before 2024 updated by those of all time."""
    n = lambda df: df.groupBy("symbol").agg(F.countDistinct("article_id").alias("n"))
    t = table(spark, sf_dir, "news_symbol").select("article_id", F.upper(F.trim("symbol")).alias("symbol"))
    a = table(spark, sf_dir, "news_article").groupBy("id").agg(F.min("created_at").alias("at"))
    old = t.join(a.where(F.col("at") < F.lit("2024-01-01").cast("timestamp")), F.col("article_id") == F.col("id")).select("article_id", "symbol")
    return rec.merge_latest(n(old), n(t), ["symbol"])


def k5_merge_fields(spark, sf_dir):
    """Companies with their exchange and, where known, industry; what isn't known replaces nothing."""
    ref = table(spark, sf_dir, "company_ref").select(F.col("ticker").alias("symbol"), "exchange", F.lit("0000").alias("sic"))
    return rec.merge_fields(ref, latest_sic(spark, sf_dir), ["symbol"])


def k8_sectors(spark, sf_dir):
    return latest_sic(spark, sf_dir).where("sic IS NOT NULL")


def k11_reclassified(spark, sf_dir):
    """Mentions with the relation that their passage states, where it names the counterparty at all."""
    m = table(spark, sf_dir, "filing_mention").select("id", "counterparty", "passage", "relation")
    says = passages.relation(passages.naming_sentence(F.col("passage"), F.col("counterparty")))
    changes = m.select("id", says.alias("said")).where("said <> 'unnamed'").withColumnRenamed("said", "relation")
    return rec.update_from(m.select("id", "relation"), changes, ["id"])


def t12_best_edges(spark, sf_dir):
    """One edge per supplier, customer and date: a stated share first, then the longest passage, then the lowest id."""
    e = table(spark, sf_dir, "supply_edge").select(F.upper(F.trim("supplier")).alias("supplier"), F.upper(F.trim("customer")).alias("customer"), "filing_date", "edge_id", "pct_revenue", F.length(F.coalesce("passage", F.lit(""))).alias("n"))
    stated = F.coalesce(F.trim("pct_revenue"), F.lit("")) == ""
    out = rec.best_of_duplicates(e.where("filing_date IS NOT NULL"), ["supplier", "customer", "filing_date"], [stated, F.col("n").desc(), F.col("edge_id")])
    return out.select("supplier", "customer", F.date_format("filing_date", "yyyy-MM-dd").alias("day"), "edge_id")


_FUNCS = (n15_merge_bars, a41_watermark, j5_missing_vectors, k2_insert_new, k3_coverage, k5_merge_fields, k8_sectors, k11_reclassified, t12_best_edges)
QUERIES = {f.__name__: f for f in _FUNCS}
_SIC = "(SELECT symbol, sic FROM (SELECT upper(trim(symbol)) AS symbol, sic, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY valid_from DESC, known_at DESC, version_id DESC) AS k FROM sic_history) WHERE k = 1)"
ORACLE = {
    "n15_merge_bars": "WITH b AS (SELECT upper(trim(symbol)) AS symbol, strftime(date, '%Y-%m-%d') AS day, arg_max(struct_pack(c := close), ingested_at).c AS close FROM bar GROUP BY ALL) SELECT symbol, day, CASE WHEN day >= '2024-11-15' THEN round(close * 1.5, 4) ELSE close END AS close FROM b",
    "a41_watermark": "SELECT strftime(max(date), '%Y-%m-%d') AS watermark FROM bar",
    "j5_missing_vectors": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "k2_insert_new": "SELECT DISTINCT article_id AS id FROM news_symbol WHERE article_id IS NOT NULL AND article_id NOT IN (SELECT id FROM news_article)",
    "k3_coverage": "SELECT upper(trim(symbol)) AS symbol, count(DISTINCT article_id) AS n FROM news_symbol GROUP BY 1",
    "k5_merge_fields": f"SELECT symbol, exchange, coalesce(s.sic, CASE WHEN ticker IS NOT NULL THEN '0000' END) AS sic FROM (SELECT ticker, ticker AS symbol, exchange FROM company_ref) FULL JOIN {_SIC} s USING (symbol)",
    "k8_sectors": f"SELECT symbol, sic FROM {_SIC} WHERE sic IS NOT NULL",
    "t12_best_edges": "SELECT supplier, customer, strftime(filing_date, '%Y-%m-%d') AS day, edge_id FROM (SELECT upper(trim(supplier)) AS supplier, upper(trim(customer)) AS customer, filing_date, edge_id, row_number() OVER (PARTITION BY upper(trim(supplier)), upper(trim(customer)), filing_date ORDER BY coalesce(trim(pct_revenue), '') = '', length(coalesce(passage, '')) DESC, edge_id) AS k FROM supply_edge WHERE filing_date IS NOT NULL) WHERE k = 1",
    "k11_reclassified": f"WITH said AS ({relations.ORACLE['x3_relations']}) SELECT m.id, CASE WHEN said.relation <> 'unnamed' THEN said.relation ELSE m.relation END AS relation FROM filing_mention m JOIN said USING (id)",
}
