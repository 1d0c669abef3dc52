"""The general (not text-specific) data-preparation queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import norm_symbol
from orrery.operators.asof import asof_versions
from orrery.operators.segtree import build_trees, correct_trees, leaves_of, rolling, trailing
from orrery.operators.treeagg import tree_aggregate
from orrery.sources.durable import durable
from orrery.sources.tables import table


def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, symbol) once each, symbols normalised, without null ids and blank symbols."""
    tags = table(spark, sf_dir, "news_symbol").select("article_id", norm_symbol(F.col("symbol")).alias("symbol"))
    return tags.where(F.col("article_id").isNotNull() & F.col("symbol").isNotNull()).distinct()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "filing_mention").select(
        F.lit("filing").alias("event_kind"),
        F.col("id").alias("event_id"),
        norm_symbol(F.col("filer_ticker")).alias("symbol"),
        (F.unix_date("filing_date").cast("long") * 86_400).alias("s"),
    )
    filings = filings.withColumn("at", F.timestamp_seconds("s")).drop("s")
    articles = table(spark, sf_dir, "news_article").groupBy(F.col("id").alias("article_id")).agg(F.min("created_at").alias("at"))
    news = distinct_tags(spark, sf_dir).join(articles, "article_id").select(
        F.lit("news").alias("event_kind"), F.col("article_id").alias("event_id"), "symbol", "at"
    )
    return filings.unionByName(news)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing mention and news tag with the industry version in force, as known then."""
    return asof_versions(
        _events(spark, sf_dir),
        table(spark, sf_dir, "sic_history"),
        event_key=F.col("symbol"),
        event_time=F.col("at"),
        event_cols=["event_kind", "event_id", "symbol"],
        version_key=norm_symbol(F.col("symbol")),
        valid_from=F.col("valid_from"),
        known_at=F.col("known_at"),
        version_id="version_id",
    )


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, those without a usable version included, with the code it had then; version 0 stands for none."""
    won = asof_versions(
        _events(spark, sf_dir),
        table(spark, sf_dir, "sic_history"),
        event_key=F.col("symbol"),
        event_time=F.col("at"),
        event_cols=["event_kind", "event_id", "symbol"],
        version_key=norm_symbol(F.col("symbol")),
        valid_from=F.col("valid_from"),
        known_at=F.col("known_at"),
        version_id="version_id",
        version_cols=["sic", "sic_desc"],
        how="left",
    )
    return won.withColumn("version_id", F.coalesce("version_id", F.lit(0)))


def _tag_counts(spark: SparkSession, sf_dir: str, tags: DataFrame) -> DataFrame:
    both = tags.select(
        F.xxhash64("article_id", "symbol").alias("tag"),
        F.explode(
            F.array(
                F.struct(F.lit("symbol").alias("key_kind"), F.col("symbol").alias("key_value")),
                F.struct(F.lit("article").alias("key_kind"), F.col("article_id").cast("string").alias("key_value")),
            )
        ).alias("x"),
    ).select("tag", "x.*")
    rows = 2 * table(spark, sf_dir, "news_symbol").count()  # from the files' footers
    return tree_aggregate(both, ["key_kind", "key_value"], {"n_tags": ("count", F.lit(1))}, rows=rows, spread=F.col("tag"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with at least 1 % of all distinct tags, articles with at least 50 distinct symbols."""
    tags = distinct_tags(spark, sf_dir)
    counts = _tag_counts(spark, sf_dir, tags)
    total = tags.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = F.when(F.col("key_kind") == "symbol", F.col("n_tags") * 100 >= total).otherwise(F.col("n_tags") >= 50)
    return counts.where(hot).select("key_kind", "key_value")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tags of every symbol and every article."""
    return _tag_counts(spark, sf_dir, distinct_tags(spark, sf_dir))


def _rolling_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling(
        table(spark, sf_dir, "bar"),
        key=norm_symbol(F.col("symbol")),
        day=F.col("date"),
        value=F.col("close"),
        latest=F.col("ingested_at"),
        windows=(7, 30),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose mean close over 7 days is at least 1.15 times that over 30 days."""
    # Means that are equal in decimals may differ in the last binary digit.
    high = F.col("avg_7") >= F.col("avg_30") * F.lit(1.15 * (1 - 1e-12))
    return _rolling_close(spark, sf_dir).where((F.col("count_7") > 0) & high).select(F.col("k").alias("symbol"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def _rounded(r: DataFrame) -> DataFrame:
    return r.select(
        F.col("k").alias("symbol"),
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[F.round(f"sum_{w}", 4).alias(f"sum_{w}") for w in (7, 30)],
        *[F.col(f"count_{w}").cast("long").alias(f"count_{w}") for w in (7, 30)],
        *[F.round(f"avg_{w}", 6).alias(f"avg_{w}") for w in (7, 30)],
    )


def p5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of close over the last 7 and 30 days, for every symbol and calendar day."""
    return _rounded(_rolling_close(spark, sf_dir))


def p5_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored trees of the first four fifths of all deliveries, corrected by what came later."""
    bars = table(spark, sf_dir, "bar").select(norm_symbol(F.col("symbol")).alias("symbol"), "date", "close", "ingested_at")
    first = F.coalesce(F.col("ingested_at") <= bars.agg(F.percentile_approx("ingested_at", 0.8).alias("t")).scalar(), F.lit(True))
    args = {"key": F.col("symbol"), "day": F.col("date"), "value": F.col("close"), "latest": F.col("ingested_at")}
    trees = durable(build_trees(leaves_of(bars.where(first), **args), (7, 30)))
    return _rounded(trailing(correct_trees(trees, leaves_of(bars.where(~first), **args), (7, 30)), (7, 30)))


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p3_found, p3_counts, p5_found, p5_rolling, p5_corrected)}

_TAGS = "tags AS (SELECT DISTINCT article_id, upper(trim(symbol)) AS symbol FROM news_symbol WHERE article_id IS NOT NULL AND trim(symbol) <> '')"
_EVENTS = f"""WITH {_TAGS},
art AS (SELECT id, min(created_at) AS ts FROM news_article GROUP BY id),
ev AS (
  SELECT 'filing' AS event_kind, id AS event_id, upper(trim(filer_ticker)) AS symbol, CAST(filing_date AS TIMESTAMP) AS ts FROM filing_mention
  UNION ALL
  SELECT 'news', article_id, symbol, CAST(art.ts AT TIME ZONE 'UTC' AS TIMESTAMP) FROM tags JOIN art ON art.id = tags.article_id),
ver AS (
  SELECT *, upper(trim(symbol)) AS k, greatest(CAST(known_at AT TIME ZONE 'UTC' AS TIMESTAMP), CAST(valid_from AS TIMESTAMP)) AS usable FROM sic_history)"""
_RANK = "row_number() OVER (PARTITION BY event_kind, event_id, ev.symbol ORDER BY valid_from DESC NULLS LAST, known_at DESC NULLS LAST, version_id DESC NULLS LAST)"
_CLOSES = """WITH last AS (
  SELECT upper(trim(symbol)) AS symbol, date AS d, arg_max(struct_pack(c := close), ingested_at).c AS close FROM bar GROUP BY ALL),
cal AS (SELECT symbol, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT symbol, min(d) AS lo, max(d) AS hi FROM last GROUP BY symbol)),
day AS (SELECT symbol, d, close FROM cal LEFT JOIN last USING (symbol, d)),
roll AS (SELECT symbol, strftime(d, '%Y-%m-%d') AS day,
  sum(close) OVER w7 AS s7, count(close) OVER w7 AS c7, sum(close) OVER w30 AS s30, count(close) OVER w30 AS c30 FROM day
  WINDOW w7 AS (PARTITION BY symbol ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY d ROWS 29 PRECEDING))"""

ORACLE = {
    "p1_found": f"{_EVENTS}\nSELECT event_kind, event_id, symbol, version_id FROM (SELECT event_kind, event_id, ev.symbol, version_id, {_RANK} AS r FROM ev JOIN ver ON k = ev.symbol AND usable <= ts) WHERE r = 1",
    "p1_attributes": f"{_EVENTS}\nSELECT event_kind, event_id, symbol, coalesce(version_id, 0) AS version_id, sic, sic_desc FROM (SELECT event_kind, event_id, ev.symbol, version_id, sic, sic_desc, {_RANK} AS r FROM ev LEFT JOIN ver ON k = ev.symbol AND usable <= ts) WHERE r = 1",
    "p3_counts": f"WITH {_TAGS} SELECT 'symbol' AS key_kind, symbol AS key_value, count(*) AS n_tags FROM tags GROUP BY symbol UNION ALL SELECT 'article', CAST(article_id AS VARCHAR), count(*) FROM tags GROUP BY article_id",
    "p3_found": f"WITH {_TAGS} SELECT 'symbol' AS key_kind, symbol AS key_value FROM tags GROUP BY symbol HAVING count(*) * 100 >= (SELECT count(*) FROM tags) UNION ALL SELECT 'article', CAST(article_id AS VARCHAR) FROM tags GROUP BY article_id HAVING count(*) >= 50",
    "p5_found": f"{_CLOSES} SELECT symbol, day FROM roll WHERE c7 > 0 AND s7 / c7 >= 1.15 * (s30 / c30) * (1 - 1e-12)",
    "p5_rolling": f"{_CLOSES} SELECT symbol, day, round(coalesce(s7, 0), 4) AS sum_7, round(coalesce(s30, 0), 4) AS sum_30, c7 AS count_7, c30 AS count_30, round(s7 / c7, 6) AS avg_7, round(s30 / c30, 6) AS avg_30 FROM roll",
}
ORACLE["p5_corrected"] = ORACLE["p5_rolling"]
