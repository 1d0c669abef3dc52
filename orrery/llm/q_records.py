"""Problem 2: one record for each supplier and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.columns import norm_symbol
from orrery.llm.survivor import Bundle, survivors
from orrery.sources.tables import table

_NUMBER = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*%?\s*$"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = F.lower(F.trim("confidence"))
    dated = F.unix_date("filing_date") <= F.floor(F.unix_micros("ingested_at") / 86_400_000_000)
    share = F.regexp_extract(F.coalesce("pct_revenue", F.lit("")), _NUMBER, 1)
    return table(spark, sf_dir, "supply_edge").select(
        norm_symbol(F.col("supplier")).alias("supplier"),
        norm_symbol(F.col("customer")).alias("customer"),
        F.col("edge_id").cast("long").alias("edge_id"),
        F.when(trust == "manual", 3).when(trust == "llm", 2).when(trust == "heuristic", 1).otherwise(0).alias("trust"),
        F.when(dated, F.unix_date("filing_date")).alias("day"),
        F.unix_micros("ingested_at").alias("at"),
        F.when(share.rlike("[0-9]"), share.cast("double")).alias("share"),
        F.when(F.col("passage").rlike(r"\S"), F.trim("passage")).alias("passage"),
    )


def _bundles(values: bool) -> list[Bundle]:
    rest = [F.col("trust"), F.col("day"), F.col("at")]
    some = lambda c: c if values else None
    return [
        Bundle("pct", (F.col("share") > 0) & (F.col("share") <= 100), (F.col("trust") + 1) / 4, rest[1:], some(F.col("share"))),
        Bundle("passage", F.col("passage").isNotNull(), 1 - 1 / (1 + F.length("passage")), rest, some(F.col("passage"))),
        Bundle("date", F.col("day").isNotNull(), (F.col("day") + 1_000_000) / 2_000_000, rest[2:], some(F.date_from_unix_date("day"))),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair with several rows, the rows that give its share, passage and date."""
    out = survivors(_edges(spark, sf_dir), ["supplier", "customer"], "edge_id", _bundles(False), min_rows=2)
    return out.select("supplier", "customer", F.col("pct_id").alias("pct_edge_id"), F.col("passage_id").alias("passage_edge_id"), F.col("date_id").alias("date_edge_id"))


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for every pair, in which the chosen filing date and passage each determine the share."""
    out = survivors(_edges(spark, sf_dir), ["supplier", "customer"], "edge_id", _bundles(True), rules=[("date", "pct"), ("passage", "pct")])
    return out.select(
        "supplier", "customer", F.col("pct_id").alias("pct_edge_id"), F.col("passage_id").alias("passage_edge_id"), F.col("date_id").alias("date_edge_id"), F.col("pct").alias("pct_revenue"), "passage", F.col("date").alias("filing_date")
    )


QUERIES = {"p2_found": p2_found, "p2_consistent": p2_consistent}

_EDGES = r"""WITH e AS (
  SELECT upper(trim(supplier)) AS supplier, upper(trim(customer)) AS customer, edge_id, ingested_at AS ts,
    CASE lower(trim(confidence)) WHEN 'manual' THEN 3 WHEN 'llm' THEN 2 WHEN 'heuristic' THEN 1 ELSE 0 END AS trust,
    CASE WHEN filing_date <= CAST(ingested_at AT TIME ZONE 'UTC' AS DATE) THEN filing_date END AS day,
    TRY_CAST(regexp_extract(pct_revenue, '^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*%?\s*$', 1) AS DOUBLE) AS share,
    CASE WHEN regexp_matches(passage, '\S') THEN length(trim(passage)) END AS chars
  FROM supply_edge)"""
_PICK = "coalesce(arg_max(edge_id, row({})) FILTER (WHERE {}), 0)"
_DAY, _AT = "coalesce(day, DATE '0001-01-01')", "coalesce(ts, TIMESTAMPTZ '0001-01-01')"
ORACLE = {
    "p2_found": f"""{_EDGES} SELECT supplier, customer,
  {_PICK.format(f"trust, {_DAY}, {_AT}, edge_id", "share > 0 AND share <= 100")} AS pct_edge_id,
  {_PICK.format(f"chars, trust, {_DAY}, {_AT}, edge_id", "chars IS NOT NULL")} AS passage_edge_id,
  {_PICK.format(f"day, {_AT}, edge_id", "day IS NOT NULL")} AS date_edge_id
FROM e WHERE supplier <> '' AND customer <> '' GROUP BY supplier, customer HAVING count(*) >= 2""",
    # Every combination of values of a pair, tried one by one.
    "p2_consistent": f"""{_EDGES}, f AS (SELECT e.*, CASE WHEN share > 0 AND share <= 100 THEN share END AS pv, CASE WHEN chars IS NOT NULL THEN trim(passage) END AS gv FROM e JOIN supply_edge USING (edge_id) WHERE e.supplier <> '' AND e.customer <> ''),
pc AS (SELECT supplier, customer, pv AS v, max(row((trust + 1) / 4.0::DOUBLE, {_DAY}, {_AT}, edge_id)) AS o FROM f WHERE pv IS NOT NULL GROUP BY ALL),
gc AS (SELECT supplier, customer, gv AS v, max(row(chars, trust, {_DAY}, {_AT}, edge_id)) AS o, arg_max(pv, row(trust, {_DAY}, {_AT}, edge_id)) FILTER (WHERE pv IS NOT NULL) AS need FROM f WHERE gv IS NOT NULL GROUP BY ALL),
dc AS (SELECT supplier, customer, day AS v, max(row(day, {_AT}, edge_id)) AS o, arg_max(pv, row(trust, {_DAY}, {_AT}, edge_id)) FILTER (WHERE pv IS NOT NULL) AS need FROM f WHERE day IS NOT NULL GROUP BY ALL),
pr AS (SELECT DISTINCT supplier, customer FROM f),
p AS (SELECT supplier, customer, v, o[4] AS id, o[1] AS sc, row_number() OVER (PARTITION BY supplier, customer ORDER BY o DESC) AS k FROM pc UNION ALL SELECT supplier, customer, NULL, 0, 0.0, 1000000 FROM pr),
g AS (SELECT supplier, customer, v, o[5] AS id, 1 - 1 / (1 + o[1])::DOUBLE AS sc, need, row_number() OVER (PARTITION BY supplier, customer ORDER BY o DESC) AS k FROM gc UNION ALL SELECT supplier, customer, NULL, 0, 0.0, NULL, 1000000 FROM pr),
d AS (SELECT supplier, customer, v, o[3] AS id, (date_diff('day', DATE '1970-01-01', v) + 1000000) / 2000000.0::DOUBLE AS sc, need, row_number() OVER (PARTITION BY supplier, customer ORDER BY o DESC) AS k FROM dc UNION ALL SELECT supplier, customer, NULL, 0, 0.0, NULL, 1000000 FROM pr),
a AS (SELECT supplier, customer, p.id AS pid, g.id AS gid, d.id AS did, p.v AS pv, g.v AS gv, d.v AS dv, row_number() OVER (PARTITION BY supplier, customer ORDER BY p.sc + g.sc + d.sc DESC, p.k, g.k, d.k) AS r
  FROM p JOIN g USING (supplier, customer) JOIN d USING (supplier, customer) WHERE (g.need IS NULL OR coalesce(p.v = g.need, false)) AND (d.need IS NULL OR coalesce(p.v = d.need, false)))
SELECT supplier, customer, pid AS pct_edge_id, gid AS passage_edge_id, did AS date_edge_id, CAST(pv AS VARCHAR) AS pct_revenue, gv AS passage, CAST(dv AS VARCHAR) AS filing_date FROM a WHERE r = 1""",
}
