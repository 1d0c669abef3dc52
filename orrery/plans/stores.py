"""Queries that make the documents of the stores: edges, sectors, vectors, news for a candidate, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import passages
from orrery.functions.columns import norm_symbol
from orrery.functions.embedding import embed
from orrery.functions.vectors import search
from orrery.operators import evidence as ev
from orrery.operators import statistics as st
from orrery.operators.comovement import edges_blocked
from orrery.operators.graphs import both_ways
from orrery.operators.panel import session_ends
from orrery.operators.shocks import scan
from orrery.plans.market import _VERDICT, CORR, PANEL, bar_panel, bars, candidates, latest_sic
from orrery.plans.relations import _TAGS, _pmi_sql, dated_tags, pmi_edges
from orrery.plans.training import distinct_tags
from orrery.sources.durable import durable
from orrery.sources.tables import table


def k6_supply_documents(spark, sf_dir):
    """One document per supplier, customer and date, the row loaded last; no share rather than an empty one, passages of 900 characters."""
    e = table(spark, sf_dir, "supply_edge").select(norm_symbol(F.col("supplier")).alias("s"), norm_symbol(F.col("customer")).alias("c"), F.col("filing_date").alias("d"), "edge_id", "ingested_at", "pct_revenue", "passage")
    k = F.row_number().over(Window.partitionBy("s", "c", "d").orderBy(F.col("ingested_at").desc(), F.col("edge_id").desc()))
    one = e.where("s IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL").withColumn("k", k).where("k = 1")
    key = F.concat_ws(":", "s", "c", F.date_format("d", "yyyy-MM-dd"))
    return one.select(key.alias("key"), F.expr("nullif(pct_revenue, '')").alias("pct_revenue"), F.substring("passage", 1, 900).alias("passage"))


def k7_comention_documents(spark, sf_dir):
    e = pmi_edges(dated_tags(spark, sf_dir))
    return e.select(F.concat_ws(":", "a", "b").alias("key"), "pmi", F.lit("co_mentioned").alias("relation"))


def j7_tagged_articles(spark, sf_dir):
    """Articles that tag a supplier or customer, once each."""
    e = table(spark, sf_dir, "supply_edge")
    u = e.select(norm_symbol(F.col("supplier")).alias("symbol")).union(e.select(norm_symbol(F.col("customer")))).distinct()
    return distinct_tags(spark, sf_dir).join(u, "symbol", "left_semi").select("article_id").distinct()


def _articles(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "news_article").groupBy("id").agg(F.min("created_at").alias("at"), F.max_by(F.struct("headline", "summary"), F.struct("ingested_at", "headline")).alias("x"))
    return a.select("id", "at", F.substring(F.coalesce("x.headline", F.lit("")), 1, 300).alias("headline"), F.substring(F.coalesce("x.summary", F.lit("")), 1, 700).alias("summary"))


def k10_vector_documents(spark, sf_dir):
    """Articles with their vectors, rounded to 5 decimals."""
    a = _articles(spark, sf_dir)
    v = embed(F.concat_ws(" ", "headline", "summary"))
    return a.select(F.col("id").cast("string").alias("key"), F.date_format("at", "yyyy-MM-dd").alias("day"), "headline", F.transform(v, lambda x: F.round(x, 5)).alias("embedding"))


def n5_news_for_candidates(spark, sf_dir):
    """The 5 articles that fit each candidate's query best, of those that tag it and are from before its date."""
    p = durable(bar_panel(spark, sf_dir))
    c = candidates(spark, sf_dir, p).select("cid", "symbol", "as_of")
    text = F.format_string("%s shares move %s", "symbol", "as_of")
    q = c.select(F.col("cid").alias("qid"), "symbol", "as_of", embed(text).alias("qvec"))
    # Only tags of candidates, and of those articles only, are turned into vectors; pairs are found by symbol.
    tags = distinct_tags(spark, sf_dir).select(F.col("article_id").alias("id"), "symbol").join(q.select("symbol").distinct(), "symbol", "left_semi")
    docs = _articles(spark, sf_dir).join(tags, "id").select("id", F.to_date("at").alias("day"), "symbol", embed(F.concat_ws(" ", "headline", "summary")).alias("vec"))
    hits = search(durable(q), docs, k=5, on="symbol", match=F.col("day") < F.col("as_of"))
    return hits.select(F.col("qid").alias("cid"), "id", "rank")


def g2_sector_and_scores(spark, sf_dir):
    """Each symbol's co-mention partners with both industries, where known."""
    e = both_ways(pmi_edges(dated_tags(spark, sf_dir)), "pmi")
    sic = latest_sic(spark, sf_dir).where("sic IS NOT NULL")
    return e.join(sic.select(F.col("symbol").alias("a"), F.col("sic").alias("sic_a")), "a", "left").join(sic.select(F.col("symbol").alias("b"), F.col("sic").alias("sic_b")), "b", "left").select("a", "b", "pmi", "sic_a", "sic_b")


def g10_movers(spark, sf_dir, top=25):
    """The largest movers as of the second last session: those with co-mentions first, then by size."""
    p = durable(bar_panel(spark, sf_dir))
    last = p.agg(F.max("i")).first()[0] or 0
    day = p.where(F.col("i") == last - 1).select(F.col("d").alias("as_of")).distinct()
    z = scan(p, session_ends(day, p), sigma=1.0)
    covered = both_ways(pmi_edges(dated_tags(spark, sf_dir))).select(F.col("a").alias("symbol")).distinct().withColumn("covered", F.lit(True))
    out = z.join(covered, "symbol", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return out.orderBy(F.col("covered").desc(), F.round(F.abs("z"), 12).desc(), "symbol").limit(top).select("symbol", F.round("z", 7).alias("z"), "covered")


def a18_edges_among(spark, sf_dir):
    """For each symbol: edges among those it co-moves with, of how many there could be."""
    p = durable(bar_panel(spark, sf_dir))
    last = p.agg(F.max("i")).first()[0] or 0
    e = durable(edges_blocked(p.where((F.col("i") >= last - 60) & (F.col("i") < last)).select("symbol", "i", "r"), first=last - 60, trail=60, min_abs_corr=0.3).select("a", "b"))
    near = durable(both_ways(e).withColumnsRenamed({"a": "centre", "b": "x"}))
    k = near.groupBy("centre").agg(F.count(F.lit(1)).alias("k"))
    among = near.join(e, F.col("x") == F.col("a")).join(near.select(F.col("centre").alias("c2"), F.col("x").alias("y")), (F.col("centre") == F.col("c2")) & (F.col("b") == F.col("y"))).groupBy("centre").agg(F.count(F.lit(1)).alias("n_edges"))
    return k.join(among, "centre", "left").select("centre", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("n_possible"))


def a29_bootstrap(spark, sf_dir):
    """Mean return of all symbols and sessions with a bootstrapped interval."""
    p = durable(bar_panel(spark, sf_dir).select("r"))
    return st.bootstrap_mean(p, "r", replicates=200)


def a34_share_test(spark, sf_dir):
    """Whether customers state a share more often than others do."""
    m = table(spark, sf_dir, "filing_mention")
    c = F.coalesce(F.col("relation") == "customer", F.lit(False))
    stated = F.col("pct_revenue").isNotNull().cast("double")
    g = m.agg(F.count_if(c).cast("double").alias("n1"), F.avg(F.when(c, stated)).alias("p1"), F.count_if(~c).cast("double").alias("n2"), F.avg(F.when(~c, stated)).alias("p2"))
    z, mde = st.proportion_test(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"))
    return g.select(F.col("n1").cast("long").alias("n1"), F.round("p1", 8).alias("p1"), F.col("n2").cast("long").alias("n2"), F.round("p2", 8).alias("p2"), F.round(z, 6).alias("z"), F.round(mde, 8).alias("mde"))


def s8_controls(spark, sf_dir):
    """For each liquid symbol of a month a control of about its dollar volume among the rest, drawn without replacement."""
    b = bars(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM").alias("day"), "symbol").agg(F.median("dollar_vol").alias("size")).where("size IS NOT NULL")
    q = F.ntile(4).over(Window.partitionBy("day").orderBy(F.col("size").desc(), "symbol"))
    b = durable(b.withColumn("q", q))
    return st.matched_controls(b.where("q = 1").drop("q"), b.where("q > 1").drop("q"))


def t14_hash_split(spark, sf_dir):
    """Symbols split in two by a hash, the same in every run."""
    return bars(spark, sf_dir).select("symbol").distinct().select("symbol", F.when(F.pmod(F.xxhash64("symbol"), F.lit(2)) == 0, "train").otherwise("test").alias("part"))


def x4_clean(spark, sf_dir):
    """Passages that were put into markup and taken out of it again."""
    m = table(spark, sf_dir, "filing_mention").where("passage IS NOT NULL")
    html = F.concat(F.lit("<p class='x'>"), F.col("passage"), F.lit("</p>&nbsp;<br/>\n end"))
    return m.select("id", passages.clean_html(html).alias("text"))


def n11_review(spark, sf_dir):
    """Whether a run has to wait for review: how many of its candidates are contradicted."""
    p = durable(bar_panel(spark, sf_dir))
    out = ev.run(candidates(spark, sf_dir, p), p, spark.createDataFrame([], "symbol string"))
    return out["assessments"].agg(F.count_if(F.col("verdict") == "contradicted").alias("n_contradicted"), F.count(F.lit(1)).alias("n")).withColumn("halt", F.col("n_contradicted") > 0)


def e17_golden(spark, sf_dir):
    """One row for every candidate, assessed or not, with numbers as text."""
    p = durable(bar_panel(spark, sf_dir))
    c = candidates(spark, sf_dir, p)
    out = ev.run(c, p, spark.createDataFrame([], "symbol string"))
    return ev.golden(c, out["assessments"]).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


_FUNCS = (k6_supply_documents, k7_comention_documents, j7_tagged_articles, k10_vector_documents, n5_news_for_candidates, g2_sector_and_scores, g10_movers, a18_edges_among, a29_bootstrap, a34_share_test, s8_controls, t14_hash_split, x4_clean, n11_review, e17_golden)
QUERIES = {f.__name__: f for f in _FUNCS}
_SIC = "sic AS (SELECT symbol, sic FROM (SELECT upper(trim(symbol)) AS symbol, sic, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY valid_from DESC, known_at DESC, version_id DESC) AS k FROM sic_history) WHERE k = 1 AND sic IS NOT NULL)"
ORACLE = {
    "k6_supply_documents": "SELECT s || ':' || c || ':' || strftime(d, '%Y-%m-%d') AS key, nullif(pct_revenue, '') AS pct_revenue, substring(passage, 1, 900) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY s, c, d ORDER BY ingested_at DESC, edge_id DESC) AS k FROM (SELECT upper(trim(supplier)) AS s, upper(trim(customer)) AS c, filing_date AS d, * FROM supply_edge) WHERE s <> '' AND c <> '' AND d IS NOT NULL) WHERE k = 1",
    "k7_comention_documents": f"WITH {_TAGS}, {_pmi_sql()} SELECT a || ':' || b AS key, pmi, 'co_mentioned' AS relation FROM pmi",
    "j7_tagged_articles": "SELECT DISTINCT article_id FROM news_symbol WHERE article_id IS NOT NULL AND upper(trim(symbol)) IN (SELECT upper(trim(supplier)) FROM supply_edge UNION SELECT upper(trim(customer)) FROM supply_edge)",
    "g2_sector_and_scores": f"WITH {_TAGS}, {_pmi_sql()}, {_SIC}, e AS (SELECT a, b, pmi FROM pmi UNION ALL SELECT b, a, pmi FROM pmi) SELECT a, b, pmi, x.sic AS sic_a, y.sic AS sic_b FROM e LEFT JOIN sic x ON x.symbol = a LEFT JOIN sic y ON y.symbol = b",
    "g10_movers": f"""WITH {_TAGS}, {_pmi_sql()}, {PANEL}, s AS (SELECT symbol, coalesce(sum(r) FILTER (WHERE i >= n - 4), 0) / nullif(stddev_samp(r) FILTER (WHERE i < n - 4) * sqrt(3), 0) AS z FROM p, ns WHERE i >= n - 64 AND i < n - 1 AND n >= 64 GROUP BY symbol)
SELECT symbol, round(z, 7) AS z, symbol IN (SELECT a FROM pmi UNION SELECT b FROM pmi) AS covered FROM s WHERE abs(z) >= 1 ORDER BY covered DESC, round(abs(z), 12) DESC, symbol LIMIT 25""",
    "a18_edges_among": f"""WITH {PANEL}, w AS (SELECT symbol, i, CASE WHEN abs(r) <= 10 THEN r END AS r FROM p, ns WHERE i >= n - 61 AND i < n - 1), e AS (SELECT a, b FROM (SELECT x.symbol AS a, y.symbol AS b, {CORR.format(x='x.r', y='y.r')} AS c FROM w x JOIN w y ON x.i = y.i AND x.symbol < y.symbol GROUP BY ALL) WHERE abs(c) >= 0.3),
nr AS (SELECT a AS c, b AS x FROM e UNION ALL SELECT b, a FROM e) SELECT c AS centre, (SELECT count(*) FROM e WHERE e.a IN (SELECT x FROM nr q WHERE q.c = k.c) AND e.b IN (SELECT x FROM nr q WHERE q.c = k.c)) AS n_edges, k * (k - 1) // 2 AS n_possible FROM (SELECT c, count(*) AS k FROM nr GROUP BY c) k""",
    "a34_share_test": "WITH g AS (SELECT CAST(count(*) FILTER (WHERE relation = 'customer') AS DOUBLE) AS n1, avg(CASE WHEN pct_revenue IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE relation = 'customer') AS p1, CAST(count(*) FILTER (WHERE relation IS DISTINCT FROM 'customer') AS DOUBLE) AS n2, avg(CASE WHEN pct_revenue IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE relation IS DISTINCT FROM 'customer') AS p2 FROM filing_mention), h AS (SELECT *, (n1 * p1 + n2 * p2) / (n1 + n2) AS p FROM g) SELECT CAST(n1 AS BIGINT) AS n1, round(p1, 8) AS p1, CAST(n2 AS BIGINT) AS n2, round(p2, 8) AS p2, round((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 6) AS z, round(2.8 * sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 8) AS mde FROM h",
    "x4_clean": r"SELECT id, regexp_replace(regexp_replace(regexp_replace('<p class=''x''>' || passage || '</p>&nbsp;<br/>' || chr(10) || ' end', '<[^>]+>', ' ', 'g'), '&#\d+;|&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g') AS text FROM filing_mention WHERE passage IS NOT NULL",
    "n11_review": f"WITH {_VERDICT} SELECT count(*) FILTER (WHERE verdict = 'contradicted') AS n_contradicted, count(*) AS n, count(*) FILTER (WHERE verdict = 'contradicted') > 0 AS halt FROM vd",
    "e17_golden": f"WITH {_VERDICT} SELECT c.symbol, strftime(c.as_of, '%Y-%m-%d') AS as_of, c.direction, coalesce(verdict, 'no_assessment') AS verdict, format('{{:.6f}}', coalesce(eff, 0.0)) AS effective_evidence, coalesce(np, 0) AS n_supporting, coalesce(nc, 0) AS n_contradicting FROM cand c LEFT JOIN vd USING (cid)",
}
