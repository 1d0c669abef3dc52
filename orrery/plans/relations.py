"""News, filing, graph and vector queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import passages
from orrery.functions.columns import norm_symbol
from orrery.functions.vectors import search
from orrery.operators.comovement import edges_blocked, latest_blocked
from orrery.operators.graphs import degrees, forest_by_rounds, hops, laggers, latest_snapshot, shown_ways, two_hop
from orrery.operators.panel import session_ends
from orrery.operators.perspectives import PMI_STRONG
from orrery.operators.shocks import scan
from orrery.plans.market import BAR, PANEL, bar_panel, latest_sic
from orrery.plans.training import distinct_tags
from orrery.sources.durable import durable
from orrery.sources.tables import table


def dated_tags(spark, sf_dir, widest: int = 8) -> DataFrame:
    """(article_id, symbol, day) of articles that tag at most ``widest`` symbols."""
    tags = distinct_tags(spark, sf_dir)
    narrow = tags.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= widest).select("article_id")
    day = table(spark, sf_dir, "news_article").groupBy(F.col("id").alias("article_id")).agg(F.to_date(F.min("created_at")).alias("day"))
    return tags.join(narrow, "article_id", "left_semi").join(day, "article_id")


def pmi_edges(tags: DataFrame, *, min_pair: int = 5, min_freq: int = 10) -> DataFrame:
    """(a, b, n_ab, pmi, first_seen, last_seen): pointwise mutual information over articles, of frequent pairs of frequent symbols."""
    freq = tags.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq)
    x, y = tags.select("article_id", F.col("symbol").alias("a"), "day"), tags.select("article_id", F.col("symbol").alias("b"))
    pairs = x.join(y, "article_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen")).where(F.col("n_ab") >= min_pair)
    total = tags.agg(F.countDistinct("article_id").alias("n")).scalar()
    j = pairs.join(freq.select(F.col("symbol").alias("a"), F.col("n").alias("n_a")), "a").join(freq.select(F.col("symbol").alias("b"), F.col("n").alias("n_b")), "b").withColumn("total", total)
    d = lambda c: F.col(c).cast("double")
    pmi = F.round(F.log((d("n_ab") / d("total")) / ((d("n_a") / d("total")) * (d("n_b") / d("total")))), 4)
    return j.select("a", "b", "n_ab", pmi.alias("pmi"), "first_seen", "last_seen")


def supply_edges(spark, sf_dir) -> DataFrame:
    """(src, dst, day, share): suppliers to customers, one edge per pair and date, the best stated share of it."""
    e = table(spark, sf_dir, "supply_edge").select(norm_symbol(F.col("supplier")).alias("src"), norm_symbol(F.col("customer")).alias("dst"), F.col("filing_date").alias("day"), F.expr("try_cast(replace(replace(pct_revenue, '%', ''), ' ', '') AS double)").alias("share"), F.length(F.coalesce("passage", F.lit(""))).alias("len"), "edge_id")
    best = Window.partitionBy("src", "dst", "day").orderBy(F.col("share").isNull(), F.col("len").desc(), "edge_id")
    usable = e.where("src IS NOT NULL AND dst IS NOT NULL AND day IS NOT NULL")
    return usable.withColumn("k", F.row_number().over(best)).where("k = 1").select("src", "dst", "day", F.when((F.col("share") > 0) & (F.col("share") <= 100), F.col("share")).alias("share"), "edge_id")


def _day(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


def f12_narrow_articles(spark, sf_dir):
    return dated_tags(spark, sf_dir).select("article_id", "symbol", _day("day"))


def f15_valid_symbols(spark, sf_dir):
    s = table(spark, sf_dir, "news_symbol").select(F.trim("symbol").alias("symbol")).distinct()
    return s.select("symbol", F.col("symbol").rlike(r"^[A-Z][A-Z.\-]{0,9}$").alias("is_valid"))


def j1_comention(spark, sf_dir):
    """Pairs of symbols on each narrow article."""
    t = dated_tags(spark, sf_dir)
    return t.select("article_id", F.col("symbol").alias("a"), _day("day")).join(t.select("article_id", F.col("symbol").alias("b")), "article_id").where("a < b")


def a15_pmi(spark, sf_dir):
    return pmi_edges(dated_tags(spark, sf_dir)).select("a", "b", "n_ab", "pmi", _day("first_seen"), _day("last_seen"))


def a16_seed_pmi(spark, sf_dir):
    """The 20 best partners of each supplier, by news from before 2024."""
    t = durable(dated_tags(spark, sf_dir).where(F.col("day") < "2024-01-01"))
    seeds = table(spark, sf_dir, "supply_edge").select(norm_symbol(F.col("supplier")).alias("a")).distinct()
    e = durable(pmi_edges(t, min_pair=4))
    both = e.select("a", "b", "pmi").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi"))
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.col("pmi").desc(), "b"))
    return both.join(seeds, "a", "left_semi").withColumn("rank", k).where("rank <= 20").select(F.col("a").alias("seed"), F.col("b").alias("partner"), "pmi", "rank")


def a38_pmi_threshold(spark, sf_dir):
    """The median score of the pairs, and how many are strong."""
    e = pmi_edges(dated_tags(spark, sf_dir))
    return e.agg(F.median("pmi").alias("median_pmi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pmi") >= PMI_STRONG).alias("n_strong"))


def g1_laggers(spark, sf_dir):
    """Suppliers of every customer, up to two steps back, by filings until mid 2024."""
    e = durable(supply_edges(spark, sf_dir))
    starts = e.select(F.col("dst").alias("sid"), F.col("dst").alias("start"), F.to_date(F.lit("2024-06-30")).alias("as_of")).distinct()
    return laggers(starts, e).select("leader", "lagger", "lag_days", F.round("beta", 6).alias("beta"))


def g7_supply_paths(spark, sf_dir):
    """The way that is shown from every customer to each supplier up to two steps back, with what the last filing on it says of its customer."""
    e = durable(supply_edges(spark, sf_dir))
    starts = e.select(F.col("dst").alias("sid"), F.col("dst").alias("start"), F.to_date(F.lit("2024-06-30")).alias("as_of")).distinct()
    ways = shown_ways(starts, e).select("start", "node", F.col("depth").alias("hops"), "path", "filed", F.get("path", F.col("depth") - 1).alias("to"))
    said = e.join(table(spark, sf_dir, "supply_edge").select("edge_id", "passage"), "edge_id").join(table(spark, sf_dir, "company_ref").select(F.col("ticker").alias("dst"), "title"), "dst", "left")
    said = said.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("day").alias("filed"), passages.disclosure(F.col("passage"), F.col("title")).alias("x"))
    return ways.join(said, ["node", "to", "filed"]).select("start", "node", "hops", F.array_join(F.reverse("path"), ">").alias("path"), _day("filed"), "x.says", "x.pct")


def g8_two_hop(spark, sf_dir):
    """Symbols two co-mentions away, over edges of 1 and more seen by the end of 2023."""
    e = durable(pmi_edges(dated_tags(spark, sf_dir)))
    out = two_hop(e, e.select(F.col("a").alias("symbol")), floor=1.0, before=F.to_date(F.lit("2023-12-31")))
    return out.groupBy("start", "node").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_ways"))


def j13_scan_candidates(spark, sf_dir):
    """Suppliers claimed by the customer that moved furthest, as of each month's last session with another one after it."""
    p = durable(bar_panel(spark, sf_dir))
    days = p.groupBy(F.trunc("d", "month").alias("m")).agg(F.max("d").alias("as_of")).select("as_of")
    shocked = durable(scan(p, session_ends(days, p)))
    starts = shocked.select(F.concat_ws("|", "symbol", "as_of").alias("sid"), F.col("symbol").alias("start"), "as_of").distinct()
    reached = laggers(starts, supply_edges(spark, sf_dir))
    claims = reached.join(shocked.withColumn("sid", F.concat_ws("|", "symbol", "as_of")), "sid")
    k = F.row_number().over(Window.partitionBy("as_of", "lagger").orderBy(F.round(F.abs("z"), 12).desc(), "leader"))
    return claims.withColumn("k", k).where("k = 1").select(_day("as_of"), F.col("lagger").alias("symbol"), F.when(F.col("z") > 0, "up").otherwise("down").alias("direction"), F.col("leader").alias("origin_leader"), F.round("z", 7).alias("origin_sigma"))


def j16_known_suppliers(spark, sf_dir):
    """How many suppliers of each customer were known at the end of each year."""
    e = supply_edges(spark, sf_dir).groupBy("src", "dst").agg(F.min("day").alias("first"))
    ends = e.select(F.explode(F.sequence(F.lit(2019), F.lit(2025))).alias("year"), "src", "dst", "first").where(F.year("first") <= F.col("year"))
    return ends.groupBy("dst", "year").agg(F.count(F.lit(1)).alias("n_suppliers"))


def g3_snapshot(spark, sf_dir):
    """Co-movement as of each company's latest snapshot: one is taken at the end of every quarter, of the 40 sessions before it."""
    p = durable(bar_panel(spark, sf_dir).select("symbol", "i", "d", "r"))
    day = date(2024, 11, 15)
    # Snapshots after the day are nobody's latest. There are four a year.
    ends = p.groupBy(F.trunc("d", "quarter").alias("q")).agg(F.max("d").alias("as_of"), F.max("i").alias("last")).where((F.col("last") >= 41) & (F.col("as_of") <= F.lit(day)))
    taken = [(r.as_of, r["last"] - 39, r["last"] + 1) for r in ends.select("as_of", "last").collect()]
    first, end = min((lo for _, lo, _ in taken), default=0), max((hi for *_, hi in taken), default=0)
    spans = F.broadcast(spark.createDataFrame([(lo, hi) for _, lo, hi in taken], "lo int, hi int"))
    w = p.join(spans, (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")), "left_semi").select("symbol", "i", "r")
    e = durable(latest_blocked(w, taken, first=first, width=end - first, least=0.4))
    asked = p.select("symbol").distinct().withColumn("day", F.lit(day))
    return latest_snapshot(e, asked).select("symbol", _day("as_of"), "other", F.round("corr", 7).alias("corr"))


def g6_network(spark, sf_dir):
    """The maximum spanning forest of co-movement over the last 120 sessions but one, with degrees."""
    p = durable(bar_panel(spark, sf_dir))
    last = p.agg(F.max("i")).first()[0] or 0
    e = durable(edges_blocked(p.where((F.col("i") >= last - 120) & (F.col("i") < last)).select("symbol", "i", "r"), first=last - 120, trail=120, min_abs_corr=0.15))
    tree = forest_by_rounds(e.select("a", "b", F.round(F.abs("corr"), 9).alias("weight")))
    d = degrees(e)
    return tree.join(d.select(F.col("symbol").alias("a"), F.col("degree").alias("degree_a")), "a").join(d.select(F.col("symbol").alias("b"), F.col("degree").alias("degree_b")), "b").select("a", "b", F.round("weight", 8).alias("weight"), "degree_a", "degree_b")


def g9_universe(spark, sf_dir):
    """All symbols at either end of a supply edge or co-mention, once, in order."""
    s, c = supply_edges(spark, sf_dir), pmi_edges(dated_tags(spark, sf_dir))
    ends = [s.select(F.col("src").alias("symbol")), s.select("dst"), c.select("a"), c.select("b")]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out.distinct().orderBy("symbol")


def x3_relations(spark, sf_dir):
    """What each filing's passage says of the counterparty, from the one sentence that names it."""
    m = table(spark, sf_dir, "filing_mention")
    s = passages.naming_sentence(F.col("passage"), F.col("counterparty"))
    out = m.select("id", s.alias("sentence"))
    return out.select("id", passages.relation(F.col("sentence")).alias("relation"), "sentence", passages.percentage(F.col("sentence")).alias("pct"), passages.quotable(F.col("sentence")).alias("quotable"))


def x5_proximity(spark, sf_dir):
    """Customer mentions, unless a competitor or supplier is spoken of close to the name."""
    m = table(spark, sf_dir, "filing_mention").where("passage IS NOT NULL")
    at = F.instr("passage", F.regexp_extract("counterparty", r"(\S+)", 1)) - 1
    return m.select("id", passages.proximity_label(F.col("passage"), F.greatest(at, F.lit(0))).alias("label"))


def x11_normalised(spark, sf_dir):
    """Passages with single spaces, and each article's tags as one string."""
    tags = distinct_tags(spark, sf_dir).groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    a = table(spark, sf_dir, "news_article").groupBy("id").agg(F.max(F.struct("ingested_at", "updated_at", "headline")).alias("x"))
    return a.join(tags, F.col("id") == F.col("article_id"), "left").select("id", F.trim(F.regexp_replace(F.coalesce("x.headline", F.lit("")), r"\s+", " ")).alias("headline"), F.coalesce("symbols", F.lit("")).alias("symbols"))


def x23_vector_search(spark, sf_dir):
    """The 5 nearest vectors of another label for every 50th one."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))
    c = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return search(q, c, k=5, match=F.col("label") != F.col("qlabel")).select("qid", "id", F.round("score", 7).alias("score"), "rank")


def a39_sic_lift(spark, sf_dir):
    """How much more often companies that share articles share an industry than any two symbols with news do."""
    sic = latest_sic(spark, sf_dir).where("sic IS NOT NULL").select("symbol", F.substring("sic", 1, 2).alias("s"))
    e = pmi_edges(dated_tags(spark, sf_dir))
    j = e.join(sic.select(F.col("symbol").alias("a"), F.col("s").alias("sa")), "a").join(sic.select(F.col("symbol").alias("b"), F.col("s").alias("sb")), "b")
    paired = j.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("sa") == F.col("sb")).cast("int")).alias("share"))
    tagged = distinct_tags(spark, sf_dir).select("symbol").distinct().join(sic, "symbol").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    base = tagged.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (n * (n - 1))).alias("base")).scalar()
    return paired.withColumn("base", base).select("n_pairs", F.round("share", 7).alias("share"), F.round("base", 7).alias("base"), F.round(F.col("share") - F.col("base"), 7).alias("lift"))


_FUNCS = (f12_narrow_articles, f15_valid_symbols, j1_comention, a15_pmi, a16_seed_pmi, a38_pmi_threshold, g1_laggers, g7_supply_paths, g8_two_hop, j13_scan_candidates, j16_known_suppliers, g3_snapshot, g6_network, g9_universe, x3_relations, x5_proximity, x11_normalised, x23_vector_search, a39_sic_lift)
QUERIES = {f.__name__: f for f in _FUNCS}

_TAGS = """tags AS (SELECT DISTINCT article_id, upper(trim(symbol)) AS symbol FROM news_symbol WHERE article_id IS NOT NULL AND trim(symbol) <> ''),
dt AS (SELECT article_id, symbol, day FROM tags JOIN (SELECT id, CAST(min(created_at) AT TIME ZONE 'UTC' AS DATE) AS day FROM news_article GROUP BY id) ON id = article_id
  WHERE article_id IN (SELECT article_id FROM tags GROUP BY article_id HAVING count(*) <= 8))"""


def _pmi_sql(src: str = "dt", pair: int = 5, freq: int = 10) -> str:
    return f"""fq AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY symbol HAVING count(*) >= {freq}), tot AS (SELECT CAST(count(DISTINCT article_id) AS DOUBLE) AS t FROM {src}),
ab AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n_ab, min(x.day) AS first_seen, max(x.day) AS last_seen FROM {src} x JOIN {src} y ON x.article_id = y.article_id AND x.symbol < y.symbol GROUP BY ALL HAVING count(*) >= {pair}),
pmi AS (SELECT a, b, n_ab, round(ln((n_ab / t) / ((fa.n / t) * (fb.n / t))), 4) AS pmi, first_seen, last_seen FROM ab JOIN fq fa ON fa.symbol = a JOIN fq fb ON fb.symbol = b, tot)"""


_SUPPLY = """sup AS (SELECT src, dst, day, CASE WHEN share > 0 AND share <= 100 THEN share END AS share FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, day ORDER BY share IS NULL, len DESC, edge_id) AS k FROM (
  SELECT upper(trim(supplier)) AS src, upper(trim(customer)) AS dst, filing_date AS day, TRY_CAST(replace(replace(pct_revenue, '%', ''), ' ', '') AS DOUBLE) AS share, length(coalesce(passage, '')) AS len, edge_id FROM supply_edge) WHERE src <> '' AND dst <> '' AND day IS NOT NULL) WHERE k = 1)"""
_WAYS = """one AS (SELECT dst AS start, src AS node, 1 AS depth, share, [dst, src] AS path, day AS d1 FROM sup WHERE day <= {d}),
two AS (SELECT o.start, s.src AS node, 2 AS depth, s.share, list_append(o.path, s.src) AS path FROM one o JOIN sup s ON s.dst = o.node AND s.day <= {d} AND NOT (s.src = o.node AND s.dst = o.start AND s.day = o.d1))"""
_SCAN = f"""{PANEL}, pit AS (SELECT max(d) AS d, max(i) + 1 AS ti FROM sess GROUP BY date_trunc('month', d) HAVING max(i) + 1 < (SELECT n FROM ns) AND max(i) + 1 >= 63),
shock AS (SELECT * FROM (SELECT symbol, day, sum0 / nullif(sd * sqrt(3), 0) AS z FROM (SELECT p.symbol, a.d AS day, coalesce(sum(r) FILTER (WHERE p.i >= a.ti - 3), 0) AS sum0, stddev_samp(r) FILTER (WHERE p.i < a.ti - 3) AS sd FROM p JOIN pit a ON p.i BETWEEN a.ti - 63 AND a.ti - 1 GROUP BY ALL)) WHERE abs(z) >= 2)"""
_C = "covar_pop(CASE WHEN y.r IS NOT NULL THEN x.r END, CASE WHEN x.r IS NOT NULL THEN y.r END) / nullif(stddev_pop(CASE WHEN y.r IS NOT NULL THEN x.r END) * stddev_pop(CASE WHEN x.r IS NOT NULL THEN y.r END), 0)"
_PIC = r"""SELECT article_id, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM tags GROUP BY 1"""
ORACLE = {
    "f12_narrow_articles": f"WITH {_TAGS} SELECT article_id, symbol, strftime(day, '%Y-%m-%d') AS day FROM dt",
    "f15_valid_symbols": r"SELECT DISTINCT trim(symbol) AS symbol, regexp_full_match(trim(symbol), '[A-Z][A-Z.\-]{0,9}') AS is_valid FROM news_symbol",
    "j1_comention": f"WITH {_TAGS} SELECT x.article_id, x.symbol AS a, strftime(x.day, '%Y-%m-%d') AS day, y.symbol AS b FROM dt x JOIN dt y ON x.article_id = y.article_id AND x.symbol < y.symbol",
    "a15_pmi": f"WITH {_TAGS}, {_pmi_sql()} SELECT a, b, n_ab, pmi, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM pmi",
    "a16_seed_pmi": f"WITH {_TAGS}, old AS (SELECT * FROM dt WHERE day < DATE '2024-01-01'), {_pmi_sql('old', 4)}, bw AS (SELECT a, b, pmi FROM pmi UNION ALL SELECT b, a, pmi FROM pmi) SELECT * FROM (SELECT a AS seed, b AS partner, pmi, row_number() OVER (PARTITION BY a ORDER BY pmi DESC, b) AS rank FROM bw WHERE a IN (SELECT upper(trim(supplier)) FROM supply_edge)) WHERE rank <= 20",
    "a38_pmi_threshold": f"WITH {_TAGS}, {_pmi_sql()} SELECT median(pmi) AS median_pmi, count(*) AS n, count(*) FILTER (WHERE pmi >= 1.1172) AS n_strong FROM pmi",
    "g1_laggers": f"WITH {_SUPPLY}, {_WAYS.format(d="DATE '2024-06-30'")}, w AS (SELECT start, node, depth, share FROM one UNION ALL SELECT start, node, depth, share FROM two) SELECT start AS leader, node AS lagger, depth AS lag_days, round(share / 100, 6) AS beta FROM (SELECT start, node, depth, coalesce(share, 0) AS share, row_number() OVER (PARTITION BY start, node ORDER BY depth, coalesce(share, 0) DESC) AS k FROM w) WHERE k = 1",
    "g7_supply_paths": rf"""WITH {_SUPPLY}, o AS (SELECT dst AS start, src AS node, 1 AS depth, share, day AS filed, dst AS t, [dst, src] AS path, dst || '|' || src || '|' || day AS e1 FROM sup WHERE day <= DATE '2024-06-30'),
w AS (SELECT start, node, depth, share, filed, t, path FROM o UNION ALL SELECT o.start, s.src, 2, s.share, s.day, s.dst, list_append(o.path, s.src) FROM o JOIN sup s ON s.dst = o.node AND s.day <= DATE '2024-06-30' WHERE o.e1 <> s.dst || '|' || s.src || '|' || s.day),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY depth, coalesce(share, 0) DESC, filed DESC, array_to_string(path, '>')) AS k FROM w) WHERE k = 1),
pick AS (SELECT src, dst, day, passage FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, day ORDER BY share IS NULL, len DESC, edge_id) AS k FROM (SELECT upper(trim(supplier)) AS src, upper(trim(customer)) AS dst, filing_date AS day, TRY_CAST(replace(replace(pct_revenue, '%', ''), ' ', '') AS DOUBLE) AS share, length(coalesce(passage, '')) AS len, edge_id, passage FROM supply_edge) WHERE src <> '' AND dst <> '' AND day IS NOT NULL) WHERE k = 1),
q AS (SELECT src, dst, day, nullif(regexp_replace(regexp_extract(title, '(\S+)', 1), '^[,.]+|[,.]+$', '', 'g'), '') AS word, string_split(regexp_replace(regexp_replace(regexp_replace(passage, '\b(Inc|Corp|Ltd|Co|No|U\.S)\.', '\1~', 'g'), '(\s[A-Z])\.', '\1~', 'g'), '\.\s+([A-Z("])', '#|#\1', 'g'), '#|#') AS parts FROM pick LEFT JOIN company_ref ON ticker = dst),
s AS (SELECT src, dst, day, trim(list_filter(list_transform(parts, lambda x: replace(x, '~', '.')), lambda x: contains(x, word))[1]) AS says FROM q)
SELECT * EXCLUDE (pct0), nullif(pct0, '') AS pct FROM (SELECT start, node, depth AS hops, array_to_string(list_reverse(path), '>') AS path, strftime(filed, '%Y-%m-%d') AS filed, says,
  regexp_extract(list_filter(regexp_extract_all(says, '\d{{1,3}}(?:\.\d)?\s?%(?:\s*(?i:or\s+(?:more|greater|higher)))?'), lambda x: x LIKE '%\%' ESCAPE '\')[1], '^[\d.]+') AS pct0 FROM b JOIN s ON s.src = node AND s.dst = t AND s.day = filed)""",
    "g8_two_hop": f"WITH {_TAGS}, {_pmi_sql()}, e AS (SELECT * FROM pmi WHERE pmi >= 1 AND first_seen <= DATE '2023-12-31'), bw AS (SELECT a, b, pmi FROM e UNION ALL SELECT b, a, pmi FROM e), f AS (SELECT * FROM bw WHERE a IN (SELECT a FROM pmi)) SELECT f.a AS start, g.b AS node, max(least(f.pmi, g.pmi)) AS score, count(*) AS n_ways FROM f JOIN bw g ON g.a = f.b AND g.b <> f.a WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.a = f.a AND h.b = g.b) GROUP BY ALL",
    "j13_scan_candidates": f"""WITH {_SCAN}, {_SUPPLY}, w AS (SELECT s.symbol AS leader, s.day, z, e.src AS lagger FROM shock s JOIN sup e ON e.dst = s.symbol AND e.day <= s.day
  UNION SELECT s.symbol, s.day, z, f.src FROM shock s JOIN sup e ON e.dst = s.symbol AND e.day <= s.day JOIN sup f ON f.dst = e.src AND f.day <= s.day AND NOT (f.src = e.src AND f.dst = e.dst AND f.day = e.day))
SELECT strftime(day, '%Y-%m-%d') AS as_of, lagger AS symbol, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction, leader AS origin_leader, round(z, 7) AS origin_sigma FROM (SELECT *, row_number() OVER (PARTITION BY day, lagger ORDER BY round(abs(z), 12) DESC, leader) AS k FROM w) WHERE k = 1""",
    "j16_known_suppliers": f"WITH {_SUPPLY}, f AS (SELECT src, dst, min(day) AS first FROM sup GROUP BY ALL) SELECT dst, CAST(y AS INTEGER) AS year, count(*) AS n_suppliers FROM f JOIN (SELECT unnest(generate_series(2019, 2025)) AS y) ON year(first) <= y GROUP BY ALL",
    "g3_snapshot": f"""WITH {PANEL}, q AS (SELECT max(d) AS as_of, max(i) AS last FROM sess GROUP BY date_trunc('quarter', d) HAVING max(i) >= 41),
e AS (SELECT as_of, x.symbol AS a, y.symbol AS b, {_C} AS corr FROM q JOIN p x ON x.i > last - 40 AND x.i <= last JOIN p y ON y.i = x.i AND y.symbol <> x.symbol GROUP BY ALL),
f AS (SELECT * FROM e WHERE abs(corr) >= 0.4), m AS (SELECT a, max(as_of) AS as_of FROM f WHERE as_of <= DATE '2024-11-15' GROUP BY a) SELECT a AS symbol, strftime(as_of, '%Y-%m-%d') AS as_of, b AS other, round(corr, 7) AS corr FROM f JOIN m USING (a, as_of)""",
    # An edge is in the forest if better ones don't connect its ends.
    "g6_network": f"""WITH RECURSIVE {PANEL}, w AS (SELECT symbol, i, CASE WHEN abs(r) <= 10 THEN r END AS r FROM p, ns WHERE i >= n - 121 AND i < n - 1),
c AS (SELECT x.symbol AS a, y.symbol AS b, abs({_C}) AS v FROM w x JOIN w y ON x.i = y.i AND x.symbol < y.symbol GROUP BY ALL), e AS (SELECT a, b, round(v, 9) AS weight, row_number() OVER (ORDER BY round(v, 9) DESC, a, b) AS k FROM c WHERE v >= 0.15),
reach(k, node) AS (SELECT k, a FROM e UNION SELECT r.k, CASE WHEN e.a = r.node THEN e.b ELSE e.a END FROM reach r JOIN e ON e.k < r.k AND r.node IN (e.a, e.b)),
deg AS (SELECT s, count(*) AS n FROM (SELECT a AS s FROM e UNION ALL SELECT b FROM e) GROUP BY s)
SELECT a, b, round(weight, 8) AS weight, x.n AS degree_a, y.n AS degree_b FROM e JOIN deg x ON x.s = a JOIN deg y ON y.s = b WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k = e.k AND r.node = e.b)""",
    "g9_universe": f"WITH {_TAGS}, {_pmi_sql()}, {_SUPPLY} SELECT src AS symbol FROM sup UNION SELECT dst FROM sup UNION SELECT a FROM pmi UNION SELECT b FROM pmi",
    "x11_normalised": f"WITH {_TAGS}, a AS (SELECT id, arg_max(struct_pack(h := headline), row(ingested_at, coalesce(updated_at, TIMESTAMPTZ '0001-01-01'), coalesce(headline, ''))).h AS h FROM news_article GROUP BY id) SELECT id, trim(regexp_replace(coalesce(h, ''), '\\s+', ' ', 'g')) AS headline, coalesce(symbols, '') AS symbols FROM a LEFT JOIN ({_PIC}) ON article_id = id",
    "x23_vector_search": "WITH s AS (SELECT q.vec_id AS qid, c.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON c.label <> q.label WHERE q.vec_id % 50 = 0) SELECT * FROM (SELECT qid, id, round(score, 7) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5",
    "a39_sic_lift": f"""WITH {_TAGS}, {_pmi_sql()}, sic AS (SELECT symbol, sic[1:2] AS s FROM (SELECT upper(trim(symbol)) AS symbol, sic, row_number() OVER (PARTITION BY upper(trim(symbol)) ORDER BY valid_from DESC, known_at DESC, version_id DESC) AS k FROM sic_history) WHERE k = 1 AND sic IS NOT NULL),
pr AS (SELECT count(*) AS n_pairs, avg(CASE WHEN x.s = y.s THEN 1 ELSE 0 END) AS share FROM pmi JOIN sic x ON x.symbol = a JOIN sic y ON y.symbol = b),
cl AS (SELECT s, count(*) AS n FROM sic WHERE symbol IN (SELECT symbol FROM tags) GROUP BY s), bs AS (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / (sum(n) * (sum(n) - 1)) AS base FROM cl)
SELECT n_pairs, round(share, 7) AS share, round(base, 7) AS base, round(share - base, 7) AS lift FROM pr, bs""",
    "x3_relations": r"""WITH s AS (SELECT id, list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(passage, 'Inc\.', 'Inc~', 'g'), 'Corp\.', 'Corp~', 'g'), 'Ltd\.', 'Ltd~', 'g'), 'Co\.', 'Co~', 'g'), 'U\.S\.', 'U~S~', 'g'), '([.!?])\s+', '\1|#|', 'g'), '\|#\|'), lambda x: replace(x, '~', '.')) AS parts, regexp_extract(counterparty, '(\S+)', 1) AS tok FROM filing_mention),
n AS (SELECT id, CASE WHEN tok <> '' THEN list_filter(parts, lambda x: regexp_matches(x, CASE WHEN regexp_matches(tok, '^[\p{L}\p{N}_]') THEN '(^|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END || regexp_escape(tok) || CASE WHEN regexp_matches(tok, '[\p{L}\p{N}_]$') THEN '($|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END))[1] END AS sentence FROM s), l AS (SELECT id, sentence, lower(sentence) AS low FROM n)
SELECT id, sentence, nullif(regexp_extract(sentence, '(\d+(?:\.\d+)?)%', 1), '') AS pct, coalesce(regexp_matches(sentence, '^\p{Lu}'), false) AS quotable,
  CASE WHEN sentence IS NULL THEN 'unnamed' WHEN low LIKE '%compet%' THEN 'competitor' WHEN low LIKE '%acqui%' OR low LIKE '%sale of%' THEN 'corporate_action' WHEN low LIKE '%supplier%' OR low LIKE '%supplied by%' THEN 'reversed' WHEN low LIKE '%customer%' OR low LIKE '%accounted for%' OR low LIKE '%sales to%' OR low LIKE '%represented%' THEN 'customer' ELSE 'unstated' END AS relation FROM l""",
    "x5_proximity": rf"""WITH m AS (SELECT id, passage, greatest(instr(passage, regexp_extract(counterparty, '(\S+)', 1)) - 1, 0) AS at_ FROM filing_mention WHERE passage IS NOT NULL),
n AS (SELECT *, substring(passage, greatest(at_ - 120, 0) + 1, at_ + 120 - greatest(at_ - 120, 0)) AS near FROM m)
SELECT id, CASE WHEN regexp_matches(near, '{passages.COMPETITOR}') OR regexp_matches(near, '{passages.SUPPLIER}') THEN 'unknown' WHEN regexp_matches(passage, '{passages.CUSTOMER}') THEN 'customer' ELSE 'unknown' END AS label FROM n""",
}
