"""Statistics for testing relationships, as aggregations.

What needs matrices (regressions) sums cross products in Spark and solves the
few equations on the driver; nothing that grows with the rows is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, order: Sequence[Column], name: str = "rank", buckets: int = 200) -> DataFrame:
    """``df`` with the 1-based place of each row in the total order, without one task that sorts everything.

    Rows go to ranges of the first key (its quantiles), ranges are counted, and
    each is sorted on its own behind the rows of those before it.
    """
    key = df.withColumn("_k", order[0].cast("double"))
    cuts = key.agg(F.percentile_approx("_k", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first()[0] or []
    edges = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: F.col("_k") > e))
    placed = key.withColumn("_b", F.when(F.col("_k").isNull(), -1).otherwise(place))
    sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return placed.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + own).drop("_k", "_b", "_before")


def auc(df: DataFrame, score: Column, label: Column, ties: Sequence[Column]) -> DataFrame:
    """(auc, n_pos, n_neg): the rank-sum area under the curve; ties stand in the order of ``ties``. Null without both labels."""
    r = ranks(df.select(score.alias("s"), label.cast("int").alias("y"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]).where("s IS NOT NULL AND y IS NOT NULL"), [F.col("s"), *[F.col(f"t{i}") for i in range(len(ties))]])
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    top = F.sum(F.col("rank") * F.col("y")) - pos * (pos + 1) / 2
    return r.agg(F.try_divide(top, pos * neg).alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def deciles(df: DataFrame, score: str, label: str, n: int = 10) -> DataFrame:
    """(bin, lo, hi, n, rate): the share of labels between exact quantiles of the score; the last bin is closed."""
    q = df.agg(F.percentile(score, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("q")).first()[0] or [0.0] * (n + 1)
    b = F.lit(0)
    for e in q[1:-1]:
        b = b + (F.col(score) >= F.lit(e)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("int")).alias("rate"))


def clustered_mean(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """(mean, se, n, n_clusters): the mean of ``value`` with a standard error clustered by ``cluster``."""
    m = df.agg(F.avg(value).alias("m")).scalar()
    by = df.where(F.col(value).isNotNull()).withColumn("d", F.col(value) - m).groupBy(cluster).agg(F.sum("d").alias("u"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("k"))
    n = F.sum("k")
    return by.agg((F.sum("s") / n).alias("mean"), (F.sqrt(F.sum(F.col("u") * F.col("u"))) / n).alias("se"), F.coalesce(n, F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_clusters"))


def slopes(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, slope, se): least squares with an intercept, classical standard errors; null where x is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n, sxx = F.count(F.lit(1)), F.var_pop(x) * F.count(F.lit(1))
    b = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    rss = F.var_pop(y) * n - b * b * sxx
    se = F.when(n > 2, F.sqrt(F.greatest(F.try_divide(F.try_divide(rss, (n - 2).cast("double")), sxx), F.lit(0.0))))
    return d.groupBy(*by).agg(n.alias("n"), b.alias("slope"), se.alias("se"))


def clustered_slopes(df: DataFrame, x: str, y: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, slope, se): least squares with an intercept, errors clustered by ``cluster``; null where x is constant. Rows without x or y don't count."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.lit(0).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_g"))
    keys = [*by, "_o"]
    fit = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x")).alias("slope"), (F.var_pop("_x") * F.count(F.lit(1))).alias("sxx"))
    away = F.col("_x") - F.col("mx")
    u = away * (F.col("_y") - F.col("my") - F.col("slope") * away)
    score = d.join(fit, keys).groupBy(*keys, "_g").agg(F.sum(u).alias("u")).groupBy(*keys).agg(F.sum(F.col("u") * F.col("u")).alias("uu"))
    return fit.join(score, keys).select(*by, "n", "slope", F.try_divide(F.sqrt("uu"), F.col("sxx")).alias("se"))


def ols(df: DataFrame, y: str, xs: Sequence[str], cluster: str | None = None) -> dict[str, tuple[float, float]]:
    """Coefficient and standard error of each regressor and of ``const``, clustered if asked."""
    names = [*xs, "const"]
    cols = [F.col(x).cast("double") for x in xs] + [F.lit(1.0)]
    d = df.dropna(subset=[y, *xs]).select(F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)], (F.col(cluster) if cluster else F.lit(0)).alias("g"))
    k = len(names)
    x = [F.col(f"x{i}") for i in range(k)]
    row = d.agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(k)], F.count(F.lit(1)).alias("n")).first()
    if not row.n or row.n <= k:
        return {c: (math.nan, math.nan) for c in names}
    inv = np.linalg.pinv(np.array([[row[f"a{i}_{j}"] for j in range(k)] for i in range(k)]))
    beta = inv @ np.array([row[f"b{i}"] for i in range(k)])
    u = F.col("y") - sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
    if cluster:
        s = d.withColumn("u", u).groupBy("g").agg(*[F.sum(x[i] * F.col("u")).alias(f"s{i}") for i in range(k)])
        m = s.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        v = inv @ np.array([[m[f"m{i}_{j}"] for j in range(k)] for i in range(k)]) @ inv
    else:
        v = inv * (d.agg(F.sum(u * u)).first()[0] / (row.n - k))
    return {c: (float(b), math.sqrt(max(0.0, e))) for c, b, e in zip(names, beta, np.diag(v))}


def pooled(df: DataFrame, estimate: str, se: str) -> DataFrame:
    """(k, pooled, se, q, i2): inverse-variance pooling of estimates, Cochran's Q and I squared in percent."""
    d = df.where((F.col(se) > 0) & F.col(estimate).isNotNull()).withColumn("w", 1 / (F.col(se) * F.col(se)))
    w, we, wee = F.sum("w"), F.sum(F.col("w") * F.col(estimate)), F.sum(F.col("w") * F.col(estimate) * F.col(estimate))
    k = F.count(F.lit(1))
    q = wee - we * we / w
    return d.agg(k.alias("k"), (we / w).alias("pooled"), F.sqrt(1 / w).alias("se"), q.alias("q"), F.greatest(F.lit(0.0), F.try_divide(q - (k - 1), q) * 100).alias("i2"))


def proportion_test(n1: Column, p1: Column, n2: Column, p2: Column) -> tuple[Column, Column]:
    """(z, smallest difference that 80 % power would detect) of two shares."""
    p = (n1 * p1 + n2 * p2) / (n1 + n2)
    s = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.try_divide(p1 - p2, s), 2.8 * s


def sign_test(k: int, n: int) -> float:
    """Two-sided p of k successes in n fair trials."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def binomial_greater(k: int, n: int) -> float:
    """One-sided p of k successes or more in n fair trials."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


def bootstrap_mean(df: DataFrame, value: str, *, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(mean, lo, hi): a 95 % interval of the mean, from Poisson-weighted replicates that need no resampling of rows."""
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("id"))
    r = d.select("v", "id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r"))
    u = (F.shiftrightunsigned(F.xxhash64("id", "r", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    cum, w, p = 0.0, F.lit(0), math.exp(-1)
    for k in range(8):  # the number of times a row is drawn is Poisson distributed with mean 1
        cum += p
        w = w + (u > cum).cast("int")
        p /= k + 1
    means = r.groupBy("r").agg(F.try_divide(F.sum(F.col("v") * w), F.sum(w)).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return ci.withColumn("mean", d.agg(F.avg("v").alias("m")).scalar()).select("mean", "lo", "hi")


def best_lag(x: DataFrame, y: DataFrame, lags: Sequence[int], min_n: int, *, signed: bool = False) -> DataFrame:
    """(key, lag, corr, n): for series (key, t, v) the lag of y behind x with the largest absolute correlation (the largest, if ``signed``), the first of equal ones.

    Without a key, ``x`` is the one series that all of ``y`` are held against.
    """
    from orrery.operators.panel import correlation

    a = x.select(*[c for c in x.columns if c in ("key", "t")], F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col("v").alias("vx"))
    on = ["key", "t"] if "key" in x.columns else ["t"]
    j = a.withColumn("t", F.col("t") + F.col("lag")).join(y.select("key", "t", F.col("v").alias("vy")), on)
    c = j.groupBy("key", "lag").agg(correlation(F.col("vx"), F.col("vy")).alias("corr"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_n) & F.col("corr").isNotNull())
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.round(F.col("corr") if signed else F.abs("corr"), 12).desc(), "lag"))
    return c.withColumn("k", k).where("k = 1").drop("k")


def matched_controls(wanted: DataFrame, pool: DataFrame, *, nearest: int = 25, seed: int = 0) -> DataFrame:
    """(day, symbol, control): for each wanted symbol of a day one of the ``nearest`` of the pool by size, without replacement.

    ``wanted`` and ``pool`` are (day, symbol, size). Within a day the choice is
    sequential, so a day is one task's work.
    """
    import pandas as pd

    def pick(key, w: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int.from_bytes(str(key[0]).encode(), "little") % 2**63])
        left = p[~p["symbol"].isin(set(w["symbol"]))].sort_values("symbol").reset_index(drop=True)
        rows = []
        for _, r in w.sort_values("symbol").iterrows():
            if left.empty:
                break
            near = (left["size"] - r["size"]).abs().sort_values(kind="stable").index[:nearest]
            got = near[int(rng.integers(len(near)))]
            rows.append((r["day"], r["symbol"], left.at[got, "symbol"]))
            left = left.drop(index=got)
        return pd.DataFrame(rows, columns=["day", "symbol", "control"])

    kind = wanted.schema["day"].dataType.simpleString()
    return wanted.groupBy("day").cogroup(pool.groupBy("day")).applyInPandas(pick, f"day {kind}, symbol string, control string")
