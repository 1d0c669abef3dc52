"""Pairwise co-movement of return series.

Two ways to the same edges. ``edges`` joins the long panel with itself by
session and lets Spark aggregate: the plain statement that tests hold the other
against. ``edges_blocked``, which the queries use, packs each symbol's window into a row, cuts the symbols into
blocks and multiplies pairs of blocks, each in its own task, with masks for
missing returns: the cost in shuffled data is symbols x blocks rather than
pairs x sessions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.panel import correlation

#: Returns larger than this are corporate actions or errors, and count as missing.
IMPLAUSIBLE = 10.0
#: No correlation below this is ever listed.
FLOOR = 0.1
SCHEMA = "a string, b string, corr double, n_sessions long, same double"


def fisher(corr: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a correlation from n sessions; null for n <= 3."""
    top = 1.0 - 1e-15
    z = F.atanh(F.least(F.greatest(corr, F.lit(-top)), F.lit(top)))
    half = F.when(n > 3, 1.96 / F.sqrt(n - 3))
    return F.tanh(z - half), F.tanh(z + half)


def _threshold(min_abs_corr: float) -> float:
    if not math.isfinite(min_abs_corr):
        raise ValueError(f"no threshold for correlations: {min_abs_corr!r}")
    return max(min_abs_corr, FLOOR)


def _finish(pairs: DataFrame, least: float) -> DataFrame:
    lo, hi = fisher(F.col("corr"), F.col("n_sessions"))
    flag = F.when(F.col("same") > 0.5, F.lit("duplicate_series"))
    return pairs.where(F.abs("corr") >= least).select("a", "b", "corr", "n_sessions", lo.alias("ci_low"), hi.alias("ci_high"), flag.alias("flag"))


def edges(window: DataFrame, *, trail: int, min_abs_corr: float = 0.3) -> DataFrame:
    """(a, b, corr, n_sessions, ci_low, ci_high, flag) for pairs a < b of ``window`` (symbol, i, r).

    ``flag`` marks series that are equal in more than half of the window.
    """
    least = _threshold(min_abs_corr)
    x = window.select("i", F.col("symbol").alias("a"), F.col("r").alias("ra"))
    y = window.select("i", F.col("symbol").alias("b"), F.col("r").alias("rb"))
    ok = lambda c: F.when(F.abs(c) <= IMPLAUSIBLE, F.col(c))
    pairs = x.join(y, (x["i"] == y["i"]) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(
        correlation(ok("ra"), ok("rb")).alias("corr"),
        F.count(ok("ra") + ok("rb")).alias("n_sessions"),
        (F.count_if(F.col("ra") == F.col("rb")) / trail).alias("same"),
    )
    return _finish(pairs, least)


def _gram(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlation, common sessions, equal sessions) of all rows of x with all rows of y, pairwise complete."""
    mx, my = np.abs(x) <= IMPLAUSIBLE, np.abs(y) <= IMPLAUSIBLE
    a, b = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    n = mx @ my.T
    with np.errstate(all="ignore"):
        sa, sb = a @ my.T, mx @ b.T
        cov = a @ b.T - sa * sb / n
        va, vb = (a * a) @ my.T - sa * sa / n, mx @ (b * b).T - sb * sb / n
        small = 1e-12 * np.maximum((a * a) @ my.T, mx @ (b * b).T)
        corr = np.where((va > small) & (vb > small), cov / np.sqrt(va * vb), np.nan)
    same = np.zeros(n.shape)
    for k in range(x.shape[1]):
        same += x[:, k][:, None] == y[:, k][None, :]
    return corr, n, same


def _cells(values: DataFrame, first: int, block: int) -> DataFrame:
    """(symbol, k, v, own, lo, hi): each symbol of ``values`` (symbol, i, v) packed into a row, once for every pair of blocks that its own is in."""
    packed = values.groupBy("symbol").agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct((F.col("i") - first).alias("k"), "v"))).alias("x"))
    blocks = F.ceil(packed.agg(F.count(F.lit(1))).scalar() / block).cast("int")
    rows = packed.select("symbol", F.col("x.k").alias("k"), F.col("x.v").alias("v"), blocks.alias("n")).withColumn("own", F.pmod(F.xxhash64("symbol"), F.col("n")).cast("int"))
    each = rows.select("symbol", "k", "v", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return each.select("symbol", "k", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _matrix(f: pd.DataFrame, width: int) -> np.ndarray:
    """Rows of a cell as a matrix, missing values as NaN."""
    x = np.full((len(f), width), np.nan)
    for row, (k, v) in enumerate(zip(f["k"], f["v"])):
        x[row, np.asarray(k, int)] = v
    return x


def edges_blocked(window: DataFrame, *, first: int, trail: int, min_abs_corr: float = 0.3, block: int = 256) -> DataFrame:
    """As :func:`edges` for the ``trail`` sessions from ``first`` on, by products of blocks of about ``block`` symbols."""
    least = _threshold(min_abs_corr)

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f, trail)
        names, own = f["symbol"].to_numpy(), f["own"].to_numpy()
        lo, hi = f["lo"].iat[0], f["hi"].iat[0]
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        corr, n, same = _gram(x[p], x[q])
        i, j = np.nonzero(np.abs(corr) >= least)
        if lo == hi:
            up = names[p[i]] < names[q[j]]
            i, j = i[up], j[up]
        s, t = names[p[i]], names[q[j]]
        return pd.DataFrame({"a": np.where(s < t, s, t), "b": np.where(s < t, t, s), "corr": corr[i, j], "n_sessions": n[i, j].astype(int), "same": same[i, j] / trail})

    cells = _cells(window.select("symbol", "i", F.col("r").alias("v")), first, block)
    return _finish(cells.groupBy("lo", "hi").applyInPandas(product, SCHEMA), least)


def parts_blocked(window: DataFrame, parts: list[tuple[int, int]], *, first: int, width: int, block: int = 256) -> DataFrame:
    """(a, b, c): for pairs a < b of ``window`` (symbol, i, r) an array of their correlations, one for the sessions [lo, hi) of each of ``parts``, by products of blocks.

    Sessions count from ``first`` on, of which there are ``width``. Pairwise
    complete; null where either series is constant or nothing is common.
    """

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f, width)
        names, own = f["symbol"].to_numpy(), f["own"].to_numpy()
        lo, hi = f["lo"].iat[0], f["hi"].iat[0]
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        each = []
        for start, end in parts:
            v = x[:, start:end]
            there = ~np.isnan(v)
            k = np.maximum(there.sum(1, keepdims=True), 1)
            v = np.where(there, v - np.where(there, v, 0.0).sum(1, keepdims=True) / k, 0.0)
            m = there.astype(float)
            a, b, ma, mb = v[p], v[q], m[p], m[q]
            with np.errstate(all="ignore"):
                n, sa, sb, qa, qb = ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T
                va, vb = qa - sa * sa / n, qb - sb * sb / n
                each.append(np.where((va > 1e-12 * qa) & (vb > 1e-12 * qb), (a @ b.T - sa * sb / n) / np.sqrt(va * vb), np.nan))
        i, j = np.nonzero(names[p][:, None] < names[q][None, :]) if lo == hi else np.nonzero(names[p][:, None] != names[q][None, :])
        s, t = names[p[i]], names[q[j]]
        c = np.stack([e[i, j] for e in each], 1) if len(i) else np.zeros((0, len(parts)))
        return pd.DataFrame({"a": np.where(s < t, s, t), "b": np.where(s < t, t, s), "c": list(c)})

    cells = _cells(window.select("symbol", "i", F.col("r").alias("v")), first, block)
    out = cells.groupBy("lo", "hi").applyInPandas(product, "a string, b string, c array<double>")
    return out.withColumn("c", F.transform("c", lambda v: F.nanvl(v, F.lit(None).cast("double"))))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's correlation of each row of x with the same row of y, deviations taken over the common sessions themselves; NaN where either is constant there."""
    there = ~np.isnan(x) & ~np.isnan(y)
    n = np.maximum(there.sum(1, keepdims=True), 1)
    at = there.argmax(1)[:, None]

    def deviations(v: np.ndarray) -> np.ndarray:
        v = np.where(there, v - np.take_along_axis(v, at, 1), 0.0)  # equal values become 0 without rounding
        return np.where(there, v - v.sum(1, keepdims=True) / n, 0.0)

    a, b = deviations(x), deviations(y)
    with np.errstate(all="ignore"):
        va, vb = (a * a).sum(1), (b * b).sum(1)
        return np.where((va > 0) & (vb > 0), (a * b).sum(1) / (np.sqrt(va) * np.sqrt(vb)), np.nan)


def _pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's correlation of all rows of x with all rows of y, pairwise complete; NaN where there is none.

    A pair whose common sessions vary little against the rest of a series is worked out by itself, since products would lose its digits.
    """

    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = ~np.isnan(v)
        k = np.maximum(m.sum(1, keepdims=True), 1)
        z = np.where(m, v - np.take_along_axis(v, m.argmax(1)[:, None], 1), 0.0)
        return np.where(m, z - z.sum(1, keepdims=True) / k, 0.0), m.astype(float)

    (a, ma), (b, mb) = centred(x), centred(y)
    with np.errstate(all="ignore"):
        n, sa, sb, qa, qb = ma @ mb.T, a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T
        va, vb = qa - sa * sa / n, qb - sb * sb / n
        corr = np.where((n > 1) & (qa > 0) & (qb > 0), (a @ b.T - sa * sb / n) / np.sqrt(va * vb), np.nan)
        i, j = np.nonzero((n > 1) & (qa > 0) & (qb > 0) & ~((va > 1e-3 * qa) & (vb > 1e-3 * qb)))
    for s in range(0, len(i), 1 << 14):
        k, l = i[s : s + (1 << 14)], j[s : s + (1 << 14)]  # noqa: E741
        corr[k, l] = _exact(x[k], y[l])
    return corr


def latest_blocked(window: DataFrame, snapshots: Sequence[tuple[date, int, int]], *, first: int, width: int, least: float, block: int = 512) -> DataFrame:
    """(as_of, a, b, corr): for pairs a < b of ``window`` (symbol, i, r) their correlations of ``least`` and more by size, over the sessions [lo, hi) of each of ``snapshots`` (as_of, lo, hi), as far as they may belong to the latest snapshot of a or b that has any.

    By products of blocks, the latest snapshot first. Once a symbol has an edge
    within a product, its earlier ones there can't be of its latest snapshot; an
    edge is left out if that holds for both its ends, and a product ends when it
    holds for all. Sessions count from ``first`` on, of which there are ``width``.
    """
    order = sorted(snapshots, reverse=True)

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f, width)
        names, own = f["symbol"].to_numpy(), f["own"].to_numpy()
        lo, hi = f["lo"].iat[0], f["hi"].iat[0]
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        seen = np.zeros(len(names), bool)
        out = [pd.DataFrame({"as_of": [], "a": [], "b": [], "corr": []})]
        for as_of, start, end in order:
            corr = _pairwise(x[p, start - first : end - first], x[q, start - first : end - first])
            hit = np.abs(corr) >= least
            i, j = np.nonzero(hit & (names[p][:, None] < names[q][None, :]) if lo == hi else hit)
            c, i, j = corr[i, j], p[i], q[j]
            keep = ~(seen[i] & seen[j])
            seen[i] = seen[j] = True
            s, t = names[i[keep]], names[j[keep]]
            out.append(pd.DataFrame({"as_of": as_of, "a": np.where(s < t, s, t), "b": np.where(s < t, t, s), "corr": c[keep]}))
            if seen.all():
                break
        return pd.concat([o for o in out if len(o)] or out)

    cells = _cells(window.select("symbol", "i", F.col("r").alias("v")), first, block)
    return cells.groupBy("lo", "hi").applyInPandas(product, "as_of date, a string, b string, corr double")


def near_blocked(cands: DataFrame, values: DataFrame, *, trail: int, topk: int, least_n: float, block: int = 512) -> DataFrame:
    """(cid, leader, corr, sl, sc): for each of ``cands`` (cid, symbol, ti) the ``topk`` symbols of ``values`` (symbol, i, r, pool) by absolute correlation over the ``trail`` sessions before ti.

    ``sl`` and ``sc`` are the deviations of the leader's and the candidate's
    returns in the window. Only symbols with ``pool`` are leaders, and only with
    ``least_n`` returns in the window at least. Symbols are packed into rows
    once, candidates carry their window, and each block of candidates meets each
    block of symbols in a task of its own, which gives its own ``topk``.
    """
    packed = values.where(F.col("r").isNotNull()).groupBy("symbol").agg(F.collect_list(F.struct("i", "r")).alias("x"), F.first("pool").alias("pool"))
    counts = cands.agg(F.count(F.lit(1)).alias("n")).scalar(), packed.agg(F.count(F.lit(1)).alias("n")).scalar()
    across, down = (F.greatest(F.ceil(c / block).cast("int"), F.lit(1)) for c in counts)
    inside = F.filter("x", lambda e: (e["i"] >= F.col("ti") - trail) & (e["i"] < F.col("ti")))
    own = cands.select("cid", "symbol", "ti").join(packed.select("symbol", "x"), "symbol", "left").select("cid", "symbol", "ti", inside.alias("x"))
    kinds = {"cid": "string", "symbol": "string", "ti": "int", "x": packed.schema["x"].dataType.simpleString()}
    row = lambda df, **cell: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *[v.alias(c) for c, v in cell.items()])
    left = row(own.withColumn("b", F.pmod(F.xxhash64("cid"), across).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), down - 1))), b=F.col("b"), d=F.col("d"))
    right = row(packed.where("pool").withColumn("d", F.pmod(F.xxhash64("symbol"), down).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), across - 1))), b=F.col("b"), d=F.col("d"))

    def product(f: pd.DataFrame) -> pd.DataFrame:
        c, s = f[f["cid"].notna()], f[f["cid"].isna()]
        out = [pd.DataFrame({"cid": [], "leader": [], "corr": [], "sl": [], "sc": []})]
        if len(c) and len(s):
            end = int(c["ti"].max())
            begin = min(int(c["ti"].min()) - trail, end - trail)
            names, m = s["symbol"].to_numpy(), np.full((len(s), end - begin), np.nan)
            for n, x in enumerate(s["x"]):
                at = np.array([e["i"] for e in x], int) - begin
                keep = (at >= 0) & (at < end - begin)
                m[n, at[keep]] = np.array([e["r"] for e in x], float)[keep]
            for cid, symbol, ti, x in zip(c["cid"], c["symbol"], c["ti"], c["x"]):
                if x is None or not len(x):
                    continue
                y = np.full(trail, np.nan)
                y[np.array([e["i"] for e in x], int) - (int(ti) - trail)] = [e["r"] for e in x]
                w = m[:, int(ti) - trail - begin : int(ti) - begin]
                there = ~np.isnan(w)
                both = there & ~np.isnan(y)
                k = both.sum(1)
                with np.errstate(all="ignore"):
                    a, b = np.where(both, w, 0.0), np.where(both, y, 0.0)
                    a, b = np.where(both, a - a.sum(1, keepdims=True) / k[:, None], 0.0), np.where(both, b - b.sum(1, keepdims=True) / k[:, None], 0.0)
                    va, vb = (a * a).sum(1), (b * b).sum(1)
                    corr = np.where((va > 0) & (vb > 0), (a * b).sum(1) / np.sqrt(va * vb), np.nan)
                    n = there.sum(1)
                    w = np.where(there, w, 0.0)
                    sl = np.sqrt((np.where(there, w - w.sum(1, keepdims=True) / n[:, None], 0.0) ** 2).sum(1) / np.where(n > 1, n - 1, np.nan))
                ok = np.flatnonzero((n >= least_n) & ~np.isnan(corr))
                r = pd.DataFrame({"cid": cid, "leader": names[ok], "corr": corr[ok], "sl": sl[ok], "sc": np.nanstd(y, ddof=1) if (~np.isnan(y)).sum() > 1 else np.nan})
                out.append(r.assign(o=-r["corr"].abs().round(12)).sort_values(["o", "leader"]).head(topk).drop(columns="o"))
        return pd.concat([o for o in out if len(o)] or out)

    return left.unionByName(right).groupBy("b", "d").applyInPandas(product, "cid string, leader string, corr double, sl double, sc double")


def lagged_blocked(window: DataFrame, lags: list[int], *, first: int, width: int, least: float, block: int = 256) -> DataFrame:
    """As :func:`lagged` over ``width`` sessions from ``first`` on, for correlations of ``least`` and more, by products of blocks."""

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f, width)
        m = ~np.isnan(x)
        z, m = np.where(m, x, 0.0), m.astype(float)
        names, own = f["symbol"].to_numpy(), f["own"].to_numpy()
        lo, hi = f["lo"].iat[0], f["hi"].iat[0]
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out = []
        for lag in lags:
            for a, b in ((p, q), (q, p))[: 1 if lo == hi else 2]:
                with np.errstate(all="ignore"):
                    c = z[a, : width - lag] @ z[b, lag:].T / (m[a, : width - lag] @ m[b, lag:].T)
                i, j = np.nonzero(np.abs(c) >= least)
                other = a[i] != b[j]
                i, j = i[other], j[other]
                out.append(pd.DataFrame({"lag": lag, "x": names[a[i]], "y": names[b[j]], "corr": c[i, j]}))
        return pd.concat(out)

    cells = _cells(window.select("symbol", "i", F.col("z").alias("v")), first, block)
    return cells.groupBy("lo", "hi").applyInPandas(product, "lag int, x string, y string, corr double")


def lagged_pearson(window: DataFrame, lags: list[int], *, first: int, width: int, top: int, min_n: int = 0, upto: int | None = None, block: int = 128) -> DataFrame:
    """(lag, x, y, c, n): the ``top`` correlations of x with y ``lag`` sessions later at each lag, by size, x and y.

    Pearson's over the n sessions of ``window`` (symbol, i, r) in which both have returns, to 9 digits; pairs of
    fewer than ``min_n`` are left out, those without a correlation come last. With
    ``upto`` only the sessions before it tell the correlation, and the others that a pair is there at all. Each product of blocks gives its own
    ``top``, of which the overall ones are part.
    """

    def product(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f, width)
        there = np.zeros(x.shape)
        for row, k in enumerate(f["k"]):
            there[row, np.asarray(k, int)] = 1.0
        x = x[:, :upto]
        told = x.shape[1]
        m = ~np.isnan(x)
        n = np.maximum(m.sum(axis=1, keepdims=True), 1)
        z = np.where(m, x - np.where(m, x, 0.0).sum(axis=1, keepdims=True) / n, 0.0)
        m = m.astype(float)
        names, own = f["symbol"].to_numpy(), f["own"].to_numpy()
        lo, hi = f["lo"].iat[0], f["hi"].iat[0]
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out = []
        for lag in lags:
            for a, b in ((p, q), (q, p))[: 1 if lo == hi else 2]:
                za, ma, zb, mb = z[a, : max(told - lag, 0)], m[a, : max(told - lag, 0)], z[b, lag:], m[b, lag:]
                with np.errstate(all="ignore"):
                    n = ma @ mb.T
                    sa, sb, qa, qb = za @ mb.T, ma @ zb.T, (za * za) @ mb.T, ma @ (zb * zb).T
                    va, vb = qa - sa * sa / n, qb - sb * sb / n
                    c = np.where((va > 1e-12 * qa) & (vb > 1e-12 * qb), (za @ zb.T - sa * sb / n) / np.sqrt(va * vb), np.nan)
                i, j = np.nonzero((there[a, : max(width - lag, 0)] @ there[b, lag:].T > 0) & (n >= min_n))
                other = a[i] != b[j]
                i, j = i[other], j[other]
                r = pd.DataFrame({"lag": lag, "x": names[a[i]], "y": names[b[j]], "c": np.round(c[i, j], 9), "n": n[i, j].astype(int)})
                out.append(r.assign(s=-r["c"].abs()).sort_values(["s", "x", "y"]).head(top).drop(columns="s"))
        return pd.concat(out)

    cells = _cells(window.select("symbol", "i", F.coalesce("r", F.lit(float("nan"))).alias("v")), first, block)
    some = cells.groupBy("lo", "hi").applyInPandas(product, "lag int, x string, y string, c double, n long").withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    k = F.row_number().over(Window.partitionBy("lag").orderBy(F.abs("c").desc_nulls_last(), "x", "y"))
    return some.withColumn("k", k).where(F.col("k") <= top).drop("k")


def lagged(window: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, x, y, corr): correlation of x with y ``lag`` sessions later, over standardised values z (0 where missing) of ``window`` (symbol, i, z)."""
    y = window.select(F.col("symbol").alias("y"), F.col("i").alias("j"), F.col("z").alias("zy"))
    x = window.select(F.col("symbol").alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), (F.col("i") + F.col("lag")).alias("j"), F.col("z").alias("zx"))
    out = x.join(y, "j").where("x <> y").groupBy("lag", "x", "y")
    return out.agg((F.sum(F.col("zx") * F.col("zy")) / F.count(F.lit(1))).alias("corr"))
