"""One surviving record for each group of duplicates.

A *bundle* is a field, or several that only make sense together, taken whole
from one row. Each bundle has its own order of preference; a *rule* says that
one bundle's value determines another's. Choosing the best row of each bundle
by itself may join values that never belonged together, so the choice is a
search: branch and bound over whole bundles, maximising the sum of their
scores, bounded by the best that the bundles not yet chosen could still add.

While it goes down, the search propagates: what a choice demands fixes the
bundle it is demanded of, and leaves others only the candidates that demand the
same or nothing, found by index. The bound counts only what is still allowed.

Groups may be of any size. Candidates are combined map-side, first by value,
then by what they demand: of candidates that demand the same, and of which
nothing is demanded, only the best can be in the best choice. A group is cut to
a short list of each bundle's best of those before it reaches one task, and the
search tells whether anything outside the short list could still win. Groups
for which it could are searched again with longer lists until the result is
proven, so nothing is lost to the cut. Without rules, dominance leaves one
candidate a bundle and the search has nothing to choose.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.durable import durable

#: Stands for a null among the integer keys of an order: after everything else.
_LAST = -(2**63)


@dataclass(frozen=True)
class Bundle:
    """A whole choice: rows for which ``usable`` holds, by ``score`` (above 0), then by ``order``, all descending.

    ``value`` is what rules compare and what comes out; left out, the bundle
    takes part in no rule and only the row's id comes out. Orders are integers.
    """

    name: str
    usable: Column
    score: Column
    order: Sequence[Column] = field(default_factory=tuple)
    value: Column | None = None
    weight: float = 1.0


def branch_and_bound(lists: Sequence[Sequence[dict]], rules: Sequence[tuple[int, int]], weights: Sequence[float]) -> tuple[list[dict | None], float, bool]:
    """(choice per bundle, total, whether it is the unconstrained best).

    ``lists`` holds each bundle's candidates, best first, with ``score``,
    ``value`` and ``need`` (per rule: the value that this one demands). Choosing
    none is allowed at score 0 and demands nothing; where something is demanded,
    none doesn't satisfy it. Of equal totals the earlier bundles' better
    candidates win.
    """
    n = len(lists)
    rank = [{v: k for k, v in reversed([(k, c["value"]) for k, c in enumerate(own)])} for own in lists]
    #: By rule and demanded value: the ranks of the candidates that demand it.
    asking: list[dict] = []
    for r, (d, _) in enumerate(rules):
        by_need: dict = {}
        for k, c in enumerate(lists[d]):
            by_need.setdefault(c["need"][r], []).append(k)
        asking.append(by_need)
    best: list = [-1.0, [None] * n]
    chosen: list[dict | None] = [None] * n
    #: Value that a bundle has or must have; a chosen none is fixed to None.
    fixed: dict[int, str | None] = {}
    must = [0] * n

    def allowed(b: int) -> Iterator[int]:
        """Ranks that bundle ``b`` may still have, best first."""
        if must[b]:
            k = rank[b].get(fixed[b])
            ways: Iterator[int] = iter(() if k is None else (k,))
        else:
            own = [r for r, (d, y) in enumerate(rules) if d == b and y in fixed]
            if not own:
                return iter(range(len(lists[b])))
            few = min(own, key=lambda r: len(asking[r].get(fixed[rules[r][1]], ())) + len(asking[r].get(None, ())))
            same = asking[few].get(fixed[rules[few][1]], []) if fixed[rules[few][1]] is not None else []
            ways = heapq.merge(same, asking[few].get(None, []))
        return (k for k in ways if all(lists[b][k]["need"][r] is None or lists[b][k]["need"][r] == fixed[y] for r, (d, y) in enumerate(rules) if d == b and y in fixed))

    def rest(b: int) -> float | None:
        """The most that bundles from ``b`` on can still add; None if one of them can't be what it must be."""
        total = 0.0
        for x in range(b, n):
            k = next(allowed(x), None)
            if k is None and must[x]:
                return None
            total += weights[x] * lists[x][k]["score"] if k is not None else 0.0
        return total

    def fits(b: int, c: dict | None) -> bool:
        """Whether what earlier bundles demand, and what ``c`` demands of them, holds."""
        return c is None or all(need is None or y > b or y not in fixed or fixed[y] == need for need, (d, y) in zip(c["need"], rules) if d == b)

    def take(b: int, c: dict | None, total: float) -> None:
        if not fits(b, c):
            return
        chosen[b] = c
        before = fixed.get(b), b in fixed
        fixed[b] = c["value"] if c else None
        set_, ok = [], True
        for r, (d, y) in enumerate(rules):
            if d == b and c is not None and (need := c["need"][r]) is not None and y > b:
                if y in fixed:
                    ok = ok and fixed[y] == need
                else:
                    fixed[y], must[y] = need, 1
                    set_.append(y)
        if ok:
            go(b + 1, total + (weights[b] * c["score"] if c else 0.0))
        for y in set_:
            del fixed[y]
            must[y] = 0
        if before[1]:
            fixed[b] = before[0]
        else:
            del fixed[b]
        chosen[b] = None

    def go(b: int, total: float) -> None:
        more = rest(b)
        if more is None or total + more <= best[0]:
            return
        if b == n:
            best[:] = [total, list(chosen)]
            return
        after = rest(b + 1)  # choosing only takes away from it
        if after is None:
            return
        for k in list(allowed(b)):
            if total + weights[b] * lists[b][k]["score"] + after <= best[0]:
                break  # those behind it score no more
            take(b, lists[b][k], total)
        if not must[b] and total + after > best[0]:
            take(b, None, total)

    go(0, 0.0)
    root = all((not own and c is None) or (own and c is own[0]) for own, c in zip(lists, best[1]))
    return best[1], best[0], root


def _dominant(cands: DataFrame, rules: Sequence[tuple[int, int]]) -> DataFrame:
    """``cands`` without those that demand the same as a better one of their bundle, where nothing is demanded of the bundle."""
    asked = F.col("b").isin(*{y for _, y in rules}) if rules else F.lit(False)
    needs = [F.col(f"need{r}") for r in range(len(rules))]
    key = [F.when(asked, F.coalesce("value", F.col("o.id").cast("string"))).alias("v"), *[c.value.alias(f"n{r}") for r, c in enumerate(needs)]]
    return cands.groupBy("g", "b", *key).agg(F.max(F.struct("o", "value", *needs)).alias("x")).select("g", "b", "x.*")


def _candidates(df: DataFrame, keys: Sequence[str], row_id: str, bundles: Sequence[Bundle], rules: Sequence[tuple[int, int]]) -> DataFrame:
    """(g, b, o, value, need0...): one row per group, bundle and value, with its best order and what it demands."""
    order = [
        F.struct(
            b.score.cast("double").alias("score"),
            F.array(*[F.coalesce(c.cast("long"), F.lit(_LAST)) for c in (*b.order, F.col(row_id))]).alias("keys"),
            F.col(row_id).cast("long").alias("id"),
        )
        for b in bundles
    ]
    value = [F.lit(None).cast("string") if b.value is None else b.value.cast("string") for b in bundles]
    rows = df.select(
        F.struct(*keys).alias("g"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("b"),
                    F.coalesce(b.usable, F.lit(False)).alias("ok"),
                    order[i].alias("o"),
                    value[i].alias("value"),
                    *[
                        (F.when(F.coalesce(bundles[y].usable, F.lit(False)), F.struct(order[y].alias("o"), value[y].alias("value"))) if d == i else F.lit(None).cast(f"struct<o:{_ORDER},value:string>")).alias(f"need{r}")
                        for r, (d, y) in enumerate(rules)
                    ],
                )
                for i, b in enumerate(bundles)
            ]
        ).alias("c"),
    )
    rows = rows.select("g", F.explode("c").alias("c")).where("c.ok").select("g", "c.*").drop("ok")
    if not rules:  # every row is a candidate; there is nothing to combine
        return rows
    return rows.groupBy("g", "b", F.coalesce("value", F.col("o.id").cast("string")).alias("v")).agg(
        F.max("o").alias("o"), F.first("value").alias("value"), *[F.max(f"need{r}").alias(f"need{r}") for r in range(len(rules))]
    ).drop("v")


_ORDER = "struct<score:double,keys:array<bigint>,id:bigint>"


def _search(shortlists: DataFrame, n: int, rules: Sequence[tuple[int, int]], weights: Sequence[float]) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, totals, proven = [], [], [], []
            for cands, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lists: list[list[dict]] = [[] for _ in range(n)]
                for c in sorted(cands or [], key=lambda c: c["rank"]):
                    lists[c["b"]].append(c)
                choice, total, root = branch_and_bound(lists, rules, weights)
                tops = [w * own[0]["score"] if own else 0.0 for own, w in zip(lists, weights)]
                outside = max((sum(tops) - tops[b] + weights[b] * lists[b][-1]["score"] for b in set(more or [])), default=-1.0)
                ids.append([c["id"] if c else None for c in choice])
                values.append([c["value"] if c else None for c in choice])
                totals.append(total)
                proven.append(root or total > outside)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.string())), pa.array(totals, pa.float64()), pa.array(proven, pa.bool_())],
                ["g", "ids", "vals", "total", "proven"],
            )

    g = shortlists.schema["g"].dataType.simpleString()
    return shortlists.mapInArrow(solve, f"g {g}, ids array<bigint>, vals array<string>, total double, proven boolean")


def survivors(
    df: DataFrame, keys: Sequence[str], row_id: str, bundles: Sequence[Bundle], *, rules: Sequence[tuple[str, str]] = (), min_rows: int = 1, shortlist: int = 4
) -> DataFrame:
    """One record per group of at least ``min_rows`` rows: keys, ``<bundle>_id``, ``<bundle>`` for bundles with a value, and ``total``.

    A rule (d, y) holds for a choice if the chosen value of y is the one that
    the best row for y among the group's rows with the chosen value of d has;
    where no such row has a usable y, anything goes. ``rules`` without conflict
    leave each bundle's best row chosen.

    Defined cases: rows with a null key are left out; a bundle for which no row
    is usable has the id 0 and a null value; nulls in an order come last; the
    row id breaks ties, and repeated rows count as rows but choose alike; an
    empty table gives no rows; columns not named are ignored, whatever their names.
    """
    names = [b.name for b in bundles]
    pairs = [(names.index(d), names.index(y)) for d, y in rules]
    if any(bundles[i].value is None for p in pairs for i in p):
        raise ValueError("bundles in rules need a value")
    df = df.dropna(subset=list(keys))
    sizes = df.groupBy(F.struct(*keys).alias("g")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_rows)
    weights = [b.weight for b in bundles]
    cands = _dominant(_candidates(df, keys, row_id, bundles, pairs), pairs)
    if pairs:
        cands = durable(cands)  # groups may be searched several times

    def solve(groups: DataFrame, cands: DataFrame, m: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("g", "b").orderBy(F.col("o").desc()))
        top = cands.withColumn("rank", rank).where(F.col("rank") <= m + 1)
        cand = F.struct("b", "rank", F.col("o.score").alias("score"), F.col("o.id").alias("id"), "value", F.array(*[F.col(f"need{r}.value") for r in range(len(pairs))]).cast("array<string>").alias("need"))
        packed = top.groupBy("g").agg(
            F.collect_list(F.when(F.col("rank") <= m, cand)).alias("c"), F.collect_list(F.when(F.col("rank") > m, F.col("b"))).alias("more")
        )
        return _search(groups.join(packed, "g", "left").select("g", "c", "more"), len(bundles), pairs, weights)

    out = solve(sizes.select("g"), cands, shortlist)
    if pairs:
        done, m = None, shortlist
        while True:
            out = durable(out)
            proven = out.where("proven")
            done = proven if done is None else done.unionByName(proven)
            open_ = out.where("NOT proven").select("g")
            if open_.isEmpty():
                break
            m *= 8
            out = solve(open_, cands.join(open_, "g", "left_semi"), m)
        out = done
    return out.select(
        "g.*",
        *[F.coalesce(F.col("ids")[i], F.lit(0)).alias(f"{b.name}_id") for i, b in enumerate(bundles)],
        *[F.col("vals")[i].alias(b.name) for i, b in enumerate(bundles) if b.value is not None],
        "total",
    )
