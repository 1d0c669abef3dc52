"""Per-key results where a handful of keys hold most rows.

The input is taken in chunks of about ``chunk_rows`` rows: the partitions it has,
larger ones cut by a hash of the row, so that a chunk never changes when a task
runs again. Rows combine within their chunk where they lie (map-side), then the
states of ``fan_in`` neighbouring chunks merge per key, round after round, until
one state per key is left. How many rounds follows from the number of chunks. No
task receives more than ``fan_in`` states of a key per round, where a single
shuffle would send one reducer the states of every chunk, and a raw group-by of
values that do not combine would send it all the rows.

Only keys that hold much of a node climb the tree. A state of fewer than
``flat_rows`` rows goes to the last merge straight away: a key can't be hot with
it, and moving it through every round would shuffle the many small keys again
and again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each kind of state starts from rows, merges, and ends.
_KINDS = {
    "count": (lambda c: F.count(c), lambda s: F.sum(s), lambda s: s),
    "sum": (lambda c: F.sum(c), lambda s: F.sum(s), lambda s: s),
    "min": (lambda c: F.min(c), lambda s: F.min(s), lambda s: s),
    "max": (lambda c: F.max(c), lambda s: F.max(s), lambda s: s),
    "approx_distinct": (lambda c: F.hll_sketch_agg(c), lambda s: F.hll_union_agg(s), lambda s: F.hll_sketch_estimate(s)),
}


def rounds(chunks: int, fan_in: int) -> int:
    """How many merge rounds bring ``chunks`` states down to one."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    return max(1, math.ceil(math.log(max(chunks, 2), fan_in) - 1e-9))


def tree_aggregate(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], *, fan_in: int = 8, rows: int | None = None, chunk_rows: int = 16_384, flat_rows: int = 64, spread: Column | None = None
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through logarithmic fan-in.

    ``aggs`` maps an output name to (kind, column); kinds are count, sum, min,
    max and approx_distinct. ``rows`` is about how many rows to expect, counted
    if not given; more than expected only make the last round wider, never
    wrong. ``spread`` tells rows of one key apart, for cutting chunks; left out,
    it is all that is aggregated.

    Defined cases: null keys form a group of their own, null values count as in
    SQL, an empty table gives no rows, repeated rows count each time, other
    columns are ignored whatever their names.
    """
    for name, (kind, _) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"{name}: no aggregate {kind!r}")
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = max(1, -(-(df.count() if rows is None else rows) // chunk_rows))
    cuts = -(-chunks // partitions)  # of each partition
    k = [F.col(f"k{i}") for i in range(len(keys))]
    kinds = [_KINDS[kind] for kind, _ in aggs.values()]
    values = [c for _, c in aggs.values()]
    cut = F.pmod(F.xxhash64(spread if spread is not None else F.struct(*[F.col(c) for c in keys], *values)), F.lit(cuts))
    taken = df.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)],
        *[c.alias(f"v{i}") for i, c in enumerate(values)],
        F.floor((F.spark_partition_id() * cuts + cut) / fan_in).alias("node"),
    )
    start = [s(F.col(f"v{i}")).alias(f"s{i}") for i, (s, _, _) in enumerate(kinds)]
    merge = [m(F.col(f"s{i}")).alias(f"s{i}") for i, (_, m, _) in enumerate(kinds)]
    climbs = rounds(min(partitions, chunks) * cuts, fan_in) - 1
    if not climbs:
        state = taken.groupBy(*k).agg(*start)
    else:
        first = taken.groupBy(*k, "node").agg(*start, F.count(F.lit(1)).alias("n"))
        state = first.where(F.col("n") >= flat_rows).drop("n")
        for _ in range(climbs - 1):
            state = state.groupBy(*k, F.floor(F.col("node") / fan_in).alias("node")).agg(*merge)
        state = state.unionByName(first.where(F.col("n") < flat_rows).drop("n")).groupBy(*k).agg(*merge)
    return state.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)],
        *[f(F.col(f"s{i}")).alias(name) for i, (name, (_, _, f)) in enumerate(zip(aggs, kinds))],
    )
