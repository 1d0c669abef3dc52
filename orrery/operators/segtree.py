"""Rolling totals over trailing periods from segment trees.

Each entity's calendar is cut into shards. A shard's days, and before them a
halo as long as the longest period, are the leaves of one segment tree, held as
two arrays (sums and counts) in heap order: the parent of node i is i // 2.
With the halo every trailing period of a shard's days lies within its own tree,
so shards answer alone. A period is the sum of O(log n) nodes; a correction of
one day touches that leaf's ancestors only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE_SCHEMA = "k string, shard int, lo int, hi int, sums array<double>, counts array<int>"


def _size(windows: Sequence[int]) -> tuple[int, int]:
    """(leaves of a tree, halo) for the given periods."""
    if not windows or min(windows) < 1:
        raise ValueError("periods are one day or longer")
    halo = max(windows) - 1
    return max(256, 1 << (8 * max(windows) - 1).bit_length()), halo


def _rollup(t: np.ndarray) -> None:
    """Fill the inner nodes of heap-ordered trees, one tree a row."""
    n = t.shape[1] // 2
    while n > 1:
        t[:, n // 2 : n] = t[:, n : 2 * n : 2] + t[:, n + 1 : 2 * n : 2]
        n //= 2


def range_sums(t: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over the leaves [left, right) of every tree, each from O(log n) nodes."""
    n = t.shape[1] // 2
    out = np.zeros((t.shape[0], len(left)), t.dtype)
    lo, hi = left + n, right + n
    while (open_ := lo < hi).any():
        at = np.flatnonzero(open_ & (lo & 1 == 1))
        out[:, at] += t[:, lo[at]]
        lo = np.where(open_ & (lo & 1 == 1), lo + 1, lo)
        at = np.flatnonzero(open_ & (hi & 1 == 1))
        out[:, at] += t[:, hi[at] - 1]
        lo, hi = lo >> 1, hi >> 1
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _ragged(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column; null lists have none."""
    lengths = np.asarray(col.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(col)), lengths), col.flatten()


def leaves_of(df: DataFrame, *, key: Column, day: Column, value: Column, latest: Column) -> DataFrame:
    """(k, d, v): one leaf per key and day, from the row with the largest ``latest``.

    Combines map-side. Of rows with one ``latest`` the largest value wins; rows
    with a null key or day are left out; a null value stays, as a day without one.
    """
    return (
        df.select(key.cast("string").alias("k"), F.unix_date(day).alias("d"), F.struct(latest.alias("o"), value.cast("double").alias("v")).alias("x"))
        .where(F.col("k").isNotNull() & F.col("d").isNotNull())
        .groupBy("k", "d")
        .agg(F.max("x").alias("x"))
        .select("k", "d", "x.v")
    )


def _shards(own: Column, span: int, halo: int) -> Column:
    """The shards that need the day ``d``: its own, and the next if it lies in that one's halo."""
    return F.when(F.col("d") - own * span >= span - halo, F.array(own, own + 1)).otherwise(F.array(own))


def _packed(leaves: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(k, shard, lo, hi, off, v): the leaves of each shard between a key's first and last day."""
    size, halo = _size(windows)
    span = size - halo
    own = F.floor(F.col("d") / span).cast("int")
    placed = leaves.select("k", "d", "v", F.explode(_shards(own, span, halo)).alias("shard"))
    mine = F.floor(F.col("d") / span).cast("int") == F.col("shard")
    packed = placed.groupBy("k", "shard").agg(
        F.collect_list(F.when(F.col("v").isNotNull(), F.struct((F.col("d") - F.col("shard") * span + halo).alias("off"), F.col("v")))).alias("x"),
        F.min(F.when(mine, F.col("d"))).alias("lo"),
        F.max(F.when(mine, F.col("d"))).alias("hi"),
    )
    bounds = packed.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shard = lambda c: F.floor(F.col(c) / span).cast("int")
    grid = bounds.select("k", "lo", "hi", F.explode(F.sequence(shard("lo"), shard("hi"))).alias("shard"))
    return grid.join(packed.drop("lo", "hi"), ["k", "shard"], "left").select(
        "k", "shard", "lo", "hi", F.col("x.off").alias("off"), F.col("x.v").alias("v")
    )


def _builder(windows: Sequence[int]):
    size, _ = _size(windows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                c = b.slice(s, 512)
                sums, counts = np.zeros((c.num_rows, 2 * size)), np.zeros((c.num_rows, 2 * size), np.int32)
                row, off = _ragged(c.column(4))
                leaf = size + np.asarray(off)
                sums[row, leaf], counts[row, leaf] = np.asarray(_ragged(c.column(5))[1]), 1
                _rollup(sums)
                _rollup(counts)
                yield pa.RecordBatch.from_arrays(
                    [*[c.column(i) for i in range(4)], _lists(sums, pa.float64()), _lists(counts, pa.int32())],
                    ["k", "shard", "lo", "hi", "sums", "counts"],
                )

    return build


def build_trees(leaves: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Segment trees of ``leaves`` (k, d, v), one row per key and shard between its first and last day.

    ``lo`` and ``hi`` are the key's first and last day. Shards without a leaf
    have a tree of zeros, so that every calendar day can be answered.
    """
    return _packed(leaves, windows).mapInArrow(_builder(windows), TREE_SCHEMA)


def correct_trees(trees: DataFrame, corrections: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Apply late values (k, d, v) to ``trees``; only the ancestors of changed leaves change.

    A null value takes the day's value away; of several for one key and day the
    largest counts, nulls last. Days before the first or after the last of a key
    extend its calendar: shards that it lacked are added, their halo filled from
    the last tree before them. Keys without trees get theirs.
    """
    size, halo = _size(windows)
    span = size - halo
    shard = lambda c: F.floor(F.col(c) / span).cast("int")
    given = corrections.where("k IS NOT NULL AND d IS NOT NULL").select("k", F.col("d").cast("int").alias("d"), F.col("v").cast("double").alias("v"))
    ends = lambda df, lo, hi: df.groupBy("k").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    bounds = ends(ends(trees, "lo", "hi").unionByName(ends(given, "d", "d")), "lo", "hi")
    grid = bounds.select("k", "lo", "hi", F.explode(F.sequence(shard("lo"), shard("hi"))).alias("shard"))
    leaf = lambda v, rank: F.struct(F.lit(rank).alias("rank"), v.isNotNull().cast("int").alias("n"), F.coalesce(v, F.lit(0.0)).alias("v"))
    late = given.select("k", F.explode(_shards(shard("d"), span, halo)).alias("shard"), "d", "v").select("k", "shard", (F.col("d") - F.col("shard") * span + halo).alias("off"), leaf(F.col("v"), 1).alias("x"))
    if halo:
        last = trees.where(F.col("shard") == shard("hi")).join(given.select("k").distinct(), "k", "left_semi")
        tail = F.arrays_zip(F.slice("sums", 2 * size - halo + 1, halo).alias("v"), F.slice("counts", 2 * size - halo + 1, halo).alias("n"))
        tail = last.select("k", (F.col("shard") + 1).alias("shard"), F.posexplode(tail).alias("off", "t")).where("t.n > 0")
        late = late.unionByName(tail.select("k", "shard", "off", leaf(F.col("t.v"), 0).alias("x")))
    # A tree that is there has its halo already; the tail of the one before it names shards that aren't.
    late = late.groupBy("k", "shard", "off").agg(F.max("x").alias("x")).groupBy("k", "shard").agg(F.collect_list(F.struct("off", "x.v", "x.n")).alias("c"))
    rows = grid.join(trees.select("k", "shard", "sums", "counts"), ["k", "shard"], "left").join(late, ["k", "shard"], "left")
    rows = rows.select("k", "shard", "lo", "hi", "sums", "counts", F.col("c.off").alias("off"), F.col("c.v").alias("v"), F.col("c.n").alias("n"))

    def trees_of(col: pa.Array, kind: type) -> np.ndarray:
        out = np.zeros((len(col), 2 * size), kind)
        there = np.flatnonzero(np.asarray(col.is_valid()))
        out[there] = np.asarray(col.flatten()).reshape(-1, 2 * size)
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                b = batch.slice(s, 512)
                sums, counts = trees_of(b.column(4), np.float64), trees_of(b.column(5), np.int32)
                row, off = _ragged(b.column(6))
                node = np.asarray(off).astype(np.int64) + size if len(off) else np.zeros(0, np.int64)
                dv = np.asarray(_ragged(b.column(7))[1]) - sums[row, node] if len(off) else np.zeros(0)
                dn = np.asarray(_ragged(b.column(8))[1]) - counts[row, node] if len(off) else np.zeros(0, np.int32)
                while len(node) and node[0] >= 1:
                    np.add.at(sums, (row, node), dv)
                    np.add.at(counts, (row, node), dn)
                    node = node >> 1
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i) for i in range(4)], _lists(sums, pa.float64()), _lists(counts, pa.int32())],
                    ["k", "shard", "lo", "hi", "sums", "counts"],
                )

    return rows.mapInArrow(apply, TREE_SCHEMA)


def _answer_schema(windows: Sequence[int]) -> str:
    return "k string, day date" + "".join(f", sum_{w} double, count_{w} int, avg_{w} double" for w in windows)


def _asker(windows: Sequence[int]):
    size, halo = _size(windows)
    span = size - halo

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = np.arange(halo, size)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                c = b.slice(s, 512)
                shard, lo, hi = (np.asarray(c.column(i)).astype(np.int64) for i in (1, 2, 3))
                sums = np.asarray(c.column(4).flatten()).reshape(-1, 2 * size)
                counts = np.asarray(c.column(5).flatten()).reshape(-1, 2 * size)
                day = shard[:, None] * span + (pos - halo)
                row, col = np.nonzero((day >= lo[:, None]) & (day <= hi[:, None]))
                out = [c.column(0).take(pa.array(row)), pa.array(day[row, col].astype(np.int32), pa.int32()).cast(pa.date32())]
                for w in windows:
                    total, n = (range_sums(t, pos - w + 1, pos + 1)[row, col] for t in (sums, counts))
                    out += [pa.array(np.where(n > 0, total, 0.0)), pa.array(n, pa.int32()), pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)]
                yield pa.RecordBatch.from_arrays(out, ["k", "day", *[f"{a}_{w}" for w in windows for a in ("sum", "count", "avg")]])

    return ask


def trailing(trees: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(k, day, sum_w, count_w, avg_w ...) for every calendar day of each key and each period w.

    A period of w days ends on the day itself. Where it has no value its sum
    and count are 0 and its average is null.
    """
    return trees.mapInArrow(_asker(windows), _answer_schema(windows))


def rolling(df: DataFrame, *, key: Column, day: Column, value: Column, latest: Column, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals, counts and averages over trailing periods for every key and calendar day.

    The days run from a key's first to its last row, days without a row
    included. See :func:`leaves_of` for repeated days, nulls and ties, and
    :func:`trailing` for the result. An empty table gives no rows; other columns
    are ignored whatever their names.
    """
    build, ask = _builder(windows), _asker(windows)
    packed = _packed(leaves_of(df, key=key, day=day, value=value, latest=latest), windows)
    return packed.mapInArrow(lambda batches: ask(build(batches)), _answer_schema(windows))
