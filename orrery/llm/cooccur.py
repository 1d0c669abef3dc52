"""How often items occur together, and how far that exceeds chance.

Baskets up to one block of items give their pairs where they are. Larger ones
are cut into chunks of about a block each, and every pair of chunks becomes a
task of its own, so that a basket's quadratic work spreads over the cluster and
no task holds more of a basket than two chunks. Both kinds of pairs are counted
map-side before anything is shuffled by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A basket with more distinct items doesn't go through one task of a join by basket.
HOT_ITEMS = 1_000_000
#: As many baskets may be broadcast by their keys; they can't be more than all rows by ``HOT_ITEMS``.
_MAX_BROADCAST = 100_000


def _tags(df: DataFrame, basket: Column, item: Column, max_basket: int | None) -> tuple[DataFrame, DataFrame]:
    """(b, i, n): each item of a basket once, with the basket's size; and (b, n).

    Rows of hot baskets find their size by broadcast. Beyond what may be
    broadcast they are joined like the others, and Spark splits that join's hot
    partitions.
    """
    named = df.select(basket.alias("b"), item.alias("i")).where(F.col("b").isNotNull() & F.col("i").isNotNull())
    most = named.count() // HOT_ITEMS  # hot baskets at most
    once = named.distinct()
    sizes = once.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes if max_basket is None else sizes.where(F.col("n") <= max_basket)
    if not 0 < most <= _MAX_BROADCAST:
        return once.join(wanted, "b"), wanted
    hot = sizes.where(F.col("n") > HOT_ITEMS)
    tags = once.join(F.broadcast(hot.select("b")), "b", "left_anti").join(wanted, "b")
    if max_basket is None or max_basket > HOT_ITEMS:
        tags = tags.unionByName(once.join(F.broadcast(hot if max_basket is None else hot.where(F.col("n") <= max_basket)), "b"))
    return tags, wanted


def _within(items: Column) -> Column:
    """All pairs of a sorted array, the smaller item first."""
    return F.flatten(
        F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("item_a"), y.alias("item_b"))))
    )


def _across(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b")))))


def cooccurrence(df: DataFrame, *, basket: Column, item: Column, max_basket: int | None = None, min_count: int = 1, block: int = 128) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi) for pairs item_a < item_b.

    Counts are of baskets: an item counts once in each. ``max_basket`` leaves
    out baskets with more distinct items, from pairs, item counts and the number
    of baskets alike. ``lift`` is n_ab * n_baskets / (n_a * n_b), ``pmi`` its
    natural logarithm.

    Defined cases: rows with a null basket or item are left out, repeated rows
    count once, baskets of one item count as baskets, an empty table gives no
    rows, other columns are ignored whatever their names.
    """
    tags, sizes = _tags(df, basket, item, max_basket)
    few = tags.where(F.col("n") <= block)
    # The work of a cell is the square of its size: cells are dealt out by number, not by bytes.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both sides lie by basket already, and no basket here has more than a block's items.
    pairs = few.select("b", F.col("i").alias("item_a")).join(few.select("b", F.col("i").alias("item_b")), "b").where("item_a < item_b").select("item_a", "item_b")
    if max_basket is None or max_basket > block:
        count = F.ceil(F.col("n") / block).cast("int")
        chunks = (
            tags.where(F.col("n") > block)
            .select("b", count.alias("c"), "i")
            .groupBy("b", "c", F.pmod(F.xxhash64("i", F.lit(17)), F.col("c")).cast("int").alias("chunk"))
            .agg(F.array_sort(F.collect_list("i")).alias("items"))
        )
        other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")
        cells = (
            chunks.select("b", "chunk", "items", other)
            .groupBy("b", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
            .agg(F.collect_list("items").alias("x"))
            .repartition(tasks, "b", "lo", "hi")
            .select(
                F.when(F.col("lo") == F.col("hi"), _within(F.col("x")[0])).when(F.size("x") == 2, _across(F.col("x")[0], F.get(F.col("x"), F.lit(1)))).alias("pairs")
            )
        )
        pairs = pairs.unionByName(cells.select(F.explode("pairs").alias("p")).select("p.*"))
    n_ab = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_count)
    each = tags.groupBy("i").agg(F.count(F.lit(1)).alias("n_i"))
    total = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = n_ab.join(each.select(F.col("i").alias("item_a"), F.col("n_i").alias("n_a")), "item_a")
    out = out.join(each.select(F.col("i").alias("item_b"), F.col("n_i").alias("n_b")), "item_b").withColumn("n_baskets", total)
    lift = F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log(lift).alias("pmi"))
