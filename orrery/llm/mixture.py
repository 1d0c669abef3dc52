"""Mixing sources to target weights.

Every record draws an exponential key at the rate of its quality weight
(Efraimidis and Spirakis): in ascending order of the keys, any prefix of a
source is a weighted sample without replacement. A source's budget is its share
of the total; the complete passes over the source that fit into it are taken
whole, up to the cap, and the fraction that remains is the longest prefix of the
order whose sizes fit.

The prefix sums need no source in one task. A record's place is an integer that
grows with its key, evenly in the key's logarithm, so that keys of any size have
places of their own. It is read digit by digit: sizes are summed map-side by
source and digit, a running sum over the few digits of a source tells the one in
which the budget ends, and only records in that digit count at the next. What
shares all digits is summed by key and the last sum ends at one record: the
source's cut. All records are then marked in one pass against the cuts, one row
a target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.durable import durable

#: Digits of a place, and the bits of each: about a billionth of the range of keys is left to sort.
_LEVELS, _BITS = 3, 10
#: A target list is configuration; a longer one is refused, so that what is broadcast stays small.
MAX_TARGETS = 100_000


def exponential_key(record: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight for a u in (0, 1) that ``record`` and ``seed`` fix; for weights of 0 and below, and null ones, -ln(u)."""
    u = (F.shiftrightunsigned(F.xxhash64(record, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / F.when(weight > 0, weight).otherwise(1.0)


def _place(late: Column, key: Column) -> Column:
    """An integer of all digits that never falls as (late, key) rises; the logarithm of a positive double lies within 1,100 of 0."""
    half = 1 << (_LEVELS * _BITS - 1)
    within = (F.log2(F.greatest(key, F.lit(5e-324))) + 1100) / 2200
    return (late.cast("long") * half + F.least(F.floor(within * half).cast("long"), F.lit(half - 1))).cast("long")


def _cuts(rows: DataFrame, open_: list[tuple[str, int]]) -> list[tuple]:
    """(src, place, key, id) of the last record in each source's longest prefix by (place, key, id) whose sizes fit into what is left.

    ``open_`` has (source, size left). Places behind ``place`` are out, before
    it in, and at it those up to (key, id); a null key and id take none of them.
    Records with equal keys and ids are taken in one piece or not at all.
    """
    spark = rows.sparkSession
    at = {src: (0, left) for src, left in open_}
    small = lambda: F.broadcast(spark.createDataFrame([(s, prefix, left) for s, (prefix, left) in at.items()], "src string, prefix long, left long"))
    whole: list[tuple] = []
    for level in range(_LEVELS):
        if not at:
            return whole
        below = (_LEVELS - level - 1) * _BITS
        inside = rows.join(small(), "src").where(F.shiftright("place", below + _BITS) == F.col("prefix"))
        sums = inside.groupBy("src", "left", F.shiftright("place", below).alias("digit")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("src").orderBy("digit"))
        over = sums.withColumn("upto", upto).where("upto > left").groupBy("src").agg(F.min(F.struct("digit", (F.col("left") - F.col("upto") + F.col("s")).alias("left"))).alias("m"))
        ends = {r.src: (r.m.digit, r.m.left) for r in over.collect()}  # at most one row a target
        whole += [(s, 1 << (_LEVELS * _BITS), None, None) for s in at if s not in ends]
        at = ends
    if not at:
        return whole
    # Sums by (key, id), so that repeats of one record are one row here.
    same = rows.join(small(), "src").where(F.col("place") == F.col("prefix")).groupBy("src", "left", "key", "id").agg(F.sum("size").alias("s"))
    fits = same.withColumn("upto", F.sum("s").over(Window.partitionBy("src").orderBy("key", "id"))).where("upto <= left")
    last = {r.src: r.m for r in fits.groupBy("src").agg(F.max(F.struct("key", "id")).alias("m")).collect()}
    return whole + [(s, prefix, last[s].key if s in last else None, last[s].id if s in last else None) for s, (prefix, _) in at.items()]


def allocate(totals: dict[str, int], corpus: int, targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int]]:
    """(complete passes, size of the rest) of each source with records.

    A source's budget is its share of ``corpus``, rounded down; a source that
    would need more than its cap of passes gives the capped number and falls
    short: the others don't make up for it, as that would move them off their shares.
    """
    out = {}
    for src, (share, cap) in targets.items():
        if (size := totals.get(src, 0)) > 0:
            budget = int(share * corpus + 1e-6)
            passes = min(budget // size, cap)
            out[src] = (passes, 0 if passes == cap else budget - passes * size)
    return out


def mixture(records: DataFrame, targets: DataFrame, *, seed: int = 0) -> DataFrame:
    """(src, id, size, copies): the records in the mix and how often each is repeated; see :func:`mixture_of`."""
    return mixture_of(records, targets, seed=seed)[0]


def mixture_of(records: DataFrame, targets: DataFrame, *, seed: int = 0) -> tuple[DataFrame, int, list[str]]:
    """(src, id, size, copies): the records in the mix and how often each is repeated; the size of all records; the sources that reach their cap.

    ``records`` has src, id, size and weight, ``targets`` src, share and cap.
    The mix is to be as large as all of ``records``, sources without a target
    included.

    Defined cases: records with a null id or source are left out of the mix, a
    null size is 0, records of weight 0, below or null come after all others in an
    order of their own, as at a weight of 1; of
    repeated targets the largest share counts, null shares and caps are 0; a
    source without records gives none; empty tables give no rows. Other columns
    are ignored whatever their names.
    """
    late = F.coalesce(F.col("weight") > 0, F.lit(False)) == F.lit(False)
    key = exponential_key(F.col("id"), F.col("weight"), seed)
    sized = records.select("src", "id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("weight").cast("double").alias("weight"))
    rows = durable(sized.select("src", "id", "size", key.alias("key"), _place(late, key).alias("place")))
    spark = rows.sparkSession
    listed = targets.where("src IS NOT NULL").groupBy("src").agg(F.max(F.struct("share", "cap")).alias("t")).select("src", "t.share", "t.cap").limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = {r.src: (max(0.0, r.share or 0.0), max(0, r.cap or 0)) for r in listed}
    names = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "name string"))
    # Sources without a target count into the total only: they are one row here, however many there are.
    by_src = rows.join(names, F.col("src") == F.col("name"), "left").groupBy("name").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("id").isNotNull(), F.col("size"))).alias("size")).collect()
    corpus = sum(r["all"] for r in by_src)
    plan = allocate({r.name: r.size or 0 for r in by_src if r.name is not None}, corpus, wanted)
    usable = rows.where("id IS NOT NULL")
    cuts = {s: c for s, *c in _cuts(usable, [(s, left) for s, (_, left) in plan.items() if left > 0])}
    marks = spark.createDataFrame([(s, n, *cuts.get(s, (-1, None, None))) for s, (n, _) in plan.items()], f"src string, copies long, cut long, last double, last_id {rows.schema['id'].dataType.simpleString()}")
    upto = F.struct(F.col("key"), F.col("id")) <= F.struct(F.col("last").alias("key"), F.col("last_id").alias("id"))
    extra = (F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & F.col("last").isNotNull() & upto)
    return usable.join(F.broadcast(marks), "src").select("src", "id", "size", (F.col("copies") + extra.cast("int")).alias("copies")).where("copies > 0"), corpus, [s for s, (n, _) in plan.items() if n >= wanted[s][1]]


def shares(mix: DataFrame, targets: DataFrame, corpus: int, capped: Sequence[str] = ()) -> DataFrame:
    """(src, target_share, actual_share, share_of_total, size, records, max_copies, short) for every target, by what ``mix`` holds.

    ``actual_share`` is of the mix, ``share_of_total`` of the ``corpus`` that the
    mix was to be as large as. ``short`` tells why a source has less than its
    target: no records, its cap, or that the next record wouldn't fit.
    """
    got = mix.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("max_copies"))
    total = got.agg(F.sum("size")).scalar()
    none = lambda c: F.coalesce(c, F.lit(0))
    lacks = none("size") < F.floor(F.col("share") * corpus + 1e-6)
    short = F.when(~lacks | F.col("share").isNull(), "").when(F.col("size").isNull(), "no records").when(F.col("src").isin(*capped), "cap").otherwise("next record")
    return targets.select("src", "share").join(got, "src", "left").select(
        "src", F.col("share").alias("target_share"), F.coalesce(F.try_divide(F.col("size"), total), F.lit(0.0)).alias("actual_share"), F.coalesce(F.try_divide(F.col("size"), F.lit(corpus)), F.lit(0.0)).alias("share_of_total"), none("size").alias("size"), none("records").alias("records"), none("max_copies").alias("max_copies"), short.alias("short")
    )
