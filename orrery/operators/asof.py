"""Attributes as known at event time.

A version of an entity's attributes has two clocks: ``valid_from`` (when it
applies) and ``known_at`` (when it was learned). It is usable at an instant
``t`` if ``known_at <= t`` and 00:00 UTC of ``valid_from`` is ``<= t``. Both
bounds only ever open, so a version *activates* once, at the later of the two,
and stays usable; the version in force at ``t`` is the running maximum of the
precedence ``(valid_from, known_at, tie-break)`` over the activations up to
``t``. A running maximum needs only its value at the start of a time slice to
go on alone, which is what makes splitting an entity by time exact:

1. a (key, day) histogram, combined map-side and written once, finds keys that
   hold more rows than a shard should and cuts their time axis into slices of
   about ``shard_rows`` rows; a single day too large for a shard is salted besides;
2. each slice gets the one preceding winner as carry-in, and the versions that
   activate within it (replicated to the salts, if any);
3. every (key, slice, salt) is merged on its own: one sort by time and one
   running maximum. No shard needs another, and a shard's size doesn't grow with
   the input.

The cuts are broadcast while there are at most ``max_broadcast`` of them, which
is counted; beyond, they are joined by key, and Spark splits that join's hot
partitions (the cuts of a key are few, its events can lie anywhere).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import DAY_MICROS, date_micros, micros, micros_day
from orrery.sources.durable import durable


def _hot_slices(events: DataFrame, shard_rows: int) -> DataFrame:
    """(k, slice, d, salts): the slices of keys with more than ``shard_rows`` events, their first days, and over how many salts each goes."""
    days = events.groupBy("k", micros_day(F.col("t")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    all_days, upto = Window.partitionBy("k"), Window.partitionBy("k").orderBy("d")
    return (
        days.withColumn("all", F.sum("n").over(all_days))
        .where(F.col("all") > shard_rows)
        .withColumn("slice", F.floor((F.sum("n").over(upto) - F.col("n")) / shard_rows))
        .groupBy("k", "slice")
        .agg(F.min("d").alias("d"), F.ceil(F.sum("n") / shard_rows).cast("int").alias("salts"))
    )


def _slice_of(cuts: Column, day: Column) -> Column:
    """The number of the slice that holds ``day``; 0 for keys without cuts and days before the first."""
    n = F.size(F.filter(cuts, lambda c: c["d"] <= day))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def asof_versions(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_key: Column,
    event_time: Column,
    event_cols: Sequence[str],
    version_key: Column,
    valid_from: Column,
    known_at: Column,
    version_id: str,
    version_cols: Sequence[str] = (),
    how: str = "inner",
    shard_rows: int = 200_000,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """Join each event to the version in force, by what was known then.

    Of the usable versions the latest ``valid_from`` wins, then the latest
    ``known_at``, then the largest ``version_id``. Returns ``event_cols`` (names
    of columns of ``events``), then ``version_id`` and ``version_cols``.

    Defined cases: events with a null key or time, and events before the first
    activation, have no version (dropped by ``inner``, nulls by ``left``).
    Versions with a null key, ``valid_from`` or ``known_at`` are never usable.
    Null attributes of the winning version stay null: it is not passed over.
    Repeated events come out as often as they came in; repeated versions change
    nothing. Other columns of either side are ignored, whatever their names. A
    version column named like an event column is an error.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    out_cols = [version_id, *version_cols]
    if clash := set(event_cols) & set(out_cols):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    ev = events.select(event_key.alias("k"), micros(event_time).alias("t"), F.struct(*event_cols).alias("e"))
    lone = F.col("k").isNull() | F.col("t").isNull()
    placed = ev.where(~lone)
    ve = versions.select(
        version_key.alias("k"),
        F.greatest(micros(known_at), date_micros(valid_from)).alias("t"),
        F.struct(valid_from.alias("vf"), known_at.alias("ka"), F.col(version_id).alias("id"), F.struct(*out_cols).alias("v")).alias("p"),
    ).where(F.col("k").isNotNull() & F.col("p.vf").isNotNull() & F.col("p.ka").isNotNull())

    slices = durable(_hot_slices(placed, shard_rows))
    by_key = slices.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "salts"))).alias("cuts"))
    hot = F.broadcast(by_key) if slices.count() <= max_broadcast else by_key
    ev_s = placed.join(hot, "k", "left").withColumn("slice", _slice_of(F.col("cuts"), micros_day(F.col("t"))))
    ev_s = ev_s.select(
        "k",
        "slice",
        F.when(F.col("cuts").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64("t", "e"), F.element_at("cuts", F.greatest("slice", F.lit(1)))["salts"]))
        .cast("int")
        .alias("salt"),
        "t",
        F.lit(1).alias("kind"),
        "e",
        F.lit(None).cast(ve.schema["p"].dataType).alias("p"),
    )
    ve_s = ve.join(hot, "k", "left").withColumn("slice", _slice_of(F.col("cuts"), micros_day(F.col("t"))))
    # The winner before each slice of a hot key: local maxima, then a running maximum over its few slices.
    grid = hot.select("k", F.posexplode("cuts").alias("i", "c")).select(
        "k", (F.col("i") + 1).alias("slice"), (F.col("c.d").cast("long") * DAY_MICROS).alias("t"), F.col("c.salts").alias("salts")
    )
    local = ve_s.where(F.col("cuts").isNotNull()).groupBy("k", "slice").agg(F.max("p").alias("p"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        grid.join(local, ["k", "slice"], "left")
        .withColumn("p", F.max("p").over(before))
        .where(F.col("p").isNotNull())
        .select("k", "slice", "salts", F.lit(None).cast("long").alias("t"), "p")
    )
    inside = ve_s.select(
        "k",
        "slice",
        F.coalesce(F.element_at("cuts", F.greatest("slice", F.lit(1)))["salts"], F.lit(1)).alias("salts"),
        "t",
        "p",
    )
    ve_all = carry.unionByName(inside).select(
        "k",
        "slice",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        "t",
        F.lit(0).alias("kind"),
        F.lit(None).cast(ev.schema["e"].dataType).alias("e"),
        "p",
    )
    merge = Window.partitionBy("k", "slice", "salt").orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    won = ev_s.unionByName(ve_all).withColumn("p", F.max("p").over(merge)).where("kind = 1")
    if how == "inner":
        won = won.where(F.col("p").isNotNull())
    else:
        won = won.select("e", "p").unionByName(ev.where(lone).select("e", F.lit(None).cast(ve.schema["p"].dataType).alias("p")))
    return won.select("e.*", *[F.col(f"p.v.{c}").alias(c) for c in out_cols])
