"""Incremental loads: merges and upserts as pure functions of what is there and what comes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_latest(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both together, one row per key: what is fresh wins over what exists. Of equal keys within a side any one row wins, but always the same."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in existing.columns if c not in keys]
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_p").desc(), *rest))
    return both.withColumn("_k", k).where("_k = 1").drop("_p", "_k")


def watermark(df: DataFrame, day: Column) -> DataFrame:
    """(watermark): the last date there is; null for an empty table."""
    return df.agg(F.max(day).alias("watermark"))


def missing(wanted: DataFrame, existing: DataFrame, wanted_key: Column, existing_key: Column) -> DataFrame:
    """(key): keys, as text, that are wanted and not there."""
    return wanted.select(wanted_key.cast("string").alias("key")).where("key IS NOT NULL").distinct().join(existing.select(existing_key.cast("string").alias("key")).distinct(), "key", "left_anti")


def insert_new(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key isn't there, one per key; what is there stays as it is."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in fresh.columns if c not in keys] or [F.lit(0)]))
    return fresh.withColumn("_k", k).where("_k = 1").drop("_k").join(existing.select(*keys).distinct(), list(keys), "left_anti")


def merge_fields(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field by field: a fresh value replaces an old one, a null or a field that isn't written leaves it. One row per key on each side."""
    f = fresh.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fresh.columns if c not in keys])
    cols = [c for c in existing.columns if c not in keys] + [c for c in fresh.columns if c not in keys and c not in existing.columns]
    out = existing.join(f, list(keys), "full")
    pick = lambda c: F.coalesce(*[x for x in ([F.col(f"_n_{c}")] if c in fresh.columns else []) + ([F.col(c)] if c in existing.columns else [])])
    return out.select(*keys, *[pick(c).alias(c) for c in cols])


def best_of_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def split_symbols(actions: DataFrame) -> DataFrame:
    """(symbol): every symbol that a corporate action touches, old and new names alike, for a full refetch."""
    cols = [c for c in ("symbol", "old_symbol", "new_symbol") if c in actions.columns]
    return actions.select(F.explode(F.array(*cols)).alias("symbol")).where("symbol IS NOT NULL").distinct()


def update_from(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``changes`` where its key is among them, nulls included; nothing is added."""
    c = changes.withColumnsRenamed({x: f"_n_{x}" for x in changes.columns if x not in keys}).withColumn("_hit", F.lit(True))
    out = df.join(c, list(keys), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns and x not in keys else F.col(x) for x in df.columns])
