"""Readers for the inputs of the engine beside plain tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def bars_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame | None:
    """Bars whose timestamp lies in the closed range; None if nothing is at ``path``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df.where(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def first_readable(readers: Sequence[Callable[[], DataFrame | None]]) -> DataFrame:
    """What the first reader that has something gives."""
    for r in readers:
        try:
            if (df := r()) is not None:
                return df
        except AnalysisException:
            continue
    raise FileNotFoundError("no source can be read")


def signals(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """(symbol, direction, as_of, as_of_ts) from a CSV file of ticker, posted_at, direction.

    Rows without a time or direction are skipped. The date is the first ten
    characters; the time is null for a bare date or one that can't be read.
    """
    raw = spark.read.csv(path, header=True).where("trim(coalesce(posted_at, '')) <> '' AND trim(coalesce(direction, '')) <> ''")
    day = F.substring(F.trim("posted_at"), 1, 10)
    ts = F.when(F.length(F.trim("posted_at")) > 10, F.expr("try_cast(trim(posted_at) AS timestamp)"))
    out = raw.select(F.col("ticker").alias("symbol"), "direction", F.expr("try_cast(substring(trim(posted_at), 1, 10) AS date)").alias("as_of"), ts.alias("as_of_ts"), day.alias("_d"))
    return (out if as_of is None else out.where(F.col("_d") == as_of)).drop("_d")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of a CSV file with a column of that name; none if there is no file."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "symbol string")
    return spark.read.csv(path, header=True).select("symbol").where("symbol IS NOT NULL").distinct()


def tab_separated(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Rows of a tab-separated latin-1 file with a header, the last by ``order`` for each ``key``."""
    df = spark.read.csv(path, header=True, sep="\t", encoding="ISO-8859-1", quote="")
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("x")).select(key, "x.*")


def audit_log(df: DataFrame, kind: str) -> DataFrame:
    """(tenant_id, occurred_at, signal_id, symbol, direction) of an event log with a JSON column ``subject``: opening actions that name a signal."""
    get = lambda p: F.get_json_object("subject", f"$.{p}")
    side = F.when(get("right") == "C", "up").when(get("right") == "P", "down")
    rows = df.where((F.col("kind") == kind) & (get("action") == "BTO") & get("signal_id").isNotNull())
    return rows.select("tenant_id", "occurred_at", get("signal_id").alias("signal_id"), F.regexp_extract(get("ticker"), "^([A-Z]+)", 1).alias("symbol"), side.alias("direction"))


def fetch_plan(spark: SparkSession, path: str) -> DataFrame:
    """(day, candidate, role, symbol) of a JSON file {day: {candidate: {role: [symbols]}}}."""
    kind = "map<string,map<string,map<string,array<string>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    day = text.select(F.explode("m").alias("day", "c"))
    cand = day.select("day", F.explode("c").alias("candidate", "r"))
    return cand.select("day", "candidate", F.explode("r").alias("role", "s")).select("day", "candidate", "role", F.explode("s").alias("symbol"))


def jdbc(spark: SparkSession, table: str, env: dict[str, str] | None = None) -> DataFrame:
    """A table of the database that the environment names; missing settings are an error."""
    env = os.environ if env is None else env
    if lacking := [k for k in ("ORRERY_JDBC_URL", "ORRERY_JDBC_USER", "ORRERY_JDBC_PASSWORD") if not env.get(k)]:
        raise RuntimeError(f"not set: {', '.join(lacking)}")
    return spark.read.jdbc(env["ORRERY_JDBC_URL"], table, properties={"user": env["ORRERY_JDBC_USER"], "password": env["ORRERY_JDBC_PASSWORD"]})


def named(source: str, builders: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """What the builder of a source gives: ``name`` or ``name:ARGUMENT``; unknown names and bad arguments are an error."""
    name, _, arg = source.partition(":")
    if name not in builders or (":" in source and not arg.isalnum()):
        raise ValueError(f"no source {source!r}")
    return builders[name](arg) if arg else builders[name]()


def bounded(value: str | float, lo: float, hi: float) -> float:
    """A finite number within [lo, hi], or an error."""
    x = float(value)
    if not lo <= x <= hi:
        raise ValueError(f"{value!r} is not within {lo} and {hi}")
    return x
