"""Writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.durable import durable


def _files(spark: SparkSession, path: str):
    """(a maker of paths, the file system of ``path``)."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    return at, at(path).getFileSystem(sc._jsc.hadoopConfiguration())


def replace_parquet(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and move it there when it is whole.

    The table that was there comes back if the move fails. Between the two moves
    there is none, for a moment; where readers must not see that, use
    :func:`publish` and :func:`published`.
    """
    at, fs = _files(df.sparkSession, path)
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.option("compression", "zstd").parquet(new)
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        raise OSError(f"can't move {path} away")
    if not fs.rename(at(new), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"can't move {new} to {path}")
    fs.delete(at(old), True)


def publish(df: DataFrame, path: str, *, keep: int = 2) -> None:
    """Write ``df`` as a new version of the table at ``path`` and point there; readers have the old version or the new one, at any time.

    The pointer is a small file that is replaced by one rename, which is atomic.
    Of earlier versions the last ``keep`` - 1 stay, for readers that have begun.
    """
    spark = df.sparkSession
    at, fs = _files(spark, path)
    jvm = spark.sparkContext._jvm
    seen = sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory() and s.getPath().getName().startswith("v")) if fs.exists(at(path)) else []
    name = f"v{int(seen[-1][1:9]) + 1 if seen else 0:08d}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    part = at(f"{path}/_current.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, at(f"{path}/_current"), overwrite)
    for gone in [*seen, name][:-keep]:
        fs.delete(at(f"{path}/{gone}"), True)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of the table that ``path`` points to; None before the first."""
    at, fs = _files(spark, path)
    if not fs.exists(at(f"{path}/_current")):
        return None
    into = fs.open(at(f"{path}/_current"))
    name = bytes(b & 255 for b in into.readAllBytes()).decode()
    into.close()
    return spark.read.parquet(f"{path}/{name}")


def merge_days(fresh: DataFrame, path: str, keys: Sequence[str], day: Column, merge: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame]) -> None:
    """Merge ``fresh`` into the table at ``path``, which is partitioned by ``day``; only partitions of days that ``fresh`` has are read and written again.

    What is merged is written elsewhere before the partitions are replaced, so
    that a run that fails and comes again finds either state whole.
    """
    spark = fresh.sparkSession
    new = fresh.withColumn("day", day)
    at, fs = _files(spark, path)
    if fs.exists(at(path)):
        days = [r.day for r in new.select("day").distinct().collect()]  # as many as a batch has days
        old = spark.read.parquet(path).where(F.col("day").isin(*days)).select(*new.columns) if days else new.limit(0)
        new = merge(old, new, keys)
    else:
        new = merge(new.limit(0), new, keys)
    replace_snapshots(durable(new), path, "day")


def replace_snapshots(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` partitioned by ``by``; partitions that it has replace those there, others stay."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def golden_csv(df: DataFrame, path: str) -> None:
    """One CSV file in total order of all columns."""
    df.orderBy(*df.columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def trace_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def server_events(rows: Iterable[tuple[str, object]]) -> Iterator[str]:
    """(event, data) pairs in the wire format of server-sent events."""
    for event, data in rows:
        yield f"event: {event}\ndata: {json.dumps(data, default=str)}\n\n"


def show(df: DataFrame, n: int = 20) -> str:
    """The first rows as lines of text."""
    return "\n".join(" ".join(str(v) for v in r) for r in df.limit(n).collect())
