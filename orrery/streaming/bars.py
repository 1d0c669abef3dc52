"""Incremental bars: files that arrive are merged into a table by symbol and timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.records import merge_latest
from orrery.sources.sinks import merge_days

SCHEMA = "symbol string, timestamp timestamp, close double, volume double"


def follow(spark: SparkSession, inbox: str, target: str, checkpoint: str) -> StreamingQuery:
    """Merge every file in ``inbox`` into the parquet table ``target``, later ones winning, then stop.

    ``target`` is partitioned by day; a batch rewrites the days that it has rows
    of and no others. A batch that is run again after a failure merges the same
    rows to the same result.
    """

    def merge(batch: DataFrame, _: int) -> None:
        merge_days(batch.where("timestamp IS NOT NULL"), target, ["symbol", "timestamp"], F.to_date("timestamp"), merge_latest)

    stream = spark.readStream.schema(SCHEMA).parquet(inbox)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
