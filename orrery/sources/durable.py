"""Cutting lineage through storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``, and the result survives
    the loss of any executor. Where it is unset, a local session, as in tests,
    takes a temporary folder that goes when it ends; on a cluster that is an
    error, as executors share no such folder. Files in the session's folder go
    with their data frames if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="orrery-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
