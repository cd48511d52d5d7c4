"""Tables written on the way to the shared folder of the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

from gristmill.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends
    here, and what a lost executor held is read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send_code(spark) -> None:
    """Give the executors this package, once per Spark application: functions
    sent to Python workers refer to it by name."""
    context = spark.sparkContext
    if getattr(context, "_gristmill_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp())  # read by the driver only, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    context._gristmill_sent = True


def shared_value(spark, value):
    """Broadcast ``value``, whose size the caller bounds, and send the code that reads it."""
    send_code(spark)
    return spark.sparkContext.broadcast(value)
