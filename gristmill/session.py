"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Adaptive execution does three things here that matter at scale: it turns
    shuffle joins into broadcast joins only after the real size of a side is
    known, it splits skewed join partitions, and it merges small partitions.
    Without ``shuffle_partitions`` the cluster's own setting stays in force.
    """
    builder = (
        SparkSession.builder.appName("gristmill")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # no call-site capture per column expression: plans are built from many
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local runs."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fresh = tempfile.mkdtemp(prefix="gristmill-")
    context.setCheckpointDir(fresh)
    return fresh


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping whatever the session names."""
    shared = _shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared location, for written tables."""
    return f"{_shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
