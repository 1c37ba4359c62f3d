"""Session helpers: checkpoint folder and input spreading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pkgaudit", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for; submit-time settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "128m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Plans are built from many small expressions; recording where each was written takes longer than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the cluster's own, or a scratch folder in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pkgaudit-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and continue from there, so lost executors replay little."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Deal a scan over partitions: for a caller whose one small file feeds a CPU-heavy projection.

    It moves all rows, so it is the caller's choice and never made by an operator.
    """
    return df.repartition(partitions, *keys)
