"""Session settings the operators rely on, and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution splits hot join partitions at run time; forcing it keeps the split
# even where the join's output partitioning would otherwise have been reused.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a local one in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder all executors share: intermediate tables "
            "are written there so that a lost executor costs no rework")
    made = os.path.join(tempfile.mkdtemp(prefix="rowproof-"), "checkpoints")
    context.setCheckpointDir(made)
    return context.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder, to be removed with the application."""
    return f"{shared_folder(spark).rstrip('/')}/rowproof-{spark.sparkContext.applicationId}"


def land(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, which cuts its lineage.

    Unlike a cached frame the result survives the loss of any executor, and unlike an
    RDD checkpoint it stays columnar, so later readers still prune columns.
    """
    path = f"{session_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A lookup table of at most this many short rows is sent to every executor.
LOOKUP_ROWS = 1_000_000


def look_up(df: DataFrame, lookup: DataFrame, keys: list[str], most: int = LOOKUP_ROWS) -> DataFrame:
    """`df` with the lookup's columns, without moving `df` while the lookup is small.

    The lookup is written and counted first: the planner's own estimate of an aggregate is
    that of the table under it, and would shuffle both sides. A longer one is joined normally.
    """
    landed = land(lookup, "lookup")
    return df.join(F.broadcast(landed) if landed.count() <= most else landed, keys)
