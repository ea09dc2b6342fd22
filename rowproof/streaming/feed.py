"""Following a run's event log while it is being written."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = ("seq bigint, ts timestamp, kind string, level int, stage string, row bigint, "
          "source string, text string")


def follow_events(spark: SparkSession, path: str, since: int = 0, stage: str | None = None,
                  files_per_trigger: int = 1000) -> DataFrame:
    """The stored event chunks as a stream, from sequence number `since` on, for one stage or all.

    The end of the run reaches every stage's feed. Filters and row operators apply to the
    stream as they do to a table; anything keyed on row positions does not.
    """
    events = (spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(path).where(F.col("seq") >= since))
    if stage is None:
        return events
    return events.where((F.col("stage") == stage) | (F.col("kind") == "run_done"))
