"""How catalogue queries read their tables."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowproof.session import configure, session_folder
from rowproof.sources import read_parquet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str, ordinals: bool = True) -> DataFrame:
    configure(spark)
    return read_parquet(spark, f"{folder}/{name}.parquet", ordinals=ordinals)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share."""
    return f"{session_folder(configure(spark))}/{label}-{uuid.uuid4().hex}"
