"""Weighing and copying files inside tasks, in constant memory per file."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.step import DIRECT

_CHUNK = 1 << 22


def _open(path: str):
    from pyarrow import fs
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside


def list_files(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> DataFrame:
    """path and bytes of every file; contents are not read. Missing paths are refused, all named."""
    missing, parts = [], []
    for position, path in enumerate(paths):
        try:
            read = spark.read.format("binaryFile")
            if recursive:
                read = read.option("recursiveFileLookup", True)
            parts.append(read.load(path).select(
                F.lit(position).alias("position"), "path", F.col("length").alias("bytes")))
        except AnalysisException:
            missing.append(path)
    if missing or not parts:
        raise ContractError(f"bound files do not exist: {missing}" if missing else "no file is bound")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def weigh_files(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, filename, sha256 and bytes per file. Each file is hashed as a stream by one task."""
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for path in batch["path"]:
                system, inside = _open(path)
                digest = hashlib.sha256()
                with system.open_input_stream(inside) as stream:
                    while chunk := stream.read(_CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    listed = list_files(spark, paths, recursive)
    spread = listed.repartition("path")
    return spread.mapInPandas(weigh, "position int, path string, bytes long, sha256 string").select(
        "position", F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), "sha256", "bytes")


def copy_files(spark: SparkSession, paths: Sequence[str], destination: str) -> DataFrame:
    """Copy each file under its own name; returns from, to and bytes, and runs when that is read."""
    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for batch in batches:
            targets = []
            for position, path in zip(batch["position"], batch["path"]):
                system, inside = _open(path)
                target = f"{destination.rstrip('/')}/{position}-{path.rsplit('/', 1)[-1]}"
                there, at = fs.FileSystem.from_uri(
                    target if "://" in target else "file://" + target)
                there.create_dir(at.rsplit("/", 1)[0], recursive=True)
                fs.copy_files(inside, at, system, there)
                targets.append(target)
            yield batch.assign(copied=targets)

    return list_files(spark, paths).repartition("path").mapInPandas(
        copy, "position int, path string, bytes long, copied string")


def source_edges(df: DataFrame, stage: str, weighed: DataFrame | None = None) -> DataFrame:
    """Which file, and which row of it, each row of a source came from."""
    rows = df.select("_ord", "_src_row", F.regexp_replace("_src_file", "^file:/+", "/").alias("_path"))
    if weighed is None:
        rows = rows.withColumn("_sha", F.lit(None).cast("string"))
    else:
        rows = rows.join(weighed.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha")),
                         "_path", "left")
    return rows.select(
        F.lit(stage).alias("stage"), F.col("_ord").alias("ord"), F.lit(0).alias("pos"),
        F.lit(stage).alias("parent_stage"), F.col("_src_row").alias("parent_ord"),
        F.lit(DIRECT).alias("kind"), F.lit(None).cast("array<string>").alias("columns"),
        F.col("_path").alias("source_file"), F.col("_sha").alias("source_sha"))
