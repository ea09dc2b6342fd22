"""Writing outputs: stage tables, exports, published artifacts and evidence bundles."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import name
from rowproof.ordinals import ORD, data_columns
from rowproof.sources.files import copy_files, weigh_files

BOM = "﻿"
_UNSTORABLE = (T.NullType, T.CalendarIntervalType)


@dataclass(frozen=True)
class Written:
    path: str
    format: str
    note: str | None = None


def _flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, which CSV can hold."""
    return df.select(*[
        F.to_json(name(f.name), {"ignoreNullFields": "false"}).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else
        name(f.name).cast("string").alias(f.name) for f in df.schema.fields])


def _stored(df: DataFrame) -> DataFrame:
    return df.select(*[name(c) for c in data_columns(df)])


def write_output(df: DataFrame, path: str, mode: str = "errorifexists") -> Written:
    """Parquet, or CSV with a note when a column's type cannot be stored."""
    rows = df.select(*[name(c) for c in data_columns(df)], *([ORD] if ORD in df.columns else []))
    odd = [f.name for f in rows.schema.fields if isinstance(f.dataType, _UNSTORABLE)]
    if not odd:
        rows.write.mode(mode).parquet(path)
        return Written(path, "parquet")
    _flat(rows).write.mode(mode).option("header", True).csv(path)
    return Written(path, "csv", f"stored as CSV: parquet holds no type for {odd}")


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> Written:
    """Every row as UTF-8 CSV; each part file starts with a byte order mark, in its header cell."""
    flat = _flat(_stored(df))
    if flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return Written(path, "csv")


def publish(df: DataFrame, destination: str, format: str = "csv",
            one_file_per: str | None = None, mode: str = "errorifexists") -> Written:
    """Final artifacts as CSV or JSON, optionally in one folder per value of a column.

    The rows of one value are not gathered in one task: a hot value gets several part files.
    """
    if format not in ("csv", "json"):
        raise ContractError(f"an artifact is csv or json, not {format!r}")
    rows = _stored(df) if format == "json" else _flat(_stored(df))
    writer = rows.write.mode(mode)
    if one_file_per is not None:
        if one_file_per not in rows.columns:
            raise ContractError(f"one_file_per names {one_file_per!r}, which is not a column")
        writer = writer.partitionBy(one_file_per)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(destination)
    else:
        writer.option("ignoreNullFields", False).json(destination)
    return Written(destination, format)


@dataclass(frozen=True)
class Bundle:
    checksums: DataFrame
    omitted: DataFrame


def export_bundle(spark: SparkSession, stages: Mapping[str, DataFrame | None], destination: str,
                  inputs: Sequence[str] = (), records: DataFrame | None = None) -> Bundle:
    """Every stage output as CSV and parquet, the run records, the copied inputs, and a sha256 of
    every file. A stage that cannot be included is listed with the reason, never left out silently.
    """
    root = destination.rstrip("/")
    omitted: list[tuple[str, str]] = []
    for stage, output in stages.items():
        if output is None:
            omitted.append((stage, "the run holds no output for this stage"))
            continue
        written = write_output(output, f"{root}/outputs/{stage}")
        if written.note:
            omitted.append((stage, written.note))
        export_csv(output, f"{root}/tables/{stage}")
    if records is not None:
        records.write.json(f"{root}/records")
    if inputs:
        copied = copy_files(spark, inputs, f"{root}/inputs")
        copied.write.json(f"{root}/copied")
    left_out = spark.createDataFrame(omitted, "stage string, reason string")
    left_out.write.json(f"{root}/omitted")
    weighed = weigh_files(spark, [root], recursive=True)
    sums = weighed.select("path", "filename", "sha256", "bytes")
    sums.write.option("header", True).csv(f"{root}-checksums")
    return Bundle(spark.read.option("header", True).schema(sums.schema).csv(f"{root}-checksums"),
                  left_out)
