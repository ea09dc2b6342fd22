"""Row positions as an explicit column.

A row's identity is its 0-based position in its table, held in `_ord`. Steps that keep the
grain keep `_ord`; steps that do not keep an orderable, unique stand-in (the parents'
ordinals) and number densely only when someone asks for positions.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.session import land

ORD = "_ord"
# Rows per block when a table that only lost rows is numbered again.
BLOCK = 1 << 20


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def running_offsets(counts: DataFrame, order: Sequence[str], size: str, offset: str) -> DataFrame:
    """Rows before each block. `counts` has one row per block, file or partition, never per row."""
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(offset, F.coalesce(F.sum(size).over(before), F.lit(0).cast("bigint")))


def number_kept(df: DataFrame, ordinal: str = ORD, into: str = ORD, block: int = BLOCK) -> DataFrame:
    """Dense positions for rows that kept their order and a unique bigint ordinal.

    Each block of the old numbering holds at most `block` rows, so the window below never
    meets a large group; the only global step is a running sum over block counts.
    """
    blocked = df.withColumn("_block", F.expr(f"`{ordinal}` div {block}"))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_offsets(counts, ["_block"], "_rows", "_before").drop("_rows")
    within = F.row_number().over(W.partitionBy("_block").orderBy(ordinal)) - 1
    return (blocked.withColumn("_within", within)
            .join(offsets, "_block")
            .withColumn(into, F.col("_before") + F.col("_within"))
            .select(*dict.fromkeys([*df.columns, into])))


def number_sorted(df: DataFrame, order: Sequence[Column], into: str = ORD) -> DataFrame:
    """Dense positions in a total order: range partitions, written once, plus per-part offsets.

    `order` must end in something unique, which is also what lets a hot sort value be cut
    across partitions. The table is landed because range bounds are sampled: numbering a
    second evaluation against the first one's counts could misplace rows.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id()))
    landed = land(placed, "sorted")
    counts = landed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_start"))
    offsets = running_offsets(counts, ["_part"], "_rows", "_before").drop("_rows")
    # One offset per shuffle partition: small by construction.
    return (landed.join(F.broadcast(offsets), "_part")
            .withColumn(into, F.col("_before") + F.col("_at") - F.col("_start"))
            .select(*dict.fromkeys([*df.columns, into])))


def running_totals(df: DataFrame, group: str, order: Sequence[Column], weight: str, into: str) -> DataFrame:
    """`into`: the weights of the rows that come before a row in its group, in a total order of the group.

    Groups are cut where the range partitions are, so one of any size is spread over tasks; what is
    summed up in one place is a row per group and partition.
    """
    placed = (df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
              .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    # Range bounds are sampled, so the parts are written once and read twice.
    landed = land(placed, "running")
    sums = landed.groupBy(group, "_part").agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part", group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    within = landed.withColumn("_within", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (within.join(offsets, ["_part", group]).withColumn(into, F.col("_before") + F.col("_within"))
            .select(*dict.fromkeys([*df.columns, into])))


def require_ordinal(df: DataFrame, step: str) -> None:
    if ORD not in df.columns or not isinstance(df.schema[ORD].dataType, T.LongType):
        raise ValueError(f"{step} needs numbered rows: read the table with ordinals, or number it")
