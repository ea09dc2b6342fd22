"""What a table's columns hold: absences, distinct values with counts, numeric ranges."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import name, present_value
from rowproof.functions.text import cell_text
from rowproof.ordinals import data_columns, running_totals
from rowproof.session import land
from rowproof.sources.readers import read_source


def _wanted(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    held = data_columns(df)
    wanted = list(columns) if columns is not None else held
    missing = [c for c in wanted if c not in held]
    if missing:
        raise ContractError(f"no column {missing}; the table has {held}")
    return wanted


def _number(df: DataFrame, column: str) -> Column:
    """The cell as a number; null where it is absent or reads as none."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        text = F.trim(name(column))
        return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    if isinstance(dtype, T.NumericType):
        return present_value(name(column), dtype).cast("double")
    return F.lit(None).cast("double")


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value text, number, count): the cells of all columns go through one grouping, counted per partition first."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell_text(name(c), df.schema[c].dataType).alias("value"),
                               _number(df, c).alias("number")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value text, count) for every distinct value, the absent one as null."""
    return _counted(df, _wanted(df, columns)).groupBy("column", "value").agg(F.sum("count").alias("count"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, max_values: int = 12,
            medians: bool = True) -> DataFrame:
    """One row per column: null_count, distinct_count, values (commonest first), truncated, and
    min/max/mean/median where every value reads as a number.

    The table is read once, into counts per distinct value; everything else is worked out from those.
    Medians and the commonest values are read off running counts over range partitions, so a column
    is never in one task, however many values it has or are asked for.
    """
    if max_values < 1:
        raise ContractError("max_values is at least 1")
    wanted = _wanted(df, columns)
    counts = land(_counted(df, wanted), "counts")
    held, number = F.col("value").isNotNull(), F.col("number")
    figures = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~held, F.col("count"))), F.lit(0)).alias("null_count"),
        F.count_distinct("value").alias("distinct_count"),
        (F.count_if(held & number.isNull()) == 0).alias("_numeric"),
        F.min("number").alias("min"), F.max("number").alias("max"),
        F.coalesce(F.sum(F.when(number.isNotNull(), F.col("count"))), F.lit(0)).alias("_n"),
        F.sum(number * F.col("count")).alias("_sum"))
    numeric = F.col("_numeric") & (F.col("_n") > 0)
    figures = figures.select("column", "null_count", "distinct_count", "_n", numeric.alias("_numeric"), *[
        F.when(numeric, F.col(c)).alias(c) for c in ("min", "max")], F.when(numeric, F.col("_sum") / F.col("_n")).alias("mean"))
    middle = _medians(counts, figures) if medians else figures.select("column", F.lit(None).cast("double").alias("median"))
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    # The column list leads, so that an empty table still has its columns profiled.
    names = df.sparkSession.createDataFrame([(c,) for c in wanted], "column string")
    return (names.join(figures, "column", "left").join(_commonest(counts, max_values), "column", "left").join(middle, "column", "left")
            .select("column", F.coalesce("null_count", F.lit(0).cast("bigint")).alias("null_count"),
                    F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
                    F.coalesce("values", empty).alias("values"),
                    (F.coalesce("distinct_count", F.lit(0)) > max_values).alias("truncated"),
                    "min", "max", "mean", "median"))


def _commonest(counts: DataFrame, most: int, shares: int = 64) -> DataFrame:
    """column, values: the `most` commonest of each column. Each share of a column's values gives up its own commonest first."""
    commonest = [F.desc("count"), F.col("value")]
    texts = counts.where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("count").alias("count"))
    share = F.pmod(F.xxhash64("value"), F.lit(shares))
    few = texts.withColumn("_place", F.row_number().over(W.partitionBy("column", share).orderBy(*commonest))).where(F.col("_place") <= most)
    placed = running_totals(few.withColumn("_one", F.lit(1).cast("bigint")), "column", commonest, "_one", "_place")
    listed = F.array_sort(F.collect_list(F.struct("_place", "value", "count")))
    return (placed.where(F.col("_place") < most).groupBy("column").agg(listed.alias("_v"))
            .select("column", F.transform("_v", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))).alias("values")))


def _medians(counts: DataFrame, figures: DataFrame) -> DataFrame:
    """column, median of the numeric columns, exactly: the values whose running counts take in the middle ranks."""
    numbers = (counts.where("number IS NOT NULL").join(F.broadcast(figures.where("_numeric").select("column", "_n")), "column")
               .groupBy("column", "number").agg(F.sum("count").alias("count"), F.first("_n").alias("_n")))
    ranked = running_totals(numbers, "column", [F.col("number")], "count", "_below")
    below = F.col("_below")
    ranks = [F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")]
    hits = [((below < r) & (r <= below + F.col("count"))) for r in ranks]
    return (ranked.where(hits[0] | hits[1]).groupBy("column")
            .agg(((F.max(F.when(hits[0], F.col("number"))) + F.max(F.when(hits[1], F.col("number")))) / 2).alias("median")))


def profile_source(spark: SparkSession, path: str, format: str | None = None,
                   columns: Sequence[str] | None = None, max_values: int = 12) -> DataFrame:
    """The profile of a raw file with nothing coerced, so that a schema can be declared from it."""
    return profile(read_source(spark, path, format, ordinals=False), columns, max_values)


def output_shape(df: DataFrame) -> tuple[int, int]:
    """Rows and data columns of an output."""
    return df.count(), len(data_columns(df))
