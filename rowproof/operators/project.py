"""Projections and row functions: one output row per input row, positions unchanged."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowproof.errors import ContractError, StepRefused
from rowproof.functions.cells import written_columns
from rowproof.functions.predicate import absent, condition, name
from rowproof.ordinals import data_columns
from rowproof.schema import Col, Table
from rowproof.step import Step

Expression = Column | str
ERROR = "_error"


def _column(value: Expression) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def extend(df: DataFrame, adds: Mapping[str, Expression] | None = None,
           rewrites: Mapping[str, Expression] | None = None) -> Step:
    """Every input column flows on; `rewrites` replace in place, `adds` follow at the end."""
    adds, rewrites = dict(adds or {}), dict(rewrites or {})
    taken = sorted(set(adds) & set(df.columns))
    unknown = sorted(set(rewrites) - set(df.columns))
    reserved = sorted(n for n in adds if n.startswith("_"))
    if taken or unknown or reserved:
        raise ContractError(
            f"adds name existing columns {taken} or reserved names {reserved}; "
            f"rewrites name absent columns {unknown}")
    kept = [_column(rewrites[c]).alias(c) if c in rewrites else name(c) for c in df.columns]
    return Step(df.select(*kept, *[_column(e).alias(n) for n, e in adds.items()]), ("_ord",))


def replace(df: DataFrame, columns: Mapping[str, Expression]) -> Step:
    """The output is exactly `columns`."""
    hidden = [name(c) for c in df.columns if c.startswith("_")]
    return Step(df.select(*[_column(e).alias(n) for n, e in columns.items()], *hidden), ("_ord",))


def narrow(df: DataFrame, reads: Sequence[str]) -> DataFrame:
    """Only the declared reads, and the row's own position."""
    missing = [c for c in reads if c not in df.columns]
    if missing:
        raise ContractError(f"the step reads {missing}, which its input does not carry")
    return df.select(*[name(c) for c in reads], *[name(c) for c in df.columns if c.startswith("_")])


def python_rows(batch: pa.RecordBatch, columns: Sequence[str]) -> list[dict[str, Any]]:
    """Rows as dicts of plain values: integers stay integers, and NaN reads as absent."""
    reals = [c for c in columns if pa.types.is_floating(batch.schema.field(c).type)]
    rows = batch.select(list(columns)).to_pylist()
    for row in rows:
        for c in reals:
            if row[c] is not None and row[c] != row[c]:
                row[c] = None
    return rows


def map_rows(df: DataFrame, fn: Callable[[dict[str, Any]], Mapping[str, Any]],
             writes: Table, reads: Sequence[str] | None = None) -> Step:
    """Authored row code: a dict in, a dict out, for what no column expression states.

    Runs inside Arrow batches. The written columns rejoin the whole row in the same batch, so
    nothing is shuffled and positions stay. A column that a row did not write, or wrote with another
    type (a fraction where an integer is declared is one), is null there and named in the row's
    `_error`, after what stood in it before; other rows are not touched. Code that raises, or
    returns no mapping at all, ends the job.
    """
    taken = [c.name for c in writes.columns]
    kept = [f for f in df.schema.fields if f.name not in (*taken, ERROR)]
    written_fields = [T.StructField(f.name, f.dataType) for f in writes.struct.fields]
    schema = T.StructType([*kept, *written_fields, T.StructField(ERROR, T.StringType())])
    read = list(reads) if reads is not None else data_columns(df)
    types = to_arrow_schema(T.StructType(written_fields))
    carried, failed_before = [f.name for f in kept], ERROR in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = [fn(row) for row in python_rows(batch, read)]
            wrong = next((w for w in written if not isinstance(w, Mapping)), None)
            if wrong is not None:
                raise TypeError(f"a row function returned {type(wrong).__name__}, not a mapping")
            # Columns the function did not write pass through as they are, never by way of Python.
            cells = [batch.column(c) for c in carried]
            made, faults = written_columns(written, types)
            if failed_before:
                faults = ["; ".join(filter(None, both)) or None for both in zip(batch.column(ERROR).to_pylist(), faults)]
            yield pa.RecordBatch.from_arrays([*cells, *made, pa.array(faults, pa.string())], names=[*carried, *taken, ERROR])

    mapped = df.mapInArrow(run, schema)
    order = [c for c in df.columns if not c.startswith("_")]
    order += [c for c in taken if c not in df.columns]
    hidden = [c for c in df.columns if c.startswith("_") and c != ERROR]
    return Step(mapped.select(*[name(c) for c in [*order, *hidden, ERROR]]), ("_ord",))


def map_frames(fn: Callable[..., DataFrame], *frames: DataFrame) -> DataFrame:
    """A table function over whole tables, in order."""
    made = fn(*frames)
    if not isinstance(made, DataFrame):
        raise TypeError(f"a table function returned {type(made).__name__}, not a DataFrame")
    return made


def refuse_where(df: DataFrame, test: Expression, reason: Expression, carried_by: str) -> DataFrame:
    """Fail the job, with a reason made from the row, wherever `test` holds.

    The refusal rides on column `carried_by`, so it fires whenever that column is computed.
    """
    found = condition(test, df) if isinstance(test, str) else test
    message = F.lit(reason) if isinstance(reason, str) else reason
    raised = F.raise_error(F.concat(F.lit("refused: "), message)).cast(df.schema[carried_by].dataType)
    return df.withColumn(carried_by, F.when(found, raised).otherwise(name(carried_by)))


def failure_kind(error: BaseException) -> str:
    """`refused`, `schema` or `crash`: which of the three a failed step is."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, StepRefused) or "refused: " in str(seen):
            return "refused"
        if isinstance(seen, ContractError):
            return "schema"
        seen = seen.__cause__
    return "crash"


def _off_type(value: Column, dtype: T.DataType, column: Col) -> Column | None:
    """Where a present value is not of the declared type; null when no value of this column can be off it."""
    wanted, number = column.spark_type, isinstance(dtype, T.NumericType)
    if isinstance(dtype, T.StringType):
        return value.try_cast(wanted).isNull() if column.type in ("int", "float", "bool", "date", "datetime") else (
            None if isinstance(wanted, T.StringType) else F.lit(True))
    if column.type == "int" and number:
        # Beyond 64 bits or with a fraction; an infinity is neither equal to its rounding's cast nor castable.
        return None if isinstance(dtype, T.IntegralType) else F.coalesce(value.try_cast("bigint") != value, F.lit(True))
    if column.type == "float" and number:
        return None
    if column.type == "date" and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("day", value) != value
    if column.type == "datetime" and isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return None
    same = type(dtype) is type(wanted) or isinstance(dtype, (T.StructType, T.MapType)) and isinstance(wanted, (T.StructType, T.MapType))
    return None if same else F.lit(True)


def write_violations(df: DataFrame, declared: Table) -> Column:
    """What is wrong with the columns a row wrote, as one text; null when nothing is."""
    found: list[Column] = []
    for column in declared.columns:
        if column.name not in df.columns:
            raise ContractError(f"the row writes no column {column.name!r}")
        value, dtype = name(column.name), df.schema[column.name].dataType
        gone = absent(value, dtype)
        if not column.nullable:
            found.append(F.when(gone, F.lit(f"{column.name}: required, but absent")))
        if column.enum:
            found.append(F.when(~gone & ~value.cast("string").isin(list(column.enum)), F.concat(
                F.lit(f"{column.name}: "), value.cast("string"), F.lit(" is outside its vocabulary"))))
        low, high = column.bounds
        outside = F.lit(False)
        if low is not None:
            outside = outside | (value < low)
        if high is not None:
            outside = outside | (value > high)
        if column.range is not None:
            found.append(F.when(~gone & outside, F.concat(
                F.lit(f"{column.name}: "), value.cast("string"),
                F.lit(f" is outside [{column.range[0]}, {column.range[1]}]"))))
        odd = _off_type(value, dtype, column)
        if odd is not None:
            found.append(F.when(~gone & odd, F.concat(
                F.lit(f"{column.name}: "), value.cast("string"), F.lit(f" is not {column.type}"))))
    if not found:
        return F.lit(None).cast("string")
    return F.nullif(F.concat_ws("; ", *found), F.lit(""))


def check_writes(df: DataFrame, declared: Table) -> DataFrame:
    """Tag each row that broke its declaration in `_error`; the map itself completes."""
    violation = write_violations(df, declared)
    if "_error" in df.columns:
        violation = F.nullif(F.concat_ws("; ", name("_error"), violation), F.lit(""))
    return df.withColumn("_error", violation)


def row_errors(df: DataFrame) -> DataFrame:
    return df.where(F.col("_error").isNotNull())


def trim(df: DataFrame, declared: Table) -> tuple[DataFrame, list[str]]:
    """Declared columns only, plus the names that were dropped."""
    missing = [c for c in declared.names if c not in df.columns]
    if missing:
        raise ContractError(f"declared columns are missing: {missing}")
    dropped = [c for c in data_columns(df) if c not in declared.names]
    hidden = [name(c) for c in df.columns if c.startswith("_")]
    return df.select(*[name(c) for c in declared.names], *hidden), dropped


def rule_branches(df: DataFrame, rules: Sequence[tuple[str, Expression]],
                  into: str = "branches") -> Step:
    """Which declared arms each row took, as their ids in declared order."""
    taken = [F.when(condition(test, df) if isinstance(test, str) else test, F.lit(arm))
             for arm, test in rules]
    return extend(df, {into: F.array_compact(F.array(*taken))})


def branch_coverage(df: DataFrame, rules: Sequence[tuple[str, Expression]],
                    branches: str = "branches") -> DataFrame:
    """Rows per declared arm, arms no row took included; one pass, no explode."""
    counts = df.agg(*[
        F.count_if(F.array_contains(name(branches), arm)).alias(f"arm{i}")
        for i, (arm, _) in enumerate(rules)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(arm).alias("branch"), F.col(f"arm{i}").alias("rows"))
        for i, (arm, _) in enumerate(rules)])))
