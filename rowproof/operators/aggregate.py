"""Grouped and whole-table figures, each with its own `where`."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import condition, name, present_value
from rowproof.ordinals import ORD, number_sorted
from rowproof.schema import Col, Table
from rowproof.step import CONTRIBUTION, Step, edge_rows

FORMULAS = ("count", "sum", "mean", "min", "max", "count_distinct",
            "first", "first_including_null", "list")
_ORDERED = ("first", "first_including_null", "list")


@dataclass(frozen=True)
class Agg:
    output: str
    formula: str
    value: str | None = None
    where: str | None = None


def output_column(op: Agg, value: Col | None) -> Col:
    """The column an aggregation adds; any figure may be null, since a `where` may admit nothing."""
    if op.formula in ("count", "count_distinct"):
        kind = "int"
    elif op.formula == "mean":
        kind = "float"
    elif op.formula == "list":
        kind = f"list[{value.type}]" if value else "list[str]"
    else:
        kind = value.type if value else "str"
    return Col(op.output, kind)


def output_table(source: Table, group_by: Sequence[str], ops: Sequence[Agg]) -> Table:
    keys = [source.get(c) for c in group_by]
    if None in keys:
        raise ContractError(f"group keys not found: {[c for c in group_by if not source.get(c)]}")
    return Table((*keys, *[output_column(o, source.get(o.value) if o.value else None) for o in ops]))  # type: ignore[arg-type]


def _check(df: DataFrame, group_by: Sequence[str], ops: Sequence[Agg]) -> None:
    problems = [f"group key {c!r} not found" for c in group_by if c not in df.columns]
    names = [*group_by, *[o.output for o in ops]]
    problems += [f"column {n!r} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for op in ops:
        if op.formula not in FORMULAS:
            problems.append(f"{op.output}: unknown formula {op.formula!r}")
        if op.output.startswith("_"):
            problems.append(f"{op.output}: names beginning with _ are reserved")
        if op.formula != "count":
            if op.value is None:
                problems.append(f"{op.output}: {op.formula} needs a value column")
            elif op.value not in df.columns:
                problems.append(f"{op.output}: value column {op.value!r} not found")
            elif op.formula in ("sum", "mean"):
                dtype = df.schema[op.value].dataType
                allowed = T.NumericType if op.formula == "mean" else (T.NumericType, T.StringType)
                if not isinstance(dtype, allowed):
                    problems.append(f"{op.output}: {op.formula} of {dtype.simpleString()}")
        if op.formula in _ORDERED and ORD not in df.columns:
            problems.append(f"{op.output}: {op.formula} needs numbered rows")
    if problems:
        raise ContractError("; ".join(problems))


def _admitted(df: DataFrame, op: Agg) -> Column | None:
    return condition(op.where, df) if op.where else None


def _ordered_values(value: Column, admitted: Column | None) -> Column:
    pair = F.struct(F.col(ORD).alias("o"), value.alias("v"))
    pairs = F.collect_list(pair if admitted is None else F.when(admitted, pair))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def _figure(df: DataFrame, op: Agg) -> Column:
    admitted = _admitted(df, op)

    def only(column: Column) -> Column:
        return column if admitted is None else F.when(admitted, column)

    rows = F.count(only(F.lit(1)))
    if op.formula == "count":
        return F.nullif(rows, F.lit(0).cast("bigint"))
    assert op.value is not None
    dtype = df.schema[op.value].dataType
    value = present_value(name(op.value), dtype)
    if op.formula in ("mean", "min", "max"):
        return {"mean": F.avg, "min": F.min, "max": F.max}[op.formula](only(value))
    if op.formula == "sum":
        if isinstance(dtype, T.StringType):
            total = F.array_join(_ordered_values(value, admitted), "")
        else:
            # A group that was admitted but holds no value sums to zero; one never admitted is absent.
            total = F.coalesce(F.sum(only(value)), F.lit(0))
        return F.when(rows > 0, total)
    if op.formula == "count_distinct":
        return F.when(rows > 0, F.count_distinct(only(value)))
    if op.formula == "first":
        present = value.isNotNull() if admitted is None else (admitted & value.isNotNull())
        return F.min_by(value, F.when(present, F.col(ORD)))
    if op.formula == "first_including_null":
        return F.min_by(value, only(F.col(ORD)))
    return F.when(rows > 0, _ordered_values(value, admitted))


def aggregate(df: DataFrame, group_by: Sequence[str], ops: Sequence[Agg], within: Sequence[str] = ()) -> Step:
    """One row per group (null keys form a group), or exactly one row when `group_by` is empty.

    `within` names columns, such as a case's id, that tell separate tables apart: each is aggregated
    by itself and its rows carry them first. With an empty `group_by` each such table has one row.

    All figures come from one grouping with map-side partials. Where every figure has its own
    `where`, rows none of them admits are filtered before the shuffle, so such groups never form.
    A figure no row was admitted to is null.
    """
    whole = bool(within) and not group_by
    group_by = [*within, *group_by]
    _check(df, group_by, ops)
    if not ops:
        return Step(df.select(*[name(c) for c in group_by]).limit(0))
    rows = df
    if group_by and not whole and all(op.where for op in ops):
        tests = [_admitted(df, op) for op in ops]
        any_test = tests[0]
        for test in tests[1:]:
            any_test = any_test | test
        rows = df.where(any_test)
    keys = [present_value(name(c), df.schema[c].dataType).alias(c) for c in group_by]
    figures = [_figure(df, op).alias(op.output) for op in ops]
    grouped = rows.groupBy(*keys).agg(*figures) if group_by else rows.agg(*figures)
    order = tuple(F.col(f"`{c}`").asc_nulls_last() for c in group_by)
    if not group_by:
        grouped = grouped.withColumn(ORD, F.lit(0).cast("bigint"))
    return Step(grouped, numbering="sorted" if group_by else "same", order=order,
                contributions=_contributions(df, group_by, ops))


def list_rows(df: DataFrame, group_by: Sequence[str], op: Agg) -> DataFrame:
    """What a `list` figure holds, as rows: the group keys, `position` from 0, and the value.

    A list cell must fit in one row. This form has no such bound: rows are numbered in one
    range-partitioned order over all groups, and each group's start is subtracted, so a group
    holding most of the table is spread over tasks like any other rows.
    """
    _check(df, group_by, [op])
    admitted = _admitted(df, op)
    rows = df if admitted is None else df.where(admitted)
    keys = [present_value(name(c), df.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(group_by)]
    value = present_value(name(op.value), df.schema[op.value].dataType)  # type: ignore[arg-type]
    listed = rows.select(*keys, value.alias(op.output), F.col(ORD).alias("_from"))
    names = [f"_k{i}" for i in range(len(group_by))]
    placed = number_sorted(listed, [*[F.col(k).asc_nulls_last() for k in names], F.col("_from").asc()])
    shown = [F.col(k).alias(c) for k, c in zip(names, group_by)]
    if not group_by:
        return placed.select(F.col(ORD).alias("position"), op.output)
    starts = placed.groupBy(*[F.col(k).alias(f"_s{k}") for k in names]).agg(F.min(ORD).alias("_start"))
    test = F.col(names[0]).eqNullSafe(F.col(f"_s{names[0]}"))
    for k in names[1:]:
        test = test & F.col(k).eqNullSafe(F.col(f"_s{k}"))
    return placed.join(starts, test).select(
        *shown, (F.col(ORD) - F.col("_start")).alias("position"), op.output)


def _contributions(df: DataFrame, group_by: Sequence[str], ops: Sequence[Agg]):
    """Each input row once, with the output columns it fed: keys looked up, nothing collected."""
    fed = F.array_compact(F.array(*[
        F.lit(op.output) if op.where is None else F.when(_admitted(df, op), F.lit(op.output))
        for op in ops]))

    def build(numbered: DataFrame, stage: str, parents: Sequence[str]) -> DataFrame:
        keys = [present_value(name(c), df.schema[c].dataType).alias(f"_in{i}")
                for i, c in enumerate(group_by)]
        rows = df.select(*keys, F.col(ORD).alias("_fed_from"), fed.alias("_fed"))
        rows = rows.where(F.size("_fed") > 0)
        if not group_by:
            placed = rows.withColumn(ORD, F.lit(0).cast("bigint"))
        else:
            groups = numbered.select(ORD, *[name(c).alias(f"_out{i}") for i, c in enumerate(group_by)])
            test = F.col("_in0").eqNullSafe(F.col("_out0"))
            for i in range(1, len(group_by)):
                test = test & F.col(f"_in{i}").eqNullSafe(F.col(f"_out{i}"))
            placed = rows.join(groups, test)
        return edge_rows(placed, stage, 0, parents[0], "_fed_from", CONTRIBUTION, F.col("_fed"))

    return build
