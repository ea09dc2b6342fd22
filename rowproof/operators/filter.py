"""Filtering, searching and reading rows by position."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.predicate import condition, name
from rowproof.operators.project import python_rows
from rowproof.ordinals import ORD, data_columns
from rowproof.step import Step

SEARCH_LIMIT = 20


def filter_rows(df: DataFrame, keep: str | Column | Callable[[dict[str, Any]], bool]) -> Step:
    """Rows for which `keep` is true, in order, columns unchanged.

    `keep` is predicate text, a boolean column, or authored row code that must return a bool.
    """
    if isinstance(keep, str):
        kept = df.where(condition(keep, df))
    elif isinstance(keep, Column):
        kept = df.where(keep)
    else:
        kept = _kept_by_code(df, keep)
    if ORD in df.columns:
        kept = kept.withColumn("_from", F.col(ORD))
    return Step(kept, ("_from",), "kept")


def _kept_by_code(df: DataFrame, keep: Callable[[dict[str, Any]], bool]) -> DataFrame:
    read = data_columns(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [keep(row) for row in python_rows(batch, read)]
            wrong = next((v for v in verdicts if not isinstance(v, bool)), None)
            if wrong is not None:
                raise TypeError(f"a row test returned {type(wrong).__name__}, not a bool")
            yield batch.filter(pa.array(verdicts, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


@dataclass(frozen=True)
class Matches:
    """`matched` counts every row the filter selects; `rows` holds the first few with `_ord`."""

    matched: int
    scanned: int
    rows: DataFrame


def search_rows(df: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> Matches:
    test = condition(text, df)
    counts = df.agg(F.count_if(test).alias("matched"), F.count(F.lit(1)).alias("scanned")).first()
    return Matches(counts["matched"], counts["scanned"], first_matches(df, text, limit))


def first_matches(df: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    return df.where(condition(text, df)).orderBy(ORD).limit(max(1, limit))


def window(df: DataFrame, offset: int = 0, limit: int | None = None) -> Step:
    """The rows at positions offset .. offset+limit-1. Positions stay those of the whole table."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit cannot be negative")
    test = F.col(ORD) >= offset
    if limit is not None:
        test = test & (F.col(ORD) < offset + limit)
    if offset == 0 and limit is None:
        return Step(df, (ORD,))
    cut = f"rows {offset} to {'the end' if limit is None else offset + limit - 1} of the input"
    return Step(df.where(test), (ORD,), notes=(cut,))


def rows_at(df: DataFrame, ordinals: Sequence[int]) -> DataFrame:
    """The rows at the given positions; a position outside the table is refused."""
    wanted = sorted(set(ordinals))
    found = df.where(F.col(ORD).isin(wanted))
    if wanted:
        held = found.select(ORD).toPandas()[ORD]
        outside = sorted(set(wanted) - set(int(o) for o in held))
        if outside:
            raise IndexError(f"the table holds no row {outside}")
    return found.orderBy(ORD)


def rows_listed(df: DataFrame, ordinals: DataFrame, column: str = ORD) -> DataFrame:
    """The rows whose position a table of ordinals names."""
    listed = ordinals.select(F.col(column).cast("bigint").alias(ORD))
    return df.join(listed, ORD, "left_semi")


def read_cell(df: DataFrame, ordinal: int, column: str) -> Any:
    if column not in df.columns:
        raise KeyError(f"no column {column!r}; the table has {data_columns(df)}")
    row = rows_at(df, [ordinal]).select(name(column)).first()
    value = row[0] if row is not None else None
    if isinstance(value, float) and value != value:
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


def top(df: DataFrame, n: int, by: Sequence[Column]) -> DataFrame:
    """The first `n` rows of an order: each partition keeps its own `n`, then they merge."""
    return df.orderBy(*by).limit(n)
