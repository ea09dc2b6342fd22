"""What a step did to its rows: aligned, filter, field and multiset differences."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.errors import GrainError
from rowproof.functions.predicate import name, present_value
from rowproof.functions.text import canonical_json, cell_text, json_cell
from rowproof.ordinals import ORD, data_columns, number_kept, number_sorted

CARRIED, CHANGED, ADDED, DROPPED = "carried", "changed", "added", "dropped"
SHOWN = 100


def _text(df: DataFrame, column: str, side: str) -> Column:
    return F.coalesce(cell_text(F.col(f"{side}.`{column}`"), df.schema[column].dataType), F.lit(""))


def aligned(inp: DataFrame, out: DataFrame) -> DataFrame:
    """Rows `was` and `now` of one position beside each other; a position that one side lacks has nulls there."""
    return inp.alias("was").join(out.alias("now"), F.col(f"was.{ORD}") == F.col(f"now.{ORD}"), "full_outer")


def _both(test: Column, message: Column) -> Column:
    """A filter that ends the job, as a refusal, where `test` fails."""
    return F.when(test, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("refused: "), message)).cast("boolean"))


def row_diff(inp: DataFrame, out: DataFrame) -> DataFrame:
    """column, state and changed_cells over two tables that share positions: one join, one pass.

    Tables whose positions differ are refused, from the same pass.
    Cells are compared as rendered text: a difference nobody can see is not one.
    """
    before, after = data_columns(inp), data_columns(out)
    both = [c for c in before if c in after]
    sides = {s: F.col(f"{s}.{ORD}") for s in ("was", "now")}
    counts = aligned(inp, out).agg(*[F.count(c).alias(f"_{s}") for s, c in sides.items()], F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(_text(inp, c, "was") != _text(out, c, "now")).alias(f"n{i}")
        for i, c in enumerate(both)])
    counts = counts.where(_both((F.col("_was") == F.col("_rows")) & (F.col("_now") == F.col("_rows")), F.concat(
        F.col("_was").cast("string"), F.lit(" input row(s) and "), F.col("_now").cast("string"),
        F.lit(" output row(s) share "), (F.col("_was") + F.col("_now") - F.col("_rows")).cast("string"), F.lit(" position(s)"))))
    lines = [F.struct(F.lit(c).alias("column"), F.lit(CARRIED if c in both else DROPPED).alias("state"),
                      (F.col(f"n{both.index(c)}") if c in both else F.lit(0).cast("bigint")).alias("changed_cells"))
             for c in before]
    lines += [F.struct(F.lit(c).alias("column"), F.lit(ADDED).alias("state"),
                       F.lit(0).cast("bigint").alias("changed_cells")) for c in after if c not in before]
    return counts.select(F.inline(F.array(*lines)))


def require_aligned(inp: DataFrame, out: DataFrame) -> None:
    a, b = inp.count(), out.count()
    if a != b:
        raise GrainError(f"{a} input row(s) and {b} output row(s) do not align")


def cell_diff(inp: DataFrame, out: DataFrame, first: int | None = SHOWN) -> DataFrame:
    """ord, column, state, was, now per cell of the first rows; every row when `first` is None.

    Tables of different lengths are refused before, a position that only one of them has when it is met.
    """
    before, after = data_columns(inp), data_columns(out)
    rows = aligned(inp, out)
    if first is not None:
        require_aligned(inp, out)
        rows = aligned(inp.where(F.col(ORD) < first), out.where(F.col(ORD) < first))
    ords = F.col(f"was.{ORD}"), F.col(f"now.{ORD}")
    rows = rows.where(_both(ords[0].isNotNull() & ords[1].isNotNull(), F.concat(
        F.lit("position "), F.coalesce(*ords).cast("string"), F.lit(" is in one table only"))))
    cells = []
    for c in [*before, *[a for a in after if a not in before]]:
        was = _text(inp, c, "was") if c in before else F.lit(None).cast("string")
        now = _text(out, c, "now") if c in after else F.lit(None).cast("string")
        state = (F.lit(ADDED) if c not in before else F.lit(DROPPED) if c not in after
                 else F.when(was == now, F.lit(CARRIED)).otherwise(F.lit(CHANGED)))
        cells.append(F.struct(F.lit(c).alias("column"), state.alias("state"),
                              was.alias("was"), now.alias("now")))
    return rows.select(F.col(f"was.{ORD}").alias("ord"), F.inline(F.array(*cells)))


def field_diff(inp: DataFrame, out: DataFrame, parent_ord: int, ordinal: int) -> DataFrame:
    """The fields of one row against the row it was made from."""
    parent = inp.where(F.col(ORD) == parent_ord).withColumn(ORD, F.lit(0).cast("bigint"))
    row = out.where(F.col(ORD) == ordinal).withColumn(ORD, F.lit(0).cast("bigint"))
    return cell_diff(parent, row, None).drop("ord")


@dataclass(frozen=True)
class FilterDiff:
    """`rows` are all input rows in order with the output position of each kept one."""

    rows: DataFrame
    totals: DataFrame


def filter_diff(inp: DataFrame, edges: DataFrame, window: int = SHOWN) -> FilterDiff:
    """Input rows marked kept or dropped, and the totals: input, kept, dropped, dropped beyond `window`."""
    kept = edges.select(F.col("parent_ord").alias(ORD), F.col("ord").alias("output_ord"))
    rows = inp.join(kept, ORD, "left").withColumn("kept", F.col("output_ord").isNotNull())
    totals = rows.agg(
        F.count(F.lit(1)).alias("input_total"), F.count_if("kept").alias("kept_total"),
        F.count_if(~F.col("kept")).alias("dropped_total"),
        F.count_if(~F.col("kept") & (F.col(ORD) >= window)).alias("dropped_beyond_window"))
    return FilterDiff(rows, totals)


def is_filter_lineage(edges: DataFrame, inp: DataFrame, out: DataFrame) -> bool:
    """Whether edges can be a filter's: one parent each, in range, strictly rising, same columns.

    Rising is tested by numbering the parents: in a filter, the k-th kept parent made row k.
    """
    if data_columns(inp) != data_columns(out):
        return False
    ranked = number_kept(edges.select("ord", F.col("parent_ord").alias("p")), "p", "_rank")
    found = ranked.agg(F.count(F.lit(1)), F.count_distinct("ord"), F.count_distinct("p"),
                       F.coalesce(F.bool_and(F.col("_rank") == F.col("ord")), F.lit(True))).first()
    n = out.count()
    in_range = edges.join(inp.select(F.col(ORD).alias("parent_ord")), "parent_ord", "left_anti").isEmpty()
    return found[0] == found[1] == found[2] == n and bool(found[3]) and in_range


# ── multisets ──────────────────────────────────────────────────────────────


def multiset_diff(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose multiplicity differs: the columns, `missing` copies and `unexpected` copies.

    Copies are counted per partition before the shuffle, so many equal rows cost nothing extra;
    absent values compare equal.
    """
    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[_normal(df, c).alias(c) for c in columns],
                         F.lit(sign).alias("_side"))
    both = counted(expected, 1).unionByName(counted(actual, -1))
    balance = both.groupBy(*[name(c) for c in columns]).agg(F.sum("_side").alias("_n"))
    return balance.where(F.col("_n") != 0).select(
        *[name(c) for c in columns], F.greatest("_n", F.lit(0)).alias("missing"),
        F.greatest(-F.col("_n"), F.lit(0)).alias("unexpected"))


def _normal(df: DataFrame, column: str) -> Column:
    return present_value(name(column), df.schema[column].dataType)


def multiset_cells(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cell differences between two equally long row sets, each put in canonical order first."""
    a, b = expected.count(), actual.count()
    if a != b:
        raise GrainError(f"expected {a} row(s), got {b}")

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("_tie"),
                         canonical_json(df, list(columns)).alias("_key"),
                         *[json_cell(name(c), df.schema[c].dataType).alias(f"{side}{i}")
                           for i, c in enumerate(columns)])
        return number_sorted(rows, [F.col("_key").asc(), F.col("_tie").asc()], "row").drop("_key", "_tie")

    pairs = placed(expected, "e").join(placed(actual, "a"), "row")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e{i}").alias("expected"),
                               F.col(f"a{i}").alias("actual")) for i, c in enumerate(columns)])
    return pairs.select("row", F.inline(cells)).where(F.col("expected") != F.col("actual"))
