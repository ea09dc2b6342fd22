"""Reshapes whose rows stay traceable: explode, dedupe, sort with rank, union."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError, StepRefused
from rowproof.functions.predicate import name, present_value
from rowproof.ordinals import BLOCK, ORD, data_columns, require_ordinal, running_offsets
from rowproof.schema import Table, promoted
from rowproof.step import CONTRIBUTION, Step, edge_rows

# ── explode ────────────────────────────────────────────────────────────────


def explode_rows(df: DataFrame, column: str, keep_empty: bool = False) -> Step:
    """One row per list element in list order; `keep_empty` keeps a row without elements, as null."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.ArrayType):
        raise ContractError(f"{column!r} is not a list column")
    split = F.posexplode_outer if keep_empty else F.posexplode
    others = [name(c) for c in df.columns if c != column]
    spread = df.select(*others, split(name(column)).alias("_at", "_element"))
    frame = spread.select(*[F.col("_element").alias(c) if c == column else name(c)
                            for c in df.columns], "_at")
    if ORD not in df.columns:
        return Step(frame.drop("_at"))
    frame = frame.withColumn("_from", F.col(ORD))
    return Step(frame, ("_from",), "sorted",
                (F.col("_from").asc(), F.col("_at").asc_nulls_first()))


# ── dedupe ─────────────────────────────────────────────────────────────────


def _standing(df: DataFrame, keep: str, by: str | None) -> list[Column]:
    """The order in which rows of a group are preferred; a tie goes to the earlier row."""
    if keep == "first":
        return [F.col(ORD).asc()]
    value = present_value(name(by), df.schema[by].dataType)
    return [value.desc_nulls_last() if keep == "highest" else value.asc_nulls_last(),
            F.col(ORD).asc()]


def dedupe(df: DataFrame, keys: Sequence[str], keep: str = "first", by: str | None = None,
           within: Sequence[str] = ()) -> Step:
    """One row per key (null keys are one group): the first, or the one highest or lowest in `by`.

    `within` names columns that tell separate tables apart: each is deduped by itself.

    The rank filter is applied per partition before the shuffle as well as after it, so a key
    with many copies sends at most one row per partition.
    """
    require_ordinal(df, "dedupe")
    if keep not in ("first", "highest", "lowest"):
        raise ContractError(f"keep is first, highest or lowest, not {keep!r}")
    if (by is None) != (keep == "first"):
        raise ContractError("`by` belongs to highest and lowest, and they need it")
    missing = [c for c in [*within, *keys, *([by] if by else [])] if c not in df.columns]
    if missing or not keys:
        raise ContractError(f"dedupe needs keys the input carries; missing {missing}")
    keys = [*within, *keys]
    standing = _standing(df, keep, by)
    groups = [present_value(name(k), df.schema[k].dataType) for k in keys]
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*standing))
    survivors = (df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
                 .withColumn("_from", F.col(ORD)))

    def losers(numbered: DataFrame, stage: str, parents: Sequence[str]) -> DataFrame:
        held = [present_value(name(k), df.schema[k].dataType) for k in keys]
        rows = df.select(*[h.alias(f"_in{i}") for i, h in enumerate(held)],
                         F.col(ORD).alias("_lost"))
        kept = numbered.select(
            ORD, F.col("_from").alias("_won"),
            *[present_value(name(k), df.schema[k].dataType).alias(f"_out{i}")
              for i, k in enumerate(keys)])
        test = F.col("_lost") != F.col("_won")
        for i in range(len(keys)):
            test = test & F.col(f"_in{i}").eqNullSafe(F.col(f"_out{i}"))
        return edge_rows(rows.join(kept, test), stage, 1, parents[0], "_lost", CONTRIBUTION)

    if keep == "first":
        return Step(survivors, ("_from",), "kept", contributions=losers)
    order = [present_value(name(by), df.schema[by].dataType).desc_nulls_last() if keep == "highest"
             else present_value(name(by), df.schema[by].dataType).asc_nulls_last(),
             F.col("_from").asc()]
    return Step(survivors, ("_from",), "sorted", tuple(order), contributions=losers)


# ── sort and rank ──────────────────────────────────────────────────────────


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls: str | None = None          # first | last; a nullable key must say
    order: Sequence[str] | None = None  # a stated order, compared as text

    def __post_init__(self) -> None:
        if self.nulls not in (None, "first", "last"):
            raise ContractError(f"{self.column}: nulls go first or last")
        if self.order is not None:
            stated = [str(v) for v in self.order]
            if self.descending:
                raise ContractError(f"{self.column}: a stated order has no direction")
            if not stated or len(set(stated)) != len(stated):
                raise ContractError(f"{self.column}: a stated order names each value once")


def sort_columns(df: DataFrame, keys: Sequence[SortKey]) -> list[Column]:
    made = []
    for key in keys:
        value = present_value(name(key.column), df.schema[key.column].dataType)
        if key.order is not None:
            stated = F.array(*[F.lit(str(v)) for v in key.order])
            value = F.when(value.isNotNull(), F.array_position(stated, value.cast("string")))
        first = key.nulls == "first"
        if key.descending:
            made.append(value.desc_nulls_first() if first else value.desc_nulls_last())
        else:
            made.append(value.asc_nulls_first() if first else value.asc_nulls_last())
    return made


def unranked_values(df: DataFrame, key: SortKey) -> list[str]:
    """Values present in the column that its stated order leaves out; stops once enough are named."""
    text = name(key.column).cast("string")
    stray = df.where(text.isNotNull() & ~text.isin([str(v) for v in key.order or ()]))
    return sorted(r[0] for r in stray.select(text.alias("v")).distinct().limit(20).collect())


def sort_rank(df: DataFrame, keys: Sequence[SortKey], rank_column: str | None = None,
              contract: Table | None = None, within: Sequence[str] = ()) -> Step:
    """Rows in a stable multi-key order; `rank_column` numbers them from 1, ties included.

    The rank is read off a range-partitioned sort, never off one global window. `within` names
    columns that tell separate tables apart: they come one after another, each ranked from 1.
    """
    require_ordinal(df, "sort_rank")
    problems = [f"sort key {k.column!r} not found" for k in keys if k.column not in df.columns]
    problems += [f"column {c!r} not found" for c in within if c not in df.columns]
    if not keys:
        problems.append("sort_rank needs a key")
    if rank_column is not None and (rank_column in df.columns or rank_column.startswith("_")):
        problems.append(f"rank column {rank_column!r} is taken or reserved")
    for key in keys:
        declared = contract.get(key.column) if contract else None
        if declared is not None and declared.nullable and key.nulls is None:
            problems.append(f"sort key {key.column!r} is nullable, so it must place its nulls")
    if problems:
        raise ContractError("; ".join(problems))
    for key in keys:
        if key.order is not None:
            stray = unranked_values(df, key)
            if stray:
                raise StepRefused(
                    f"column {key.column!r} holds {stray}, which its stated order does not rank")
    tables = [present_value(name(c), df.schema[c].dataType) for c in within]
    order = [*[t.asc_nulls_last() for t in tables], *sort_columns(df, keys), F.col("_from").asc()]
    frame = df.withColumn("_from", F.col(ORD))
    step = Step(frame, ("_from",), "sorted", tuple(order))
    if rank_column is None:
        return step
    ranked = step.numbered()
    if within:
        # A row per table, not per row: where each begins.
        starts = ranked.groupBy(*[t.alias(f"_in{i}") for i, t in enumerate(tables)]).agg(F.min(ORD).alias("_start"))
        test = F.lit(True)
        for i, t in enumerate(tables):
            test = test & t.eqNullSafe(F.col(f"_in{i}"))
        ranked = ranked.join(starts, test).withColumn(rank_column, F.col(ORD) - F.col("_start") + 1)
    else:
        ranked = ranked.withColumn(rank_column, F.col(ORD) + 1)
    shown = [c for c in data_columns(ranked) if c != rank_column] + [rank_column]
    return Step(ranked.select(*[name(c) for c in shown], ORD, "_from"), ("_from",), "same")


def review_order(df: DataFrame, sort: Sequence[tuple[str, str]]) -> list[Column]:
    """A review queue's order: stable, and an absent value last whichever the direction."""
    made = []
    for column, direction in sort:
        if column not in df.columns:
            raise ContractError(f"the queue is ordered by {column!r}, which its rows do not carry")
        if isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ContractError(f"{column!r} has no order")
        if direction not in ("ascending", "descending"):
            raise ContractError(f"{column!r}: direction is ascending or descending")
        value = present_value(name(column), df.schema[column].dataType)
        made.append(value.desc_nulls_last() if direction == "descending" else value.asc_nulls_last())
    return [*made, F.col(ORD).asc()]


# ── union ──────────────────────────────────────────────────────────────────

def union(*frames: DataFrame, contracts: Sequence[Table] | None = None) -> Step:
    """All rows of every input, in declared order, duplicates kept. Columns are those of the first."""
    if len(frames) < 2:
        raise ContractError("a union takes two inputs or more")
    if contracts is not None:
        for position, contract in enumerate(contracts[1:], start=1):
            differing = contracts[0].differing(contract)
            if differing:
                raise ContractError(f"input {position} differs from input 0 on {sorted(differing)}")
    names = data_columns(frames[0])
    for position, frame in enumerate(frames[1:], start=1):
        odd = set(data_columns(frame)) ^ set(names)
        if odd:
            raise ContractError(f"input {position} does not carry the same columns: {sorted(odd)}")
    target = {c: promoted([f.schema[c].dataType for f in frames], c) for c in names}
    numbered = all(ORD in f.columns for f in frames)
    parts = []
    for position, frame in enumerate(frames):
        cells = [name(c) if frame.schema[c].dataType == target[c] else
                 name(c).cast(target[c]).alias(c) for c in names]
        hidden = []
        if numbered:
            hidden = [F.lit(position).alias("_input"), F.col(ORD)] + [
                (F.col(ORD) if i == position else F.lit(None).cast("bigint")).alias(f"_from{i}")
                for i in range(len(frames))]
        parts.append(frame.select(*cells, *hidden))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if not numbered:
        return Step(whole)
    parents = tuple(f"_from{i}" for i in range(len(frames)))
    return _Concatenated(whole, parents, "sorted",
                         (F.col("_input").asc(), F.col(ORD).asc()), inputs=len(frames))


@dataclass(frozen=True)
class _Concatenated(Step):
    """A union whose inputs are already numbered: positions shift by the rows before each input.

    Inputs that lost rows are numbered densely by blocks of their old positions first, all in one pass.
    """

    inputs: int = 0

    def numbered(self) -> DataFrame:
        if not self.landed:
            held = {r["_input"]: r for r in self.frame.groupBy("_input").agg(
                F.count(F.lit(1)).alias("rows"), F.max(ORD).alias("last")).collect()}
            if all(r["rows"] == r["last"] + 1 for r in held.values()):
                before, total = [], 0
                for i in range(self.inputs):
                    before.append(total)
                    total += held[i]["rows"] if i in held else 0
                shift = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("_input") + 1)
                self.landed.append(self.frame.withColumn(ORD, F.col(ORD) + shift))
            else:
                self.landed.append(self._dense())
        return self.landed[0]

    def _dense(self) -> DataFrame:
        block = ["_input", "_block"]
        blocked = self.frame.withColumn("_block", F.expr(f"`{ORD}` div {BLOCK}"))
        counts = blocked.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
        offsets = running_offsets(counts, block, "_rows", "_before").drop("_rows")
        within = F.row_number().over(W.partitionBy(*block).orderBy(ORD)) - 1
        return (blocked.withColumn("_within", within).join(offsets, block)
                .withColumn(ORD, (F.col("_before") + F.col("_within")).cast("bigint")).select(*self.frame.columns))
