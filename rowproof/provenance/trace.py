"""Following rows back to where they came from.

Stages are visited once each, readers before what they read, so every stage's recorded
parents are joined exactly once however many rows are traced.
"""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError, StepRefused
from rowproof.functions.predicate import name
from rowproof.ordinals import ORD, data_columns
from rowproof.plans.workflow import SAME_GRAIN, SOURCE
from rowproof.session import land
from rowproof.step import CONTRIBUTION, DIRECT

NAMED, LINKED = 3, 500
# Where a step kind's columns come from.
ORIGINS = {"input_data": "source", "python_row_function": "computed", "llm_transform": "llm"}


@dataclass(frozen=True)
class Stage:
    """One stage as a run left it. `edges` is absent where rows are aligned by position alone."""

    kind: str
    inputs: tuple[str, ...] = ()
    table: DataFrame | None = None
    edges: DataFrame | None = None

    @property
    def positional(self) -> bool:
        return self.edges is None and self.kind in SAME_GRAIN and len(self.inputs) == 1


History = Mapping[str, Stage]


def readers_first(history: History) -> list[str]:
    order: list[str] = []

    def visit(stage: str) -> None:
        if stage not in order:
            for parent in history[stage].inputs:
                if parent in history:
                    visit(parent)
            order.append(stage)

    for stage in history:
        visit(stage)
    return order[::-1]


def _direct(history: History, stage: str) -> DataFrame | None:
    edges = history[stage].edges
    if edges is None:
        return None
    return edges.where((F.col("stage") == stage) & (F.col("kind") == DIRECT)
                       & (F.col("parent_stage") != stage))


def _followed(edges: DataFrame) -> DataFrame:
    """The first direct parent of each row. A row has few direct parents: one per input."""
    place = F.row_number().over(W.partitionBy("ord").orderBy("pos", "parent_stage", "parent_ord"))
    return edges.withColumn("_place", place)


# ── one row ────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Visit:
    """A row that a walk came through, and what its stage did to it."""

    stage: str
    ord: int
    cells: dict[str, Any]
    introduced: list[str]             # columns that the row it was made from does not have
    made_by: str
    beside: list[tuple[str, int]]     # rows it was also made from, which the walk did not follow
    fed_by: int                       # rows that only contributed figures
    read_from: tuple[str, int] | None # file and row of the file


@dataclass(frozen=True)
class Walk:
    """`ends` is `origin`, `summary`, `unrecorded`, or `gone` where the next row is not to be found."""

    steps: list[Visit]
    ends: str


def trace_row(history: History, stage: str, ordinal: int) -> Walk:
    """One row's walk back: the bulk walk of a single seed, then one read of all rows met and one of their links."""
    if stage not in history:
        raise ContractError(f"stage {stage!r} is not in this run")
    tables = [s.table for s in history.values() if s.table is not None]
    seeds = tables[0].sparkSession.createDataFrame([(stage, ordinal)], "stage string, ord bigint")
    walked = sorted(trace_rows(history, seeds).collect(), key=lambda r: r["step"])
    cells, links = _cells_met(history, walked), _links_met(history, walked)
    if 0 not in cells:
        raise IndexError(f"stage {stage!r} holds no row {ordinal}")
    steps: list[Visit] = []
    onward = [r["stage"] for r in walked[1:]] + [None]
    for row, source in zip(walked, onward):
        if row["step"] not in cells:
            return Walk(steps, "gone")
        spec = history[row["stage"]]
        if source is None and len(spec.inputs) == 1:
            source = spec.inputs[0]
        known = set(data_columns(history[source].table)) if source in history and history[source].table is not None else set()
        direct = links.get(row["step"], [])
        followed = direct[0] if direct else None
        steps.append(Visit(
            row["stage"], row["ord"], cells[row["step"]], [c for c in data_columns(spec.table) if c not in known],
            ORIGINS.get(spec.kind, "other"), [(r["parent_stage"], r["parent_ord"]) for r in direct[1:]],
            followed["fed_by"] if followed else links.get(("fed", row["step"]), 0),
            (followed["source_file"], followed["parent_ord"]) if followed and followed["source_file"] else None))
    return Walk(steps, walked[-1]["ends"] or "gone")


def _cells_met(history: History, walked: Sequence[Row]) -> dict[int, dict[str, Any]]:
    """Each step's cells, from one job over the tables met; a cell that is no finite number is null."""
    parts = []
    for row in walked:
        table = history[row["stage"]].table
        if table is None:
            continue
        shown = [F.when(F.abs(name(c)) < float("inf"), name(c)).alias(c) if isinstance(table.schema[c].dataType, (T.DoubleType, T.FloatType))
                 else name(c) for c in data_columns(table)]
        parts.append(table.where(F.col(ORD) == row["ord"]).select(
            F.lit(row["step"]).alias("step"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("cells")))
    return {r["step"]: json.loads(r["cells"]) for r in _all(parts).collect()} if parts else {}


def _links_met(history: History, walked: Sequence[Row]) -> dict[Any, Any]:
    """Each step's direct links in order, and the number of rows that fed it, from one job over the edges met."""
    parts = []
    for row in walked:
        edges = history[row["stage"]].edges
        if edges is None:
            continue
        mine = edges.where((F.col("stage") == row["stage"]) & (F.col("ord") == row["ord"]))
        fed = F.count_if(F.col("kind") == CONTRIBUTION).alias("fed_by")
        link = F.when(F.col("kind") == DIRECT, F.struct("pos", "parent_stage", "parent_ord", "source_file"))
        # A row has few direct links, one per input; contributors are counted, not gathered.
        parts.append(mine.groupBy(F.lit(row["step"]).alias("step")).agg(F.sort_array(F.collect_list(link)).alias("links"), fed))
    found: dict[Any, Any] = {}
    for r in _all(parts).collect() if parts else []:
        found["fed", r["step"]] = r["fed_by"]
        found[r["step"]] = [{**link.asDict(), "fed_by": r["fed_by"]} for link in r["links"]]
    return found


# ── many rows ──────────────────────────────────────────────────────────────


def _seeded(history: History, seeds: DataFrame) -> tuple[DataFrame, list[str]]:
    """The seeds written once, and the stages a walk from them can meet, readers first."""
    landed = land(seeds.select("stage", F.col("ord").cast("bigint").alias("ord")), "seeds")
    met: set[str] = set()
    open_ = [r[0] for r in landed.select("stage").distinct().collect()]
    unknown = sorted(set(open_) - set(history))
    if unknown:
        raise ContractError(f"seeds name stages that are not in this run: {unknown}")
    while open_:
        stage = open_.pop()
        if stage not in met and stage in history:
            met.add(stage)
            open_ += history[stage].inputs
    return landed, [s for s in readers_first(history) if s in met]


def trace_rows(history: History, seeds: DataFrame) -> DataFrame:
    """Every step of every seed (stage, ord): seed_stage, seed_ord, step, stage, ord, ends.

    `ends` says why a walk stopped there and is null on the rows it passed through.
    """
    seeds, order = _seeded(history, seeds)
    arrivals: dict[str, list[DataFrame]] = {s: [] for s in order}
    for stage in order:
        arrivals[stage].append(seeds.where(F.col("stage") == stage).select(
            F.col("stage").alias("seed_stage"), F.col("ord").alias("seed_ord"),
            F.lit(0).alias("step"), "ord"))
    passed: DataFrame | None = None
    for stage in order:
        spec, here = history[stage], _all(arrivals[stage])
        walked, moved = _advance(history, stage, spec, here)
        passed = walked if passed is None else passed.unionByName(walked)
        for parent in dict.fromkeys(spec.inputs):
            if moved is not None and parent in arrivals:
                arrivals[parent].append(moved.where(F.col("parent_stage") == parent).select(
                    "seed_stage", "seed_ord", (F.col("step") + 1).alias("step"),
                    F.col("parent_ord").alias("ord")))
    assert passed is not None
    return passed


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _advance(history: History, stage: str, spec: Stage,
             here: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    def shown(df: DataFrame, ends) -> DataFrame:
        return df.select("seed_stage", "seed_ord", "step", F.lit(stage).alias("stage"), "ord",
                         ends.cast("string").alias("ends"))

    if spec.kind == SOURCE:
        return shown(here, F.lit("origin")), None
    direct = _direct(history, stage)
    if direct is not None:
        direct = direct.join(here.select("ord"), "ord", "left_semi")
        first = _followed(direct).where(F.col("_place") == 1).select("ord", "parent_stage", "parent_ord")
        # The joined stage is written once: its rows are both reported and walked on from.
        moved = land(here.join(first, "ord", "left"), "trace")
        return shown(moved, F.when(F.col("parent_ord").isNull(), F.lit("summary"))), moved.where(
            F.col("parent_ord").isNotNull())
    if spec.positional:
        moved = here.withColumns({"parent_stage": F.lit(spec.inputs[0]), "parent_ord": F.col("ord")})
        return shown(here, F.lit(None)), moved
    return shown(here, F.lit("unrecorded")), None


def closure(history: History, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Every row owed an explanation when `seeds` (stage, ord) are published: stage, ord, paged.

    A seed and each parent its walk did not follow are `paged`; the rows a walk passes through
    are not, unless they are reached as a branch too. More paged rows than `cap` are refused
    whole, never cut: pass None for no limit.
    """
    seeds, order = _seeded(history, seeds)
    arrivals: dict[str, list[DataFrame]] = {s: [] for s in order}
    for stage in order:
        arrivals[stage].append(seeds.where(F.col("stage") == stage).select(
            "ord", F.lit(True).alias("paged")))
    found: DataFrame | None = None
    for stage in order:
        spec = history[stage]
        here = _all(arrivals[stage]).groupBy("ord").agg(F.bool_or("paged").alias("paged"))
        kept = here.select(F.lit(stage).alias("stage"), "ord", "paged")
        found = kept if found is None else found.unionByName(kept)
        if spec.kind == SOURCE:
            continue
        reached: DataFrame | None = None
        if spec.edges is not None:
            mine = spec.edges.where((F.col("stage") == stage) & (F.col("parent_stage") != stage))
            mine = mine.join(here.select("ord"), "ord", "left_semi")
            direct = _followed(mine.where(F.col("kind") == DIRECT))
            # Written once, so that a stage's edges are joined once whatever number of inputs it has.
            reached = land(direct.select("parent_stage", "parent_ord", (F.col("_place") > 1).alias("paged")).unionByName(
                mine.where(F.col("kind") == CONTRIBUTION).select(
                    "parent_stage", "parent_ord", F.lit(True).alias("paged"))), "closure")
        elif spec.positional:
            reached = here.select(F.lit(spec.inputs[0]).alias("parent_stage"),
                                  F.col("ord").alias("parent_ord"), F.lit(False).alias("paged"))
        for parent in dict.fromkeys(spec.inputs):
            if reached is not None and parent in arrivals:
                arrivals[parent].append(reached.where(F.col("parent_stage") == parent).select(
                    F.col("parent_ord").alias("ord"), "paged"))
    assert found is not None
    if cap is not None:
        pages = found.where("paged").count()
        if pages > cap:
            raise StepRefused(f"{pages:,} rows feed the published ones, over the limit of {cap:,}; "
                              "a partial set would leave some looking unsourced")
    return found


# ── contributors ───────────────────────────────────────────────────────────


def contributors(edges: DataFrame, stage: str, ordinal: int | None = None,
                 linked: int = LINKED, named: int = NAMED) -> DataFrame:
    """Contributor cohorts by (parent stage, columns fed) of one output row, or of every one.

    `total` is exact. `rows` holds at most `linked` ordinals, kept by a per-partition limit
    before anything is gathered; `named` repeats them where the cohort is that small.
    """
    mine = edges.where((F.col("stage") == stage) & (F.col("kind") == CONTRIBUTION))
    if ordinal is not None:
        mine = mine.where(F.col("ord") == ordinal)
    mine = mine.select("ord", "parent_stage", F.coalesce("columns", F.array()).alias("columns"), "parent_ord")
    cohort = ["ord", "parent_stage", "columns"]
    totals = mine.groupBy(*cohort).agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy(*cohort).orderBy("parent_ord"))
    first = (mine.withColumn("_n", place).where(F.col("_n") <= linked).groupBy(*cohort)
             .agg(F.array_sort(F.collect_list("parent_ord")).alias("rows")))
    return totals.join(first, cohort).select(
        *cohort, "total", F.when(F.col("total") <= named, F.col("rows")).otherwise(F.array()).alias("named"),
        "rows")


def contributor_rows(edges: DataFrame, stage: str, ordinal: int, parent: str, table: DataFrame,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of one cohort, whole, from the parent's table."""
    mine = edges.where((F.col("stage") == stage) & (F.col("ord") == ordinal)
                       & (F.col("kind") == CONTRIBUTION) & (F.col("parent_stage") == parent))
    if columns is not None:
        mine = mine.where(F.col("columns") == F.array(*[F.lit(c) for c in columns]))
    return table.join(mine.select(F.col("parent_ord").alias(ORD)).distinct(), ORD, "left_semi").select(
        *[name(c) for c in table.columns])
