"""A workflow as named steps over named inputs: lazy tables, no run loop.

Building a step only composes DataFrames; Spark plans and runs what an action needs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.errors import ContractError
from rowproof.operators.filter import rows_at, window
from rowproof.ordinals import ORD
from rowproof.schema import Signature, Table
from rowproof.step import Step

# Step kinds whose output row i comes from input row i.
SOURCE = "input_data"
SAME_GRAIN = (SOURCE, "python_row_function", "llm_transform", "human_review_queue")


@dataclass(frozen=True)
class StageDef:
    """`make` takes the input tables in order and returns a Step, or a plain table for a source."""

    id: str
    kind: str
    make: Callable[..., Step | DataFrame]
    inputs: tuple[str, ...] = ()
    signature: Signature | None = None

    @property
    def same_grain(self) -> bool:
        return self.kind in SAME_GRAIN or self.kind == "enrich"


@dataclass
class Workflow:
    stages: Sequence[StageDef]
    _by_id: dict[str, StageDef] = field(init=False)

    def __post_init__(self) -> None:
        self._by_id = {s.id: s for s in self.stages}
        if len(self._by_id) != len(self.stages):
            raise ContractError("stage ids repeat")
        unknown = sorted({i for s in self.stages for i in s.inputs} - set(self._by_id))
        if unknown:
            raise ContractError(f"inputs name no stage: {unknown}")
        self.upstream_first(self._by_id)

    def __getitem__(self, stage: str) -> StageDef:
        if stage not in self._by_id:
            raise ContractError(f"no stage {stage!r}; the workflow has {sorted(self._by_id)}")
        return self._by_id[stage]

    def upstream_first(self, wanted: Iterable[str], stop: Iterable[str] = ()) -> list[str]:
        """The wanted stages and all they read, inputs before readers; `stop` are not looked behind."""
        order: list[str] = []
        open_: set[str] = set()
        stop = set(stop)

        def visit(stage: str) -> None:
            if stage in order:
                return
            if stage in open_:
                raise ContractError(f"stage {stage!r} reads its own output")
            open_.add(stage)
            if stage not in stop:
                for parent in self[stage].inputs:
                    visit(parent)
            order.append(stage)

        for stage in wanted:
            visit(stage)
        return order

    def schemas(self, sources: Mapping[str, Table]) -> dict[str, Table]:
        """Declared output of every stage with a signature, checked edge by edge before any job."""
        found: dict[str, Table] = dict(sources)
        for stage in self.upstream_first(self._by_id):
            spec = self[stage]
            if stage in found or spec.signature is None:
                continue
            missing = [i for i in spec.inputs if i not in found]
            if missing:
                raise ContractError(f"stage {stage!r} reads {missing}, whose columns are not declared")
            try:
                found[stage] = spec.signature.output({i: found[i] for i in spec.inputs})
            except ContractError as error:
                raise ContractError(f"stage {stage!r}: {error}") from error
        return found

    def build(self, wanted: Sequence[str], given: Mapping[str, DataFrame] | None = None,
              stored: Sequence[str] = ()) -> "Run":
        """Steps for the wanted stages. A stage in `given` is not built: its table is used as it is.

        The numbered rows of a stage in `stored` are written once, and its readers, edges and
        traces use that copy; the others are worked out again by each use.
        """
        given = dict(given or {})
        run = Run(self, {})
        for stage in self.upstream_first(wanted, given):
            if stage in given:
                run.steps[stage] = Step(given[stage], (ORD,))
                run.given.add(stage)
                continue
            spec = self[stage]
            made = spec.make(*[run.table(i) for i in spec.inputs])
            step = made if isinstance(made, Step) else Step(made, (ORD,))
            run.steps[stage] = step.stored() if stage in stored else step
        return run


@dataclass
class Run:
    """The built steps of a workflow; tables are numbered when they are asked for."""

    workflow: Workflow
    steps: dict[str, Step]
    given: set[str] = field(default_factory=set)

    def table(self, stage: str) -> DataFrame:
        step = self.steps[stage]
        return step.frame if step.numbering == "same" else step.output()

    def edges(self, *stages: str) -> DataFrame:
        """The recorded parents of every row of the given stages, or of all that record them."""
        wanted = stages or tuple(
            s for s in self.steps if s not in self.given and self.workflow[s].inputs)
        whole: DataFrame | None = None
        for stage in wanted:
            part = self.steps[stage].edges(stage, *self.workflow[stage].inputs)
            whole = part if whole is None else whole.unionByName(part)
        if whole is None:
            raise ContractError("no stage here records parents")
        return whole


def run_slice(workflow: Workflow, overrides: Mapping[str, DataFrame], target: str) -> DataFrame:
    """The target's table when `overrides` stand in for what their stages would have produced."""
    if not overrides:
        raise ContractError("a slice starts from at least one replaced stage")
    reached = workflow.upstream_first([target], overrides)
    unused = sorted(set(overrides) - set(reached))
    if unused:
        raise ContractError(f"{target!r} does not depend on {unused}")
    if target in overrides:
        raise ContractError(f"{target!r} is itself replaced")
    return workflow.build([target], overrides).table(target)


def grain_blockers(workflow: Workflow, override: str, target: str) -> list[str]:
    """Stages between the two that do not keep one row per row; scoring by position needs none."""
    between = workflow.upstream_first([target], [override])
    if override not in between:
        raise ContractError(f"{target!r} does not depend on {override!r}")

    def depends(stage: str) -> bool:
        return stage == override or any(depends(i) for i in workflow[stage].inputs)

    return [s for s in between if s != override and depends(s) and not (
        workflow[s].same_grain and depends(workflow[s].inputs[0]))]


def slice_run(workflow: Workflow, sources: Mapping[str, DataFrame], limit: int | None = None,
              offset: int = 0, stages: Sequence[str] | None = None) -> Run:
    """A trial of the workflow on a window of each source; review steps should approve on their own."""
    held = [s.id for s in workflow.stages if s.kind == SOURCE]
    if not held:
        raise ContractError("the workflow reads no source")
    cut = {s: window(sources[s], offset, limit).frame for s in held if s in sources}
    read = {i for s in workflow.stages for i in s.inputs}
    wanted = list(stages) if stages is not None else [s.id for s in workflow.stages if s.id not in read]
    return workflow.build(wanted, cut)


def preview(make: Callable[..., Step | DataFrame], first: DataFrame, ordinals: Sequence[int],
            *others: DataFrame) -> tuple[DataFrame, list[int]]:
    """One operator on chosen rows of its first input, the other inputs whole; nothing is written.

    Positions outside the table and repeats are dropped; the chosen rows are renumbered in the
    order they were named.
    """
    asked = list(dict.fromkeys(o for o in ordinals if isinstance(o, int) and o >= 0))
    found = first.where(F.col(ORD).isin(asked))
    held = {r[0] for r in found.select(ORD).collect()}
    chosen = [o for o in asked if o in held]
    if not chosen:
        raise ContractError("no chosen row is in the table")
    place = F.array_position(F.array(*[F.lit(o).cast("bigint") for o in chosen]), F.col(ORD)) - 1
    made = make(rows_at(first, chosen).withColumn(ORD, place.cast("bigint")), *others)
    return (made.rows if isinstance(made, Step) else made), chosen
