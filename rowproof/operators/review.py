"""Human review as joins: recorded decisions replayed, the rest queued or passed through."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError
from rowproof.functions.predicate import columns_read, mask, name
from rowproof.functions.text import cell_text, row_fingerprint
from rowproof.operators.reshape import review_order
from rowproof.ordinals import ORD, data_columns
from rowproof.step import Step

APPROVE, MODIFY, SKIPPED = "approve", "modify", "skipped"


@dataclass(frozen=True)
class Queue:
    """`reviewed` maps each source column to the column that carries the reviewed value."""

    reviewed: Mapping[str, str]
    verdict: str = "verdict"
    reviewer: str = "reviewer"
    reviewed_at: str = "reviewed_at"
    notes: str | None = None
    filter: str | None = None
    sort: Sequence[tuple[str, str]] = ()
    context: Sequence[str] | None = None
    instructions: str | None = None
    reads: Sequence[str] | None = None

    def read(self, df: DataFrame) -> list[str]:
        return list(self.reads) if self.reads is not None else data_columns(df)

    def added(self) -> list[str]:
        extra = [self.notes] if self.notes else []
        return [*self.reviewed.values(), self.verdict, self.reviewer, self.reviewed_at, *extra]

    def check(self, df: DataFrame) -> None:
        problems = []
        read, added = self.read(df), self.added()
        missing = sorted(c for c in {*self.reviewed, *read, *(self.context or ()), *(c for c, _ in self.sort)}
                         if c not in df.columns)
        if missing:
            problems.append(f"columns not found: {missing}")
        nested = [c for c in self.reviewed if c in df.columns and isinstance(
            df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
        if nested or not self.reviewed:
            problems.append(f"reviewed columns are scalar, and there is at least one: {nested}")
        taken = sorted({c for c in added if c in df.columns or added.count(c) > 1 or c.startswith("_")})
        if taken:
            problems.append(f"added names are taken, repeated or reserved: {taken}")
        unread = sorted({*self.reviewed, *(self.context or ()), *(c for c, _ in self.sort)} - set(read) - set(missing))
        if unread:
            problems.append(f"columns the queue shows or sorts by are not read: {unread}")
        both = sorted(set(self.context or ()) & set(self.reviewed))
        if both:
            problems.append(f"context columns are also reviewed: {both}")
        if self.filter and not missing:
            odd = sorted(columns_read(self.filter, df.columns) - set(df.columns))
            if odd:
                problems.append(f"the filter reads {odd}")
        if problems:
            raise ContractError("; ".join(problems))


# Fields that do not change which decision a row needs.
_INCIDENTAL = {"sort"}


def definition_fingerprint(kind: str, config: object, signature: object = None) -> str:
    """16 hex digits over what a step does: its kind, signature and behaviour, not its prose."""
    body = asdict(config) if hasattr(config, "__dataclass_fields__") else config  # type: ignore[call-overload]
    if isinstance(body, dict):
        body = {k: v for k, v in body.items() if k not in _INCIDENTAL}
    payload = json.dumps([kind, body, signature], sort_keys=True, default=str)
    return hashlib.sha1(payload.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Reviewed:
    """`done` holds every settled row; `pending` those awaiting a person, with `row_fp`, in order.

    A non-empty `pending` is what a halted run is: the caller decides whether to go on.
    """

    done: Step
    pending: DataFrame
    rows: DataFrame
    queue: Queue = field(repr=False, default_factory=lambda: Queue({}))


def latest_decisions(decisions: DataFrame, stage_fp: str) -> DataFrame:
    """The last decision recorded per row under one definition; one without a time comes before all others.

    Decisions of one time are told apart by their content, so that every run takes the same one.
    """
    mine = decisions.where(F.col("stage_fp") == stage_fp)
    rest = [c for c in decisions.columns if c not in ("stage_fp", "row_fp")]
    packed = F.struct(*[name(c) for c in rest])
    recorded = F.struct(F.coalesce(name("reviewed_at").cast("string"), F.lit("")), F.to_json(packed))
    return (mine.groupBy("row_fp").agg(F.max_by(packed, recorded).alias("_d"))
            .select("row_fp", "_d"))


def decisions_schema(df: DataFrame, queue: Queue) -> T.StructType:
    return T.StructType(
        [T.StructField("stage_fp", T.StringType()), T.StructField("row_fp", T.StringType())]
        + [T.StructField(t, df.schema[s].dataType) for s, t in queue.reviewed.items()]
        + [T.StructField(c, T.StringType()) for c in ("verdict", "reviewer", "reviewed_at", "notes")])


def review(df: DataFrame, queue: Queue, decisions: DataFrame | None = None,
           stage_fp: str | None = None, auto_approve: bool = False, test_run: bool = False) -> Reviewed:
    """Settle each row from its recorded decision, or pass it by, or queue it.

    A row keeps its recorded decision whatever the filter says; a row the filter does not
    select is `skipped`; the rest wait. `auto_approve` settles every row, in test runs only.
    """
    queue.check(df)
    stage_fp = stage_fp or definition_fingerprint("human_review_queue", queue)
    if auto_approve and not test_run:
        raise ContractError("only a test run approves on its own")
    named = df.withColumn("row_fp", row_fingerprint(df, queue.read(df)))
    if auto_approve:
        settled = named.withColumns({"_state": F.lit(APPROVE), "_d": F.lit(None)})
    else:
        selected = mask(queue.filter, df) if queue.filter else F.lit(True)
        if decisions is None:
            settled = named.withColumn("_d", F.lit(None))
            decided = F.lit(False)
        else:
            settled = named.join(latest_decisions(decisions, stage_fp), "row_fp", "left")
            decided = F.col("_d").isNotNull()
        settled = settled.withColumn(
            "_state", F.when(decided, "decided").when(selected, "pending").otherwise(SKIPPED))
    from_decision = decisions is not None and not auto_approve
    was_decided = F.col("_state") == "decided"

    def added(target: str, recorded: str, otherwise: Column, dtype: T.DataType) -> Column:
        value = F.when(was_decided, F.col("_d")[recorded]).otherwise(otherwise) if from_decision else otherwise
        return value.cast(dtype).alias(target)

    text = T.StringType()
    nothing = F.lit(None).cast("string")
    cells = [added(t, t, name(s), df.schema[s].dataType) for s, t in queue.reviewed.items()]
    cells.append(added(queue.verdict, "verdict", F.col("_state"), text))
    cells += [added(queue.reviewer, "reviewer", nothing, text),
              added(queue.reviewed_at, "reviewed_at", nothing, text)]
    if queue.notes:
        cells.append(added(queue.notes, "notes", nothing, text))
    rows = settled.select(*[name(c) for c in df.columns], "row_fp", "_state", *cells)
    done = rows.where(F.col("_state") != "pending").drop("row_fp", "_state")
    pending = (rows.where(F.col("_state") == "pending")
               .select("row_fp", *[name(c) for c in queue.read(df)], ORD))
    ordered = pending.orderBy(*(review_order(pending, queue.sort) if queue.sort else [F.col(ORD)]))
    return Reviewed(Step(done, (ORD,)), ordered, rows, queue)


def queue_stats(reviewed: Reviewed) -> DataFrame:
    """items_queued_total, items_passed_through, items_pending, items_decided: one pass."""
    state = F.col("_state")
    decided = F.count_if(state.isin("decided", APPROVE))
    pending = F.count_if(state == "pending")
    return reviewed.rows.agg(
        (pending + decided).alias("items_queued_total"),
        F.count_if(state == SKIPPED).alias("items_passed_through"),
        pending.alias("items_pending"), decided.alias("items_decided"))


def record_decisions(pending: DataFrame, answers: DataFrame, queue: Queue, stage_fp: str) -> DataFrame:
    """Decisions to append: an answer that changes a value is `modify`, one that changes none `approve`.

    `answers` holds row_fp, exactly the reviewed columns, reviewer, reviewed_at, and notes only
    where the queue declares them. An answer to a row that is not pending, and two different answers
    to one row, are refused by name before anything is recorded; the same answer given twice is one.
    """
    wanted = {"row_fp", "reviewer", "reviewed_at", *queue.reviewed.values()}
    held = set(answers.columns)
    if "verdict" in held:
        if not answers.where(F.col("verdict") == SKIPPED).isEmpty():
            raise ContractError("`skipped` records that nobody saw the row, so no reviewer may post it")
        held.discard("verdict")
    if "notes" in held:
        if not queue.notes:
            raise ContractError("notes were given, but the queue declares no notes column")
        held.discard("notes")
    if held != wanted:
        raise ContractError(f"answers lack {sorted(wanted - held)} and carry unknown {sorted(held - wanted)}")
    answers = answers.distinct()
    refuse_answers(pending, answers)
    prefill = pending.select("row_fp", *[name(s).alias(f"_was{i}") for i, s in enumerate(queue.reviewed)])
    # Equal rows share a fingerprint, and one decision answers them all.
    met = answers.join(prefill.dropDuplicates(["row_fp"]), "row_fp")
    changed = F.lit(False)
    for i, (source, target) in enumerate(queue.reviewed.items()):
        a = cell_text(name(target), answers.schema[target].dataType)
        b = cell_text(F.col(f"_was{i}"), pending.schema[source].dataType)
        changed = changed | ~a.eqNullSafe(b)
    notes = name("notes") if "notes" in answers.columns else F.lit(None).cast("string")
    return met.select(
        F.lit(stage_fp).alias("stage_fp"), "row_fp", *[name(t) for t in queue.reviewed.values()],
        F.when(changed, MODIFY).otherwise(APPROVE).alias("verdict"),
        "reviewer", "reviewed_at", notes.alias("notes"))


def refuse_answers(pending: DataFrame, answers: DataFrame, named: int = 5) -> None:
    """Refuse answers that no pending row asks for, or that several give to one row: one join of fingerprints."""
    given = answers.groupBy("row_fp").agg(F.count(F.lit(1)).alias("_given"))
    asked = pending.select("row_fp").distinct().withColumn("_asked", F.lit(True))
    odd = given.join(asked, "row_fp", "left").select("row_fp", F.when(F.col("_asked").isNull(), "unknown").when(
        F.col("_given") > 1, "double").alias("fault")).where("fault IS NOT NULL")
    counts = {r["fault"]: r["count"] for r in odd.groupBy("fault").count().collect()}
    if counts:
        shown = [f"{r['row_fp']} ({r['fault']})" for r in odd.orderBy("fault", "row_fp").limit(named).collect()]
        raise ContractError(f"{counts.get('unknown', 0)} answer(s) to rows that are not pending and {counts.get('double', 0)} row(s) "
                            f"answered in two ways: {', '.join(shown)}")


def _spelled(column: Column, dtype: T.DataType) -> Column:
    """One spelling per value: a midnight timestamp reads as its date, blank text as absent."""
    text = F.nullif(F.trim(cell_text(column, dtype)), F.lit(""))
    return F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[ T]00:00:00(\.0+)?$", "$1")


def departures(reviewed: Reviewed) -> DataFrame:
    """For each decided row, which reviewed values differ from the value received."""
    queue, rows = reviewed.queue, reviewed.rows
    flags = [(~_spelled(name(s), rows.schema[s].dataType).eqNullSafe(
        _spelled(name(t), rows.schema[t].dataType))).alias(f"{t}_departs") for s, t in queue.reviewed.items()]
    return rows.where(F.col("_state") == "decided").select(ORD, *flags)
