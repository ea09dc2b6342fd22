"""Calls to an outside service, one row or one batch of rows at a time, with verified rejoin."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowproof.errors import ContractError
from rowproof.functions.cells import written_columns
from rowproof.functions.predicate import name
from rowproof.functions.text import render_template, template_fields
from rowproof.ordinals import ORD, data_columns, number_kept
from rowproof.schema import Table
from rowproof.step import Step

ROW_NUMBER = "row_number"
USAGE = "input_tokens long, output_tokens long, calls long, cost_usd double, model string"
_USAGE_TYPE = T.StructType([
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("calls", T.LongType()), T.StructField("cost_usd", T.DoubleType()),
    T.StructField("model", T.StringType())])


class StageWideFailure(Exception):
    """A failure every other row would meet too: it ends the job instead of tagging rows."""


@dataclass(frozen=True)
class Reply:
    """What a call returned. In a batch each result carries the `row_number` it answers."""

    results: Sequence[Mapping[str, Any]]
    usage: Mapping[str, Any] = field(default_factory=dict)


# Called inside tasks with the rendered prompts and, on a re-ask, what was wrong with the last reply.
Caller = Callable[[Sequence[str], str | None], Reply]


def check_call(df: DataFrame, template: str, adds: Table, reads: Sequence[str]) -> None:
    problems = []
    fields = template_fields(template)
    missing = sorted(fields - set(data_columns(df)))
    unread = sorted((fields & set(data_columns(df))) - set(reads))
    if missing:
        problems.append(f"the template names {missing}, which are not columns")
    if unread:
        problems.append(f"the template names {unread}, which the step does not read")
    if not adds.columns:
        problems.append("a call adds at least one column")
    taken = sorted(c for c in adds.names if c in df.columns)
    if taken:
        problems.append(f"a call adds columns and rewrites none: {taken}")
    if problems:
        raise ContractError("; ".join(problems))


def call_rows(df: DataFrame, caller: Caller, adds: Table, template: str, batch_size: int = 1,
              max_retries: int = 2, reads: Sequence[str] | None = None, wait: float = 0.0,
              parallelism: int | None = None) -> Step:
    """Each row with the reply's columns, `_error` where its call failed, and `_usage`.

    Batches are `batch_size` rows that follow one another, whatever positions lie between them, so
    n rows take ceil(n / batch_size) calls and a retried task forms the same batches. A batched
    reply must answer exactly the items 0..n-1; one that does not is asked for again and then fails
    its whole batch. A value that a reply lacks or gives another type is a fault of its row alone. `parallelism` is how many tasks call at once: all
    cores by default for batches, the input's own partitions for single rows. Write the result
    before using it twice: a second evaluation calls again.
    """
    if batch_size < 1:
        raise ContractError("batch_size is at least 1")
    read = list(reads) if reads is not None else data_columns(df)
    check_call(df, template, adds, read)
    prompts = df.withColumn("_prompt", render_template(df, template))
    if batch_size > 1:
        # Positions alone are numbered, so texts are moved once, with their number.
        dense = number_kept(df.select(ORD), into="_dense").select(ORD, F.expr(f"_dense div {batch_size}").alias("_group"))
        prompts = prompts.join(dense, ORD)
    else:
        prompts = prompts.withColumn("_group", F.col(ORD))
    if batch_size > 1 or parallelism is not None:
        # A stated number of partitions is not merged at run time, however small they are.
        tasks = parallelism or df.sparkSession.sparkContext.defaultParallelism
        prompts = prompts.repartition(tasks, "_group").sortWithinPartitions("_group", ORD)
    flags = T.StructType([T.StructField("_error", T.StringType()), T.StructField("_usage", _USAGE_TYPE)])
    fields = [T.StructField(f.name, f.dataType) for f in adds.struct.fields] + list(flags.fields)
    schema = T.StructType(list(df.schema.fields) + fields)
    added, kept = adds.names, list(df.columns)
    types = to_arrow_schema(T.StructType(fields))
    nothing = {"input_tokens": 0, "output_tokens": 0, "calls": 0, "cost_usd": 0.0, "model": None}

    def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups in, the same rows with their replies out; other columns pass untouched."""
        groups = rows.column("_group").to_pylist()
        prompts_ = rows.column("_prompt").to_pylist()
        answered: list[Mapping[str, Any] | None] = []
        failed: list[str | None] = []
        spent: list[Mapping[str, Any]] = []
        start = 0
        while start < len(groups):
            end = start + 1
            while end < len(groups) and groups[end] == groups[start]:
                end += 1
            results, error, usage = _ask(caller, prompts_[start:end], batch_size > 1, max_retries, wait)
            answered += results[:end - start] if results else [None] * (end - start)
            failed += [error] * (end - start)
            spent += [usage, *[nothing] * (end - start - 1)]
            start = end
        cells, faults = written_columns(answered, [f for f in types if f.name in added])
        cells += [pa.array([e or f for e, f in zip(failed, faults)], pa.string()), pa.array(spent, types.field("_usage").type)]
        out = rows.select(kept)
        for f, column in zip(types, cells):
            out = out.append_column(f, column)
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A group may straddle two Arrow batches, so the last one is held back until it is whole.
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            groups = rows.column("_group").to_pylist()
            cut = len(groups)
            while cut and groups[cut - 1] == groups[-1]:
                cut -= 1
            held = rows.slice(cut)
            if cut:
                yield from answer(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield from answer(held)

    called = prompts.mapInArrow(run, schema)
    order = [*data_columns(df), *added, *[c for c in df.columns if c.startswith("_")], "_error", "_usage"]
    return Step(called.select(*[name(c) for c in order]), (ORD,))


def _ask(caller: Caller, prompts: list[str], batched: bool, max_retries: int,
         wait: float) -> tuple[list[Mapping[str, Any]] | None, str | None, dict[str, Any]]:
    spent: list[Mapping[str, Any]] = []
    problem, correction = "no reply", None
    for attempt in range(max_retries + 1):
        try:
            reply = caller(prompts, correction)
        except StageWideFailure:
            raise
        except TimeoutError as error:
            # Asking again after a full timeout multiplies the wait and changes nothing.
            return None, str(error) or "TimeoutError", _total(spent)
        except Exception as error:  # noqa: BLE001 - any failed call fails its rows, not the job
            problem, correction = str(error) or type(error).__name__, None
            if attempt < max_retries and wait:
                time.sleep(min(4.0, wait * (attempt + 1)))
            continue
        spent.append(reply.usage)
        if not batched:
            if reply.results:
                return [reply.results[0]], None, _total(spent)
            problem = "the reply holds no result"
            continue
        placed, problem = rejoin(reply.results, len(prompts))
        if placed is not None:
            return placed, None, _total(spent)
        correction = problem
    if batched and correction:
        problem = f"no usable batch reply in {max_retries + 1} call(s): {problem}"
    return None, problem, _total(spent)


def rejoin(results: Sequence[Mapping[str, Any]], n: int) -> tuple[list[Mapping[str, Any]] | None, str]:
    """Results in item order, or what is wrong: a repeat and a gap together keep the right length."""
    by_number: dict[Any, Mapping[str, Any]] = {}
    repeated, strange = set(), []
    for result in results:
        number = result.get(ROW_NUMBER)
        if not isinstance(number, int) or isinstance(number, bool) or not 0 <= number < n:
            strange.append(number)
        elif number in by_number:
            repeated.add(number)
        else:
            by_number[number] = result
    missing = [i for i in range(n) if i not in by_number]
    if missing or repeated or strange:
        return None, (f"items 0..{n - 1} are each answered once: unanswered {missing}, "
                      f"answered again {sorted(repeated)}, not asked for {sorted(strange, key=str)}")
    return [by_number[i] for i in range(n)], ""


def _total(parts: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    models = {p.get("model") for p in parts if p.get("model")}
    if len(models) > 1:
        raise StageWideFailure(f"usage of two models cannot be totalled: {sorted(models)}")
    return {"input_tokens": int(sum(p.get("input_tokens", 0) for p in parts)),
            "output_tokens": int(sum(p.get("output_tokens", 0) for p in parts)),
            "calls": int(sum(p.get("calls", 1) for p in parts)),
            "cost_usd": float(sum(p.get("cost_usd", 0.0) for p in parts)),
            "model": next(iter(models), None)}


def usage_total(df: DataFrame) -> DataFrame:
    """Tokens, calls and cost over a step's rows; refused when they name two models."""
    u = F.col("_usage")
    models = F.min(u["model"]).alias("model"), F.max(u["model"]).alias("_other")
    summed = df.agg(*[F.coalesce(F.sum(u[k]), F.lit(0)).alias(k)
                      for k in ("input_tokens", "output_tokens", "calls")],
                    F.coalesce(F.sum(u["cost_usd"]), F.lit(0.0)).alias("cost_usd"), *models)
    refused = F.raise_error(F.concat(F.lit("refused: usage of two models cannot be totalled: "),
                                     F.col("model"), F.lit(", "), F.col("_other"))).cast("string")
    return summed.select("input_tokens", "output_tokens", "calls", "cost_usd",
                         F.when(F.col("model") == F.col("_other"), F.col("model"))
                         .when(F.col("model").isNotNull(), refused).alias("model"))
