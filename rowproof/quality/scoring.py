"""Scoring a workflow slice against labelled rows, and judging a step by its own cases."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import ContractError, GrainError, StepRefused
from rowproof.functions.predicate import absent, name
from rowproof.functions.text import canonical_json
from rowproof.operators.project import failure_kind, narrow
from rowproof.ordinals import ORD
from rowproof.quality.profile import profile
from rowproof.quality.runs import latest_run
from rowproof.quality.validate import ERROR, row_checks, shape_issues
from rowproof.schema import Table

METRICS = ("exact", "abs_tol", "sign")


@dataclass(frozen=True)
class Expect:
    """`expected` of the dataset against `output` of the target, under one metric."""

    output: str
    metric: str = "exact"
    tolerance: float | None = None
    expected: str | None = None

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ContractError(f"unknown metric {self.metric!r}")
        if (self.metric == "abs_tol") != (self.tolerance is not None):
            raise ContractError("a tolerance belongs to abs_tol, which needs one")


def check_expectations(target: Table, checks: Sequence[Expect]) -> None:
    problems = []
    for check in checks:
        column = target.get(check.output)
        if column is None:
            problems.append(f"the target emits no column {check.output!r}")
        elif check.metric in ("abs_tol", "sign") and column.type not in ("int", "float"):
            problems.append(f"{check.metric} compares numbers, and {check.output!r} is {column.type}")
    if problems:
        raise ContractError("; ".join(problems))


def deconflicted(override: Sequence[str], expected: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Dataset names for injected and expected columns: a shared one is prefixed on both sides."""
    shared = set(override) & set(expected)
    return ({c: f"override.{c}" if c in shared else c for c in override},
            {c: f"output.{c}" if c in shared else c for c in dict.fromkeys(expected)})


def injected_table(dataset: DataFrame, override: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """The override stage's columns out of a dataset, under their own names."""
    names, _ = deconflicted(override, expected)
    missing = sorted(n for n in names.values() if n not in dataset.columns)
    if missing:
        raise ContractError(f"the dataset lacks {missing}")
    return dataset.select(*[name(n).alias(c) for c, n in names.items()], ORD)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text" if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else dtype.simpleString()


def _matches(check: Expect, e: Column, a: Column, e_type, a_type) -> Column:
    if check.metric == "exact":
        # Values of two families, such as text and numbers or truth values and numbers, are never equal, as in predicates.
        test = e == a if _family(e_type) == _family(a_type) else F.lit(False)
    elif check.metric == "abs_tol":
        test = F.abs(a.cast("double") - e.cast("double")) <= check.tolerance
    else:
        test = F.signum(a.cast("double")) == F.signum(e.cast("double"))
    return F.coalesce(~absent(e, e_type) & ~absent(a, a_type) & test, F.lit(False))


def score(dataset: DataFrame, target: DataFrame, checks: Sequence[Expect],
          override: Sequence[str] = ()) -> DataFrame:
    """Per row: `<c>__expected`, `<c>__actual`, `<c>__match` per check, and `row_passed`.

    Rows are aligned by position; an absent value on either side does not match.
    """
    n, m = dataset.count(), target.count()
    if n != m:
        raise GrainError(f"the dataset has {n} row(s) but the target produced {m}: "
                         "rows cannot be aligned to score")
    return scored(dataset, target, checks, override)


def scored(dataset: DataFrame, target: DataFrame, checks: Sequence[Expect],
           override: Sequence[str] = ()) -> DataFrame:
    """`score` without counting the rows first."""
    _, names = deconflicted(override, [c.output for c in checks])
    wanted = [c.expected or names[c.output] for c in checks]
    left = dataset.select(ORD, *[name(w).alias(f"_e{i}") for i, w in enumerate(wanted)])
    right = target.select(ORD, *[name(c.output).alias(f"_a{i}") for i, c in enumerate(checks)])
    cells, flags = [], []
    for i, c in enumerate(checks):
        e, a = F.col(f"_e{i}"), F.col(f"_a{i}")
        flag = _matches(c, e, a, dataset.schema[wanted[i]].dataType, target.schema[c.output].dataType)
        cells += [e.alias(f"{c.output}__expected"), a.alias(f"{c.output}__actual"), flag.alias(f"{c.output}__match")]
        flags.append(flag)
    passed = F.lit(True)
    for flag in flags:
        passed = passed & flag
    return left.join(right, ORD).select(ORD, *cells, passed.alias("row_passed"))


def checked_columns(result: DataFrame) -> list[str]:
    """Columns scored in full: expected, actual and match are all there."""
    scored_names = [c.removesuffix("__match") for c in result.columns if c.endswith("__match")]
    return [c for c in scored_names if {f"{c}__expected", f"{c}__actual"} <= set(result.columns)]


def _verdict(result: DataFrame) -> Column:
    if "row_passed" in result.columns:
        return name("row_passed")
    passed = F.lit(True)
    for c in checked_columns(result):
        passed = passed & name(f"{c}__match")
    return passed


def rollup(result: DataFrame) -> DataFrame:
    """rows_scored, rows_passed, accuracy and accuracy.<column>; zero rows score 0.0."""
    def share(flag: Column) -> Column:
        return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))
    return result.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(_verdict(result)).alias("rows_passed"),
        share(_verdict(result)).alias("accuracy"),
        *[share(name(f"{c}__match")).alias(f"accuracy.{c}") for c in checked_columns(result)])


def check_counts(result: DataFrame) -> DataFrame:
    """column, matched, failed per check, one pass."""
    checks = checked_columns(result)
    counts = result.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(name(f"{c}__match")).alias(f"m{i}") for i, c in enumerate(checks)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("matched"),
                 (F.col("n") - F.col(f"m{i}")).alias("failed")) for i, c in enumerate(checks)])))


def failed_rows(result: DataFrame) -> DataFrame:
    return result.where(~F.coalesce(_verdict(result), F.lit(False)))


def score_with(fn: Callable[[DataFrame, DataFrame], DataFrame], target: DataFrame, dataset: DataFrame) -> DataFrame:
    """An authored scorer: whole tables in, a table of metrics out."""
    made = fn(target, dataset)
    if not isinstance(made, DataFrame):
        raise TypeError(f"a scorer returned {type(made).__name__}, not a DataFrame")
    return made


def coverage(runs: DataFrame, version: str | None) -> DataFrame:
    """The newest scored run of each eval judged: stale, mismatches or checked, worst first.

    `runs` holds eval_name, run_id, status, workflow_version, rows_passed, rows_total. A verdict
    on another version is stale whatever it scored.
    """
    newest = W.partitionBy("eval_name").orderBy(F.desc("run_id"))
    latest = (runs.where(F.col("status") == "scored").withColumn("_n", F.row_number().over(newest))
              .where(F.col("_n") == 1))
    same = F.lit(False) if version is None else F.col("workflow_version") == version
    verdict = (F.when(~same, "stale").when(F.col("rows_passed") == F.col("rows_total"), "checked")
               .otherwise("mismatches"))
    worst = (F.when(F.col("coverage") == "mismatches", 0).when(F.col("coverage") == "stale", 1).otherwise(2))
    return (latest.withColumn("coverage", verdict)
            .select("eval_name", "coverage", "rows_passed", "rows_total", "workflow_version")
            .orderBy(worst, "eval_name"))


# ── a step's own cases ─────────────────────────────────────────────────────


def run_cases(make: Callable[..., DataFrame], inputs: Mapping[str, DataFrame], expected: DataFrame,
              columns: Sequence[str], contracts: Mapping[str, Table] | None = None,
              must_fail: Sequence[str] = ()) -> DataFrame:
    """case_id, status and detail: passed, mismatch, malformed or error.

    All cases run through the step at once, told apart by `case_id`, which the step must carry
    through; aggregate, dedupe and sort_rank do so by `within=["case_id"]`. Rows are compared without regard to order. A case in `must_fail` is run alone,
    since a refusal ends the job it happens in; its inputs are the case's own small rows.
    """
    malformed = _malformed(inputs, contracts or {})
    bad = malformed.select("case_id").distinct()
    alone = [str(c) for c in must_fail]

    def sound(df: DataFrame) -> DataFrame:
        return df.where(~F.col("case_id").isin(alone)).join(bad, "case_id", "left_anti")

    cases = expected.select("case_id").distinct()
    for df in inputs.values():
        cases = cases.unionByName(df.select("case_id").distinct())
    cases = cases.distinct().where(~F.col("case_id").isin(alone))
    actual = make(*[sound(df) for df in inputs.values()])
    key = ["case_id", "_cells"]

    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select("case_id", canonical_json(df, list(columns)).alias("_cells"),
                         F.lit(sign).alias("_side"))

    balance = (counted(sound(expected), 1).unionByName(counted(actual, -1)).groupBy(*key)
               .agg(F.sum("_side").alias("_n"), F.count_if(F.col("_side") == 1).alias("_e"),
                    F.count_if(F.col("_side") == -1).alias("_a")))
    per_case = balance.groupBy("case_id").agg(
        F.sum(F.abs("_n")).alias("_off"), F.sum("_e").alias("_e"), F.sum("_a").alias("_a"))
    detail = (F.when(F.col("_e") != F.col("_a"), F.concat(
        F.lit("expected "), F.col("_e").cast("string"), F.lit(" row(s), got "), F.col("_a").cast("string")))
        .when(F.col("_off") > 0, F.concat((F.col("_off") / 2).cast("bigint").cast("string"),
                                          F.lit(" row(s) differ"))))
    judged = cases.join(per_case, "case_id", "left").join(malformed, "case_id", "left").select(
        "case_id", F.when(F.col("problem").isNotNull(), "malformed")
        .when(F.coalesce("_off", F.lit(0)) == 0, "passed").otherwise("mismatch").alias("status"),
        F.coalesce("problem", detail).alias("detail"))
    lone = [_failing_case(make, inputs, case) for case in alone]
    if not lone:
        return judged
    spark = expected.sparkSession
    lone_table = spark.createDataFrame(lone, "case_id string, status string, detail string")
    return judged.withColumn("case_id", F.col("case_id").cast("string")).unionByName(lone_table)


def _malformed(inputs: Mapping[str, DataFrame], contracts: Mapping[str, Table]) -> DataFrame:
    parts = []
    for label, df in inputs.items():
        contract = contracts.get(label)
        if contract is None:
            continue
        shape = [i.message for i in shape_issues(df, contract) if i.severity == ERROR]
        texts = [F.lit(m) for m in shape] + [
            F.when(c.broken, F.lit(f"{c.column.name}: {c.kind}")) for c in row_checks(df, contract)]
        if texts:
            said = F.nullif(F.concat_ws("; ", *texts), F.lit(""))
            parts.append(df.select("case_id", said.alias("problem"), F.lit(label).alias("label")))
    if not parts:
        any_input = next(iter(inputs.values()))
        return any_input.select("case_id", F.lit(None).cast("string").alias("problem")).limit(0)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    said = F.min(F.concat(F.lit("input "), F.col("label"), F.lit(": "), F.col("problem")))
    return whole.where(F.col("problem").isNotNull()).groupBy("case_id").agg(said.alias("problem"))


def _failing_case(make: Callable[..., DataFrame], inputs: Mapping[str, DataFrame],
                  case: str) -> tuple[str, str, str]:
    try:
        made = make(*[df.where(F.col("case_id") == case) for df in inputs.values()])
        rows = made.select(*[name(c) for c in made.columns]).toPandas()
    except Exception as error:  # noqa: BLE001 - whatever the step raises is the result
        if isinstance(error, StepRefused) or failure_kind(error) == "refused":
            return case, "passed", str(error)[:500]
        return case, "error", f"{type(error).__name__}: {str(error)[:500]}"
    return case, "mismatch", f"expected the step to fail, got {len(rows)} row(s)"


def example_rows(outputs: Mapping[str, DataFrame], runs: DataFrame, stage: str, reads: Sequence[str],
                 values: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows of the newest finished run that wrote `stage`, narrowed to `reads`, and their profile.

    `outputs` maps run ids to that stage's table; `runs` holds run_id, stage_id, status.
    """
    found = latest_run(runs, stage).first()
    if found is None or found["run_id"] not in outputs:
        raise ContractError(f"no run finished {stage!r}, so there are no rows to choose from")
    table = narrow(outputs[found["run_id"]], reads)
    if table.isEmpty():
        raise ContractError(f"{stage!r} produced no rows in run {found['run_id']}")
    return table, profile(table, list(reads), values)

