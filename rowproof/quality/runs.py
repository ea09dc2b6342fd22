"""Roll-ups over run records: spend, inputs, statuses, events, durations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels of spend whose model or project was not recorded.
NO_MODEL, NO_PROJECT = "not recorded", "no project"
# Stage statuses, in the order a reader is shown them.
STATUSES = ("ok", "validation_warnings", "running", "awaiting_review", "error", "cancelled", "pending")
FINISHED = ("ok", "validation_warnings")

# ── spend ──────────────────────────────────────────────────────────────────


def _totals() -> list[Column]:
    def total(column: str, zero: object) -> Column:
        return F.coalesce(F.sum(column), F.lit(zero)).alias(column)
    return [total("cost_usd", 0.0), total("input_tokens", 0), total("output_tokens", 0),
            total("calls", 0), F.count(F.lit(1)).alias("entries")]


def spend_total(entries: DataFrame) -> DataFrame:
    return entries.agg(*_totals())


def _label(column: str) -> Column:
    value = F.nullif(F.col(column), F.lit(""))
    return F.coalesce(value, F.lit({"model": NO_MODEL, "project": NO_PROJECT}.get(column, "")))


def spend_by(entries: DataFrame, column: str) -> DataFrame:
    """Totals per source, model or project, dearest first, ties by label."""
    return (entries.groupBy(_label(column).alias("label")).agg(*_totals())
            .orderBy(F.desc("cost_usd"), "label"))


def spend(entries: DataFrame) -> DataFrame:
    """Totals by source, by model and by project in one pass over the entries: dimension, label, …."""
    spread = entries.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), _label(c).alias("label"))
                           for c in ("source", "model", "project")])),
        "cost_usd", "input_tokens", "output_tokens", "calls")
    return spread.groupBy("dimension", "label").agg(*_totals())


def biggest(entries: DataFrame, n: int = 25) -> DataFrame:
    return entries.orderBy(F.desc("cost_usd"), "at").limit(n)


def daily(entries: DataFrame, at: str = "at") -> DataFrame:
    """Totals per calendar day from the first to the last, days without spend as zeros."""
    by_day = entries.groupBy(F.to_date(at).alias("day")).agg(*_totals())
    span = by_day.agg(F.min("day").alias("a"), F.max("day").alias("z")).where(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence("a", "z")).alias("day"))
    filled = days.join(by_day, "day", "left")
    return filled.select("day", *[
        F.coalesce(c, F.lit(0.0 if c == "cost_usd" else 0)).alias(c)
        for c in ("cost_usd", "input_tokens", "output_tokens", "calls", "entries")]).orderBy("day")


# ── inputs ─────────────────────────────────────────────────────────────────


def input_keys(bindings: DataFrame) -> DataFrame:
    """Per run, 16 hex digits naming which stage read which bytes (the path where none were hashed).

    `bindings` holds run_id, stage_id, path, filename, sha256, one row per bound file. The
    bindings of a run are hashed one by one and summed, so their order does not matter and a
    run with very many files is never gathered.
    """
    content = F.coalesce(F.nullif("sha256", F.lit("")), F.concat(F.lit("path:"), F.col("path")))
    digest = F.sha2(F.concat(F.col("stage_id"), F.lit("\x1f"), content), 256)

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    summed = bindings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), half(1).alias("_a"), half(16).alias("_b"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("files", "_a", "_b")])
    return summed.select("run_id", F.substring(F.sha2(text, 256), 1, 16).alias("input_key"), "files")


def runs_on_same_inputs(bindings: DataFrame) -> DataFrame:
    return input_keys(bindings).groupBy("input_key").agg(F.count(F.lit(1)).alias("runs"))


def ambiguous_filenames(bindings: DataFrame) -> DataFrame:
    """File names bound to more than one content."""
    hashed = bindings.where(F.coalesce("sha256", F.lit("")) != "")
    return (hashed.groupBy("filename").agg(F.count_distinct("sha256").alias("contents"))
            .where("contents > 1"))


def run_costs(records: DataFrame) -> DataFrame:
    """Cost and tokens per run over its stages' usage."""
    u = F.col("usage")
    return records.groupBy("run_id").agg(
        F.coalesce(F.sum(u["cost_usd"]), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum(u["input_tokens"] + u["output_tokens"]), F.lit(0)).alias("tokens"))


# ── statuses ───────────────────────────────────────────────────────────────


def status_counts(records: DataFrame) -> DataFrame:
    """Stages per run and status, in display order."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return (records.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("stages"))
            .orderBy("run_id", place))


def run_status(records: DataFrame) -> DataFrame:
    """A run's own status: errors, then awaiting_review, then warnings, then ok."""
    def any_(status: str) -> Column:
        return F.bool_or(F.col("status") == status)
    return records.groupBy("run_id").agg(
        F.when(any_("error"), "errors").when(any_("awaiting_review"), "awaiting_review")
        .when(any_("validation_warnings"), "warnings").otherwise("ok").alias("status"))


def latest_run(records: DataFrame, stage: str) -> DataFrame:
    """The newest run that finished a stage."""
    done = records.where((F.col("stage_id") == stage) & F.col("status").isin(*FINISHED))
    return done.select("run_id", "stage_id", "status").orderBy(F.desc("run_id")).limit(1)


def latest_runs(records: DataFrame) -> DataFrame:
    """Per stage, the newest run that finished it."""
    return (records.where(F.col("status").isin(*FINISHED)).groupBy("stage_id")
            .agg(F.max("run_id").alias("run_id")))


def list_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(n)


# ── events ─────────────────────────────────────────────────────────────────


def _of_stage(events: DataFrame, stage: str | None) -> DataFrame:
    if stage is None:
        return events
    # The end of a run belongs to every stage's view of it.
    return events.where((F.col("stage") == stage) | (F.col("kind") == "run_done"))


def events_tail(events: DataFrame, n: int, stage: str | None = None) -> DataFrame:
    """The last `n` events, oldest first."""
    last = _of_stage(events, stage).orderBy(F.desc("seq")).limit(n)
    return last.orderBy("seq")


def events_before(events: DataFrame, before: int, n: int, stage: str | None = None) -> DataFrame:
    """The page of up to `n` events just before a sequence number."""
    older = _of_stage(events, stage).where(F.col("seq") < before)
    return older.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def events_since(events: DataFrame, since: int, stage: str | None = None) -> DataFrame:
    return _of_stage(events, stage).where(F.col("seq") >= since).orderBy("seq")


def tail_per_stage(events: DataFrame, n: int) -> DataFrame:
    """The last `n` events of every stage; each partition keeps its own last `n` first."""
    place = F.row_number().over(W.partitionBy("stage").orderBy(F.desc("seq")))
    return events.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def outcomes(events: DataFrame) -> DataFrame:
    """Rows computed, answered from the cache and failed, per stage."""
    kind, source = F.col("kind"), F.col("source")
    return events.where(kind.isin("row_ok", "row_error")).groupBy("stage").agg(
        F.count_if((kind == "row_ok") & ~source.eqNullSafe(F.lit("cached"))).alias("computed"),
        F.count_if((kind == "row_ok") & source.eqNullSafe(F.lit("cached"))).alias("cached"),
        F.count_if(kind == "row_error").alias("errors"))


# ── durations ──────────────────────────────────────────────────────────────


def _instant(text: Column) -> Column:
    return F.when(_offset(text), text.try_cast("timestamp").try_cast("double")).otherwise(
        F.concat(text, F.lit("Z")).try_cast("timestamp").try_cast("double"))


def _offset(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.lit(False))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    two = F.lpad(F.pmod(whole, F.lit(60)).cast("string"), 2, "0")
    minutes = F.lpad(F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("string"), 2, "0")
    return (F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s")))
            .when(whole < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), two, F.lit("s")))
            .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), minutes, F.lit("m"))))


def durations(records: DataFrame, carried: Sequence[str] = ("run_id",), now: str | None = None) -> DataFrame:
    """elapsed_s and elapsed per record of started_at and finished_at texts.

    Unknown when one carries an offset and the other does not, when either does not read as a
    time, or when it would be negative. A record with status `running` ends `now`.
    """
    start, end = F.col("started_at"), F.col("finished_at")
    if now is not None:
        end = F.coalesce(end, F.when(F.col("status") == "running", F.lit(now)))
    same = _offset(start) == _offset(end)
    seconds = F.round(_instant(end) - _instant(start), 6)
    known = F.when(same & (seconds >= 0), seconds)
    return records.select(*carried, known.alias("elapsed_s"), duration_text(known).alias("elapsed"))
