"""Content-addressed replay: work done once per (definition, row content) is not done again."""
from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.functions.predicate import name
from rowproof.functions.text import canonical_json, json_row, row_fingerprint, short_hash
from rowproof.ordinals import ORD, data_columns
from rowproof.session import land, look_up
from rowproof.step import Step

CACHE = "key_version int, stage string, stage_fp string, row_fp string, frozen_input string, output string, seq bigint"
KEY_VERSION = 1
KEY = ["stage", "stage_fp", "row_fp"]


@dataclass(frozen=True)
class Replayed:
    """`step` holds all rows; `entries` are to be appended to the cache; `counts` is hits and misses.

    Entries of one call share a `seq` above every one the cache holds: of several answers to one row
    the one recorded last counts.
    """

    step: Step
    entries: DataFrame
    counts: DataFrame


def incremental_map(df: DataFrame, cache: DataFrame | None, fn: Callable[[DataFrame], DataFrame],
                    writes: T.StructType, stage: str, stage_fp: str,
                    reads: Sequence[str] | None = None, bust_cache: bool = False) -> Replayed:
    """Rows the cache answers keep their recorded output; only the others go through `fn`.

    `fn` receives the missed rows (reads, `_ord`, `_fp`) and returns them with the written columns
    and, if it can fail on a row, `_error`. It may be costly or call out, so what it wrote is landed
    once and everything below reads that. Failed rows are never recorded. `bust_cache` skips the
    reading, not the recording: what is worked out then replaces older answers.

    Only positions, fingerprints and outputs are landed or grouped; the row's own cells are read from
    `df` again where they are needed, so `df` has to give the same rows each time it is read.
    """
    read = list(reads) if reads is not None else data_columns(df)
    named = df.withColumn("_fp", row_fingerprint(df, read))
    if cache is not None and not bust_cache:
        # One answer per fingerprint, so a fingerprint many rows share meets one row.
        last = F.min_by("output", F.struct((-_seq(cache)).alias("newest"), F.col("output")))
        answers = _of_stage(cache, stage, stage_fp).groupBy(F.col("row_fp").alias("_fp")).agg(last.alias("_output"))
        # Hits, misses and their counts are three readers of one lookup.
        looked = land(named.select(ORD, "_fp").join(answers, "_fp", "left"), "looked")
        missing = look_up(df, looked.where(F.col("_output").isNull()).select(ORD, "_fp"), [ORD])
    else:
        looked = named.select(ORD, "_fp", F.lit(None).cast("string").alias("_output"))
        missing = named
    made = fn(missing.select(*[name(c) for c in read], ORD, "_fp"))
    wrote = [f.name for f in writes.fields]
    error = name("_error") if "_error" in made.columns else F.lit(None).cast("string").alias("_error")
    usage = [name("_usage")] if "_usage" in made.columns else []
    computed = land(made.select(ORD, "_fp", *[name(c) for c in wrote], error, *usage), "computed")
    parsed = F.from_json("_output", writes)
    hits = df.join(looked.where(F.col("_output").isNotNull()).select(ORD, "_output"), ORD).select(
        *[name(c) for c in df.columns], *[parsed[c].alias(c) for c in wrote],
        F.lit(None).cast("string").alias("_error"), F.lit("cached").alias("_source"))
    fresh = missing.drop("_fp").join(
        computed.select(ORD, *[name(c) for c in wrote], "_error", *usage), ORD).withColumn(
        "_source", F.lit("computed"))
    whole = hits.unionByName(fresh, allowMissingColumns=True)
    # One row stands for all of its content; only then is its frozen input fetched.
    output = F.to_json(F.struct(*[name(c) for c in wrote]), {"ignoreNullFields": "false"})
    recorded = computed.where(F.col("_error").isNull()).select("_fp", F.struct(ORD, output.alias("output")).alias("_made")).groupBy(
        "_fp").agg(F.min("_made").alias("_made")).select(F.col(f"_made.{ORD}").alias(ORD), F.col("_fp"), F.col("_made.output").alias("_output"))
    entries = df.select(ORD, canonical_json(df, read).alias("frozen_input")).join(recorded, ORD).select(
        F.lit(KEY_VERSION).alias("key_version"), F.lit(stage).alias("stage"),
        F.lit(stage_fp).alias("stage_fp"), F.col("_fp").alias("row_fp"), "frozen_input", F.col("_output").alias("output"),
        F.lit(_next_seq(cache, stage, stage_fp)).alias("seq"))
    counts = looked.agg(F.count_if(F.col("_output").isNotNull()).alias("hits"),
                        F.count_if(F.col("_output").isNull()).alias("misses"))
    return Replayed(Step(whole, (ORD,)), entries, counts)


def _of_stage(cache: DataFrame, stage: str, stage_fp: str) -> DataFrame:
    return cache.where((F.col("stage") == stage) & (F.col("stage_fp") == stage_fp) & (F.col("key_version") == KEY_VERSION))


def _seq(cache: DataFrame) -> Column:
    """When an entry was recorded; caches written before there was a sequence come first."""
    return F.coalesce(F.col("seq"), F.lit(0).cast("bigint")) if "seq" in cache.columns else F.lit(0).cast("bigint")


def _next_seq(cache: DataFrame | None, stage: str, stage_fp: str) -> int:
    """Above every entry of the stage, and above those of a cache that was not given, by the clock."""
    now = time.time_ns()
    if cache is None:
        return now
    held = _of_stage(cache, stage, stage_fp).agg(F.max(_seq(cache))).first()[0]
    return max(now, (held or 0) + 1)


# ── whole tables ───────────────────────────────────────────────────────────


def table_fingerprint(df: DataFrame) -> str:
    """16 hex digits naming a numbered table; column order and row order are part of it.

    Every row is hashed with its position and the hashes are summed in two halves, so no
    task ever sees more than its own rows.
    """
    columns = data_columns(df)
    row = json_row({c: (name(c), df.schema[c].dataType) for c in columns}, in_order=True)
    digest = F.sha1(F.concat(F.col(ORD).cast("string"), F.lit(":"), row).cast("binary"))

    def half(start: int):
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    total = df.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(16).alias("b"))
    text = F.concat_ws("|", F.lit(",".join(columns)), F.col("n").cast("string"),
                       F.coalesce(F.col("a").cast("string"), F.lit("0")),
                       F.coalesce(F.col("b").cast("string"), F.lit("0")))
    return total.select(short_hash(text)).first()[0]


def tables_fingerprint(*tables: DataFrame) -> str:
    """Order matters: the two sides of a join swapped are another input."""
    return hashlib.sha1("|".join(table_fingerprint(t) for t in tables).encode()).hexdigest()[:16]


def cached_table(spark: SparkSession, root: str, stage: str, stage_fp: str, inputs: Sequence[DataFrame],
                 make: Callable[[], DataFrame], bust_cache: bool = False) -> tuple[DataFrame, bool]:
    """The stored table for these inputs, or `make()` stored under their fingerprint."""
    path = f"{root.rstrip('/')}/v{KEY_VERSION}/{stage}/{stage_fp}/{tables_fingerprint(*inputs)}"
    if not bust_cache:
        try:
            return spark.read.parquet(path), True
        except AnalysisException:
            pass
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


# ── moving a cache ─────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Merged:
    entries: DataFrame   # to append to the destination
    report: DataFrame    # stage, imported, written, already_stored, reachable


def merge_cache(source: DataFrame, destination: DataFrame, live: DataFrame) -> Merged:
    """Entries of `source` the destination lacks; an id it already holds wins.

    `live` lists the (stage, stage_fp) pairs that would be looked up today: an entry outside it
    lands but is never read, and is counted so.
    """
    held = source.where(F.col("key_version") == KEY_VERSION)
    if not source.where(F.col("key_version") != KEY_VERSION).isEmpty():
        raise ValueError(f"the cache was written with another key version than {KEY_VERSION}")
    stored = destination.select(*KEY).distinct().withColumn("_stored", F.lit(True))
    alive = live.select("stage", "stage_fp").distinct().withColumn("_live", F.lit(True))
    here, there = held.join(stored, KEY, "left").alias("here"), alive.alias("there")
    pair = [F.col(f"here.{c}").eqNullSafe(F.col(f"there.{c}")) for c in ("stage", "stage_fp")]
    marked = here.join(there, pair, "left").select("here.*", "there._live")
    report = marked.groupBy("stage").agg(
        F.count(F.lit(1)).alias("imported"), F.count_if(F.col("_stored").isNull()).alias("written"),
        F.count_if(F.col("_stored").isNotNull()).alias("already_stored"),
        F.count_if(F.col("_live").isNotNull()).alias("reachable"))
    return Merged(marked.where(F.col("_stored").isNull()).select(*source.columns), report)
