"""Left equi-joins that bring reference columns onto a subject, and what they leave uncovered."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.errors import CardinalityError, ContractError, GrainError
from rowproof.functions.predicate import absent, name, present_value
from rowproof.functions.text import cell_text
from rowproof.ordinals import ORD
from rowproof.session import LOOKUP_ROWS, land
from rowproof.step import Step

Keys = Sequence[tuple[str, str] | str]
SAMPLE = 10
# Rows of one reference key that are matched in one place; a key with more is cut into as many slices as that takes.
SLICE_ROWS = 1_000_000


def key_pairs(keys: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in keys]


def _check(subject: DataFrame, reference: DataFrame, pairs: list[tuple[str, str]],
           brings: Mapping[str, str]) -> None:
    problems = []
    missing = [l for l, _ in pairs if l not in subject.columns]
    missing += [r for _, r in pairs if r not in reference.columns]
    missing += [c for c in brings if c not in reference.columns]
    if missing:
        problems.append(f"columns not found: {missing}")
    landed = list(brings.values())
    taken = [c for c in landed if c in subject.columns or c in {r for _, r in pairs}
             or c.startswith("_") or landed.count(c) > 1]
    if taken:
        problems.append(f"landed names are taken, repeated or reserved: {sorted(set(taken))}")
    if not pairs:
        problems.append("a join needs a key")
    if not missing:
        for left, right in pairs:
            a, b = subject.schema[left].dataType, reference.schema[right].dataType
            numbers = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
            if a != b and not numbers:
                problems.append(f"key {left}={right} compares {a.simpleString()} with {b.simpleString()}")
    if problems:
        raise ContractError("; ".join(problems))


def _narrowed(reference: DataFrame, pairs: list[tuple[str, str]],
              brings: Mapping[str, str]) -> DataFrame:
    keys = [present_value(name(r), reference.schema[r].dataType).alias(f"_key{i}")
            for i, (_, r) in enumerate(pairs)]
    ordinal = [F.col(ORD).alias("_ref_ord")] if ORD in reference.columns else []
    return reference.select(*keys, *[name(s).alias(l) for s, l in brings.items()], *ordinal)


def _on(subject: DataFrame, pairs: list[tuple[str, str]], null_keys_match: bool) -> Column:
    test: Column | None = None
    for i, (left, _) in enumerate(pairs):
        mine = present_value(name(left), subject.schema[left].dataType)
        link = mine.eqNullSafe(F.col(f"_key{i}")) if null_keys_match else mine == F.col(f"_key{i}")
        test = link if test is None else test & link
    assert test is not None
    return test


def enrich(subject: DataFrame, reference: DataFrame, keys: Keys,
           enrich_with: Mapping[str, str], null_keys_match: bool = True,
           verify: str = "first") -> Step:
    """Each subject row with its one reference row's columns, or nulls where none matches.

    The reference must hold at most one row per key. `verify="first"` counts keys in one
    pruned pass and fails before the join runs; `verify="in_plan"` groups the reference by
    key inside the join's own shuffle and fails when a repeated key is met.
    """
    pairs = key_pairs(keys)
    _check(subject, reference, pairs, enrich_with)
    narrowed = _narrowed(reference, pairs, enrich_with)
    key_names = [f"_key{i}" for i in range(len(pairs))]
    if not null_keys_match:
        for key in key_names:
            narrowed = narrowed.where(F.col(key).isNotNull())
    shown = ", ".join(f"{l}={r}" for l, r in pairs)
    if verify == "first":
        repeated = (narrowed.groupBy(*key_names).count().where("count > 1")
                    .orderBy(F.desc("count"), *key_names).limit(SAMPLE).collect())
        if repeated:
            named = [tuple(row[k] for k in key_names) for row in repeated]
            raise CardinalityError(
                f"the reference repeats a key of {shown}: {named}. Narrow the key, aggregate the "
                "reference to one row per key, or use expand if the fan-out is meant")
    elif verify == "in_plan":
        rest = [c for c in narrowed.columns if c not in key_names]
        one = narrowed.groupBy(*key_names).agg(
            F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
        failed = F.raise_error(F.lit(f"the reference repeats a key of {shown}"))
        narrowed = one.select(*key_names, *[
            F.when(F.col("_n") == 1, F.col("_row")[c])
            .otherwise(failed.cast(narrowed.schema[c].dataType)).alias(c) for c in rest])
    else:
        raise ValueError("verify is 'first' or 'in_plan'")
    joined = subject.join(narrowed, _on(subject, pairs, null_keys_match), "left").drop(*key_names)
    return Step(joined, (ORD, "_ref_ord") if "_ref_ord" in joined.columns else (ORD,))


def expand(subject: DataFrame, reference: DataFrame, keys: Keys, enrich_with: Mapping[str, str],
           null_keys_match: bool = True, hot_rows: int | None = SLICE_ROWS) -> Step:
    """Each subject row once per matching reference row, and once with nulls where none matches.

    A reference key with n rows is cut into ceil(n / `hot_rows`) slices, each met by its own copy
    of the subject rows, so that no task reads more of a key than that. A reference row's slice
    follows from its position, or in a table without positions from its values, so that a
    repeated task deals it alike; only equal rows of an unnumbered table stay in one slice. Keys
    of several slices are counted once and written; there are at most (reference rows / `hot_rows`)
    of them. A hot subject side is split by adaptive execution. `hot_rows=None` cuts nothing.
    """
    pairs = key_pairs(keys)
    _check(subject, reference, pairs, enrich_with)
    if hot_rows is not None and hot_rows < 1:
        raise ContractError("hot_rows is 1 or more, or None")
    narrowed = _narrowed(reference, pairs, enrich_with)
    key_names = [f"_key{i}" for i in range(len(pairs))]
    if not null_keys_match:
        for key in key_names:
            narrowed = narrowed.where(F.col(key).isNotNull())
    on = _on(subject, pairs, null_keys_match)
    joined = None
    if hot_rows is not None:
        slices = F.ceil(F.col("count") / hot_rows).cast("int").alias("_slices")
        hot = land(narrowed.groupBy(*key_names).count().where(F.col("count") > hot_rows)
                   .select(*[F.col(k).alias(f"_hot{k}") for k in key_names], slices), "hot")
        listed = hot.count()
        if listed:
            hot = F.broadcast(hot) if listed <= LOOKUP_ROWS else hot
            joined = _sliced_join(subject, narrowed, pairs, key_names, on, hot)
    if joined is None:
        joined = subject.join(narrowed, on, "left")
    joined = joined.drop(*key_names)
    if ORD not in subject.columns or "_ref_ord" not in joined.columns:
        return Step(joined)
    joined = joined.withColumn("_sub_ord", F.col(ORD))
    return Step(joined, ("_sub_ord", "_ref_ord"), "sorted",
                (F.col("_sub_ord").asc(), F.col("_ref_ord").asc_nulls_first()))


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def _sliced_join(subject: DataFrame, narrowed: DataFrame, pairs: list[tuple[str, str]],
                 key_names: list[str], on: Column, hot: DataFrame) -> DataFrame:
    """The left join with each key of `hot` matched in its own number of slices."""
    def with_slices(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
        test = columns[0].eqNullSafe(F.col(f"_hot{key_names[0]}"))
        for column, key in zip(columns[1:], key_names[1:]):
            test = test & column.eqNullSafe(F.col(f"_hot{key}"))
        return df.join(hot, test, "left").drop(*[f"_hot{k}" for k in key_names])

    mine = [present_value(name(l), subject.schema[l].dataType) for l, _ in pairs]
    left = with_slices(subject, mine).withColumn("_slice", F.explode(F.sequence(
        F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
    # Maps have no hash; what else a row holds decides.
    told = ["_ref_ord"] if "_ref_ord" in narrowed.columns else [
        f.name for f in narrowed.schema.fields if not _has_map(f.dataType)]
    place = F.pmod(F.xxhash64(*[name(c) for c in told]), F.coalesce("_slices", F.lit(1))).cast("int")
    right = with_slices(narrowed, [F.col(k) for k in key_names]).select(
        *[name(c) for c in narrowed.columns], place.alias("_ref_slice"), F.lit(True).alias("_met"))
    joined = left.join(right, on & (F.col("_slice") == F.col("_ref_slice")), "left")
    # A hot key has matches by definition, so a slice without one only means an empty slice.
    return (joined.where(F.col("_slices").isNull() | F.col("_met").isNotNull())
            .drop("_slices", "_slice", "_ref_slice", "_met"))


def key_presence(subject: DataFrame, reference: DataFrame, keys: Keys) -> DataFrame:
    """Every distinct non-null key of either table and which of the two hold it: one shuffle."""
    pairs = key_pairs(keys)
    for l, r in pairs:
        for df, column in ((subject, l), (reference, r)):
            if isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType)):
                raise ContractError("key coverage was not checked: a key holds lists or objects")

    def tagged(df: DataFrame, columns: list[str], in_subject: bool) -> DataFrame:
        kept = df
        for c in columns:
            kept = kept.where(~absent(name(c), df.schema[c].dataType))
        return kept.select(*[name(c).alias(f"key{i}") for i, c in enumerate(columns)],
                           F.lit(in_subject).alias("_s"), F.lit(not in_subject).alias("_r"))

    both = tagged(subject, [l for l, _ in pairs], True).unionByName(
        tagged(reference, [r for _, r in pairs], False))
    return both.groupBy(*[f"key{i}" for i in range(len(pairs))]).agg(
        F.bool_or("_s").alias("in_subject"), F.bool_or("_r").alias("in_reference"))


def key_coverage(subject: DataFrame, reference: DataFrame, keys: Keys,
                 sample: int = SAMPLE) -> DataFrame:
    """Two rows, `reference` and `subject`: keys of that side the other side lacks.

    `absent` of `total` distinct keys, with the first `sample` of them in text order.
    """
    presence = key_presence(subject, reference, keys)
    key_names = [c for c in presence.columns if c.startswith("key")]
    shown = [cell_text(F.col(k), presence.schema[k].dataType) for k in key_names]
    text = shown[0] if len(shown) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(")"))
    counts = presence.agg(
        F.count_if("in_reference").alias("rt"), F.count_if("in_subject").alias("st"),
        F.count_if(F.col("in_reference") & ~F.col("in_subject")).alias("ra"),
        F.count_if(F.col("in_subject") & ~F.col("in_reference")).alias("sa"))
    sides = counts.select(F.inline(F.array(
        F.struct(F.lit("reference").alias("side"), F.col("ra").alias("absent"), F.col("rt").alias("total")),
        F.struct(F.lit("subject").alias("side"), F.col("sa").alias("absent"), F.col("st").alias("total")))))
    gaps = presence.where(F.col("in_subject") != F.col("in_reference")).select(
        F.when(F.col("in_reference"), "reference").otherwise("subject").alias("side"),
        text.alias("key"), F.struct(*shown).alias("_at"))
    place = F.row_number().over(W.partitionBy("side").orderBy("_at"))
    samples = (gaps.withColumn("_n", place).where(F.col("_n") <= sample).groupBy("side")
               .agg(F.array_sort(F.collect_list(F.struct("_n", "key"))).alias("_rows"))
               .select("side", F.transform("_rows", lambda r: r["key"]).alias("sample")))
    return sides.join(samples, "side", "left").select(
        "side", "absent", "total",
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def coverage_warnings(coverage: DataFrame, subject: str, reference: str) -> list[str]:
    """The coverage rows worded for a reader; only gaps are mentioned."""
    said = []
    for row in coverage.where("absent > 0").orderBy("side").collect():
        more = row["absent"] - len(row["sample"])
        shown = ", ".join(row["sample"]) + (f", and {more:,} more" if more > 0 else "")
        if row["side"] == "reference":
            said.append(f"{row['absent']:,} of {row['total']:,} keys of {reference} have no row in "
                        f"{subject}, so the output holds none of them: {shown}")
        else:
            said.append(f"{row['absent']:,} of {row['total']:,} keys of {subject} are not listed in "
                        f"{reference}; their landed columns are null: {shown}")
    return said


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row i of one table beside row i of the other; both must have the same number of rows, at the same positions."""
    a, b = left.count(), right.count()
    if a != b:
        raise GrainError(f"{a} row(s) cannot be aligned with {b}")
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), ORD, "full_outer")
    lone = F.raise_error(F.concat(F.lit("refused: position "), F.col(ORD).cast("string"), F.lit(" is in one table only"))).cast("boolean")
    met = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    return both.where(F.when(met, F.lit(True)).otherwise(lone)).drop("_left", "_right")
