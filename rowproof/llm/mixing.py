"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source is cut into blocks of `block_rows` rows. With weight w (weights of the sources that are left
add up to 1), its j-th block (from 1) is released at slot floor((j-1)/w) and due by slot ceil(j/w), and each
slot takes, of the released blocks, the one due first (of equal ones the first source by name). At every
slot t each source thus stays less than one block from w * t.

Weights are given per source, or follow the square roots of the sources' sizes. They are whole numbers of a
common total, without rounding where the given decimals allow it while (blocks + 2) * total is under 2^62;
others are rounded to such a total, which moves a source by less than blocks^2 / 2^61 blocks.
When a source runs out, the others start anew with their weights, in the same proportions: a phase, one per
source at most. A source of weight 0 comes after all others: nothing is dropped or repeated.

Phases are cut into slabs longer than any block's window, which are worked out independently. How many blocks
each source has before a cut: those due by then, and of those whose window spans it the ones due first, as
far as those released after any slot fit between that slot and the cut. Both sides then have a schedule.

The order within a source is that of a scrambled id, so copies in sequence are spread. A null source
is a source of its own, a null id counts as 0, sources named in `weights` but absent take no slot,
and a source absent from `weights` has the weight 1 / `parts`. An empty table gives an empty result. Rows
that repeat an id each have a place.
"""
from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import isqrt, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.llm.base import unused
from rowproof.session import land

# Rows of one source and bucket that are numbered together, on average.
BUCKET_ROWS = 1 << 16
SCRAMBLED = 1 << 31

# Slots of a slab, at least, and slots whose picks are gathered in one array.
SLAB = 64
CHUNK = 256
# Slots times the total of the weights stay under this.
WIDEST = 1 << 62

# Slot by slot: of the released blocks the one due first; its source's count goes up.
SCHEDULE = f"""
flatten(aggregate(sequence(0L, (b - a - 1) div {CHUNK}),
  named_struct('done', low, 'chunks', cast(array() as array<array<struct<source: int, block: bigint>>>)),
  (all, c) -> aggregate(sequence(a + c * {CHUNK}, least(b, a + (c + 1) * {CHUNK}) - 1),
    named_struct('done', all.done, 'picks', cast(array() as array<struct<source: int, block: bigint>>)),
    (acc, t) -> transform(array(array_min(transform(w, (m, i) ->
        if(acc.done[i] < high[i] AND (acc.done[i] * total) div m <= t,
           named_struct('due', least(b, ((acc.done[i] + 1) * total + m - 1) div m), 'at', i), null))).at),
      best -> named_struct(
        'done', transform(acc.done, (d, i) -> if(i = best, d + 1, d)),
        'picks', array_append(acc.picks, named_struct('source', best, 'block', acc.done[best]))))[0],
    acc -> named_struct('done', acc.done, 'chunks', array_append(all.chunks, acc.picks))),
  all -> all.chunks))
"""


def source_key(source: str) -> Column:
    """The source as a text that no other source has; null is one of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def scrambled(doc_id: str) -> Column:
    """A fixed spread of the ids over 0 .. 2^31 - 1."""
    return F.pmod(F.pmod(F.coalesce(F.col(doc_id), F.lit(0)), F.lit((1 << 31) - 1)) * 1103515245 + 12345, F.lit(SCRAMBLED))


def whole_weights(blocks: Mapping[str, int], rows: Mapping[str, int], weights: Mapping[str, float] | None, parts: int) -> dict[str, int]:
    """Each source's weight as a whole number of a common total."""
    most = WIDEST // (sum(blocks.values()) + 2)
    if weights is None:
        exact = {k: Fraction(isqrt(n << 128), 1 << 64) for k, n in rows.items()}
    else:
        given = {f"s{name}": Fraction(str(w)) for name, w in weights.items()}
        exact = {k: given.get(k, Fraction(1, parts)) for k in rows}
    unit = lcm(*(x.denominator for x in exact.values()))
    whole = {k: int(x * unit) for k, x in exact.items()}
    total = sum(whole.values())
    if total > most:
        # Room for those that are rounded up to 1.
        whole = {k: max(1, round(Fraction(x * (most - len(whole)), total))) if x else 0 for k, x in whole.items()}
    return whole


def last_counts(w: list[int], total: int, t: int, left: list[int]) -> list[int]:
    """Blocks of each source before the end of a phase: sources that can run out do so first, then those due first."""
    low = [x * t // total for x in w]
    spans = [(low[i] + 1 < left[i], -(-(low[i] + 1) * total // w[i]), i, low[i] * total // w[i], w[i] * t % total)
             for i in range(len(w)) if w[i] * t % total]
    # By release, latest first: blocks released then or later, at most.
    caps, over = {}, 0
    for _, _, _, release, part in sorted(spans, key=lambda x: -x[3]):
        over += part
        caps[release] = -(-over // total)
    for _, _, i, release, _ in sorted(spans):
        if all(cap > 0 for r, cap in caps.items() if r <= release):
            low[i] += 1
            for r in caps:
                caps[r] -= r <= release
    return low


def phases(sizes: Mapping[str, int], weights: Mapping[str, float] | None, parts: int, block_rows: int) -> list[dict]:
    """Runs of slots with one set of sources: keys, weights, slots and blocks before it, blocks at its end, slab length."""
    left = {k: -(-n // block_rows) for k, n in sorted(sizes.items())}
    whole = whole_weights(left, sizes, weights, parts)
    taken, before, out = dict.fromkeys(left, 0), 0, []
    while any(left.values()):
        keys = [k for k in left if left[k] and whole[k]]
        if not keys:
            whole = dict.fromkeys(left, 1)
            continue
        w, held = [whole[k] for k in keys], [left[k] for k in keys]
        total = sum(w)
        length = min(n * total // x for n, x in zip(held, w))
        ends = last_counts(w, total, length, held)
        out.append({"keys": keys, "w": w, "total": total, "start": before, "length": length, "taken": [taken[k] for k in keys],
                    "ends": ends, "slab": max(SLAB, -(-total // min(w)) + 2)})
        before += length
        for k, n in zip(keys, ends):
            left[k] -= n
            taken[k] += n
    return out


def counts_at(t: str) -> str:
    """SQL for each source's blocks before slot t, a cut within a phase."""
    spans = f"""sort_array(filter(transform(w, (x, i) -> named_struct(
        'due', ((x * {t} div total + 1) * total + x - 1) div x, 'at', i,
        'release', ((x * {t} div total) * total) div x, 'over', x * {t} % total)), s -> s.over > 0))"""
    # With each its cap: blocks released with it or later, at most.
    capped = f"""transform(array({spans}), spans -> transform(spans, k -> named_struct('at', k.at, 'release', k.release, 'cap',
        (aggregate(spans, 0L, (n, o) -> if(o.release >= k.release, n + o.over, n)) + total - 1) div total)))[0]"""
    picked = f"""transform(array({capped}), spans -> aggregate(spans,
        named_struct('held', transform(spans, k -> 0L), 'picks', cast(array() as array<int>)),
        (acc, c) -> if(exists(transform(spans, (k, n) -> k.release <= c.release AND acc.held[n] >= k.cap), full -> full), acc,
          named_struct('held', transform(acc.held, (h, n) -> if(spans[n].release <= c.release, h + 1, h)),
                       'picks', array_append(acc.picks, c.at))),
        acc -> acc.picks))[0]"""
    return f"transform(array({picked}), picks -> transform(w, (x, i) -> x * {t} div total + if(array_contains(picks, i), 1L, 0L)))[0]"


def schedules(spark: SparkSession, found: list[dict]) -> DataFrame:
    """(key, block, slot, release, due) of every block; block counts from 0 within its source."""
    shape = ("array<struct<keys: array<string>, w: array<bigint>, total: bigint, start: bigint, length: bigint, "
             "taken: array<bigint>, ends: array<bigint>, slab: bigint>>")
    listed = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(found)), shape)))
    # The last slab of a phase has the slots that are left over as well.
    slabs = (listed.withColumn("slabs", F.expr("greatest(1L, length div slab)")).withColumn("k", F.explode(F.expr("sequence(0L, slabs - 1)")))
             .withColumn("a", F.expr("k * slab")).withColumn("b", F.expr("if(k = slabs - 1, length, (k + 1) * slab)"))
             .repartition(max(1, spark.sparkContext.defaultParallelism), "start", "k"))
    cut = (slabs.withColumn("low", F.expr(f"if(k = 0, transform(w, x -> 0L), {counts_at('a')})"))
           .withColumn("high", F.expr(f"if(k = slabs - 1, ends, {counts_at('b')})")))
    picks = cut.select("keys", "w", "total", "start", "taken", "a", F.posexplode(F.expr(SCHEDULE)).alias("at", "pick"))
    m = "w[pick.source]"
    return picks.select(
        F.expr("keys[pick.source]").alias("key"), F.expr("taken[pick.source] + pick.block").alias("block"),
        F.expr("start + a + at").alias("slot"), F.expr(f"start + (pick.block * total) div {m}").alias("release"),
        F.expr(f"start + ((pick.block + 1) * total + {m} - 1) div {m}").alias("due"))


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, parts: int = 100, block_rows: int = 1,
                names: Sequence[str] = ("__key", "__rank", "__block", "__slot", "__release", "__due")) -> DataFrame:
    """`docs` with each row's source key, rank in its source and block (from 1), slot, release and due slot (from 0)."""
    key, rank, block, slot, release, due = names
    spread, bucket, at, earlier, *theirs = unused([*docs.columns, *names], "__spread", "__bucket", "__at", "__before",
                                                  "__k", "__j", "__k2", "__b2", "__s", "__r", "__d")
    k, j, k2, b2, s_, r_, d_ = theirs
    keyed = docs.withColumn(key, source_key("source")).withColumn(spread, scrambled("doc_id"))
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = keyed.withColumn(bucket, F.expr(f"(`{spread}` * {buckets}) div {SCRAMBLED}"))
    # Pre-aggregated counts of every source and bucket, then running sums of those.
    counts = land(keyed.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    # One number per source reaches the driver.
    sizes = {r["key"]: r["n"] for r in counts.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    slots = land(schedules(docs.sparkSession, phases(sizes, weights, parts, block_rows)), "slots").select(
        F.col("key").alias(k), F.col("block").alias(j), F.col("slot").alias(s_), F.col("release").alias(r_), F.col("due").alias(d_))
    offsets = land(counts.withColumn("rows_before", F.coalesce(before, F.lit(0).cast("bigint"))).drop("n"), "offsets").select(
        F.col("key").alias(k2), F.col("bucket").alias(b2), F.col("rows_before").alias(earlier))
    ties = [F.xxhash64(*docs.columns)] if "text" in docs.columns else []
    within = W.partitionBy(key, bucket).orderBy(spread, "doc_id", *ties)
    ranked = (keyed.withColumn(at, F.row_number().over(within))
              .join(offsets, (F.col(key) == F.col(k2)) & (F.col(bucket) == F.col(b2)))
              .withColumn(rank, F.col(earlier) + F.col(at))
              .withColumn(block, F.expr(f"(`{rank}` - 1) div {block_rows}")))
    joined = ranked.join(slots, (F.col(key) == F.col(k)) & (F.col(block) == F.col(j)))
    return joined.select(*docs.columns, F.col(key), F.col(rank), (F.col(block) + 1).alias(block), F.col(s_).alias(slot),
                         F.col(r_).alias(release), F.col(d_).alias(due))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, parts: int = 100, block_rows: int = 1) -> DataFrame:
    """The rows of `docs` in mixed order, across and within partitions; written, part files follow it."""
    names = unused(docs.columns, "__key", "__rank", "__block", "__slot", "__release", "__due")
    placed = mixed_order(docs, weights, parts, block_rows, names)
    return placed.repartitionByRange(names[3], names[1]).sortWithinPartitions(names[3], names[1]).select(*docs.columns)
