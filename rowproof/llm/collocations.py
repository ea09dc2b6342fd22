"""Phrase collocations, counted with quotient filters.

Texts are cut into chunks of a few megabytes. A chunk lists its own words with their counts; their sums give
every word's frequency, and the words that are frequent enough get a number, the more frequent the smaller. Each
chunk is then rewritten as such numbers, 0 standing for a break or a rarer word.

An n-gram is the packed sequence of its word numbers. An invertible permutation (a Feistel network as wide as the
packed number) spreads it, its first half is the quotient, the rest the remainder, kept in full: a filter that holds,
in order, the occupied quotients with the length of their runs, the remainders and their counters is therefore exact,
and its keys can be turned back into words. Chunks' filters are cut at quotient boundaries and merged, up to `fan`
of them at a time, each merged one being cut `fan` times finer: rows stay as many as there are entries by the
thousand, however many chunks there are. The entries that reach the threshold are passed back down the same way to
the chunks that hold them. A longer n-gram is counted only where both its shorter ones are frequent, which its own
frequency implies, so nothing is lost and the rare mass of long n-grams is never written.

A phrase is scored by its weakest cut in exact decimals. Phrases that always stand inside a longer one are left out.
Only phrases tied with the ones reported get their words spelled out before the last ordering.

A null text is the empty text, a null lang `und`; rows without words give nothing, nor does an empty table. Ids are
not looked at: rows that repeat count as often as they stand there. Columns other than text and lang are not looked
at, whatever their names. A text is never divided, however long: a chunk
is at least as large as its longest text.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.llm.base import mix_number, mixed, spans, text_bytes
from rowproof.ordinals import number_sorted
from rowproof.session import land

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~BREAKS
INSIDE[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 6 << 20
FAN_BITS = 8
ROUNDS = 4

CHUNKS = "chunk bigint, local int, lang string, word string, n bigint, body binary"
SLICES = "shard bigint, slot bigint, body binary"
MERGED = SLICES + ", ids array<bigint>, a bigint"


# Numbers as bytes

def to_bytes(*columns: np.ndarray) -> bytes:
    """Whole numbers with as many bytes each as the largest of a column needs, laid out byte by byte: all lowest bytes,
    then all second ones, and so on. High bytes are mostly zeros, which compress away."""
    heads, planes = [], []
    for column in columns:
        size = max(1, (int(column.max()).bit_length() + 7) // 8) if len(column) else 1
        heads += [size, len(column)]
        planes += [(column >> np.array(8 * i, column.dtype)).astype(np.uint8).tobytes() for i in range(size)]
    return b"".join([struct.pack(f"<B{'BQ' * len(columns)}", len(columns), *heads), *planes])


def from_bytes(data: bytes) -> list[np.ndarray]:
    heads = struct.unpack_from(f"<{'BQ' * data[0]}", data, 1)
    at, out = 1 + struct.calcsize(f"<{'BQ' * data[0]}"), []
    for size, count in zip(heads[::2], heads[1::2]):
        kind = np.uint32 if size <= 4 else np.uint64
        column = np.zeros(count, dtype=kind)
        for i in range(size):
            column |= np.frombuffer(data, dtype=np.uint8, count=count, offset=at).astype(kind) << kind(8 * i)
            at += count
        out.append(column)
    return out


# Quotient filters

@dataclass(frozen=True)
class Layout:
    """How n-grams of `n` words, numbered with `bits` bits each, lie in lanes of up to 62 bits."""

    n: int
    bits: int

    @property
    def lanes(self) -> int:
        return max(2, -(-self.n * self.bits // 62))

    @property
    def width(self) -> int:
        return max(-(-self.n * self.bits // self.lanes), self.bits)

    def pack(self, words: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The words' numbers, one after another, as one wide number in lanes, the highest first."""
        bits, width = np.uint64(self.bits), np.uint64(self.width)
        mask = np.uint64((1 << self.width) - 1)
        lanes = [np.zeros(len(words[0]), dtype=np.uint64) for _ in range(self.lanes)]
        for word in words:
            carry = word.astype(np.uint64)
            for i in range(self.lanes - 1, -1, -1):
                over = lanes[i] >> (width - bits)
                lanes[i] = (lanes[i] << bits | carry) & mask
                carry = over
        return lanes

    def unpack(self, lanes: Sequence[np.ndarray]) -> list[np.ndarray]:
        bits, width, low = np.uint64(self.bits), np.uint64(self.width), np.uint64((1 << self.bits) - 1)
        lanes, words = list(lanes), []
        for _ in range(self.n):
            words.append(lanes[-1] & low)
            carry = np.zeros_like(lanes[0])
            for i in range(self.lanes):
                below = lanes[i] & low
                lanes[i] = lanes[i] >> bits | carry << (width - bits)
                carry = below
        return words[::-1]

    def _turn(self, lane: np.ndarray, step: int) -> np.ndarray:
        return mixed(lane + np.uint64(mix_number(step) >> 1)) >> np.uint64(64 - self.width)

    def permute(self, lanes: Sequence[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for step in range(ROUNDS * self.lanes):
            i = step % self.lanes
            lanes[i] = lanes[i] ^ self._turn(lanes[(i + 1) % self.lanes], step)
        return lanes

    def restore(self, lanes: Sequence[np.ndarray]) -> list[np.ndarray]:
        lanes = list(lanes)
        for step in range(ROUNDS * self.lanes - 1, -1, -1):
            i = step % self.lanes
            lanes[i] = lanes[i] ^ self._turn(lanes[(i + 1) % self.lanes], step)
        return lanes

    def slot_bits(self, rounds: int, fan_bits: int) -> int:
        """Leading bits of the quotient that name a slot after so many cuts."""
        return min(self.width, rounds * fan_bits)

    def order(self, lanes: Sequence[np.ndarray]) -> np.ndarray:
        if self.lanes == 2 and self.width <= 32:
            return np.argsort(lanes[0] << np.uint64(self.width) | lanes[1], kind="stable")
        return np.lexsort(lanes[::-1])


@dataclass
class Filter:
    """Counted keys of one layout: permuted lanes in ascending order, each key once. The first lane is the quotient."""

    layout: Layout
    lanes: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def of(cls, layout: Layout, lanes: Sequence[np.ndarray], counts: np.ndarray | None = None) -> Filter:
        """Sort keys and add up the counts of equal ones."""
        if counts is None and layout.lanes == 2 and layout.width <= 32:
            # Both lanes fit one number: sorted without moving anything else.
            keys = lanes[0] << np.uint64(layout.width)
            keys |= lanes[1]
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            kept = keys[first]
            return cls(layout, [kept >> np.uint64(layout.width), kept & np.uint64((1 << layout.width) - 1)],
                       np.diff(np.append(first, len(keys))))
        order = layout.order(lanes)
        lanes = [x[order] for x in lanes]
        counts = np.ones(len(order), np.int64) if counts is None else counts[order]
        if not len(order):
            return cls(layout, lanes, counts)
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in lanes], axis=0)])
        first = np.flatnonzero(new)
        return cls(layout, [x[first] for x in lanes], np.add.reduceat(counts, first))

    @classmethod
    def merge(cls, filters: Sequence[Filter]) -> Filter:
        return cls.of(filters[0].layout, [np.concatenate([f.lanes[i] for f in filters]) for i in range(filters[0].layout.lanes)],
                      np.concatenate([f.counts for f in filters]))

    def __len__(self) -> int:
        return len(self.counts)

    def where(self, chosen: np.ndarray | slice) -> Filter:
        return Filter(self.layout, [x[chosen] for x in self.lanes], self.counts[chosen])

    def has(self, lanes: Sequence[np.ndarray]) -> np.ndarray:
        """Which of these keys it holds: a quotient's run is found by bisection, then compared remainder by remainder."""
        found = np.zeros(len(lanes[0]), dtype=bool)
        if not len(self) or not len(found):
            return found
        if self.layout.lanes == 2 and self.layout.width <= 32:
            width = np.uint64(self.layout.width)
            own, asked = self.lanes[0] << width | self.lanes[1], lanes[0] << width | lanes[1]
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            return own[at] == asked
        at = np.searchsorted(self.lanes[0], lanes[0])
        waiting = np.flatnonzero(at < len(self))
        while len(waiting):
            here = at[waiting]
            waiting = waiting[self.lanes[0][here] == lanes[0][waiting]]
            here = at[waiting]
            equal = np.all([x[here] == y[waiting] for x, y in zip(self.lanes[1:], lanes[1:])], axis=0)
            found[waiting[equal]] = True
            waiting = waiting[~equal]
            at[waiting] += 1
            waiting = waiting[at[waiting] < len(self)]
        return found

    def cut(self, bits: int) -> Iterator[tuple[int, Filter]]:
        """Its parts by the leading `bits` of the quotient."""
        slots = (self.lanes[0] >> np.uint64(self.layout.width - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else []
        for low, high in zip(first, np.append(first[1:], len(slots))):
            yield int(slots[low]), self.where(slice(low, high))

    def dump(self) -> bytes:
        """Occupied quotients as steps, lengths of their runs, remainders, one-byte counters, and counters beyond a byte."""
        first = np.flatnonzero(np.concatenate([[True], self.lanes[0][1:] != self.lanes[0][:-1]])) if len(self) else np.empty(0, np.int64)
        quotients = self.lanes[0][first]
        steps = np.diff(quotients, prepend=np.uint64(0))
        large = self.counts >= 255
        return to_bytes(steps, np.diff(np.append(first, len(self))), np.where(large, 255, self.counts), self.counts[large],
                        *self.lanes[1:])

    @classmethod
    def load(cls, layout: Layout, data: bytes) -> Filter:
        steps, runs, counts, large, *rest = from_bytes(data)
        quotients = np.repeat(np.cumsum(steps.astype(np.uint64), dtype=np.uint64), runs.astype(np.int64))
        counts = counts.astype(np.int64)
        counts[counts == 255] = large.astype(np.int64)
        return cls(layout, [quotients, *(x.astype(np.uint64) for x in rest)], counts)


# Chunks and their words

def _small(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a megabyte of text, so that work arrays by the byte stay small."""
    for batch in batches:
        reach = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(batch):
            before = reach[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(reach, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of chunks: their words (local, lang, word, n) and, in one row of each, the words in order as a body of
    local numbers plus one, 0 where a piece or a text ends."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        words, langs, sizes, ends, held = [], [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            coded = pa.concat_arrays(words).dictionary_encode()
            spoken = pa.concat_arrays(langs).dictionary_encode()
            total = len(coded.dictionary)
            of_text = spoken.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.repeat(of_text, np.concatenate(sizes)) * max(total, 1) + coded.indices.to_numpy(zero_copy_only=False)
            known, local, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            end = np.concatenate(ends)
            del pairs
            body = np.zeros(len(local) + int(end.sum()), dtype=np.uint32)
            body[np.arange(len(local)) + np.cumsum(end) - end] = local + 1
            del local
            words.clear(), langs.clear(), sizes.clear(), ends.clear()
            held, n = 0, len(known)
            if n:
                for low in range(0, n, 1 << 14):
                    part = known[low:low + (1 << 14)]
                    size = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, chunk), pa.int64()), pa.array(np.arange(low, low + size), pa.int32()),
                         spoken.dictionary.take(pa.array(part // total)).cast(pa.string()),
                         coded.dictionary.take(pa.array(part % total)).cast(pa.string()), pa.array(counts[low:low + size], pa.int64()),
                         pa.nulls(size, pa.binary())], [c.split()[0] for c in CHUNKS.split(", ")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
                     pa.nulls(1, pa.int64()), pa.array([to_bytes(body)], pa.binary())], [c.split()[0] for c in CHUNKS.split(", ")])
            chunk += 1
            pa.default_memory_pool().release_unused()

        for batch in _small(batches):
            data, starts = text_bytes(batch["text"])
            if not len(data):
                continue
            begin, end, first = spans(data, starts, INSIDE)
            if not len(begin):
                continue
            if words and held + len(data) > chunk_bytes:
                yield from close()
            inside = LOWER[data[INSIDE[data]]]
            offsets = np.concatenate([[0], np.cumsum(end - begin)])
            words.append(pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(inside)))
            breaks = np.flatnonzero(BREAKS[data])
            last = np.zeros(len(begin), dtype=bool)
            last[:-1] = np.searchsorted(breaks, begin[1:]) != np.searchsorted(breaks, end[:-1])
            last[first[1:][first[1:] > 0] - 1] = True
            ends.append(last)
            langs.append(batch["lang"].cast(pa.large_string()))
            sizes.append(np.diff(first))
            held += len(data)
        if words:
            yield from close()

    known = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    return known.mapInArrow(cut, CHUNKS)


def encoded(landed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(chunk, body): chunks as word numbers, 0 for breaks and words that have none."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, codes in zip(batch["chunk"].to_pylist(), batch["body"], batch["codes"]):
                local, ids = (codes.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                body = from_bytes(body.as_py())[0]
                numbers = np.zeros(int(max(body.max(initial=0), local.max(initial=0) + 1)) + 1, dtype=np.int64)
                numbers[local + 1] = ids
                ids = numbers[body]
                # Words between two breaks are in no n-gram, and one break is as good as several.
                around = np.concatenate([[0], ids, [0]])
                ids = _closed(ids, (around[:-2] != 0) | (around[2:] != 0))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([to_bytes(ids)], pa.binary())], ["chunk", "body"])

    # Every word of a chunk goes through the join, so that its size follows the chunks' words, however many are frequent.
    known = landed.where("body IS NULL").join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left")
    codes = (known.groupBy("chunk").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("local", "id"))).alias("codes"))
             .where(F.size("codes") > 0))
    return (landed.where("body IS NOT NULL").select("chunk", "body").hint("merge").join(codes, "chunk")
            .mapInArrow(coded, "chunk bigint, body binary"))


def _closed(ids: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Word numbers with breaks in place of words that are not kept, and one break for several."""
    ids = np.where(kept, ids, 0)
    return ids[(ids != 0) | np.concatenate([[True], ids[:-1] != 0])]


# n-grams of one length

def _lanes_at(ids: np.ndarray, at: np.ndarray, layout: Layout, block: int = 1 << 16) -> list[np.ndarray]:
    """Permuted lanes of the n-grams that begin at these places, a block at a time: work arrays stay small."""
    out = [np.empty(len(at), np.uint64) for _ in range(layout.lanes)]
    for low in range(0, len(at), block):
        here = at[low:low + block]
        for lane, part in zip(out, layout.permute(layout.pack([ids[here + i] for i in range(layout.n)]))):
            lane[low:low + block] = part
    return out


def chunk_filters(bodies: DataFrame, kept: DataFrame | None, layout: Layout, fan_bits: int) -> DataFrame:
    """SLICES of every chunk's filter of the n-grams whose shorter ones (`kept`, rows of chunk and filter) are frequent,
    and in slot -1 the chunk's body without the words that are in no frequent shorter one."""
    shorter = Layout(layout.n - 1, layout.bits)
    bits, pairs = layout.slot_bits(1, fan_bits), kept is None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                chunk = batch["chunk"][row].as_py()
                ids = from_bytes(batch["body"][row].as_py())[0]
                word = ids != 0
                at = _all_words(word, layout.n if pairs else shorter.n)
                if not pairs:
                    filters = [Filter.load(shorter, b.as_py()) for b in batch["filters"][row].values]
                    known = np.zeros(len(ids) + 1, dtype=bool)
                    known[at] = Filter.merge(filters).has(_lanes_at(ids, at, shorter))
                    at = np.flatnonzero(known[:-1] & known[1:])
                    covered = known[:-1].copy()
                    for i in range(1, shorter.n):
                        covered[i:] |= known[:-1][:len(ids) - i]
                own = Filter.of(layout, _lanes_at(ids, at, layout))
                cuts = [(slot, f.dump()) for slot, f in own.cut(bits)]
                if cuts and not pairs:
                    cuts.append((-1, to_bytes(_closed(ids, covered))))
                if cuts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * len(cuts), pa.int64()), pa.array([s for s, _ in cuts], pa.int64()),
                         pa.array([b for _, b in cuts], pa.binary())], ["shard", "slot", "body"])

    if kept is not None:
        filters = kept.groupBy("chunk").agg(F.collect_list("body").alias("filters"))
        bodies = bodies.hint("merge").join(filters, "chunk")
    return bodies.mapInArrow(counted, SLICES)


def _all_words(word: np.ndarray, n: int) -> np.ndarray:
    """Where n words in a row begin."""
    if len(word) < n:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.all([word[i:len(word) - n + 1 + i] for i in range(n)], axis=0))


def _rows(shards: list[int], slots: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int64()), "slot": pa.array(slots, pa.int64()), "body": pa.array(bodies, pa.binary())})


def merged_finer(slices: DataFrame, shards: int, layout: Layout, bits: int) -> DataFrame:
    """Filters of the same slot and shard number modulo `shards` merged, and cut by `bits` leading bits."""
    def merge(key, group):
        whole = Filter.merge([Filter.load(layout, b.as_py()) for b in group["body"]])
        cuts = list(whole.cut(bits))
        return _rows([key[0].as_py()] * len(cuts), [s for s, _ in cuts], [f.dump() for _, f in cuts])

    return _dealt(slices, shards).groupBy("into", "slot").applyInArrow(merge, SLICES)


def merged_whole(slices: DataFrame, layout: Layout, least: int) -> DataFrame:
    """The last merge: n-grams (ids, a) that reach `least`, and for each slice what of it does (shard, slot, body)."""
    def merge(key, group):
        filters = [Filter.load(layout, b.as_py()) for b in group["body"]]
        whole = Filter.merge(filters)
        frequent = whole.where(whole.counts >= least)
        words = layout.unpack(layout.restore(frequent.lanes))
        ids = np.stack(words, axis=1).astype(np.int64) if len(frequent) else np.empty((0, layout.n), np.int64)
        shards, slots, bodies = _of_slices(group, filters, frequent)
        total, back = len(frequent), len(shards)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * layout.n, pa.int32()), pa.array(ids.ravel(), pa.int64()))
        return pa.table({
            "shard": pa.array(shards + [None] * total, pa.int64()), "slot": pa.array(slots + [None] * total, pa.int64()),
            "body": pa.array(bodies + [None] * total, pa.binary()),
            "ids": pa.concat_arrays([pa.nulls(back, pa.list_(pa.int64())), lists]),
            "a": pa.concat_arrays([pa.nulls(back, pa.int64()), pa.array(frequent.counts, pa.int64())])})

    return slices.groupBy("slot").applyInArrow(merge, MERGED)


def _of_slices(group: pa.Table, filters: list[Filter], frequent: Filter) -> tuple[list[int], list[int], list[bytes]]:
    """What of each slice is frequent, slices without any left out."""
    shards, slots, bodies = [], [], []
    for shard, slot, own in zip(group["shard"].to_pylist(), group["slot"].to_pylist(), filters):
        own = own.where(frequent.has(own.lanes))
        if len(own):
            shards.append(shard), slots.append(slot), bodies.append(own.dump())
    return shards, slots, bodies


def passed_back(slices: DataFrame, kept: DataFrame, shards: int, layout: Layout, finer: int) -> DataFrame:
    """What is frequent of each slice, from what is frequent (`kept`) of the filters they were merged into."""
    def choose(key, group, found):
        if not len(found) or not len(group):
            return _rows([], [], [])
        frequent = Filter.merge([Filter.load(layout, b.as_py()) for b in found["body"]])
        return _rows(*_of_slices(group, [Filter.load(layout, b.as_py()) for b in group["body"]], frequent))

    above = kept.select(F.col("shard").alias("into"), F.shiftright("slot", finer).alias("at"), "body")
    return (_dealt(slices, shards).withColumn("at", F.col("slot")).groupBy("into", "at")
            .cogroup(above.groupBy("into", "at")).applyInArrow(choose, SLICES))


def _dealt(slices: DataFrame, shards: int) -> DataFrame:
    return slices.withColumn("into", F.pmod(F.xxhash64("shard"), F.lit(shards)))


def frequent_grams(bodies: DataFrame, kept: DataFrame | None, layout: Layout, least: int, shards: int,
                   fan_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, a) of the n-grams that reach `least`, (chunk, body) of those in each chunk, and the bodies that longer ones need."""
    counted = land(chunk_filters(bodies, kept, layout, fan_bits), "grams")
    left = bodies if kept is None else counted.where("slot = -1").select(F.col("shard").alias("chunk"), "body")
    levels, sizes = [counted.where("slot >= 0")], []
    while shards > 1 << fan_bits:
        shards = -(-shards >> fan_bits)
        sizes.append(shards)
        levels.append(land(merged_finer(levels[-1], shards, layout, layout.slot_bits(len(levels) + 1, fan_bits)), "grams"))
    last = land(merged_whole(levels[-1], layout, least), "grams")
    back = last.where("ids IS NULL").select("shard", "slot", "body")
    for depth in range(len(sizes) - 1, -1, -1):
        finer = layout.slot_bits(depth + 2, fan_bits) - layout.slot_bits(depth + 1, fan_bits)
        back = land(passed_back(levels[depth], back, sizes[depth], layout, finer), "grams")
    return last.where("ids IS NOT NULL").select("ids", "a"), back.select(F.col("shard").alias("chunk"), "body"), left


# Scores

def scored(grams: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """(ids, lang, n, a, l, r, score) of every phrase of two words or more; `grams` has its parts too."""
    exact = "decimal(19,0)"
    phrases = grams.where(F.size("ids") > 1).withColumn("id", F.col("ids")[0]).join(vocabulary.select("id", "lang"), "id").drop("id")
    cuts = (phrases.join(totals, "lang")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
            .withColumn("left", F.slice("ids", F.lit(1), F.col("k")))
            .withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))))
    cuts = (cuts.join(grams.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
            .join(grams.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right"))
    cuts = cuts.withColumn("score", F.expr(f"(1000 * cast(a AS {exact}) * cast(n AS {exact})) div (cast(l AS {exact}) * cast(r AS {exact}))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return (cuts.groupBy("ids").agg(lowest, F.min("lang").alias("lang"), F.min("n").alias("n"), F.min("a").alias("a"))
            .select("ids", "lang", "n", "a", "m.l", "m.r", "m.score"))


def not_inside_longer(phrases: DataFrame) -> DataFrame:
    """Phrases but those that a longer one contains as often as they occur.

    One word longer is enough: frequencies only fall as words are added, so what lies between is as frequent too.
    """
    size = F.size("ids")
    inner = (phrases.where(size > 2)
             .select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a")
             .groupBy("ids").agg(F.max("a").alias("longer")))
    return phrases.join(inner, "ids", "left").where("longer IS NULL OR longer < a").drop("longer")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, chunk_bytes: int = CHUNK_BYTES,
                 fan_bits: int = FAN_BITS) -> DataFrame:
    """The `best` phrases of 2 to `longest` words of each lang: (lang, rank, phrase, a, l, r, n, score)."""
    landed = land(chunks(docs, chunk_bytes), "chunks")
    words = land(landed.where("body IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = number_sorted(words.where(F.col("a") >= least), [F.col("a").desc(), F.col("lang"), F.col("word")], into="id")
    vocabulary = land(vocabulary.withColumn("id", F.col("id") + 1).select("id", "lang", "word", "a"), "vocabulary")
    bits = max(1, int(vocabulary.count()).bit_length())
    bodies = land(encoded(landed, vocabulary), "bodies")
    shards = bodies.count()
    # A merge of all chunks has no more entries a slot than a quarter of a chunk, as long as one round is enough.
    fan_bits = min(fan_bits, shards.bit_length() + 2)

    parts, kept = [vocabulary.select(F.array("id").alias("ids"), "a")], None
    for n in range(2, longest + 1):
        found, kept, bodies = frequent_grams(bodies, kept, Layout(n, bits), least, shards, fan_bits)
        parts.append(found)
    grams = parts[0]
    for more in parts[1:]:
        grams = grams.unionByName(more)
    return ranked(not_inside_longer(scored(grams, vocabulary, totals)), vocabulary, best)


def ranked(phrases: DataFrame, vocabulary: DataFrame, best: int) -> DataFrame:
    """The first `best` of each lang, by score, frequency and spelling."""
    figures: list[Column] = [F.col("score").desc(), F.col("a").desc()]
    tied = land(phrases.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*figures))).where(F.col("place") <= best), "tied")
    spelled = (tied.select("ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "word"), "id")
               .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
               .select("ids", F.array_join("words.word", " ").alias("phrase")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(*figures, F.col("phrase")))
    return (tied.join(spelled, "ids").withColumn("rank", place).where(F.col("rank") <= best)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
