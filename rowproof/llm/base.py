"""What the operators share: session settings, tables, and hashing of the words of a batch of texts."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.session import configure, land

# Arrow batches small enough that a batch of very long texts fits beside its word hashes.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}

MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")))


def mix_number(x: int) -> int:
    """The finishing step of SplitMix64 on one number."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def numbers(count: int, seed: int) -> np.ndarray:
    """`count` fixed pseudo-random 64-bit numbers."""
    return np.array([mix_number((seed << 32) + i) for i in range(count)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finishing step on every element."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(max(count, 1), base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


BYTE_BASE = 0x9DDFEA08EB382D69
WORD_BASE = 0xC2B2AE3D27D4EB4F


def _folded(table: np.ndarray) -> np.ndarray:
    table[65:91] = table[97:123]
    return table


PLAIN_CODES = numbers(256, 12)
BYTE_CODES = _folded(numbers(256, 11))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Letters, digits and everything outside ASCII: words without their punctuation.
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and where each text starts; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[starts[0]:starts[-1]], starts - starts[0]


def spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes admitted by `inside`: their starts, their ends, and the first run of each text."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    ok = inside[data]
    edge[1:-1] = ok[1:] != ok[:-1]
    if len(data):
        edge[0], edge[-1] = ok[0], ok[-1]
    # A run also ends where its text does.
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = np.unique(cuts[ok[cuts] & ok[cuts - 1]]) if len(cuts) else cuts
    at = np.flatnonzero(edge)
    begin, end = at[0::2], at[1::2]
    if len(joined):
        begin = np.sort(np.concatenate([begin, joined]))
        end = np.sort(np.concatenate([end, joined]))
    return begin, end, np.searchsorted(begin, starts)


STRETCH = 1 << 15
BYTE_POWERS = powers(BYTE_BASE, STRETCH)
# The base is odd, so that dividing by it is multiplying by its inverse modulo 2^64.
BYTE_ROOTS = powers(pow(BYTE_BASE, -1, 1 << 64), STRETCH)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, longest: int | None = None) -> np.ndarray:
    """A 64-bit hash of each run of bytes, A-Z folded; of its first `longest` bytes when given.

    The runs ascend. A run's sum of codes times powers of the base is a difference of running sums over a stretch of bytes,
    brought back to the run's own start.
    """
    size = end - begin
    if longest is not None:
        size = np.minimum(size, longest)
        end = begin + size
    out = np.empty(len(begin), dtype=np.uint64)
    sums = np.zeros(STRETCH + 1, dtype=np.uint64)
    low = 0
    while low < len(begin):
        base = begin[low]
        high = int(np.searchsorted(end, base + STRETCH, "right"))
        if high <= low:
            # One run longer than a stretch.
            out[low], low = _long_sum(data[base:end[low]]), low + 1
            continue
        codes = BYTE_CODES[data[base:end[high - 1]]]
        codes *= BYTE_POWERS[:len(codes)]
        np.cumsum(codes, out=sums[1:len(codes) + 1])
        first = begin[low:high] - base
        out[low:high] = (sums[end[low:high] - base] - sums[first]) * BYTE_ROOTS[first]
        low = high
    return mixed(out ^ (size.astype(np.uint64) * np.uint64(WORD_BASE)))


def _long_sum(data: np.ndarray) -> np.uint64:
    total = 0
    for at in range(0, len(data), STRETCH):
        codes = BYTE_CODES[data[at:at + STRETCH]]
        total += int((codes * BYTE_POWERS[:len(codes)]).sum()) * pow(BYTE_BASE, at, 1 << 64)
    return np.uint64(total & MASK)


def word_hashes(texts: pa.Array, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the index of each text's first word (one more at the end)."""
    data, starts = text_bytes(texts)
    begin, end, first = spans(data, starts, inside)
    return span_hashes(data, begin, end), first


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` words in a row of one text; of the whole text where it has fewer."""
    if not len(words):
        return words
    use = min(size, len(words))
    total = np.zeros(len(words) - use + 1, dtype=np.uint64)
    for i, power in enumerate(powers(WORD_BASE, use)):
        total += words[i:len(words) - use + 1 + i] * power
    return mixed(total ^ np.uint64(use))


def list_array(values: np.ndarray, offsets: Sequence[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(values, type=kind))


def whole_groups(batches, keys: Sequence[str]):
    """Tables of whole groups from batches sorted by `keys`: each table holds complete groups only.

    Yields (table, starts): where each group starts in the table, with its length at the end.
    Memory holds a batch and the group that runs over its end, so groups must be of bounded size.
    """
    held = []

    def cut(table: pa.Table):
        edge = np.zeros(len(table), dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            edge[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(edge)

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = cut(table)
        if not len(at):
            held = table.to_batches()
            continue
        yield table.slice(0, at[-1]), np.concatenate([[0], at])
        held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([[0], cut(table), [len(table)]])


def fixed_lists(column: pa.ChunkedArray, kind) -> np.ndarray:
    """A matrix from a list column whose lists are equally long and not null."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).view(kind).reshape(len(column), -1)


def checked_broadcast(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A table of a few numbers a row, written and counted: sent to every executor up to `most_rows`,
    otherwise left to a shuffled join. The result is the same either way."""
    written = land(df, "lookup")
    return F.broadcast(written) if written.count() <= most_rows else written
