"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A text becomes its pieces of the greatest total score (of equal ones the one whose last piece is
longest, from the end on; scores may be fractions); a character in no piece becomes its UTF-8 bytes. As in the library, a
space is written as U+2581 and one is put before the text, so decoding gives the text back exactly,
but for U+2581 itself, which comes back as a space. The model file is a parameter.

Neighbouring characters that no piece holds side by side are a certain boundary. Cut there, a batch
falls into short chunks, each distinct one solved once: chunks of equal length advance together, the
hashes of their substrings probe the sorted keys of the pieces, and the maxima store backpointers.

Null and empty texts have no ids (an empty list); null ids decode to null.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.base import list_array, mixed, powers, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
BASE = 0x9E3779B97F4A7C15
LONG = 400  # characters; longer chunks, of which there are few, are solved one by one
# What an unknown character costs below the least score, as in the library.
PENALTY = 10


def inverse_powers(count: int) -> np.ndarray:
    return powers(pow(BASE, -1, 1 << 64), count)


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: sorted substring hashes, ids and scores, and each id's bytes."""
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: int | float
    first_byte: int
    filter: np.ndarray
    pairs: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        may = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        found = np.searchsorted(self.keys, hashes[may])
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == hashes[may]
        out[may[hit]] = found[hit]
        return out


def pair_slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)


def key_of(points: np.ndarray) -> np.ndarray:
    """Hash of one string of code points, as the search computes it for substrings."""
    return mixed(np.array([(points.astype(np.uint64) * powers(BASE, len(points))).sum()], dtype=np.uint64)
                 ^ np.uint64(len(points)))


def load_pieces(model_file: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found, raw = [], []
    first_byte = next(i for i in range(model.vocab_size()) if model.is_byte(i))
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([i - first_byte]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.replace(chr(SPACE), " ").encode())
            points = np.array([ord(c) for c in piece], dtype=np.uint32)
            found.append((int(key_of(points)[0]), i, model.get_score(i), points))
    found.sort(key=lambda x: x[0])
    keys = np.array([x[0] for x in found], dtype=np.uint64)
    scores = np.array([x[2] for x in found], dtype=np.float64)
    if (scores == np.floor(scores)).all():
        scores = scores.astype(np.int64)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[keys >> np.uint64(44)] = True
    pairs = np.zeros(1 << 20, dtype=bool)
    for *_, points in found:
        pairs[pair_slots(points[:-1], points[1:])] = True
    return Pieces(keys, np.array([x[1] for x in found], dtype=np.int32), scores, max(len(x[3]) for x in found),
                  scores.min().item() - PENALTY, first_byte, seen, pairs,
                  np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def search(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of chunks of one length (a row each): flat places, or -1 - code point, and their number per row."""
    rows, size = points.shape
    sums = np.zeros((size + 1, rows), dtype=np.uint64)
    columns = np.ascontiguousarray(points.T)
    np.cumsum(columns.astype(np.uint64) * powers(BASE, size)[:, None], axis=0, out=sums[1:])
    back_powers = inverse_powers(size)
    best = np.zeros((size + 1, rows), dtype=p.scores.dtype)
    piece = np.empty((size + 1, rows), dtype=np.int32)
    length = np.empty((size + 1, rows), dtype=np.int16)
    least = np.iinfo(np.int64).min if p.scores.dtype == np.int64 else -np.inf
    for end in range(1, size + 1):
        top = np.full(rows, least, dtype=p.scores.dtype)
        # From the longest piece down, so that of equal sums the longest stays.
        for take in range(min(end, p.longest), 0, -1):
            at = end - take
            place = p.probe(mixed(((sums[end] - sums[at]) * back_powers[at]) ^ np.uint64(take)))
            score = best[at] + np.where(place >= 0, p.scores[place], p.unknown)
            better = score > top
            if take > 1:
                better &= place >= 0
            top[better] = score[better]
            piece[end, better] = place[better]
            length[end, better] = take
        best[end] = top
    tokens = np.empty((size, rows), dtype=np.int32)
    count = np.zeros(rows, dtype=np.int64)
    at = np.full(rows, size)
    alive = np.arange(rows)
    while len(alive):
        here = at[alive]
        place = piece[here, alive]
        count[alive] += 1
        tokens[size - count[alive], alive] = np.where(place >= 0, place, -1 - columns[here - 1, alive].astype(np.int32))
        at[alive] = here - length[here, alive]
        alive = alive[at[alive] > 0]
    kept = np.arange(size)[None, :] >= (size - count)[:, None]
    return tokens.T[kept], count


def search_long(points: np.ndarray, p: Pieces, by_key: dict[bytes, int]) -> np.ndarray:
    """Tokens of one long chunk, piece by piece through a dictionary."""
    size, raw = len(points), points.astype(np.uint32).tobytes()
    best, piece, length = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for end in range(1, size + 1):
        top = None
        for take in range(min(end, p.longest), 0, -1):
            place = by_key.get(raw[4 * (end - take):4 * end], -1)
            if place < 0 and take > 1:
                continue
            score = best[end - take] + (p.scores[place].item() if place >= 0 else p.unknown)
            if top is None or score > top:
                top, piece[end], length[end] = score, place, take
        best[end] = top
    out, at = [], size
    while at:
        out.append(piece[at] if piece[at] >= 0 else -1 - int(points[at - 1]))
        at -= length[at]
    return np.array(out[::-1], dtype=np.int32)


def by_points(p: Pieces) -> dict[bytes, int]:
    """Each piece's code points to its place."""
    out = {}
    for place, i in enumerate(p.ids):
        text = p.data[p.starts[i]:p.starts[i + 1]].tobytes().decode().replace(" ", chr(SPACE))
        out[text.encode("utf-32-le")] = place
    return out


def spell(tokens: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of tokens, unknown characters spelt in bytes, and how many ids each token takes."""
    lost = tokens < 0
    points = (-1 - tokens).astype(np.int64)
    width = np.where(lost, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
    ids = np.repeat(np.where(lost, 0, p.ids[np.where(lost, 0, tokens)]), width)
    if lost.any():
        text = "".join(map(chr, points[lost])).encode("utf-8", "surrogatepass")
        ids[np.repeat(lost, width)] = np.frombuffer(text, dtype=np.uint8).astype(np.int32) + p.first_byte
    return ids, width


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] steps, then the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def encode(texts: pa.Array, p: Pieces, long_pieces: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and where each text's ids start (one more at the end)."""
    data, starts = text_bytes(texts)
    # Code points of the batch, a marker before each text that is not empty.
    lead = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[starts]
    plain = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).copy()
    plain[plain == 0x20] = SPACE
    filled = np.diff(first) > 0
    points = np.insert(plain, first[:-1][filled], SPACE)
    edges = first + np.concatenate([[0], np.cumsum(filled)])
    if not len(points):
        return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
    cut = np.ones(len(points) + 1, dtype=bool)
    cut[1:-1] = ~p.pairs[pair_slots(points[:-1], points[1:])]
    cut[edges] = True
    begin = np.flatnonzero(cut)
    size = np.diff(begin)
    begin = begin[:-1]
    # Distinct chunks.
    sums = np.zeros(len(begin), dtype=np.uint64)
    step = 1 << 18
    for low in range(0, len(begin), step):
        n = size[low:low + step]
        head = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(head, n)
        part = points[begin[low]:begin[low] + int(n.sum())].astype(np.uint64)
        sums[low:low + step] = np.add.reduceat(part * powers(BASE, int(n.max()))[within], head)
    _, one, back = np.unique(mixed(sums ^ size.astype(np.uint64)), return_index=True, return_inverse=True)
    tokens, counts = [], np.zeros(len(one), dtype=np.int64)
    order = np.argsort(size[one], kind="stable")
    sizes, at = np.unique(size[one][order], return_index=True)
    limits = np.append(at, len(order))
    for k, n in enumerate(sizes):
        group = order[limits[k]:limits[k + 1]]
        if n > LONG:
            long_pieces = long_pieces or by_points(p)
            solved = [search_long(points[begin[one[g]]:begin[one[g]] + n], p, long_pieces) for g in group]
            tokens += solved
            counts[group] = [len(x) for x in solved]
            continue
        for low in range(0, len(group), max(1, (1 << 20) // int(n))):
            some = group[low:low + max(1, (1 << 20) // int(n))]
            flat, counts[some] = search(points[begin[one[some]][:, None] + np.arange(n)], p)
            tokens.append(flat)
    ids, width = spell(np.concatenate(tokens), p)
    # Tokens lie in the order of `order`; bring them back to the chunks of the texts.
    reach = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(counts[order])
    id_start, id_count = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    id_start[order] = reach[ends - counts[order]]
    id_count[order] = reach[ends] - reach[ends - counts[order]]
    chunk_ids = id_count[back]
    out = ids[ranges(id_start[back], chunk_ids)].astype(np.int32)
    before = np.concatenate([[0], np.cumsum(chunk_ids)])
    return out, before[np.searchsorted(begin, edges)]


def decode(ids: np.ndarray, starts: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of lists of ids, without the leading marker, and where each text starts."""
    width = np.diff(p.starts)[ids]
    data = p.data[ranges(p.starts[:-1][ids], width)]
    edges = np.concatenate([[0], np.cumsum(width)])[starts]
    filled = np.diff(edges) > 0
    marked = filled & (data[np.minimum(edges[:-1], max(len(data) - 1, 0))] == 0x20) if len(data) else filled
    return np.delete(data, edges[:-1][marked]), edges - np.concatenate([[0], np.cumsum(marked)])


def encode_pieces(text: Column, p: Pieces) -> Column:
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        ids, starts = encode(texts, p)
        return list_array(ids, starts, pa.int32())
    return encoded(text)


def decode_pieces(ids: Column, p: Pieces) -> Column:
    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
        data, starts = decode(flat, np.concatenate([[0], np.cumsum(sizes)]), p)
        raw = data.tobytes()
        return pa.array([None if not there else raw[a:b].decode("utf-8", "replace") for a, b, there in
                         zip(starts[:-1], starts[1:], lists.is_valid().to_pylist())], pa.string())
    return decoded(ids)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                        T.StructField("round_trip", T.BooleanType())])


def encode_checked(text: Column, p: Pieces) -> Column:
    """A struct of the ids, their number, and whether they decode to the text's own bytes."""
    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        ids, starts = encode(texts, p)
        again, edges = decode(ids, starts, p)
        data, own = text_bytes(texts)
        same = np.diff(own) == np.diff(edges)
        if same.all():
            wrong = np.searchsorted(own, np.flatnonzero(data != again), "right") - 1
            same[wrong] = False
        else:
            same = np.array([bool(np.array_equal(data[a:b], again[c:d])) for a, b, c, d in
                             zip(own[:-1], own[1:], edges[:-1], edges[1:])])
        return pa.StructArray.from_arrays([list_array(ids, starts, pa.int32()), pa.array(np.diff(starts).astype(np.int64)),
                                           pa.array(same)], names=[f.name for f in ENCODED])
    return encoded(text)
