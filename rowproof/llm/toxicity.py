"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: its words without punctuation, and the first five bytes of each
word longer than that. Terms are hashed into buckets; the buckets that tell the classes apart on the
labelled rows, alone or in a pair, carry a weight each and a short vector, and the score is
sigmoid(bias + sum of weights + sum over pairs of the products of their vectors), so that a pair of
terms can count for more, or less, than its parts, also where each part alone says nothing.

Null and empty texts score as texts without terms. Repeated rows score alike. With no labelled row,
or only one class among them, every score is the smoothed share of label 1.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.base import IS_TERM, id_crc, mixed, span_hashes, spans, text_bytes
from rowproof.session import land

PREFIX = 5


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 20
    least_rows: int = 3
    factors: int = 8
    epochs: int = 30
    rate: float = 0.1
    decay: float = 1e-4
    # Labelled rows the model is fitted on, at most: those whose hashed ids come first.
    most_rows: int = 20_000


def term_sets(texts: pa.Array, buckets: int) -> list[np.ndarray]:
    """The distinct buckets of each text's terms."""
    data, starts = text_bytes(texts)
    begin, end, first = spans(data, starts, IS_TERM)
    whole = span_hashes(data, begin, end)
    long = np.flatnonzero(end - begin > PREFIX)
    heads = mixed(span_hashes(data, begin[long], end[long], PREFIX))
    first_long = np.searchsorted(long, first)
    size = np.uint64(buckets)
    whole, heads = (whole % size).astype(np.int32), (heads % size).astype(np.int32)
    return [np.unique(np.concatenate([whole[first[i]:first[i + 1]], heads[first_long[i]:first_long[i + 1]]]))
            for i in range(len(starts) - 1)]


@dataclass(frozen=True)
class Machine:
    """Weights of the chosen buckets, which are sorted."""
    buckets: int
    chosen: np.ndarray
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.array([self._one(self.places(s)) for s in term_sets(texts, self.buckets)])

    def places(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, terms), len(self.chosen) - 1)
        return at[self.chosen[at] == terms]

    def _one(self, at: np.ndarray) -> float:
        v = self.vectors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        x = self.bias + float(self.weight[at].sum()) + pairs
        return 1.0 / (1.0 + float(np.exp(-np.clip(x, -30, 30))))


def fit_machine(rows: list[tuple[np.ndarray, int]], chosen: np.ndarray, s: Settings) -> Machine:
    """Stochastic gradient steps with a step size per weight; `rows` hold places in `chosen`."""
    positive = sum(label for _, label in rows)
    share = (positive + 0.5) / (len(rows) + 1)
    bias = float(np.log(share / (1 - share)))
    weight = np.zeros(len(chosen))
    draw = np.random.default_rng(7)
    vectors = draw.normal(0, 0.01, (len(chosen), s.factors))
    if 0 < positive < len(rows):
        seen_w, seen_v, seen_b = np.full(len(chosen), 1e-3), np.full(vectors.shape, 1e-3), 1e-3
        for _ in range(s.epochs):
            for k in draw.permutation(len(rows)):
                at, label = rows[k]
                v = vectors[at]
                total = v.sum(0)
                x = bias + weight[at].sum() + 0.5 * (total ** 2 - (v * v).sum(0)).sum()
                slope = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - label
                seen_b += slope * slope
                bias -= s.rate * slope / np.sqrt(seen_b)
                step = slope + s.decay * weight[at]
                seen_w[at] += step * step
                weight[at] -= s.rate * step / np.sqrt(seen_w[at])
                step = slope * (total - v) + s.decay * v
                seen_v[at] += step * step
                vectors[at] = v - 0.3 * s.rate * step / np.sqrt(seen_v[at])
    return Machine(s.buckets, chosen, bias, weight, vectors)


def evidence(n, t, share):
    """Twice the log likelihood ratio of `t` toxic rows among `n` against a share of toxic rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(t > 0, t * np.log(t / (n * share)), 0.0)
                    + np.where(n > t, (n - t) * np.log((n - t) / (n * (1 - share))), 0.0))


PIECE = 1 << 20


def renumbered(terms: np.ndarray, ends: np.ndarray, number: np.ndarray, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """Every row's terms by their new numbers, those numbered -1 left out, and where each row starts (one more at the end)."""
    kept, parts = np.zeros(len(terms) + 1, dtype=np.int32), [np.empty(0, kind)]
    for at in range(0, len(terms), PIECE):
        new = number[terms[at:at + PIECE]]
        kept[at + 1:at + 1 + len(new)] = new >= 0
        parts.append(new[new >= 0].astype(kind))
    before = np.cumsum(kept, dtype=np.int32)
    return np.concatenate(parts), np.concatenate([np.zeros(1, np.int32), before[ends]])


def often_enough(n: np.ndarray, share: float) -> np.ndarray:
    """Which of the terms in `n` rows each are in so many that a pair of them could tell the classes apart."""
    return 2 * n * -np.log(min(share, 1 - share)) >= least_of_pairs(len(n))


def least_of_pairs(known: int) -> float:
    return 2 * np.log(max(known * (known - 1) // 2, 1))


def numbered(held: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and labels of the rows, all their terms among `buckets` (sorted) by number, and where each row's terms end."""
    kind = np.uint16 if len(buckets) <= 1 << 16 else np.int32

    def short(batches):
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["terms"].value_lengths().to_numpy()
            terms = batch["terms"].flatten().to_numpy()
            at = np.minimum(np.searchsorted(buckets, terms), max(len(buckets) - 1, 0))
            known = buckets[at] == terms if len(buckets) else np.zeros(len(terms), dtype=bool)
            before = np.concatenate([[0], np.cumsum(known)])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(before[ends] - before[ends - sizes], pa.int64()),
                 pa.array([x.tobytes() for x in np.split(at[known].astype(kind), before[ends[:-1]])], pa.binary())],
                ["doc_id", "label", "size", "body"])

    found = held.mapInArrow(short, "doc_id bigint, label int, size bigint, body binary").toArrow()
    label = (found["label"].to_numpy() == 1).astype(np.int64)
    terms = np.frombuffer(b"".join(x.as_buffer() for c in found["body"].chunks for x in c), kind)
    return found["doc_id"].to_numpy().copy(), label, terms, np.cumsum(found["size"].to_numpy())


def paired(spark: SparkSession, terms: np.ndarray, ends: np.ndarray, label: np.ndarray, n: np.ndarray, t: np.ndarray,
           share: float, often: np.ndarray, known: int, least_rows: int) -> np.ndarray:
    """Terms of pairs that tell the classes apart beyond the share of all rows and that of either term; in every pair of terms
    that are in rows often enough, of `known` ones.

    `terms` holds each row's terms, which are ascending numbers; `n` and `t` their rows and toxic rows.
    """
    least = least_of_pairs(known)
    often = np.flatnonzero(often)
    if len(often) < 2:
        return np.empty(0, np.int64)
    number = np.full(len(n), -1, dtype=np.int32)
    number[often] = np.arange(len(often))
    # Tasks are sent the short numbers alone, and sort them themselves.
    terms, first = renumbered(terms, ends, number, np.uint16 if len(often) <= 1 << 16 else np.int32)
    rate = (t[often] + share) / (n[often] + 1)

    def found(batches):
        order = np.argsort(terms, kind="stable")
        begin = np.searchsorted(terms[order], np.arange(len(rate) + 1))
        rows = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(first))[order]
        # A row's terms ascend: those after a term, up to the row's end, are its pairs.
        after, stop, toxic = order + 1, first[rows + 1], label[rows] == 1

        def beside(a, only):
            held = slice(begin[a], begin[a + 1])
            spans_ = [terms[x:y] for x, y in zip(after[held][only].tolist(), stop[held][only].tolist())]
            return np.bincount(np.concatenate(spans_) if spans_ else np.empty(0, np.int32), minlength=len(rate))

        for batch in batches:
            told = set()
            for a in batch["id"].to_pylist():
                both, ill = beside(a, slice(None)), beside(a, toxic[begin[a]:begin[a + 1]])
                b = a + 1 + np.flatnonzero(both[a + 1:] >= least_rows)
                told_by = np.minimum(evidence(both[b], ill[b], share),
                                     np.minimum(evidence(both[b], ill[b], rate[a]), evidence(both[b], ill[b], rate[b])))
                b = b[told_by >= least]
                if len(b):
                    told.update(b.tolist(), [a])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(told), pa.int64())], ["term"])

    parts = 4 * spark.sparkContext.defaultParallelism
    told = spark.range(0, len(often), 1, parts).mapInArrow(found, "term bigint").distinct().toArrow()["term"].to_numpy()
    return often[told]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: Column | None = None) -> Machine:
    """A machine fitted on at most `most_rows` labelled documents, those of `held_out` left out.

    Short numbers of the terms that can count reach the driver, not the texts nor their other terms; terms and pairs are
    counted in tasks.
    """
    s = settings
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        usable = usable.where(~held_out)
    sample = (usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_rows))
    # At most `most_rows` pairs of numbers are broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(term_sets(batch["text"], s.buckets), pa.list_(pa.int32()))],
                ["doc_id", "label", "terms"])

    # The sample's terms stay in the shared folder; the driver gets the counts of those that several rows hold.
    held = land(texts.select("doc_id", "text", "label").mapInArrow(placed, "doc_id bigint, label int, terms array<int>"), "terms")
    toxic = F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)).alias("t")
    count, positive = held.agg(F.count("*"), toxic).first()
    counts = (held.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), toxic)
              .where(F.col("n") >= s.least_rows).toArrow().sort_by("bucket"))
    buckets, n, t = (counts[c].to_numpy() for c in ("bucket", "n", "t"))
    share = (positive + 0.5) / (count + 1)
    # Evidence of a term, or a pair, against the label must exceed what the best of as many meaningless ones would reach.
    alone = evidence(n, t, share) >= 2 * np.log(max(len(n), 1))
    often = often_enough(n, share)
    used = np.flatnonzero(alone | often)
    doc_ids, label, terms, ends = numbered(held, buckets[used])
    places = paired(docs.sparkSession, terms, ends, label, n[used], t[used], share, often[used], len(n), s.least_rows)
    told = np.union1d(np.flatnonzero(alone[used]), places).astype(np.int64)
    place = np.full(len(used), -1, dtype=np.int32)
    place[told] = np.arange(len(told))
    terms, first = renumbered(terms, ends, place)
    rows = [(terms[first[k]:first[k + 1]], int(label[k])) for k in np.argsort(doc_ids, kind="stable").tolist()]
    return fit_machine(rows, buckets[used[told]].astype(np.int32), s)


def toxicity_score(text: Column, machine: Machine) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(machine.scores(texts), pa.float64())
    return score(text)


def held_out_third() -> Column:
    return id_crc() % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
                    settings: Settings = Settings()) -> DataFrame:
    """Every document with its score; labels of the held-out third are never read."""
    machine = train(docs, labels, settings, held_out_third())
    return (docs.select("doc_id", held_out_third().alias("held_out"), toxicity_score(F.col("text"), machine).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
                 settings: Settings = Settings()) -> DataFrame:
    """The documents below the threshold, their columns untouched."""
    machine = train(docs, labels, settings, held_out_third())
    return docs.where(toxicity_score(F.col("text"), machine) < threshold)
