"""Exact top-k inner products through a pivot-distance index.

Vectors are keyed by their nearest pivot and, within it, by distance: every pivot's distances are cut
into rings, a ring into cells of bounded size. For a query q and a ring of pivot p with distances in
[near, far], no vector of the ring is closer than max(|q-p| - far, near - |q-p|, 0), and since
2 q.x = |q|^2 + |x|^2 - |q-x|^2, no score in the ring exceeds (|q|^2 + largest |x|^2 - that^2) / 2.
A query first opens the rings with the highest bounds until they hold k vectors and keeps its k-th
score; then it opens, in all, just the rings whose bound reaches that score. What is left out is
proved lower, so results are exact; ties go to the smaller id.

Pivots are drawn from a bounded sample (`most_sampled` vectors of the smallest hashed ids); every
vector is indexed. Vectors that are null, or hold null or non-finite components, take no part, nor do
rows without an id. Vectors shorter than the longest count as zero beyond their end. Components
become floor(1024 * x). Rows that repeat an id are candidates each; a query never meets its own id.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowproof.session import land


@dataclass(frozen=True)
class Settings:
    k: int = 10
    pivots: int = 64
    rings: int = 8
    cell_rows: int = 4096
    block_queries: int = 512
    most_sampled: int = 4096


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of whole numbers."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (table.where(F.col("vec_id").isNotNull()).where(fine)
            .select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * 1024).cast("bigint")).alias("v")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    sizes = np.array(column.value_lengths().to_pylist(), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def draw_pivots(vectors: DataFrame, s: Settings) -> np.ndarray:
    """Spread-out vectors of a bounded sample, each drawn with a chance that grows with its distance."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.most_sampled).select("v").toArrow()["v"]
    if not len(rows):
        return np.zeros((1, 1))
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    sample = matrix(pa.concat_arrays(rows.chunks) if rows.num_chunks else rows.combine_chunks(), max(width, 1))
    draw = np.random.default_rng(5)
    chosen = [sample[0]]
    gap = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < s.pivots and gap.sum() > 0:
        chosen.append(sample[draw.choice(len(sample), p=gap / gap.sum())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def index_vectors(vectors: DataFrame, pivots: np.ndarray, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(vectors with pivot, ring and cell; rings with their distances, largest |x|^2 and cells)."""
    width = pivots.shape[1]

    def keyed(batches):
        for batch in batches:
            x = matrix(batch["v"], width)
            d = distances(x, pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]),
                 pa.array((x * x).sum(1))], ["vec_id", "v", "pivot", "distance", "square"])

    near = land(vectors.mapInArrow(keyed, "vec_id bigint, v array<bigint>, pivot int, distance double, square double"), "vectors")
    # Ring borders are approximate quantiles: any borders give right results.
    shares = [i / s.rings for i in range(1, s.rings)]
    borders = near.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("borders"))
    ringed = near.join(borders, "pivot").withColumn("ring", F.size(F.filter("borders", lambda b: b < F.col("distance"))))
    rings = land(ringed.groupBy("pivot", "ring").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("square").alias("square"),
        F.count("*").alias("n")).withColumn("cells", F.ceil(F.col("n") / s.cell_rows).cast("int")), "rings")
    celled = (ringed.join(rings.select("pivot", "ring", "cells"), ["pivot", "ring"])
              .select("vec_id", "v", "pivot", "ring", F.pmod(F.xxhash64("vec_id"), "cells").cast("int").alias("cell")))
    return land(celled, "cells"), rings


def routes(queries: DataFrame, rings: DataFrame, pivots: np.ndarray, s: Settings, first: bool) -> DataFrame:
    """(query_id, v, pivot, ring) for the rings a query opens: at first the best that hold k vectors and one
    more, later those whose bound reaches `least`. Rings are pivots * rings rows at most, a fixed number."""
    table = rings.orderBy("pivot", "ring").toPandas()
    pivot, ring, near, far, square, n = (table[c].to_numpy() for c in ("pivot", "ring", "near", "far", "square", "n"))
    width, k = pivots.shape[1], s.k

    def routed(batches):
        for batch in batches:
            q = matrix(batch["v"], width)
            d = distances(q, pivots)[:, pivot]
            gap = np.maximum(np.maximum(d - far, near - d), 0)
            # A margin for rounding keeps bounds safe.
            bound = ((q * q).sum(1)[:, None] + square - gap * gap) / 2 * (1 + 1e-9) + 1.0
            if first:
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                opened = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(opened, order, held - n[order] < k + 1, axis=1)
            else:
                least = batch["least"].to_numpy(zero_copy_only=False)
                opened = ~(bound < least[:, None])
            at, to = np.nonzero(opened)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch["query_id"].take(rows), batch["v"].take(rows), pa.array(pivot[to].astype(np.int32)),
                                              pa.array(ring[to].astype(np.int32))], ["query_id", "v", "pivot", "ring"])

    return queries.mapInArrow(routed, "query_id bigint, v array<bigint>, pivot int, ring int")


def best_in_cells(routed: DataFrame, cells: DataFrame, rings: DataFrame, width: int, s: Settings) -> DataFrame:
    """(query_id, vec_id, score): the k best of every opened cell. Queries meet a cell in blocks."""
    k = s.k
    dealt = (routed.join(rings.select("pivot", "ring", "cells"), ["pivot", "ring"])
             .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells"))
    blocks = land(dealt, "routes")
    many = blocks.groupBy("pivot", "ring", "cell").agg(F.ceil(F.count("*") / s.block_queries).cast("int").alias("blocks"))
    left = blocks.join(many, ["pivot", "ring", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    right = (cells.join(many, ["pivot", "ring", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def scored(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(vectors):
            one = lambda t, c: pa.concat_arrays(t[c].chunks)
            q, x = matrix(one(queries, "v"), width), matrix(one(vectors, "v"), width)
            ids, own = one(vectors, "vec_id").to_numpy(), one(queries, "query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            # Whole numbers below 2^53 are exact in doubles.
            scores = (q @ x.T).astype(np.int64)
            scores[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            take = min(k, len(ids))
            best = np.argsort(-scores, axis=1, kind="stable")[:, :take] if len(ids) <= 4 * k else None
            for i in range(len(own)):
                if best is None:
                    kth = np.partition(scores[i], len(ids) - take)[len(ids) - take]
                    over = np.flatnonzero(scores[i] > kth)
                    at = np.concatenate([over, np.flatnonzero(scores[i] == kth)[:take - len(over)]])
                else:
                    at = best[i]
                at = at[ids[at] != own[i]]
                found.append((np.full(len(at), own[i]), ids[at], scores[i, at]))
        columns = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else [(), (), ()])]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    keys = ["pivot", "ring", "cell", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, "query_id bigint, vec_id bigint, score bigint")


def top_k(table: DataFrame, is_query, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores over all other rows."""
    vectors = land(whole_vectors(table), "vectors")
    pivots = draw_pivots(vectors, s)
    cells, rings = index_vectors(vectors, pivots, s)
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    probe = land(best_in_cells(routes(queries, rings, pivots, s, True), cells, rings, pivots.shape[1], s), "probe")
    kth = (probe.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k).groupBy("query_id")
           .agg(F.min("score").alias("least"), F.count("*").alias("n")))
    # A query that has met fewer than k has no bound yet and opens everything.
    bounded = queries.join(kth, "query_id", "left").select(
        "query_id", "v", F.when(F.col("n") >= s.k, F.col("least")).otherwise(F.lit(-(1 << 62))).cast("double").alias("least"))
    found = best_in_cells(routes(bounded, rings, pivots, s, False), cells, rings, pivots.shape[1], s)
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k)
            .select("query_id", "rank", "vec_id", "score"))
