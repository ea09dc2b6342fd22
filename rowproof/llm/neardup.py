"""MinHash near-duplicate documents by tensored banding.

A document's set holds the hashes of its five-word shingles (words split at ASCII white space, A-Z
folded); a shorter text is one shingle, a text without words is the empty set, linked with nothing.
Two small collections of half keys, A_1..A_m and B_1..B_m, are drawn from the minima of 4m hash
functions. The m * m tables are keyed by the pairs (A_i, B_j), so tables cost only their square root
in minima. A pair at similarity s meets in some table with chance (1 - (1 - s^2)^m)^2, which for
m = 14 and s = 0.75 is 0.99998. A meeting is only a candidate: a link is confirmed on the full sets.
Half keys that one document alone holds can meet nothing; they go before any pair of half keys is formed.

How hot tables are kept linear: equal sets are one node from the start. In every bucket each node
is first compared with one drawn node of its bucket only, in a few turns with other draws. Two nodes
that are connected by then need no comparison; every other pair of a bucket is compared after that,
so no component that the tables can find is lost.

Rows with a null id take part in nothing and are kept. Rows that repeat an id are one document whose
parts all count. Results are written to the shared folder between steps, so a lost executor costs a task.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.base import checked_broadcast, fixed_lists, gram_hashes, list_array, mixed, numbers, unused, whole_groups, word_hashes
from rowproof.llm.graph import components
from rowproof.session import land


@dataclass(frozen=True)
class Settings:
    words: int = 5
    share: int = 75  # a link needs 100 * common >= share * union
    half_keys: int = 14
    center_rounds: int = 3
    chunk: int = 1024


SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())),
    T.StructField("bits", T.ArrayType(T.LongType()))])
# Longs in a set's bitmap, a bit for each of its shingles' residues.
BITMAP = 32


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, first = word_hashes(texts)
    return [np.unique(gram_hashes(hashes[first[i]:first[i + 1]], words)) for i in range(len(texts))]


def minima(items: np.ndarray, turn: np.ndarray, times: np.ndarray, piece: int = 4096) -> np.ndarray:
    """The smallest value of each hash function over the items, piece by piece."""
    least = np.full(len(turn), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), piece):
        np.minimum(least, ((items[at:at + piece][None, :] ^ turn[:, None]) * times[:, None]).min(axis=1), out=least)
    return least


def sketch(text: Column, s: Settings) -> Column:
    m = s.half_keys

    @F.arrow_udf(SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        turn, times = numbers(4 * m, 21), numbers(4 * m, 22) | np.uint64(1)
        sets = shingle_sets(texts, s.words)
        halves = np.zeros((len(sets), 2 * m), dtype=np.uint64)
        sums = np.zeros((2, len(sets)), dtype=np.uint64)
        bits = np.zeros((len(sets), 64 * BITMAP), dtype=bool)
        for k, items in enumerate(sets):
            if len(items):
                least = minima(items, turn, times)
                bits[k, (items % np.uint64(64 * BITMAP)).astype(np.int64)] = True
                halves[k] = mixed(least[0::2] + mixed(least[1::2]))
                sums[0, k], sums[1, k] = mixed(items).sum(), mixed(items ^ np.uint64(0x5851F42D4C957F2D)).sum()
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        full = np.concatenate([[0], np.cumsum(np.where(sizes > 0, m, 0))])
        lists = [list_array(halves[sizes > 0][:, part].astype(np.int64, copy=False).view(np.int64).ravel(), full, pa.int64())
                 for part in (slice(0, m), slice(m, 2 * m))]
        lists.append(list_array(np.packbits(bits, axis=1).view(np.int64).ravel(),
                                np.arange(len(sets) + 1) * BITMAP, pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists],
            names=[f.name for f in SKETCH])
    return sketched(text)


def shingles_of(text: Column, words: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def shingles(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, words)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        return list_array(values.view(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int64())
    return shingles(text)


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (x, y) of document ids whose full sets are alike."""
    # Texts stay where they are while the documents asked for are few, as they are in all turns but the first.
    wanted = checked_broadcast(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct())
    sets = land(texts.join(wanted, "doc_id").select("doc_id", shingles_of(F.col("text"), s.words).alias("items")), "sets")
    both = (pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("items").alias("xs")), "x")
            .join(sets.select(F.col("doc_id").alias("y"), F.col("items").alias("ys")), "y"))
    common = F.size(F.array_intersect("xs", "ys"))
    return (both.select("x", "y", common.alias("c"), (F.size("xs") + F.size("ys")).alias("total"))
            .where(100 * F.col("c") >= s.share * (F.col("total") - F.col("c"))).select("x", "y").distinct())


def alike_sizes(s: Settings) -> Column:
    return 100 * F.least("xn", "yn") >= s.share * F.greatest("xn", "yn")


def across(left_over: DataFrame, s: Settings) -> DataFrame:
    """Pairs (x, y) with a half key in common, across components, that sizes and bitmaps do not rule out.

    Nodes of one bucket share its A half, so every pair of a bucket is among them, fewer times over.

    Of the bits set in one bitmap alone each proves a shingle in one set alone. Large buckets are
    cut into chunks and every pair of chunks is a group of its own, so a group is of bounded size.
    """
    rest = left_over.select("node", "n", "label", "bits", F.posexplode("a").alias("i", "half")).withColumn("key", F.xxhash64("i", "half"))
    chunks = (rest.groupBy("key").agg(F.ceil(F.count("*") / s.chunk).cast("int").alias("chunks"), F.count("*").alias("rows"))
              .where(F.col("rows") > 1).drop("rows"))
    dealt = rest.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = copies.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own",
                           "node", "n", "label", "bits")
    share = s.share

    def close(batches):
        for table, starts in whole_groups(batches, ["key", "p", "q"]):
            node, n, label, own, p, q = (table[c].to_numpy() for c in ("node", "n", "label", "own", "p", "q"))
            bits = fixed_lists(table["bits"], np.uint64)
            found = [np.empty((0, 2), dtype=np.int64)]
            for low, high in zip(starts[:-1], starts[1:]):
                rows = np.arange(low, high)
                left = rows if p[low] == q[low] else rows[own[rows] == p[low]]
                right = rows if p[low] == q[low] else rows[own[rows] == q[low]]
                for i in left:
                    j = right[(label[right] != label[i]) & (node[right] != node[i])]
                    if p[low] == q[low]:
                        j = j[node[j] > node[i]]
                    j = j[(100 * np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i]))]
                    apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    total = n[j] + n[i]
                    j = j[100 * (total - apart) >= share * (total + apart)]
                    if len(j):
                        found.append(np.column_stack([np.minimum(node[j], node[i]), np.maximum(node[j], node[i])]))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])

    return (groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
            .mapInArrow(close, "x bigint, y bigint").distinct())


def shared_keys(rows: DataFrame) -> DataFrame:
    """The values of `key` that several nodes hold; minima are taken before the shuffle."""
    return rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")


def shared_halves(nodes: DataFrame, side: str) -> DataFrame:
    """(node, of_<side>): which of a node's half keys some other node has as well; nodes without any are left out."""
    rows = nodes.select("node", F.posexplode(side).alias("i", "half")).select("node", "i", F.xxhash64("i", "half").alias("key"))
    return rows.join(shared_keys(rows), "key").groupBy("node").agg(F.collect_set("i").alias(f"of_{side}"))


def linked_nodes(nodes: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(node, label) of every node with a link; label is the smallest node it reaches.

    `nodes` has (node, n, a, b, bits): a document standing for an equal set of n shingles, and its sketch.
    """
    # Nodes that meet at (A_i, B_j) share A_i and B_j: tables are formed of the half keys that some other node holds too.
    left, right = shared_halves(nodes, "a"), shared_halves(nodes, "b")
    halves = land(left.join(right, "node").join(nodes.select("node", "a", "b"), "node"), "halves")
    keys = halves.select("node", "a", "b", F.explode("of_a").alias("i"), "of_b").select(
        "node", "a", "b", "i", F.explode("of_b").alias("j")).select(
        F.xxhash64("i", "j", F.get("a", "i"), F.get("b", "j")).alias("key"), "node")
    met = land(keys.join(shared_keys(keys), "key"), "met")
    labels = met.select("node").distinct().join(nodes.select("node", "n").dropDuplicates(["node"]), "node").withColumn("label", F.col("node"))
    compared = None
    for turn in range(s.center_rounds + 1):
        rest = met.join(checked_broadcast(labels), "node")
        if turn:
            # Buckets that still hold several components.
            several = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
            rest = land(rest.join(several.select("key"), "key"), "rest")
        if turn < s.center_rounds:
            # One of each bucket's nodes, another every turn, against all of it.
            drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "label"))
            right = rest.groupBy("key").agg(drawn.alias("e")).select("key", "e.node", "e.n", "e.label")
            left, right = (side.select("key", *(F.col(c).alias(name + c) for c in ("node", "n", "label")))
                           for name, side in (("x", rest), ("y", right)))
            pairs = (left.join(right, "key").where("xlabel <> ylabel").where(alike_sizes(s))
                     .select(F.least("xnode", "ynode").alias("x"), F.greatest("xnode", "ynode").alias("y")).distinct())
        else:
            left_over = rest.select("node", "n", "label").distinct().join(nodes.select("node", "a", "bits"), "node")
            pairs = across(left_over, s)
        if compared is not None:
            pairs = pairs.join(compared, ["x", "y"], "left_anti")
        pairs = land(pairs, "pairs")
        if pairs.isEmpty():
            continue
        compared = pairs if compared is None else compared.union(pairs)
        known = labels.select(F.col("node").alias("x"), F.col("label").alias("y"))
        found = components(known.union(confirmed(pairs, texts, s)))
        labels = land(labels.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")),
                      "labels")
    return labels


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`, which has doc_id and text."""
    texts = docs.select("doc_id", "text")
    sketched = land(texts.select("doc_id", sketch(F.col("text"), s).alias("s")).select("doc_id", "s.*"), "sketches")
    same = ["n_shingles", "h1", "h2"]
    sets = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One node per distinct set, named by its smallest document.
    named = sets.groupBy(*same).agg(F.min("doc_id").alias("node"))
    members = land(sets.join(named, same).select("doc_id", "node", F.col("n_shingles").alias("n"), "a", "b", "bits"), "members")
    nodes = members.where("doc_id = node").drop("doc_id").distinct()
    labels = linked_nodes(nodes, texts, s)
    # A document whose id comes with several sets joins them.
    of_id = members.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("most")).where("x < most")
    joined = members.join(of_id, "doc_id").select("x", F.col("node").alias("y"))
    labels = components(labels.select(F.col("node").alias("x"), F.col("label").alias("y")).union(joined))
    # A node that no link has reached is its own label.
    of_doc = (members.select("doc_id", "node").join(labels, "node", "left")
              .groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id")))
    return (sketched.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs` whose document stays: the smallest id of each group, once; null ids all stay."""
    kept_id, place = unused(docs.columns, "__stays", "__turn")
    stays = near_duplicates(docs, s).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept_id)).distinct()
    turn = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    ranked = (docs.where("doc_id IS NOT NULL").join(stays, F.col("doc_id") == F.col(kept_id))
              .withColumn(place, F.row_number().over(turn)).where(F.col(place) == 1))
    return ranked.select(docs.columns).union(docs.where("doc_id IS NULL"))
