"""How filters interact: what every order of them would remove at every step, from one pass over the texts.

Each document has a mask of the filters it fails. A mask is mapped to one big integer whose fields hold
the outcomes of all steps of all orders (for five filters 120 orders of 5 steps, six figures a step). The
integers of a part are added up, each times the number of documents that share it, and the sum is unpacked.
A field is as many whole bytes wide as the number of the part's documents needs, so no field can run over
into the next one.

Documents are counted by (part, mask, labels) before anything moves, so a part is at most 2**filters * 4 rows
in the task that adds its integers, however many documents it has. Equal texts are found by their SHA-256 and
the smallest id of each; texts themselves are never shuffled.

A null text is the empty text, a null lang the part ''. A document whose id is null has no labels, is no copy of
another and makes no other one a copy; rows that repeat an id are documents of their own, none smaller than the
other. Several labels of one id count where any of them is 1; labels without an id count nowhere. No documents
give no rows. Columns that are not named here are not looked at, whatever their names; texts of any length are
read whole.
"""
from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.session import land

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    total, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": total < 200, "B": different * 100 < total * 50, "C": capitals * 100 > F.length(text) * 3,
            "D": text.rlike("[#$%&*|]")}


def outcomes(mask: int, good: bool, toxic: bool, filters: int) -> np.ndarray:
    """1 or 0 for every figure of every step of every order: what one document of this mask adds."""
    out = np.zeros((len(list(permutations(range(filters)))), filters, len(FIGURES)), dtype=np.uint8)
    for row, order in zip(out, permutations(range(filters))):
        gone = False
        for step, f in zip(row, order):
            fails = bool(mask >> f & 1)
            here = fails and not gone
            step[:] = (not (gone or fails), here, fails and gone, mask == 1 << f, here and good, here and toxic)
            gone = gone or fails
    return out


def packed(bits: np.ndarray, width: int) -> int:
    """One integer with a field of `width` bytes for every element of `bits`."""
    fields = np.zeros((bits.size, width), dtype=np.uint8)
    fields[:, 0] = bits.ravel()
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, fields: int, width: int) -> np.ndarray:
    raw = np.frombuffer(total.to_bytes(fields * width, "little"), dtype=np.uint8).reshape(fields, width)
    whole = np.zeros((fields, 8), dtype=np.uint8)
    whole[:, :width] = raw
    return whole.view("<i8").ravel()


def step_counts(counts: DataFrame, letters: str) -> DataFrame:
    """RESULT's rows from (part, mask, good, toxic, n): how many documents of a part have this mask and these labels."""
    def added(rows: pd.DataFrame) -> pd.DataFrame:
        documents = int(rows["n"].sum())
        width = (documents.bit_length() + 7) // 8
        total = sum(int(n) * packed(outcomes(int(m), bool(g), bool(t), len(letters)), width)
                    for m, g, t, n in zip(rows["mask"], rows["good"], rows["toxic"], rows["n"]))
        orders = ["".join(o) for o in permutations(letters)]
        shape = (len(orders), len(letters), len(FIGURES))
        figures = unpacked(total, int(np.prod(shape)), width).reshape(shape)
        by_filter = dict.fromkeys(letters, 0)
        for order, steps in zip(orders, figures[:, :, FIGURES.index("removed")].tolist()):
            for letter, removed in zip(order, steps):
                by_filter[letter] += removed
        out = pd.DataFrame(figures.reshape(-1, len(FIGURES)), columns=list(FIGURES))
        out.insert(0, "part", rows["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(orders, len(letters)))
        out.insert(2, "step", np.tile(np.arange(1, len(letters) + 1), len(orders)))
        out["shapley"] = [by_filter[letter] for order in orders for letter in order]
        return out

    return counts.groupBy("part").applyInPandas(added, RESULT)


def masks(docs: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, mask, sha) per document; bits stand in the order of the filters' names, that of copies is the last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = filters or text_filters(text)
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(found.values())), F.lit(0))
    # Read twice below: written once, so that texts are gone through once.
    seen = land(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("mask"),
                            F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha")), "masks")
    smallest = (seen.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                .where("least < most").drop("most"))
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << len(found)).otherwise(0)
    return seen.join(smallest, "sha", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """What each of all orders of the filters keeps and removes at each step, per part.

    `filters` names failure conditions over the column `text` by single letters before E, the filter for copies.
    """
    letters = "".join(filters or text_filters(F.lit(""))) + COPY
    known = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    counts = (masks(docs, filters).join(known, "doc_id", "left")
              .groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
              .agg(F.count(F.lit(1)).alias("n")))
    return step_counts(counts, letters)
