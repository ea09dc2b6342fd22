"""Connected components by repeated minima, every round written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowproof.session import land


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (x, y): label is the smallest node it can reach.

    Each round every node points to the smallest neighbour of its neighbourhood and then to that
    one's own pointer, so distances at least halve; edges within a component thin out to a star.
    Stars are done as they stand: no round is spent on finding that nothing changes.
    """
    now = land(edges.select("x", "y").where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
               .distinct(), "edges")
    while not stars(now):
        # Large star: every larger neighbour of a node points to the least of its neighbourhood.
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        large = land(large, "edges")
        # Small star: a node and its smaller neighbours point to the least of these.
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(
            F.struct(F.col("x").alias("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = land(small.select("e.*").where("x <> y").distinct(), "edges")
    return now.select(F.col("x").alias("node"), F.col("y").alias("label")).union(
        now.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every x has one y alone and no y is an x."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
                                          F.struct(F.col("y").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e"))
    both = ends.select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return both.where(F.col("out") + F.col("into") > 1).where("out > 0").isEmpty()
