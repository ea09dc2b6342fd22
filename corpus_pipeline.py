"""A training corpus from the documents table, in five stages written one after another."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import lines, mixing, neardup, pieces, toxicity
from rowproof.llm.base import prepare, table, unused
from rowproof.session import session_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    prepare(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, or nearly repeat, an earlier line."""
    prepare(spark)
    return lines.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    prepare(spark)
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by weight."""
    prepare(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with piece ids, their number and the slot of the mixed order; sorted by it.

    Rows read back from files have no order of their own, so the slot is worked out again: it follows from ids and sources.
    """
    prepare(spark)
    encoded = pieces.encode_checked(F.col("text"), pieces.load_pieces())
    *names, made = unused(docs.columns, "__key", "__rank", "__block", "__slot", "__release", "__due", "__encoded")
    slot = names[3]
    placed = mixing.mixed_order(docs, names=names).repartitionByRange(slot).sortWithinPartitions(slot)
    return (placed.withColumn(made, encoded)
            .select(*[c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip", "slot")],
                    f"{made}.ids", f"{made}.n_tokens", f"{made}.round_trip", F.col(slot).alias("slot")))


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", one_of_each),
          ("mixing", mix_sources), ("sentencepiece", encode)]

# A fitted model, edit distances and piece ids have no SQL; tests hold the stages' operators to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it kept, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{session_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
