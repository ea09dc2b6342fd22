"""One query per operator, with production parameters over whole tables, and the pipeline."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import (collocations, fingerprint, interactions, language, lines, mixing, neardup, passages, pieces, sql, topk, toxicity, warc,
                          webtext)
from rowproof.llm.base import table
from rowproof.session import land


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    parts = land(warc.write_bundles(table(spark, folder, "pages")), "bundles")
    return warc.read_bundles(parts).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.score(table(spark, folder, "documents"), language.held_out_fifth())


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(table(spark, folder, "documents"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    placed = mixing.mixed_order(table(spark, folder, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"),
                         F.col("__release").alias("release_slot"), F.col("__due").alias("due_slot"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.passages(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_checked(F.col("text"), pieces.load_pieces())
    return table(spark, folder, "documents").select("doc_id", encoded.alias("e")).select("doc_id", "e.ids", "e.n_tokens", "e.round_trip")


def op11_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return webtext.extract(table(spark, folder, "pages"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_language, op3_line_dedup, op4_fingerprints, op5_top_k, op6_mixing, op7_passages, op8_toxicity, op9_near_duplicates, op10_sentencepiece,
                                   op11_interactions, op12_collocations, op13_main_text)}
SQL: dict[str, str] = {"op11_interactions": sql.INTERACTIONS, "op12_collocations": sql.COLLOCATIONS}
