"""Queries over the operators for training data, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import bpe, leakage, mojibake, names, neardup, pairs, splitting
from lodespark.llm.sql import SQL
from lodespark.session import table

__all__ = ["QUERIES", "SQL"]

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the entries of samples.chunks that have a chunk; the title counts as text."""
    c = table(spark, sf_dir, "samples").select(F.explode("chunks").alias("c")).select("c.id", "c.title", "c.chunk")
    return c.where(F.col("chunk").rlike(r"(?U)[^\s]")).select("id", F.concat_ws(" ", "title", "chunk").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_entries(spark, sf_dir), 0.7).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_classes(_entries(spark, sf_dir), 0.7)


def _long_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk_metadata").select(F.lit("chunk_metadata").alias("origin"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    entries = table(spark, sf_dir, "samples").select(F.explode("chunks").alias("c")).select(F.lit("samples").alias("origin"), F.col("c.id").alias("item_id"), F.col("c.chunk").alias("text"))
    return chunks.unionByName(entries)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.pieces(_long_items(spark, sf_dir), ["origin", "item_id"], "text", only_cut=True)
    forced = F.when(F.max("forced"), F.lit("forced")).otherwise(F.lit("natural"))
    return cut.groupBy("origin", "item_id").agg(forced.alias("cut"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(_long_items(spark, sf_dir), ["origin", "item_id"], "text").distinct()


_PAIR = ("prediction_id", "question", "predicted_answer", "ground_truth_answer")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "predictions")
    return pairs.defects(rows, *_PAIR, pairs.fitted(rows, *_PAIR)).distinct()


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "predictions")
    found = pairs.labelled(rows, *_PAIR, pairs.fitted(rows, *_PAIR)).select("prediction_id", "field", F.explode("labels").alias("label"))
    return found.distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_entity_pairs(table(spark, sf_dir, "traces"), "entity_text", "entity_type")


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(table(spark, sf_dir, "traces"), "entity_text", "entity_type")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("tokens"), bpe.decode(F.col("ids"), f"{TOKENIZERS}/byte_bpe_50k.json").alias("decoded"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.join(docs, "doc_id").select("doc_id", "tokens", same.alias("same"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["question", "passage"])
    return found.select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.remove_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["question", "passage"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p4_labels": p4_labels, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_restored": p9_restored}
