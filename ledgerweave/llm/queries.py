"""Queries of the training-data operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder
from ..sources.artefacts import read_table
from . import byte_bpe, canonical, delivery_dedup, linkage, mixing, reading_level


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery_dedup.repeated_deliveries(read_table(spark, sf_dir, "raw_artefacts"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return linkage.link(*(read_table(spark, sf_dir, t) for t in ("statement_rows", "transactions", "declared_accounts")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_links(spark, sf_dir).select("row_id", "entity_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return canonical.meant_merchants(*(read_table(spark, sf_dir, t) for t in ("planted_events", "worklist_groups", "canon_merchants")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(read_table(spark, sf_dir, "documents"))


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return byte_bpe.decode_ids(byte_bpe.encode_texts(read_table(spark, sf_dir, "documents")))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shared_folder(spark)
    sizes = mixing.measured(read_table(spark, sf_dir, "documents"))
    allotted = mixing.allotments(sizes, read_table(spark, sf_dir, "mix_targets"))
    return mixing.mix(sizes, allotted), allotted


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.demanding(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "graded_texts"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "graded_texts"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_links": p2_links, "p3_found": p3_found, "p8_ids": p8_ids, "p8_texts": p8_texts, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_levels": p10_levels}

ORACLES: dict[str, str] = {
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
