"""The corpus pipeline over the documents table: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes what its predecessor kept, all of it, and returns the columns of documents; the last returns token ids.
Odd rows are treated as each operator's module says: a null or empty text has no words and fails the quality rules; rows
without doc_id take part; very long texts are never cut; of repeated rows one stays; an empty table gives an empty result.
Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import exact_dedup, mixing, near_dedup, pieces, quality
from barlight.llm.tables import deleted, read, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules or the forest reject."""
    return quality.judged(docs, read(spark, sf_dir, "labels")).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of domains, languages and sources takes them."""
    return mixing.mixed(docs, mixing.LEVELS, mixing.BUDGET_SHARE, mixing.MAX_EPOCHS, mixing.SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids."""
    out = pieces.encoded(docs, pieces.model_bytes(), columns=["doc_id", "lang", "source"])
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: The forest, the sampled signatures and the encoding are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            deleted(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
