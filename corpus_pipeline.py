"""The corpus pipeline: quality classifier, exact dedup, near dedup, source mixing and SentencePiece coding, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
``documents``. The mix repeats a document as often as it takes it, so a doc_id may come back more than once.

Defined cases, in every stage: null texts count as empty; a null doc_id, lang or source is a value like others; rows that are
repeated in full go through the exact stage once; empty and very long texts are treated as whole texts; an empty table
gives an empty result; further columns come through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, importance, mixing, near_dedup, pieces
from factloom.llm.common import clear_settled, settle, settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample; those that it rejects go."""
    return importance.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.8 or more on five-word shingles."""
    return near_dedup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the cube method takes it for the sources' target weights."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding the ids gives the text back."""
    vocabulary = pieces.read_vocabulary()
    out = pieces.decode(pieces.encode(docs.select("doc_id", "source", "text"), vocabulary), vocabulary)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mixing", source_mix),
    ("sentencepiece", sentencepiece),
]

#: The classifier and the mix can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), settled()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        clear_settled(spark, before, docs)  # what the stage and the one before it wrote is used up
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
