"""A pipeline over ``documents``: quality rules, line dedup, near-dedup by SimHash and shingles, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import jaccard, line_dedup, packing, quality
from tablewright.llm.common import WORD, table, written

#: The share of its characters that has to be left of a document without repeated lines: any character at all.
MIN_KEPT = 1e-12
#: Words of a shingle in the near-dedup.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line of the corpus; those of which no line with words is left go."""
    kept = line_dedup.dedup(docs, min_kept=MIN_KEPT).where(F.col("text").rlike(WORD))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share four fifths of their shingles or more.

    SimHash fingerprints tell the first pairs; a join on shingle hashes finds all others. Every pair is verified.
    """
    return jaccard.one_of_each(docs, width=SHINGLE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, in sequences of balanced cost."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL has no XXH64, no edit join without all pairs and no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, written as Parquet in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
