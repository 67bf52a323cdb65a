"""Corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import stages

STAGES = [
    ("quality", stages.keep_good),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("suffix_dedup", stages.cut_repeats),
    ("packing", stages.pack),
]

#: The classifier, the components and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
