"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage's result is written as Parquet into the shared folder and read again as the next one's documents, so a lost
executor costs at most a stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headline_engine.llm.common import durable
from headline_engine.llm.pipeline import STAGES

#: Language models, content-defined hashes and tokenizers have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
