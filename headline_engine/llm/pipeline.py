"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents.

Rejected by language ID: documents without a letter in any script; those whose language stays undecided (the best
language's share of 2^(-code length) is under MIN_SCORE: three or more languages are about equally likely); and those in
no learned language: the best model needs MAX_BITS a byte or more, which is what a byte costs without any model. Line dedup changes texts
(and n_chars, where there is such a column); a document all of whose lines are copies of earlier ones goes. One document
of each near-duplicate group stays (the smallest doc_id). Documents in which a benchmark window occurs go. Packing
returns the pieces with their ids.

Defined cases are those of the operators; an empty table passes through every stage. Columns of the documents pass
untouched, also those named like a column that a stage's operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headline_engine.llm import decontaminate, langid, linechunks, ngramjoin, packing

MIN_SCORE = 0.3
MAX_BITS = 8.0


def _aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list]:
    """The documents with the columns that an operator would overwrite renamed, and the selection that gives all columns
    back under their names."""
    names = {c: f"_own_{i}" if c in added else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: PPM language ID; undecided documents and those in no learned language go."""
    docs, back = _aside(docs, ("lang_pred", "score", "bits_per_byte"))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("bits_per_byte") < MAX_BITS)
    return langid.identify(docs).where(known).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: content-defined line chunks that occurred before are removed."""
    docs, back = _aside(docs, ("n_lines", "n_removed"))
    out = linechunks.clean(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return out.select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: one document of each group of near-duplicates stays."""
    return ngramjoin.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: documents with a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: training sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", pack)]
