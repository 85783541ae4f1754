"""The registered queries of this subpackage: thin digests of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headline_engine.llm import common, decontaminate, fingerprint, langid, linechunks, lmscore, ngramjoin, oracle, packing, prefixtrie, substrings, tokencounts, tokenfile, tokens, vectorcodes, warc


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(_documents(spark, sf_dir, "doc_id", "text"), items)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(_documents(spark, sf_dir, "doc_id", "text"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lmscore.score(_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("log10_per_word", 6).alias("log10_per_word"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir, "doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    out = langid.identify(docs)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "tokens")
    tokenfile.write(_documents(spark, sf_dir, "doc_id", "text"), folder)
    return tokenfile.read(spark, folder)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(_documents(spark, sf_dir, "doc_id", "text")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.report(_documents(spark, sf_dir, "doc_id", "text"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.report(_documents(spark, sf_dir, "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(_documents(spark, sf_dir, "doc_id", "text"), tokens.tokenizer_path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_lm_scores, op4_packing, op5_warc, op6_language,
                                   op7_token_files, op8_substring_dedup, op9_line_dedup, op10_ngram_join, op11_prefix_trie, op12_vector_codes, op13_token_counts)}

ORACLE_SQL = oracle.SQL
