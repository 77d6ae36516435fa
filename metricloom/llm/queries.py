"""The registered query of each training-data operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import (
    alignment, decontaminate, digests, hnsw, language_id, masked_scoring, merkle, quality_rules, seed_extend, sql, suffix_repeats, superminhash, token_counts, token_files,
    word_table_bpe,
)
from metricloom.llm.shared import shared_folder, stored, table

QUERIES = {}
SQL = {"op3_common_prefix_intervals": sql.REPEATED_BYTES, "op5_superminhash": sql.NEAR_DUPLICATES,
       "op6_suffix_automaton_decontamination": sql.CONTAMINATION, "op9_seed_and_extend": sql.REPEATED_WORDS, "op12_merkle_manifest": sql.MERKLE,
       "op13_rule_bitmask_ledger": sql.QUALITY}


def query(run):
    """Register a query under its own name."""
    QUERIES[run.__name__] = run
    return run


def held_out(id_col: str = "doc_id"):
    """One document in four, by the crc32 of its id as text, is never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


@query
def op1_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    target = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target)
    return token_files.read_digests(spark, target)


@query
def op2_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_common_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a smaller one."""
    found = suffix_repeats.repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", _span_sum().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return masked_scoring.score(docs, masked_scoring.fit(docs))


@query
def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by four-word shingles."""
    found = superminhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op6_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found)


@query
def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of one vector in fifty among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build(rows), rows.where("vec_id % 50 = 0"))


@query
def op8_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled rows."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _span_sum():
    """Units in a list of spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)


@query
def op9_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a smaller one."""
    found = seed_extend.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _span_sum().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_distinct_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded under the word vocabulary."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return digests.of_tokens(word_table_bpe.encode(table(spark, sf_dir, "documents"), path), path)


@query
def op11_interval_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the byte-level and the piece vocabulary, aligned; links are tokens that end together."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), *paths, links="end", digest=True).withColumnRenamed("groups", "groups_sha256")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, half of them folded from a text that has lost its line ends."""
    docs, names = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    columns = [F.col(c) for c in names]
    cut_text = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in names]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(*cut_text))
    found = merkle.verified(merkle.manifest(docs, merkle.leaf(*columns), "source", "doc_id", tampered))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document: the stored ledger, judged by the base rules and the newest policy."""
    rows = stored(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    base, newest = quality_rules.failed_any(quality_rules.BASE), quality_rules.failed_any(quality_rules.POLICIES[-1])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~newest).alias("kept"), "failed")
