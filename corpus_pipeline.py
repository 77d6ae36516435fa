"""The training-corpus pipeline: five stages, each over all documents its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents with the columns of its input, the last one tokens.
Rows without a document id are dropped by the first stage. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, language_id, suffix_repeats, superminhash, word_table_bpe
from metricloom.llm.shared import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language (null, or no letter); a missing ``lang`` becomes the predicted one.

    Where no row has a label but null or 'und', nothing can be learned: the others are kept, their ``lang`` as it is.
    """
    labelled = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit(labelled)
    other = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    found = language_id.identify(docs.select("text", other.alias("rest")), model, unnamed=None)
    kept = found.where("rest.doc_id is not null and (lang_pred is null or lang_pred <> 'und')")
    own = {"text": F.col("text"), "lang": F.coalesce(F.col("rest.lang"), F.col("lang_pred")) if "lang" in docs.columns else None}
    return kept.select(*[own[c].alias(c) if c in own else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the least id."""
    found = superminhash.near_duplicates(docs, size=5, percent=80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes and more that a document with a smaller id holds, in whole characters; ``n_chars`` follows the text."""
    found = suffix_repeats.repeated_bytes(docs, whole_characters=True, carry=True)
    text = F.col("kept").cast("string")
    new = {"text": F.when(F.size("spans") > 0, text).otherwise(F.col("rest.text")), "n_chars": F.when(F.size("spans") > 0, F.length(text))}
    return found.select(*[F.coalesce(new[c], F.col(f"rest.`{c}`")).alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words one in twenty or more lies in a benchmark passage."""
    found = decontaminate.judged(decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))
    bad = found.where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document that is left."""
    found = word_table_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Not expressible: learned filters and subword merges. Tested against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
