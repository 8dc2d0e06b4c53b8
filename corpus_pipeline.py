"""From raw documents to token ids: five stages, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.llm import bpe, decontam, secrets, simhash, toxicity
from mailsift.llm.common import held_out, packed, unpacked, written
from mailsift.sources import table

#: SimHash stage: words of a shingle and bits that may differ.
SHINGLE, BITS = 3, 3
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out(5, 0))
    return unpacked(toxicity.score(packed(docs), scorer, ["_row"]).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id."""
    return simhash.keep_one(docs, words=SHINGLE, k=BITS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    found = decontam.with_leaks(packed(docs), table(spark, sf_dir, "benchmark"), ["_row"])
    return unpacked(found.where(F.size("leaks") == 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their lengths counted anew."""
    clean = secrets.redact(docs, secrets.new_ledger(spark))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed as little-endian unsigned 32-bit numbers, and whether they decode to the text."""
    coded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("byte_bpe", tokenize),
]

#: The classifier, the groups and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
