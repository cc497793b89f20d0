"""From documents to token ids: the stages of the corpus pipeline.

A stage takes the session, the documents that the stage before it kept, and the folder of the tables; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.llm import minhash, mixing, rules, sentencepiece_sampling, substrings
from parchment.llm.store import written

#: Share of the tokens that mixing keeps, and the power that smooths shares of sources, languages and topics.
MIX_SHARE, MIX_POWER = 0.9, 0.7
#: Sampled segmentations of a document.
SAMPLES = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return rules.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: 0.8 or more of their five-word shingles in common.

    SimHash fingerprints of the shingles find the pairs within two bits, by all variants within one. As 64 bits can't bound that
    similarity, minimum hashes find the pairs beyond; whole sets verify both.
    """
    return minhash.deduplicated(docs, by_simhash=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has."""
    return substrings.cleaned(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to smoothed source, language and topic shares."""
    return mixing.sampled(docs, share=MIX_SHARE, power=MIX_POWER)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, as piece ids."""
    return sentencepiece_sampling.encoded(docs, k=SAMPLES, key_cols=("doc_id", "source", "lang"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_weights),
    ("SentencePiece encoding and decoding", encoding),
]
#: Substring dedup and sampled encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
