"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, tokens; in this order, over all documents.

Stages judge rows, not ids. Defined cases: rows of a null or repeated doc_id are documents of their own; of repeated rows one
stays after near-duplicates; null and empty texts pass every stage; very long texts are read whole; empty tables give
empty tables; further columns, whatever their names, are returned as they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from sparkloom.llm.common import stage

#: Least similarity, in percent, of near-duplicates here; op3_near_dedup has a tighter one of its own.
LINKED = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labelled training rows among them."""
    return toxicity.kept(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity of word shingles LINKED % or more): that of the smallest doc_id."""
    return near_dedup.deduplicated(docs, percent=LINKED)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials masked."""
    return secrets.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.tokenized(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]

#: SQL expresses neither the classifier nor the tokens: the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
