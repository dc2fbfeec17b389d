"""The corpus pipeline: toxicity, SimHash near-dedup, PII, mixing, BPE, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probewell.llm import bpe, mixing, pii, simhash, toxicity
from probewell.llm.common import stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects. The model is fitted on labelled rows of docs.

    Null and empty texts have no words and stay; repeated rows and null ids are judged each by its own text.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, by steps, by a Jaccard similarity of 0.8 or more of their shingles of five words, one stays. Candidates come
    from the SimHash index and from bands of min-hashes, without which most pairs at 0.8 would be missed; all are verified.

    The smallest id stays, null ids last. Texts without words are equal.
    """
    return simhash.deduplicate(docs)


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; keeps every document. Null texts stay null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its budget of words, with whole further copies where it calls for them.

    Documents without words, null texts among them, don't take part. Null sources are one source.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each document of the mix, with its ids: one row for each row."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_duplicates_out),
    ("pii", personal_data_masked),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: None: no SQL for the trained model, the fingerprints' components and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
