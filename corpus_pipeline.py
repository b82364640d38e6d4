"""A corpus pipeline in five stages; each reads the documents that its predecessor wrote.

run(spark, sf_dir) applies the stages to `documents`. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever these are, also where a further column has a name that an operator uses itself. An empty
table goes through all stages. ORACLE_SQL is None: SQL can't express the classifier, the draw or the tokenizer; tests/llm holds each
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import bpe, eb_classifier, jaccard_join, mixing, suffix_dedup
from riskloom.llm.common import bounded_batches, delete, new_path, read

ORACLE_SQL = None
REPEAT_BYTES = 200  # 50 words take this much at four bytes a word, space included, so a repeated passage of more words is found whole


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects. A null text has no words and is judged by its other features; equal rows are judged alike."""
    bounded_batches(spark)
    return eb_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the Jaccard join: that of the smallest doc_id, null ids last. Wordless and null texts are
    components of their own; of equal rows one stays."""
    bounded_batches(spark)
    return jaccard_join.dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of REPEAT_BYTES that are found elsewhere, every copy of them. Null texts stay null, very long ones are read whole."""
    bounded_batches(spark)
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights. A null source is a source; documents without words stay; equal rows are cut each at its
    own place."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts of tokens, digests of ids and of the bytes that they decode to; a null text has none."""
    import public_tokenizers

    bounded_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)  # the next stage is written
            before = path
    return docs
