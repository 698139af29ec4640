"""A training corpus from raw documents: toxicity, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeline.llm import decontamination, line_dedup, minhash, packing, toxicity
from quakeline.llm.common import driver_returned, heaps_returned, removed, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language."""
    heaps_returned(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    driver_returned(spark)  # the rows that it was fitted on
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, equal or within two edits, and sentences that repeat an earlier one go, and documents that consist of them."""
    heaps_returned(spark)
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    heaps_returned(spark)
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select(F.struct("doc_id").alias("doc_id"))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that mostly consist of them go."""
    heaps_returned(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    heaps_returned(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests/llm compares each operator, and run() as a whole, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage stored on its way goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
