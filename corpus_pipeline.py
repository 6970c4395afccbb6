"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, BPE.

STAGES are applied in order to the documents; each result is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents, extra
ones included, whatever their names. Null and empty texts and null ids are documents like others;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, mixing, near_texts, substrings, toxicity
from threadloom.llm._shared import fresh_folder

#: Toxicity, near duplicates and BPE aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on these documents' labels, doesn't predict to be toxic.
    Repeated rows are scored, and kept or dropped, each; texts without words get the score of none."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id, null last; of repeated rows and of
    all texts without words, one."""
    return near_texts.without_near_copies(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that documents with smaller ids have."""
    return substrings.without_passages(docs, window=50)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the mix to target weights takes them; texts without words aren't taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, a row for each time it was taken."""
    return bpe.bpe_digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("passages", drop_passages), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_folder(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
