"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens). Contents are normalised
(null is the empty text) and digested in the JVM; digests are joined to the cache, and one
text of each digest that is missing there is encoded and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh_folder, ordered_key, texts_of

CACHE = "content binary, tokenizer string, n_tokens long"
_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_digest(path: str) -> str:
    """Kind and contents of the vocabulary file: another version is another key."""
    return hashlib.sha256(Path(path).suffix.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts by the library that the public tokenizer file is for, loaded once a worker."""
    if name not in _loaded:
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[name] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _loaded[name]


def _encode(name: str, digest: str, step: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(name)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                counts = count(part.column("_text").to_pylist())
                yield pa.record_batch([part.column("content"), pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, tokenizer: str = "piece_bpe_32k.model", cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer is a file of public_tokenizers; cache_path a folder that outlives the call
    (without one, a new folder in the shared one is used). Null texts count as empty ones,
    with 0 bytes; repeated rows and ids are counted each; null ids are kept. Whole texts
    are encoded, whatever their length. Other columns of docs are ignored.
    """
    import public_tokenizers

    spark = docs.sparkSession
    digest = tokenizer_digest(public_tokenizers.path(tokenizer))
    cache_path = cache_path or fresh_folder(spark, "token-cache")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("content", F.unhex(F.sha2("_text", 256))).withColumn("_key", ordered_key(F.col("_id")))
    fill_cache(rows, spark, tokenizer, digest, cache_path)
    known = _cached(spark, cache_path, digest)
    return rows.select("_id", "content", F.octet_length("_text").cast("long").alias("n_bytes")).join(known, "content", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """content, n_tokens: one row a content, though a repeated job may have appended it twice."""
    table = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == digest)
    return table.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(rows: DataFrame, spark: SparkSession, tokenizer: str, digest: str, path: str) -> None:
    """Append the counts of the contents that the cache lacks; rows: content, _key, _text."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)  # so that it can be read
    misses = rows.groupBy("content").agg(F.min("_key").alias("_key")).join(_cached(spark, path, digest), "content", "left_anti")
    texts = texts_of(rows.select("content", "_key", "_text"), misses, ["content", "_key"])
    texts.select("content", "_text").mapInArrow(_encode(tokenizer, digest), CACHE).write.mode("append").parquet(path)
