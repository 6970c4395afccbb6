"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
WORD = r"[^ \x09-\x0D]+"
GAP = r"[ \x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is missing, a local session (tests) gets a temporary folder;
    on a cluster that is an error, as executors wouldn't see a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and
    a lost executor costs only what it was just computing."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        dropped(df.sparkSession, df._folder)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ordered_key(c: Column) -> Column:
    """A long id, with nulls after all others."""
    return F.coalesce(c.cast("long"), F.lit(2**63 - 1))


def texts_of(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df (which holds texts) whose key is in rows. The key side is built into
    the hash table, so that texts are neither sorted nor held."""
    return df.join(rows.hint("shuffle_hash"), on, "left_semi")
