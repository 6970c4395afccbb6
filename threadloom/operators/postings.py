"""A positional inverted index of search documents, with a dictionary for typing errors.

`postings` has a row for each word of a document's field: the word, where it stands, and how long the
field is. It is partitioned by a hash of the word and sorted by it, so a query reads the row groups of its own words and
nothing else. `typos` has the words under each of the strings that deleting one or two of their letters gives: two words
within that many edits share one, so looking up the query word's own deletions finds all of them without comparing it with
the dictionary. What is found is verified by edit distance.

Hits are ordered by rules, each deciding only where those before it tie: more of the query's words, fewer
typing errors, words closer together and in order, words in weightier fields, more words as they were typed (a field that is the query
and nothing else counts as one more), the id.
"""

from __future__ import annotations

import functools
import operator
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from .search import FIELDS, filtered

#: Letters from which a query's word may have one error, and two; words longer than the last are never corrected.
ONE, TWO, LONGEST = 5, 9, 40
#: The distance of words that don't stand together.
FAR = 8
#: Words that a query's scan is given by name; with more, it reads the buckets of all.
NAMED = 2000
#: Parts of a bucket, which are different tasks' work.
PARTS = 4
GAP = r"(?U)[^\p{L}\p{N}_]+"
POSTINGS = "term string, doc_id string, field int, n int, places array<int>, bucket int"
RULES = "doc_id string, words int, typos int, proximity int, attribute int, exactness int"
TYPOS = "variant string, term string, bucket int"


def allowed(length: Column) -> Column:
    """Errors that a query's word of some length may have."""
    return F.when((length < ONE) | (length > LONGEST), 0).when(length < TWO, 1).otherwise(2)


def query_words(query: str) -> list[str]:
    """The distinct words of a query in order, as the index has them."""
    low = "".join(c.lower() if c.isascii() else c for c in query)
    return list(dict.fromkeys("".join(c if c.isalnum() or c == "_" else " " for c in low).split()))


def tokens(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """term, doc_id, field (its number), n (the field's words), place of every word of every field. Documents are dealt by
    their id before, as what files hold may be few tasks' work."""
    of = lambda f: F.filter(F.split(ascii_lower(F.coalesce(F.col(f), F.lit(""))), GAP), lambda w: w != "")
    dealt = docs.select("doc_id", *fields).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    words = dealt.select("doc_id", F.posexplode(F.array(*map(of, fields))).alias("field", "words"))
    return words.select("doc_id", "field", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))


def deletions(word: Column, depth: Column) -> Column:
    """A word and what is left of it without one letter or, at depth 2, two."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when((depth > 0) & (F.length(word) > 0), less(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when((depth > 1) & (F.length(word) > 1), F.flatten(F.transform(less(word), less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


class Index:
    """An index in a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, c: Column) -> Column:
        return (F.crc32(c.cast("binary")) % self.buckets).cast("int").alias("bucket")

    def build(self, docs: DataFrame, fields: tuple[str, ...]) -> Index:
        """Write both tables, of documents (doc_id string, fields). A document's words are put together where it is split, and
        each bucket is dealt in PARTS by a hash, so a word that most documents have isn't one task's work. Of all that the index takes, deletions
        are most; they are alike where they are sorted, so both tables are compressed with zstd."""
        tasks = self.spark.sparkContext.defaultParallelism
        by = ["bucket", "term", "doc_id"]
        rows = tokens(docs, fields).groupBy("doc_id", "field", "n", "term").agg(F.array_sort(F.collect_list("place")).alias("places")).select("*", self._bucket(F.col("term")))
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).sortWithinPartitions(*by, "field").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")
        terms = self.postings().select("term").distinct().where(F.length("term").between(ONE - 1, LONGEST + 2)).repartition(2 * tasks, "term")
        depth = F.when(F.length("term") >= TWO - 2, 2).otherwise(1)
        pairs = terms.select("term", F.explode(deletions(F.col("term"), depth)).alias("variant")).select("*", self._bucket(F.col("variant")))
        pairs.repartition("bucket", F.pmod(F.xxhash64("variant"), F.lit(PARTS))).sortWithinPartitions("bucket", "variant", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/typos")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def typos(self) -> DataFrame:
        return self.spark.read.schema(TYPOS).parquet(f"{self.path}/typos")

    def corrected(self, words: DataFrame, word: str = "word", typos: DataFrame | None = None) -> DataFrame:
        """words with term and typos: every word of the index within the errors that a word may have. Words themselves
        are among them, whether the index has them or not."""
        k = allowed(F.length(word))
        own = words.select("*", F.col(word).alias("term"), F.lit(0).alias("typos"))
        asked = words.where(k > 0).select("*", F.explode(deletions(F.col(word), k)).alias("variant")).select("*", self._bucket(F.col("variant")))
        found = asked.join(self.typos() if typos is None else typos, ["bucket", "variant"]).where(F.col("term") != F.col(word)).select(*words.columns, "term").distinct()
        return own.unionByName(found.withColumn("typos", F.levenshtein("term", word)).where(F.col("typos") <= k))

    def _of(self, table: DataFrame, key: str, names: list[str]) -> DataFrame:
        """The rows of some keys: their buckets are the files that are read, and the keys reach the scan."""
        return table.where(F.col("bucket").isin(sorted({zlib.crc32(x.encode()) % self.buckets for x in names})) & F.col(key).isin(names))

    def matches(self, words: list[str]) -> DataFrame:
        """doc_id, field, n, places, at (the word's number in the query), typos of the postings of a query's words."""
        asked = self.spark.createDataFrame(list(enumerate(words)), "at int, word string")
        k = allowed(F.length("word"))
        variants = asked.where(k > 0).select(F.explode(deletions(F.col("word"), k))).distinct().collect()  # at most 821 a word
        names = self.corrected(asked, typos=self._of(self.typos(), "variant", sorted(r[0] for r in variants))).select("at", "term", "typos")
        rows = names.limit(NAMED + 1).collect()
        if len(rows) > NAMED:
            return self.postings().join(names, "term").select("doc_id", "field", "n", "places", "at", "typos")
        of = self._of(self.postings(), "term", sorted({r["term"] for r in rows}))
        return of.join(F.broadcast(self.spark.createDataFrame(rows, "at int, term string, typos int")), "term").select("doc_id", "field", "n", "places", "at", "typos")

    def ranked(self, query: str) -> DataFrame:
        """doc_id, words, typos, proximity, attribute, exactness of every document with a word of the query; none for a
        query without words."""
        words = query_words(query)
        return rules(self.matches(words), len(words)) if words else self.spark.createDataFrame([], RULES)


def _gap(a: Column, b: Column) -> Column:
    """The least distance from a place in a to one in b, one more if b comes first, FAR at most; one pass in order."""
    both = F.array_sort(F.concat(F.transform(a, lambda p: F.struct(p.alias("p"), F.lit(0).alias("of"))), F.transform(b, lambda p: F.struct(p.alias("p"), F.lit(1).alias("of")))))
    never = -2 * FAR
    start = F.struct(F.lit(never).alias("a"), F.lit(never).alias("b"), F.lit(FAR).alias("best"))

    def step(s: Column, x: Column) -> Column:
        here = F.when(x["of"] == 1, F.greatest(x["p"] - s["a"], F.lit(1))).otherwise(x["p"] - s["b"] + 1)
        return F.struct(F.when(x["of"] == 0, x["p"]).otherwise(s["a"]).alias("a"), F.when(x["of"] == 1, x["p"]).otherwise(s["b"]).alias("b"), F.least(s["best"], here).alias("best"))

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(both, start, step, lambda s: s["best"]))


def rules(matches: DataFrame, n: int) -> DataFrame:
    """What the ranking rules say of each document, from the postings of a query of n words. Documents are dealt once."""
    by_field = [f(i) for i in range(n) for f in (
        lambda i: F.array_sort(F.flatten(F.collect_list(F.when(F.col("at") == i, F.col("places"))))).alias(f"p{i}"),
        lambda i: F.min(F.when(F.col("at") == i, F.col("typos"))).alias(f"t{i}"),
    )]
    fields = matches.repartition("doc_id").groupBy("doc_id", "field", "n").agg(*by_field)
    gaps = [_gap(F.col(f"p{i}"), F.col(f"p{i + 1}")).alias(f"g{i}") for i in range(n - 1)]
    fields = fields.select("doc_id", "field", "n", *[f"t{i}" for i in range(n)], *gaps)
    whole = functools.reduce(operator.and_, [F.col(f"t{i}") == 0 for i in range(n)] + [F.col(f"g{i}") == 1 for i in range(n - 1)], F.col("n") == n)
    docs = fields.groupBy("doc_id").agg(
        *[F.min(f"t{i}").alias(f"t{i}") for i in range(n)], *[F.min(F.when(F.col(f"t{i}").isNotNull(), F.col("field"))).alias(f"f{i}") for i in range(n)], *[F.min(f"g{i}").alias(f"g{i}") for i in range(n - 1)], F.max(F.coalesce(whole, F.lit(False)).cast("int")).alias("whole")
    )
    total = lambda cols: functools.reduce(operator.add, cols, F.lit(0))
    return docs.select(
        "doc_id", total(F.col(f"t{i}").isNotNull().cast("int") for i in range(n)).alias("words"), total(F.coalesce(f"t{i}", F.lit(0)) for i in range(n)).alias("typos"), total(F.coalesce(f"g{i}", F.lit(FAR)) for i in range(n - 1)).alias("proximity"),
        total(F.coalesce(f"f{i}", F.lit(0)) for i in range(n)).alias("attribute"), total([F.coalesce((F.col(f"t{i}") == 0).cast("int"), F.lit(0)) for i in range(n)] + [F.col("whole")]).alias("exactness"),
    )


def search_index(index: Index, docs: DataFrame, scope: str, query: str, *, sort: str = "relevance", limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """A page of hits of docs that pass the filters, with what each rule says. date_desc sorts by date and id first, as
    a scope's own sort does; an empty query finds nothing."""
    hits = filtered(docs, scope, **filters).join(index.ranked(query), "doc_id")
    rule = [F.desc("words"), F.asc("typos"), F.asc("proximity"), F.asc("attribute"), F.desc("exactness"), F.asc("doc_id")]
    return hits.orderBy(*([F.desc("date_ts"), F.desc("doc_id")] if sort == "date_desc" else rule)).offset(offset).limit(limit)


def build_index(docs: DataFrame, scope: str, path: str, buckets: int = 64) -> Index:
    """The index of a scope's searchable fields."""
    return Index(docs.sparkSession, path, buckets).build(docs, FIELDS[scope])
