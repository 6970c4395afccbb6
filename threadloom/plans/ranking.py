"""Search over a positional index of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings import Index, build_index, search_index
from ..sources.folders import fresh_folder
from ._base import Tables, query
from .searching import documents

#: Two of the words have errors; the second is in most texts.
ASKED = ["under", "the", "apache", "licence", "worthlesss"]
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[\p{{L}}\p{{N}}_]+')"
_TOKENS = f"""SELECT doc_id, field, len(w) AS n, unnest(w) AS term, unnest(range(len(w))) AS place FROM (SELECT 'thread-' || doc_id AS doc_id, unnest([0, 1, 2]) AS field,
unnest([{_WORDS.format("coalesce(source, '')")}, {_WORDS.format("coalesce(lang, '')")}, {_WORDS.format("coalesce(text, '')")}]) AS w FROM documents)"""
_MAY = "CASE WHEN length(word) < 5 OR length(word) > 40 THEN 0 WHEN length(word) < 9 THEN 1 ELSE 2 END"
#: DuckDB counts bytes; the asked words are ASCII, so any other character may stand for one that isn't.
_EDITS = r"levenshtein(regexp_replace(term, '[^\x00-\x7F]', '?', 'g'), word)"
_HITS = f"""WITH tok AS MATERIALIZED ({_TOKENS}), q(nr, word) AS (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(ASKED))}),
near AS (SELECT nr, term, CASE WHEN term = word THEN 0 ELSE {_EDITS} END AS typos FROM (SELECT DISTINCT term FROM tok), q WHERE term = word OR length(term) BETWEEN 4 AND 42 AND {_EDITS} <= {_MAY}),
m AS MATERIALIZED (SELECT doc_id, field, n, place, nr, typos FROM tok JOIN near USING (term)),
w AS (SELECT doc_id, nr, min(typos) AS typos, min(field) AS field FROM m GROUP BY ALL),
g AS (SELECT a.doc_id, a.nr, least(8, min(CASE WHEN b.place >= a.place THEN greatest(1, b.place - a.place) ELSE a.place - b.place + 1 END)) AS gap FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.field = b.field AND b.nr = a.nr + 1 GROUP BY ALL),
whole AS (SELECT DISTINCT doc_id FROM m WHERE n = {len(ASKED)} AND typos = 0 AND place = nr GROUP BY doc_id, field HAVING count(*) = {len(ASKED)}),
hits AS (SELECT doc_id, count(*) AS words, sum(typos) AS typos, {8 * (len(ASKED) - 1)} - coalesce((SELECT sum(8 - gap) FROM g WHERE g.doc_id = w.doc_id), 0) AS proximity, sum(field) AS attribute,
count(*) FILTER (WHERE typos = 0) + (SELECT count(*) FROM whole WHERE whole.doc_id = w.doc_id) AS exactness FROM w GROUP BY doc_id)"""


def document_index(t: Tables) -> Index:
    return build_index(documents(t), "thread", fresh_folder(t.spark, "index"))


@query(f"{_HITS} SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(typos AS INTEGER) AS typos, CAST(proximity AS INTEGER) AS proximity, CAST(attribute AS INTEGER) AS attribute, CAST(exactness AS INTEGER) AS exactness FROM hits")
def index_ranking(t: Tables) -> DataFrame:
    """Q2, Q3: what each ranking rule says of every document that has one of five words, two of them mistyped; from their postings alone."""
    return document_index(t).ranked(" ".join(ASKED))


@query(f"{_HITS} SELECT doc_id, row_number() OVER (ORDER BY words DESC, typos, proximity, attribute, exactness DESC, doc_id) AS place FROM hits JOIN (SELECT 'thread-' || doc_id AS doc_id FROM documents WHERE lang = 'en') USING (doc_id) ORDER BY place LIMIT 10 OFFSET 5")
def index_page(t: Tables) -> DataFrame:
    """The second page, of ten hits after five, of one author's documents in the order of all rules."""
    page = search_index(document_index(t), documents(t), "thread", " ".join(ASKED), author="en@x", limit=10, offset=5)
    rank = F.struct(-F.col("words"), "typos", "proximity", "attribute", -F.col("exactness"), "doc_id")
    ids = page.agg(F.array_sort(F.collect_list(rank)).alias("x"))  # ten rows
    return ids.select(F.posexplode("x").alias("i", "x")).select("x.doc_id", (F.col("i") + 6).cast("long").alias("place"))


@query(f"""WITH tok AS ({_TOKENS}), asked AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark) WHERE length(word) >= 5)
SELECT word, term, CAST(typos AS INTEGER) AS typos FROM (SELECT word, term, {_EDITS} AS typos FROM (SELECT DISTINCT term FROM tok WHERE length(term) BETWEEN 4 AND 42), asked WHERE term <> word AND abs(length(term) - length(word)) <= 2) WHERE typos <= {_MAY} UNION ALL SELECT word, word, 0 FROM asked""")
def typo_terms(t: Tables) -> DataFrame:
    """Q3: the words of all documents within the errors that the benchmark's words may have, by a table of deletions."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^a-z0-9_]+")).alias("word"))
    return document_index(t).corrected(words.where(F.length("word") >= 5).distinct())
