"""Licence scans: notices are found by their rarest words, at the same distances as in a template.

The templates' words and places are an index that every task holds. How many documents have each of these words is
counted over the whole table. Of a file that has all words of a template's key phrase, the template's rarest words in it are
looked up: each of their places, less the word's place in the template, is where the template would start. A start on
which enough of the words agree is verified: the key phrase must stand within the template's span, and the share of
words that stand where the template has them is the match's score. So edits within a notice cost a part of its score, and words
of a notice that are strewn over a text match nothing.

Everything is DataFrame functions on a file's own row: no file is shuffled, only counts of words are.
Null and empty texts have no words, places or labels and a score of 0; repeated rows get their results each; null ids are kept;
an empty table gives no rows. Other columns may have any names.
"""

from __future__ import annotations

import functools
import operator
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of letters, digits and whatever isn't ASCII, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Labels, key phrases and wordings of common licence notices, as words of the scan.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
]
#: Rarest words of a template that are looked up in a file; how many must agree on a start; the least share
#: of a template's words in their places; the score of a file with a base phrase and no more.
RARE, AGREE, SHARE, BASE_SCORE = 4, 3, 0.6, 0.5


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _has_all(present: Column, words: list[str]) -> Column:
    return functools.reduce(operator.and_, [F.array_contains(present, w) for w in dict.fromkeys(words)])


def _places(words: Column, word: Column) -> Column:
    """Where a word stands, from 0."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def _phrase_places(words: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand one after another."""
    follow = lambda i: functools.reduce(operator.and_, [F.get(words, i + n) == w for n, w in enumerate(phrase) if n], F.lit(True))
    return F.filter(_places(words, F.lit(phrase[0])), follow)


def _match(words: Column, present: Column, wording: list[str], key: str, ranked: list[str]) -> Column:
    """The best verified (share, start) of a template in a file that has the words of its key phrase; null if none."""
    agree = min(AGREE, len(ranked))
    keys = F.slice(F.filter(_strings(ranked), lambda w: F.array_contains(present, w)), 1, RARE)
    # the template's postings of a word, and the starts that the word's places in the file speak for
    within = lambda w: _places(_strings(wording), w)
    starts_of = lambda w: F.array_distinct(F.flatten(F.transform(_places(words, w), lambda p: F.transform(within(w), lambda q: p - q))))
    starts = F.array_sort(F.flatten(F.transform(keys, starts_of)))
    # equal ones are neighbours now: one that is repeated AGREE - 1 places on is agreed on
    agreed = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + (agree - 1)) == x))
    in_place = lambda s: F.size(F.filter(F.transform(_strings(wording), lambda w, j: F.get(words, s + j) == w), lambda same: same))

    def verified(s: Column) -> Column:
        span = F.array_join(F.slice(words, F.greatest(s, F.lit(0)) + 1, F.least(s, F.lit(0)) + len(wording)), " ")
        share = in_place(s) / F.lit(float(len(wording)))
        return F.when((share >= SHARE) & F.contains(F.concat(F.lit(" "), span, F.lit(" ")), F.lit(f" {key} ")), F.struct(share.alias("share"), (-s).alias("place")))

    inner = F.transform(F.array(starts), lambda s: F.transform(agreed(s), verified))  # starts are computed once
    return F.array_max(F.get(inner, F.lit(0)))


def document_counts(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents of all each word of a vocabulary is; at most one row a word comes back."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), _strings(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """id_col, n_words, base (label and start of every place of a phrase), matches (label, start and share of every template
    that is found, the best place of each)."""
    vocabulary = sorted({w for _, _, text in templates for w in text.split()} | {w for p, _ in phrases for w in p.split()})
    counts = document_counts(docs, text_col, vocabulary)
    rows = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    rows = rows.select(id_col, "words", F.array_intersect("words", _strings(vocabulary)).alias("present"))
    words, present = F.col("words"), F.col("present")
    base = []
    for phrase, label in phrases:
        parts = phrase.split()
        places = F.transform(_phrase_places(words, parts), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))  # noqa: B023  used at once
        base.append(F.when(_has_all(present, parts), places).otherwise(F.array().cast("array<struct<label:string,start:int>>")))
    matches = []
    for label, key, text in templates:
        wording = text.split()
        ranked = sorted(set(wording), key=lambda w: (counts.get(w, 0), w))  # highest inverse document frequency first
        best = F.when(_has_all(present, key.split()), _match(words, present, wording, key, ranked))
        matches.append(F.transform(F.array(best), lambda m: F.when(m.isNotNull(), F.struct(F.lit(label).alias("label"), (-m["place"]).alias("start"), m["share"].alias("share")))))  # noqa: B023
    found = F.filter(F.flatten(F.array(*matches)), lambda m: m.isNotNull())
    return rows.select(id_col, F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*base)).alias("base"), found.alias("matches"))


def license_labels(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    found = scan(docs, **parameters)
    start = F.transform("base", lambda b: b["start"].cast("long"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own = F.transform("base", lambda b: b["label"]), F.transform("matches", lambda m: m["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(0.0))
    return found.select(parameters.get("id_col", "doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"))
