"""Licence scans against a plain search of every start, with awkward rows and planted notices."""

from __future__ import annotations

import random
import re

from threadloom.llm import licenses

SCHEMA = "doc_id long, text string, words string, present int, base string, matches string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT, BSD, GPL, APACHE = (next(t for label, _, t in reversed(licenses.TEMPLATES) if label == want) for want in ("mit", "bsd", "gpl", "apache"))


def texts() -> list[str | None]:
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the of a software use license general copy über été this and in to".split()) for _ in range(n))
    edited = MIT.split()
    edited[7], edited[20] = "every", "Übung"
    moved = BSD.replace("with or without", "with, oh, or without")  # a word is added in the middle
    strewn = MIT.split()
    rng.shuffle(strewn)
    return [
        None, "", " \n--", "MIT License", "mit-license MIT\tLICENSE, mit license", "The Apache License, the General Public License", "general public general public license", "MIT License", "mit été license", "İMIT License MİT License",
        MIT, prose(50) + " " + MIT.upper() + ". " + prose(20), prose(9) + " " + " ".join(edited), moved, " ".join(strewn), GPL, APACHE, "  ".join([MIT, BSD, GPL, APACHE] * 3), " ".join(BSD.split()[4:]), " ".join(BSD.split()[:14]), "redistribution and use in source and binary forms",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under CC BY-NC 4.0.", "licensed under cc by-sa 4.0", "license " * 3000 + "released under the mit license", prose(30_000) + " released under the mit license " + prose(5), "public license", "mit", "license mit",
    ]


def expected(rows: list[tuple]) -> list[tuple]:
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = [(r[0], WORD.findall(low(r[1]))) for r in rows]
    count = lambda w: sum(w in set(ws) for _, ws in split)
    counts = {w: count(w) for w in {w for _, _, t in licenses.TEMPLATES for w in t.split()}}
    out = []
    for doc_id, words in split:
        base = [(label, i) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        own, best = [], 0.0
        for label, key, text in licenses.TEMPLATES:
            t, k = text.split(), key.split()
            if not set(k) <= set(words):
                continue
            rare = sorted(set(t) & set(words), key=lambda w: (counts[w], w))[: licenses.RARE]
            votes: dict[int, set] = {}
            for p, w in enumerate(words):
                if w in rare:
                    for q in (q for q, x in enumerate(t) if x == w):
                        votes.setdefault(p - q, set()).add(w)
            for s, agreed in votes.items():
                span = words[max(s, 0) : max(s + len(t), 0)]
                share = sum(s + j >= 0 and words[s + j : s + j + 1] == [w] for j, w in enumerate(t)) / len(t)
                if len(agreed) >= licenses.AGREE and share >= licenses.SHARE and any(span[i : i + len(k)] == k for i in range(len(span))):
                    own.append(label)
                    best = max(best, share)
        starts = [i for _, i in base]
        joined = lambda x: ",".join(sorted(set(x)))
        labels = [label for label, _ in base]
        out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), joined(labels), joined(labels + own), max(best, 0.5 if base else 0.0)))
    return out


def test_license_labels(spark):
    rows = [(i, t, "own", 1, "b", "m") for i, t in enumerate(texts())]
    rows += [rows[10], rows[10], (None, MIT, None, None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = licenses.license_labels(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows)))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[12]["labels"] == "mit" and by_id[12]["n_base"] == 0 and 0.9 < by_id[12]["score"] < 1
    assert by_id[14]["labels"] == "" and by_id[13]["labels"] == "" and by_id[18]["labels"] == ""
    assert by_id[17]["labels"] == "apache,bsd,gpl,mit" and by_id[17]["score"] == 1
    assert by_id[21]["labels"] == "gpl,lgpl" and by_id[22]["labels"] == "cc-by-nc" and by_id[24]["labels"] == by_id[25]["labels"] == "mit"
    assert licenses.license_labels(df.limit(0)).count() == 0


def test_spans(spark):
    found = licenses.scan(spark.createDataFrame([(1, "x y " + MIT)], "doc_id long, text string")).first()
    assert [(m["label"], m["start"], m["share"]) for m in found["matches"]] == [("mit", 2, 1.0)] and found["base"] == []
