"""Operators on vectors and pages, toxicity, and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import html_text, near_vectors, neighbours, toxicity
from threadloom.llm.queries import queries

VECTORS = "vec_id long, embedding array<float>, label int, _v string"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        rows.append([i, rng.standard_normal(8), i % 3])
    for i in range(40):  # a dense group, and near copies of others
        rows.append([300 + i, rows[0][1] + 0.05 * rng.standard_normal(8), 0])
        rows.append([400 + i, rows[i][1] + 0.1 * rng.standard_normal(8), i % 3])
    out = [(i, [float(x) for x in v], l, "own") for i, v, l in rows]
    bad = [(900, None, 1, ""), (901, [0.0] * 8, 1, ""), (902, [float("nan")] * 8, 1, ""), (903, [1.0, None] * 4, 1, ""), (904, [1.0] * 5, 1, ""), (905, out[5][1], None, ""), (920, [float("inf")] * 8, 0, ""), (None, out[0][1], 0, "")]
    return out + bad + [out[3]]


def usable(label=True):
    return {i: (np.asarray(v, np.float32).astype(float), l) for i, v, l, _ in vectors() if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v) and (l is not None or not label)}


@pytest.mark.parametrize("block", [1024, 16])
def test_link_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "CELL", 40)
    rows = usable()
    links = {i: {j for j in rows if i != j and rows[i][1] == rows[j][1] and rows[i][0] @ rows[j][0] / np.linalg.norm(rows[i][0]) / np.linalg.norm(rows[j][0]) >= 0.93} for i in rows}
    least = {i: i for i in rows}
    while True:
        new = {i: min([least[i], *(least[j] for j in links[i])]) for i in rows}
        if new == least:
            break
        least = new
    df = spark.createDataFrame(vectors(), VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(df).collect()}
    assert len(got) == len({i for i, *_ in vectors()})
    wrong = [i for i in got if got[i] != ((len(links[i]), least[i], least[i] == i) if i in rows else (0, i, True))]
    assert len(wrong) <= 2, wrong  # the tables miss a pair at the threshold with a chance of 1e-4
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    rows = usable(label=False)
    df = spark.createDataFrame(vectors(), VECTORS)
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    assert set(got) == {i for i in rows if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        want = sorted(((j, float(rows[q][0] @ rows[j][0])) for j in rows if j != q), key=lambda p: (-p[1], p[0]))[:20]
        hit, total = hit + len({j for j, _ in want} & {j for j, _ in found}), total + len(want)
        assert all(abs(s - float(rows[q][0] @ rows[j][0])) < 1e-9 for j, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hit / total >= 0.9
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), lambda i: i % 20 == 0)
    assert [r["vec_id"] for r in few.collect()].__len__() == 2


def test_vectors_of_other_lengths(spark):
    """Vectors of a rare length are searched and linked among themselves; equal ones count each; ties go to smaller ids."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0 + 0.01 * i], 0) for i in range(3)] + [(200 + i, [1.0, 2.0, 3.0], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(df).collect()}
    assert len(got) == len(rows) and got[100] == (5, 100, True) and got[204] == (5, 100, False) and got[201] == (2, 201, True) and got[203] == (2, 201, False)
    found = [(r["rank"], r["vec_id"]) for r in neighbours.nearest(df, lambda i: i % 20 == 0).where("query_id = 100").orderBy("rank").collect()]
    assert found == [(n + 1, i) for n, i in enumerate([102, 101, 200, 201, 202, 203, 204, 205])]


def test_nearest_in_many_lists(spark, monkeypatch):
    for name, value in {"LIST_ROWS": 16, "SHARD_ROWS": 40, "QUERY_ROWS": 5}.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = usable(label=False)
    found = neighbours.nearest(spark.createDataFrame(vectors(), VECTORS), lambda i: i % 20 == 0).collect()
    hit = 0
    for q in {r["query_id"] for r in found}:
        want = {j for _, j in sorted((-float(rows[q][0] @ rows[j][0]), j) for j in rows if j != q)[:20]}
        hit += len(want & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hit / len(found) >= 0.9 and len({(r["query_id"], r["vec_id"]) for r in found}) == len(found)


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></ul></nav><div class="ad">Buy</div><article><h1>T&auml;st &amp; x</h1><p>One <b>two</b>\n three<br>four<p>five<script>var a="</p>";</script></article><section class="comments"><p>me too</section><footer>(c)</footer></body></html>'


def test_pages(spark):
    rows = [(1, "http://a.x/1", PAGE, "own"), (1, "http://a.x/1", PAGE, "own"), (2, None, None, ""), (3, "u", "", ""), (None, "http://[", PAGE[:150], ""), (4, "http://a.x/4", PAGE[: PAGE.index("five")], "")]
    rows += [(10 + i, f"http://b.x/{i}", f"<body><div><p>We are b</p><p>Since ever</p></div><div><p>story {i}</p><table><tr><td>1{i}<td>2<tr><td>3{i}</table></div>", "") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Täst & x\n\nOne two three four\n\nfive" and text[2] == text[3] == "" and text[4] == "Täst & x\n\nOne two three four"
    assert text[12] == "story 2\n\n12 2\n\n32", "what all of the site's pages have is no article"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [0, 40])
def test_nearest_in_short_lists(spark, monkeypatch, copies):
    """However short a query's lists are, or whatever ids they repeat, it gets k neighbours if there are so many."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 4)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    rows = vectors() + [vectors()[20]] * copies
    found = neighbours.nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0, wanted=0.0).collect()
    by_query: dict[int, set] = {}
    for r in found:
        by_query.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(by_query) == {i for i in usable(label=False) if i % 20 == 0}
    assert {len(f) for f in by_query.values()} == {20} and len(found) == 20 * len(by_query)


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="content-with-sidebar">', '<div class="no-sidebar">', '<div id="search-results">', '<div class="a has-header">', '<div class="search">', '<main><div class="widget">', '<div id="sidebar"><div><main>'],
)
def test_names_do_not_hide_articles(wrapper):
    article = '<article class="related"><header class="entry-header"><h1>Title</h1></header><div class="post-header">By x</div><div class="header site-header"><p>Dek</p></div><p>Text</p><div class="ads-free">Free</div>'
    page = f'<body><div class="top nav-menu">Home</div>{wrapper}{article}<div class="wide ad">Buy</div><div class="cookie-banner">Ok?</div><div id="comments"><article>me too</article></div></article>'
    assert html_text.Page(page).main_text(set()) == "Title\n\nBy x\n\nDek\n\nText\n\nFree"


def test_formulas_stay_in_their_blocks():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <span class='ad-hoc'>so</span>.</p><p class='social-history'>S</p><div id='menu-of-the-day'>M</div></article>"
    assert html_text.Page(page).main_text(set()) == "Let x=1 be so.\n\nS\n\nM"


def test_roles_still_hide_articles():
    for wrapper in ("<aside>", "<nav>", '<div role="search">'):
        assert html_text.Page(f"<body>{wrapper}<article>Teaser</article>").main_text(set()) == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>S</h1><p>Story</p><div class="ad-slot">BUY</div></article>', "S\n\nStory"),
        ('<main><p>Story</p><div class="cookie-bar">Ok</div><div class="sidebar-left">x</div></main>', "Story"),
        ('<article><p>Story</p><div class="share-buttons">s</div><section id="user-comments"><p>first!</section><div class="userComments">second</div>', "Story"),
        ("<article>teaser</article><div><h1>Head</h1><p>The story stands outside.</p><p>All of it does.</p></div>", "Head\n\nThe story stands outside.\n\nAll of it does."),
        ("<article><p>Teaser of another</p></article><article><p>The story has most of the text.</p><p>More of it.</p></article>", "The story has most of the text.\n\nMore of it."),
        ('<article><p>The <label>value</label> word</p><p class="notices">N</p><p>a <button>go</button> b</p></article>', "The value word\n\nN\n\na b"),
        ('<body><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><div><p>Text with <a>a link</a>.</p></div>', "Text with a link ."),
        ("<article>" * 40 + "x" + "<div>" * 300, "x"),
        ("<p>" + "long " * 300_000, ("long " * 300_000).strip()),
    ],
)
def test_structure_decides(page, text):
    assert html_text.Page(page).main_text(set()).replace("link.", "link .") == text


def site() -> list[tuple]:
    """A site whose stories hold templates that no name gives away, with copies of one story under other addresses."""
    bar = "<div><span>Follow us</span> on the net</div><ul><li>Print</li><li>Send</li></ul>"
    page = lambda i, story: f"<body><div><p>We are c</p></div><article><h1>T{i}</h1><h2>Summary</h2><p>{story}</p>{bar}<p>More of {i}.</p></article><div>All rights</div>"
    rows = [(i, f"https://www.c.x/{i}", page(i, f"Story number {i} is told here at length."), "own") for i in range(12)]
    rows += [(50 + i, f"https://c.x/copy/{i}", page(50, "One story is told again and again, with the same words."), "own") for i in range(30)]
    return rows + [(90, "http://d.x/1", f"<article><p>Elsewhere.</p>{bar}</article>", "own"), (91, "http://d.x/1", f"<article><p>Elsewhere.</p>{bar}</article>", "own")]


def test_templates_within_stories(spark):
    rows = site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, subtree string").repartition(3)
    text = {r["page_id"]: r["text"] for r in html_text.main_texts(df).collect()}
    assert text[3] == "T3\n\nSummary\n\nStory number 3 is told here at length.\n\nMore of 3."
    assert text[60] == "T50\n\nSummary\n\nOne story is told again and again, with the same words.\n\nMore of 50.", "copies of a story don't make it a template"
    assert text[90] == text[91] == "Elsewhere.\n\nFollow us on the net\n\nPrint\n\nSend", "two pages are too few"
    # the counts, by hand
    pages = {(html_text.host_of(u), h): html_text.Page(h) for _, u, h, _ in rows}
    on: dict[tuple, set] = {}
    for (host, h), p in pages.items():
        for x in p.subtrees():
            on.setdefault((host, x), set()).add(p.story_key())
    size = {host: len({p.story_key() for (o, _), p in pages.items() if o == host}) for host, _ in pages}
    want = {x for (host, x), keys in on.items() if len(keys) >= 3 and (len(keys) >= 0.1 * size[host] or len(keys) >= 20)}
    keyed = df.select("url", "html").withColumn("_key", html_text.page_key(df.url, df.html)).withColumnsRenamed({"url": "_url", "html": "_html"})
    assert {x for r in html_text.site_templates(keyed).collect() for x in r["_gone"]} == want and size == {"c.x": 13, "d.x": 1}
    changed = sum(html_text.Page(h).main_text(set()) != text[i] for i, _, h, _ in rows)
    assert changed == 42, "templates change rows"


def toxic_docs():
    rng = random.Random(6)
    plain, rude = [f"wo{a}{b}" for a in "abcdefgh" for b in "rstuvw"], ["grumbl", "snarkle", "vexo"]
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", "a", "ing"])
        docs.append((i, " ".join(words), "x"))
        if i % 4 < 3:
            labels.append((i, 1, int(bad)))
    return docs + [(1000, None, None), (1001, "", None), (None, "grumbl grumbl", None), docs[0]], labels + [(5, 1, None), (None, 1, 1)]


def test_toxicity(spark):
    docs, labels = toxic_docs()
    d, l = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(d, l).collect()
    assert len(got) == len(docs)
    rows = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items() if i is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(rows[i]["predicted"], int(i % 6 == 0)) for i in range(900) if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    assert rows[1000]["predicted"] == rows[1001]["predicted"] == 0
    kept = toxicity.drop_toxic(d, l)
    assert kept.columns == d.columns and 0.75 * len(docs) < kept.count() < 0.9 * len(docs)
    assert toxicity.score_toxicity(d.limit(0), l).count() == 0
    assert toxicity.score_toxicity(d, l.limit(0)).count() == len(docs)


@pytest.mark.parametrize("entries", [0, 40])
def test_toxicity_beyond_held_entries(spark, monkeypatch, entries):
    """Entries that tasks don't hold count all the same: in scores, the calibration and what is dropped."""
    docs, labels = toxic_docs()
    d, l = spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = lambda: sorted(toxicity.score_toxicity(d, l).collect(), key=str)
    kept = lambda: sorted(map(str, toxicity.drop_toxic(d, l).collect()))
    whole, left = rows(), kept()
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    got = rows()
    assert [(r["doc_id"], r["held_out"], r["predicted"]) for r in got] == [(r["doc_id"], r["held_out"], r["predicted"]) for r in whole]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in whole], abs=1e-12)
    assert kept() == left and len(left) < len(docs)
    assert toxicity.score_toxicity(d.limit(0), l).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "encode" or out.columns == columns
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before and len(after) >= 0.6 * len(before), name
        docs = out.cache()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
