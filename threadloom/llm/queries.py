"""The registered queries opN_<name>: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, html_text, licenses, merkle, mixing, near_texts, near_vectors, neighbours, substrings, suffix_levels, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer="piece_bpe_32k.model")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passage_digests(_table(spark, sf_dir, "documents"), window=50)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), name="word_bpe_49k.json")


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_copies(_table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.repeat_digests(_table(spark, sf_dir, "documents"), length=400)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op10_link_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_with_inertia(_table(spark, sf_dir, "embeddings"), dimensions=64, k=16, rounds=3, seed=1)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_passages, op4_bpe, op5_near_copies, op6_repeats, op7_nearest, op8_toxicity, op9_main_texts, op10_link_vectors, op11_clusters, op12_licenses, op13_manifest)}


OP3_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN firsts USING (h), range(0, 50) t(k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _crc32(text: str) -> str:
    """DuckDB's lack of it, made good: CRC-32 of ASCII, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = lambda x: f"xor({table}[({x} & 15) + 1], {x} >> 4)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: {step(step('xor(c, b)'))}), 4294967295)"


def _op13_sql(levels: int = 7, over: int = 3) -> str:
    """Trees of at most 8^levels leaves a lang and 8^over langs, written out level by level."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(low)} END AS bad FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT g, pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM p)",
    ]

    def grow(t: str, height: int, key: str) -> None:
        run = f"PARTITION BY {key}, pos // 8 ORDER BY pos ROWS BETWEEN"
        for k in range(height):
            parts.append(f"x{t}s{k} AS (SELECT {key}, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WHERE n > {8**k})")
            parts.append(f"{t}{k + 1} AS (SELECT {key}, pos // 8 AS pos, n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {t}{k} WHERE n > {8**k} GROUP BY ALL UNION ALL SELECT * FROM {t}{k} WHERE n <= {8**k})")

    grow("a", levels, "g")
    parts.append(f"b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM a{levels})")
    grow("b", over, "one")
    parts.append(f"top AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM a{levels})")
    joins = [f"LEFT JOIN xas{k} ON xas{k}.g = p.g AND xas{k}.pos = p.pos // {8**k}" for k in range(levels)] + [f"LEFT JOIN xbs{k} ON xbs{k}.pos = place // {8**k}" for k in range(over)]
    names = [f"xas{k}" for k in range(levels)] + [f"xbs{k}" for k in range(over)]
    folds = ["coalesce(bad, leaf) AS f0"] + [f"CASE WHEN {s}.l IS NULL THEN f{i} ELSE sha256({s}.l || f{i} || {s}.r) END AS f{i + 1}" for i, s in enumerate(names)]
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in names)
    parts.append(f"e AS (SELECT doc_id, leaf, subroot, b{over}.h AS root, sha256({proof}) AS proof_sha256, {', '.join(folds)} FROM p JOIN top ON top.g = p.g {' '.join(joins)} CROSS JOIN b{over})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(names)} AS folded_root, f{len(names)} = root AS verified FROM e"


def _op11_sql(rounds: int = 3) -> str:
    """Rounds written out one by one, every vector compared with every centroid."""
    fine = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(x) < 2097152)) = 64"  # NaN is above all numbers
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {fine})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS k, q AS c FROM v QUALIFY k < 16)",
    ]
    gap = "list_sum(list_transform(list_zip(q, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': {gap}, 'k': k}}) AS m FROM v, c{r} GROUP BY i)")
        parts.append(f"s{r} AS (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(q) AS x, unnest(range(64)) AS p FROM a{r}) GROUP BY k, p)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(f, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS f FROM s{r} GROUP BY k) USING (k))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = m.k"""


def _op12_sql() -> str:
    """The same by joins of words' places: starts are counted in groups and not within a row."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({i}, '{label}', '{key}', {quoted(text.split())})" for i, (label, key, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in licenses.PHRASES)
    in_row = "list_sum(list_transform(range(len(t.w)), lambda j: CASE WHEN s + j >= 0 AND d.w[s + j + 1] = t.w[j + 1] THEN 1 ELSE 0 END))"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(id, label, key, w) AS (VALUES {templates}), ph(label, w) AS (VALUES {phrases}),
tw AS (SELECT id, word, q FROM (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS q FROM t)),
dw AS MATERIALIZED (SELECT r, word, p FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d) WHERE word IN (SELECT word FROM tw UNION SELECT unnest(w) FROM ph)),
df AS (SELECT word, count(DISTINCT r) AS n FROM dw GROUP BY word),
base AS (SELECT r, ph.label, p FROM dw JOIN d USING (r) JOIN ph ON dw.word = ph.w[1] WHERE d.w[p + 1 : p + len(ph.w)] = ph.w),
cand AS (SELECT r, id FROM d JOIN t ON list_has_all(d.w, string_split(t.key, ' '))),
keys AS (SELECT r, id, word FROM (SELECT r, id, word, n FROM cand JOIN (SELECT DISTINCT id, word FROM tw) USING (id) JOIN (SELECT DISTINCT r, word FROM dw) USING (r, word) JOIN df USING (word)) QUALIFY row_number() OVER (PARTITION BY r, id ORDER BY n, word) <= {licenses.RARE}),
starts AS (SELECT r, id, p - q AS s FROM keys JOIN dw USING (r, word) JOIN tw USING (id, word) GROUP BY ALL HAVING count(DISTINCT word) >= {licenses.AGREE}),
found AS (SELECT r, t.label, {in_row} / CAST(len(t.w) AS DOUBLE) AS share FROM starts JOIN d USING (r) JOIN t USING (id)
WHERE contains(' ' || array_to_string(d.w[greatest(s, 0) + 1 : s + len(t.w)], ' ') || ' ', ' ' || t.key || ' ') AND {in_row} / CAST(len(t.w) AS DOUBLE) >= {licenses.SHARE}),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS l FROM base GROUP BY r), m AS (SELECT r, max(share) AS share, list(DISTINCT label) AS l FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(b.l, m.l))), ','), '') AS labels,
greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {licenses.BASE_SCORE} ELSE 0 END)::DOUBLE AS score FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


def oracle_sql() -> dict[str, str]:
    """Only what DuckDB can express over whole tables; tests hold the others against brute force."""
    return {"op3_passages": OP3_SQL, "op11_clusters": _op11_sql(), "op12_licenses": _op12_sql(), "op13_manifest": _op13_sql()}
