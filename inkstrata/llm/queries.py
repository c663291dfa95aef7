"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, cross_polytope, jaccard_join, kdtree_search, language_id, license_scan, mixing, packing, pitman_yor, quality_rules, suffix_sigma, toxicity, warc
from ._util import discarded, fold, stored, table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(quality_rules.measured(table(spark, sf_dir, "documents")))
    judged = quality_rules.apply_policy(book, quality_rules.POLICIES["v1"])
    failed = quality_rules.hits(quality_rules.POLICIES["base"].mask()) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
t AS (SELECT rid, pos, word, lead(word) OVER (PARTITION BY rid ORDER BY pos) AS b, lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS c FROM w),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM t WHERE c IS NOT NULL),
p AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM r CROSS JOIN (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2 GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
m AS (SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.word_chars, 0) AS word_chars,
             len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
             coalesce(p.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
      FROM d LEFT JOIN s USING (rid) LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
             + 8 * (word_chars > 15 * n_words)::INT + 16 * (2 * n_symbols > n_words)::INT
             + 32 * (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, (SELECT 1.5 * sum(source_size) FROM s) AS budget, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS at_cap,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM w),
l AS (SELECT arg_min((budget - capped) / free, at_cap) AS level FROM o WHERE (budget - capped) / free <= ratio),
t AS (SELECT source, source_size, weight, CASE WHEN (SELECT level FROM l) * weight > cap OR (SELECT level FROM l) IS NULL THEN cap ELSE (SELECT level FROM l) * weight END AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM p),
g AS (SELECT source, key, sum(size) AS words, count(*) AS n FROM k GROUP BY source, key),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g)
SELECT k.doc_id, k.size, q.source_size, q.target,
       CAST(q.whole * k.size + CASE WHEN c.start + c.words <= q.rest THEN k.size WHEN c.start <= q.rest THEN (q.rest - c.start) // c.n ELSE 0 END AS BIGINT) AS taken
FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source JOIN c ON c.key = k.key AND c.source IS NOT DISTINCT FROM k.source
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.archive_root(spark)
    records = warc.typed(table(spark, sf_dir, "pages"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = warc.write_archive(records, root, shards)
    back = warc.read_archive(manifest, root, with_payload=False)
    digests = stored(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-digests")
    discarded(spark, root)
    return digests


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree_search.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return kdtree_search.top_k(vectors, "vec_id % 50 = 0", k=5)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scanned(docs).select("doc_id", F.inline("matches"))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pitman_yor.scored(docs, "crc32(coalesce(cast(doc_id as string), '')) % 5 <> 1")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")
    return toxicity.fit(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.measured(docs.select("doc_id", "text"), toxicity_model(spark, sf_dir, docs))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, F.lit(1)).otherwise(F.lit(0)).cast("int")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_kmeans.kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", size=64, scale=1024)
    return ball_kmeans.clustered(vectors, size=64, k=8, rounds=10, seed=3)


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """A step per round: every vector's nearest centroid, then every centroid's floored mean."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        d = "CAST(list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM (SELECT rid, vec_id, v.v, c.c, {d} AS d FROM v CROSS JOIN c{i} AS c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if i < rounds:
            steps += [
                f"u{i} AS (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i})",
                f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{i} GROUP BY c, p) GROUP BY c)",
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m{i}.m, c.m) AS m FROM c{i} AS c LEFT JOIN m{i} ON m{i}.c = c.c)",
            ]
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON c.c = a.c"""


def op12_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sigma.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT c.lang, c.a, array_to_string(list_slice(c.w, i, i + m - 1), ' ') AS inner_ FROM c CROSS JOIN (VALUES (2), (3)) AS t(m) CROSS JOIN (VALUES (1), (2), (3)) AS u(i) WHERE m < c.k AND i + m - 1 <= c.k),
o AS (SELECT lang, inner_, max(a) AS longer FROM s GROUP BY ALL),
x AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, CAST(floor_div AS BIGINT) AS score
      FROM (SELECT c.*, t.j, array_to_string(c.w[1:t.j], ' ') AS lp, array_to_string(c.w[t.j + 1:], ' ') AS rp FROM c CROSS JOIN (VALUES (1), (2), (3)) AS t(j) WHERE t.j < c.k) AS c
      JOIN f AS l ON l.lang = c.lang AND l.k = c.j AND l.phrase = c.lp JOIN f AS r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = c.rp,
      LATERAL (SELECT (CAST(2000000 AS HUGEINT) * c.a) // (CAST(l.f AS HUGEINT) + r.f) AS floor_div)),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.inner_ = b.phrase
WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a QUALIFY rank <= 2000
"""


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cross_polytope.vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cross_polytope.nearest(vectors, "vec_id % 100 = 0", k=10)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * both_ >= 90 * (nx.n + ny.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(reach) FROM r WHERE r.doc_id = d.doc_id) AS component_id, CAST((SELECT count(*) FROM e WHERE e.x = d.doc_id) AS BIGINT) AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best, sha1(html) AS hex FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substring(hex, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER)) AS groups FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM v
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_suffix_sigma": op12_suffix_sigma,
    "op13_cross_polytope": op13_cross_polytope,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_source_mixing": OP4_SQL, "op7_warc": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op11_ball_kmeans": _op11_sql(), "op12_suffix_sigma": OP12_SQL}
