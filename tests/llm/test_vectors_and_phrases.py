"""Ball k-means, suffix-sigma and cross-polytope search against brute-force versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import ball_kmeans, cross_polytope, suffix_sigma

VECTORS = "vec_id bigint, embedding array<float>, cluster string, row string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "own", "own") for i, v in rows], VECTORS)


def lloyd(rows, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assigned()
    per = collections.Counter()
    for d, c in own:
        per[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, per[c], sum(per.values()), names[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


def scattered(seed, n, dim, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("case", ["groups", "odd", "equal"])
def test_ball_kmeans_equals_lloyd(spark, case):
    rows = scattered(1, 200, 6)
    if case == "odd":
        rows += [(None, [0.5] * 6), (7, None), (8, [1.0, None, 0, 0, 0, 0]), (9, [float("nan")] + [0.0] * 5), (3, rows[3][1]), (3, [0.1] * 6), (11, [100.0] * 6)]
    if case == "equal":  # more starts than distinct vectors: equal centroids, empty clusters
        rows = [(i, [float(i % 3)] * 6) for i in range(60)]
    df = vector_rows(spark, rows + [(500, [1.0, 2.0]), (501, [])]).repartition(3)
    got = ball_kmeans.clustered(ball_kmeans.kept_vectors(df, "vec_id", "embedding", 6, 64), 6, k=8, rounds=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == lloyd(rows, 8, 4, 3, 64)


def test_ball_kmeans_without_rows_and_beyond_its_integers(spark):
    none = ball_kmeans.kept_vectors(vector_rows(spark, []), "vec_id", "embedding", 6, 64)
    assert ball_kmeans.clustered(none, 6).collect() == []
    few = ball_kmeans.kept_vectors(vector_rows(spark, [(1, [1.0] * 6), (2, [2.0] * 6)]), "vec_id", "embedding", 6, 64)
    assert sorted((r.vec_id, r.distance) for r in ball_kmeans.clustered(few, 6).collect()) == [(1, 0), (2, 0)]
    huge = ball_kmeans.kept_vectors(vector_rows(spark, [(1, [1e30] * 6)]), "vec_id", "embedding", 6, 64)
    with pytest.raises(Exception, match="64 bits"):
        ball_kmeans.clustered(huge, 6).collect()


def test_a_ball_skips_centroids_that_cannot_be_nearer():
    rng = np.random.default_rng(5)
    centroids = (rng.normal(size=(8, 4)) * 10_000).astype(np.int64)
    own = rng.integers(0, 8, 2_000)
    points = centroids[own] + rng.integers(-300, 300, (2_000, 4))
    between = np.stack([ball_kmeans.squared(centroids, c) for c in centroids])
    cluster, distance, work = ball_kmeans.reassigned(points, own, centroids, between)
    all_of = np.stack([ball_kmeans.squared(points, c) for c in centroids], 1)
    assert (cluster == all_of.argmin(1)).all() and (distance == all_of.min(1)).all()
    assert work < 2 * len(points)


def brute_phrases(docs, least, top, absorb=80):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = max((b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * longer >= absorb * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def worded(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "x\x01", "a\x01", "\x00", "naïve", "Éa", "日本", "😀", "u-v", "|"]
    docs = []
    for i in range(n):
        text = "".join(rng.choices(words, weights=[9, 3, 6, 4, 1, 2, 1, 1, 1, 1, 1, 1, 2])[0] + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice(["en", "e n", "e%20n", None, "und"]), text))
    return docs + [(None, None), ("en", ""), ("en", " ,. \t"), ("en", "hot pair " * 300), ("en", "hot pair " * 300), ("fr", "one")]


@pytest.mark.parametrize("cut", [400, 4 << 20])
def test_collocations_equal_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(suffix_sigma, "CUT", cut)  # small: texts are cut, merged in many turns
    docs = worded(3, 150)
    df = spark.createDataFrame([(i, lang, text, "own", 1) for i, (lang, text) in enumerate(docs)], "doc_id bigint, lang string, text string, phrase string, n bigint").repartition(3)
    got = suffix_sigma.collocations(df, least=5, top=40).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_phrases(docs, 5, 40)


def test_hot_phrases_are_split_over_ranges(spark):
    df = spark.createDataFrame([("en", " ".join(f"hot pair w{i}x{j}" for j in range(40))) for i in range(100)], "lang string, text string")
    borders = suffix_sigma._borders(df, 4, 100, 16)
    per = suffix_sigma.suffixes(df, 4, borders).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert len(per) >= 12 and max(r.n for r in per) < sum(r.n for r in per) / 4
    rows = [r for r in suffix_sigma.phrase_counts(df, 4, 30)[0].collect() if r.words]
    assert sorted((r.phrase, r.f) for r in rows) == [("hot", 4000), ("hot pair", 4000), ("pair", 4000)]


def test_collocations_of_no_documents_and_of_huge_counts(spark):
    assert suffix_sigma.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    rows = [(9 * 10**18, 9 * 10**18, 9 * 10**18 - 1), (10**13 + 7, 3 * 10**13, 10**13), (30, 31, 1_999_999)]
    got = [r.x for r in spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(suffix_sigma.score().alias("x")).collect()]
    assert got == [2_000_000 * a // (left + right) for a, left, right in rows]


def test_many_words_need_more_than_one_number():
    rng = random.Random(9)
    texts = [(b"en ", np.frombuffer(" ".join(f"w{rng.randrange(9000)}" for _ in range(30_000)).encode(), np.uint8)) for _ in range(2)]
    found, n = suffix_sigma.merged_suffixes(texts, 6)
    brute = collections.Counter()
    for _, t in texts:
        w = t.tobytes().split()
        for i in range(len(w)):
            brute[b"en " + b"".join(x + b" " for x in w[i : i + 6])] += 1
    assert found.to_pylist() == sorted(brute) and dict(zip(found.to_pylist(), n.tolist(), strict=True)) == brute


def brute_nearest(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    answers = {}
    for q in {i for i, _ in ok if i % every == 0}:
        own = [v for i, v in ok if i == q]
        answers[q] = sorted((min(float(np.sqrt(((v - o) ** 2).sum())) for o in own), i) for i, v in ok if i != q)[:k]
    return answers


def test_cross_polytope_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    rows = scattered(4, 3_000, 24, groups=40)
    rows += [(10_000 + i, rows[5][1]) for i in range(400)]  # one hot vector
    rows += [(20_000 + i, (np.array(rows[i][1]) * rng.uniform(0.2, 5)).tolist()) for i in range(200)]  # other norms
    df = vector_rows(spark, rows).repartition(5)
    got = collections.defaultdict(list)
    for r in cross_polytope.nearest(cross_polytope.vectors_of(df, "vec_id", "embedding"), "vec_id % 50 = 0", k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    exact = brute_nearest(rows, 50, 10)
    assert set(got) == set(exact) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    found = sum(len({round(s, 9) for s, _ in got[q]} & {round(s, 9) for s, _ in exact[q]}) for q in exact) / sum(len({round(s, 9) for s, _ in x}) for x in exact.values())
    assert found >= 0.9


def test_cross_polytope_odd_rows_are_exact(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 2.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (100, [3e-30, 0.0, 0.0]), (7, [1e30, 1e30, 0.0]), (8, [])]
    df = vector_rows(spark, rows)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in cross_polytope.nearest(cross_polytope.vectors_of(df, "vec_id", "embedding"), "vec_id % 100 = 0", k=4).orderBy("query_id", "rank").collect()]
    brute = brute_nearest(rows, 100, 4)
    assert [(q, v) for q, _, v, _ in got] == [(q, i) for q in sorted(brute) for _, i in brute[q]]
    assert np.allclose([s for *_, s in got], [s for q in sorted(brute) for s, _ in brute[q]], rtol=1e-5)
    assert cross_polytope.nearest(cross_polytope.vectors_of(vector_rows(spark, []), "vec_id", "embedding"), "true").collect() == []


def test_cells_are_refined_with_the_rows():
    assert cross_polytope.cell_shape(10_000, 64) == [64]
    for n in (100_000, 10**7, 10**9):
        cells = math.prod(2 * d for d in cross_polytope.cell_shape(n, 64))
        assert n / cells <= cross_polytope.CELL_ROWS < 2.5 * n / cells * 2
    hasher = cross_polytope.Hasher(16, [16, 4], 2)
    unit = cross_polytope.units(np.random.default_rng(1).normal(size=(50, 16)))
    for t in range(2):
        rotated = hasher.rotated(unit, t)
        assert np.allclose(np.linalg.norm(rotated[0], axis=1), 1)
        for i in range(50):  # the likeliest cell is the vector's own
            ranked = hasher.likeliest([y[i] for y in rotated], 256)
            assert ranked[0] == hasher.cell(unit[i : i + 1], t)[0] and len(set(ranked.tolist())) == hasher.cells
