"""The join, mixing, packing, archives and search against brute-force versions."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import components, jaccard_join, kdtree_search, mixing, packing, warc
from inkstrata.llm._util import even_keys, partition_of
from inkstrata.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, percent):
    sets, up = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, n = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * n:
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted((doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _, _) in enumerate(rows) if doc is not None)


def near_copies(seed, groups=6, copies=12, words=60):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=55))
    for g in range(groups):
        base = rng.choices(vocabulary, k=words + 25 * g)
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if c % 4 == 3:
                text = text[: len(text) - rng.choice((1, 2, 5))]
            rows.append((1000 * g + c, " ".join(text), f"s{g % 4}"))
        rows.append((1000 * g + 500, f"{passage} " + " ".join(rng.choices(vocabulary, k=9)), "shared"))
    rng.shuffle(rows)
    return rows


def test_a_buckets_shingles_are_counted_in_ranges(monkeypatch):
    rng, blocks = np.random.default_rng(1), {}
    rows = [(1, 99, [1], *[b""] * 4, None, None)]
    for block in range(20):
        keys = np.unique(rng.integers(0, 1 << 12, 200).astype(np.uint64) << np.uint64(30))
        owners = rng.integers(0, 30, len(keys)).astype(np.uint16)
        owners[::17] = jaccard_join.OWNERS
        blocks[block] = keys, owners
        rows.append((1, block, *[None] * 5, jaccard_join.packed(keys), owners.tobytes()))
    times = collections.Counter(k for keys, _ in blocks.values() for k in keys.tolist())
    want = {b: np.bincount([o for k, o in zip(keys.tolist(), owners.tolist(), strict=True) if times[k] > 1 and o != jaccard_join.OWNERS]).tolist() for b, (keys, owners) in blocks.items()}
    for at_once in (4_000_000, 300):
        monkeypatch.setattr(jaccard_join, "COUNTED", at_once)
        found = jaccard_join._answered(pd.DataFrame(rows, columns=jaccard_join.MESSAGE.names))
        got = {r.block: np.trim_zeros(np.frombuffer(r.shared, np.int64), "b").tolist() for r in found.itertuples() if r.ids is None}
        assert got == want and sum(r.ids is not None for r in found.itertuples()) == 1


def test_answers_dont_grow_with_buckets(spark):
    """A document costs its shared shingles, not a count for each bucket that its block asks."""
    rows = [(i, " ".join(f"w{i // 2 * 40 + k}" for k in range(40)), "a") for i in range(400)]
    jaccard = lambda buckets: jaccard_join.screened(documents(spark, rows), 3, buckets)
    size = sum(len(t) for _, t, _ in rows)
    sent = []
    for n in (4, 400):
        screen = jaccard_join.Screen(3, np.arange(n), 0, 1 << 20)
        for i, text, _ in rows[::2]:
            list(screen.add(i, text))
        (first,) = screen.flush()
        for i, text, _ in rows[1::2]:
            list(screen.add(i, text))
        (second,) = screen.flush()
        frames = pd.concat([first.to_pandas(), second.to_pandas()])
        answers = [jaccard_join._sparse(g.reset_index(drop=True)) for _, g in frames.groupby("bucket")]
        sent.append(sum(len(x) for a in answers for x in a[a["ids"].isna()]["shared"]))
        assert sum(np.frombuffer(x, np.int32).sum() for a in answers for x in a[a["ids"].isna()]["shared"]) == 400 * 38
    assert sent[1] <= 400 * 38 * 4
    by_buckets = [sorted((r.doc_id, r.shared) for r in jaccard(-(-size // n)).collect()) for n in (4, 400)]
    assert by_buckets[0] == by_buckets[1] == [(i, 38) for i in range(400)]


def test_few_buckets_change_nothing(spark, monkeypatch):
    rows = [*near_copies(3), (-1, None, "a"), (-2, "", "a")]
    monkeypatch.setattr(jaccard_join, "MOST_BUCKETS", 1)
    got = jaccard_join.joined(documents(spark, rows), percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 80)


def test_equal_vectors_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(kdtree_search, "BLOCKS_A_TASK", 2)
    vectors = kdtree_search.integer_vectors(spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding")), "vec_id", "embedding")
    found, pairs = kdtree_search.planned(vectors, "vec_id % 50 = 0", 5, 1_000, 20, kdtree_search.CELLS)
    assert pairs is None
    met = {}
    monkeypatch.setattr(kdtree_search, "_searched", lambda rows, k: met.setdefault("rows", rows) and rows.selectExpr("0L as query_id", "0L as row", "0L as vec_id", "0L as score"))
    kdtree_search.planned(vectors, "vec_id % 50 = 0", 5, 1_000, 20, kdtree_search.CELLS)
    keys = met["rows"].groupBy("cell", "shard", "group").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in keys) == 20 * 20 and len(keys) >= 150 and max(r.n for r in keys) <= 10
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.where("query_id in (0, 100)").collect())
    assert got == [(0, r, r) for r in range(1, 6)] + [(100, r, r - 1) for r in range(1, 6)]


@pytest.mark.parametrize("percent,block", [(90, 4000), (80, 5), (70, 3)])
def test_join_matches_brute_force(spark, percent, block):
    rows = near_copies(percent)
    got = jaccard_join.joined(documents(spark, rows), percent=percent, block_sets=block)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, percent)


def test_join_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", "a"), (4, "one", "a"), (5, "ONE ", "a"), (6, "one two", "a"), (6, "one two", "a"), (7, "x " * 3000, "a"), (None, "one two", "a")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.joined(documents(spark, rows)).collect())
    assert got == [(False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 1, 4), (False, 5, 1, 4), (False, 6, 1, 6), (False, 6, 1, 6), (False, 7, 1, 7), (True, 0, 1, 6)]
    assert jaccard_join.joined(documents(spark, [])).count() == 0


def test_deduplicated_keeps_one_of_each(spark):
    rows = near_copies(5)
    kept = sorted(r.doc_id for r in jaccard_join.deduplicated(documents(spark, [*rows, rows[0], (None, "a b c d", "x"), (None, "a b c d", "x")])).collect() if r.doc_id is not None)
    assert kept == sorted({c for _, _, c in brute_components(rows, 90)})


def test_deduplicated_decides_texts_that_share_an_id(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(3, a, "s"), (5, f"{a} z", "s"), (5, b, "s"), (7, c, "s"), (7, f"{c} z", "s"), (9, d, "s"), (9, d, "s"), (9, e, "s"), (5, "", "s"), (1, f"{e} z", "s")]
    got = sorted((r.doc_id, r.text[:1]) for r in jaccard_join.deduplicated(documents(spark, rows)).collect())
    assert got == [(1, "e"), (3, "a"), (5, ""), (5, "b"), (7, "c"), (9, "d")]


def test_short_sets_differ_in_one(spark):
    base = [f"a{i}" for i in range(14)]
    rows = [(1, " ".join(base), "s"), (2, " ".join(base[:-1]), "s"), (3, " ".join(base[1:]), "s"), (4, " ".join([*base[:6], "z", *base[7:]]), "s")]
    got = jaccard_join.joined(documents(spark, rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 90)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 90))), s) for i, s in enumerate(["a"] * 200 + ["b"] * 30 + ["c"] * 60 + [None] * 20)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " ", "empty"), (1, rows[1][1], "a")]
    got = mixing.mixture(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 2
        assert own[0].target <= 2 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 * total
    free = {s: own[0].target / w for s, own, w in zip(["a", "b", "c", "empty", None], [by[s] for s in ["a", "b", "c", "empty", None]], [5, 2, 1, 5, 2]) if own[0].target < 2 * own[0].source_size}
    assert max(free.values()) - min(free.values()) < 1e-9 * total
    again = mixing.mixture(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(documents(spark, [])).count() == 0


def test_mixing_carries_a_fraction_that_rounds_to_all_words(spark):
    for sizes in ([1], [3], [2, 1], [1, 1, 1]):
        for i in (8, 9, 13, 16, 19):
            target = sum(sizes) * i / 10
            df = mixing.sized(documents(spark, [(k, "w " * n, None) for k, n in enumerate(sizes)]))
            src = spark.createDataFrame([(None, sum(sizes), 1.0, float(target))], "source string, source_size bigint, weight double, target double")
            got = mixing.apply_mix(df, mixing.plan_mix(df, src)).collect()
            assert sum(r.taken for r in got) == int(target + 0.5), (sizes, target)
            if target >= sum(sizes) - 0.5:
                assert all(r.taken >= r.size for r in got)


def test_mixed_documents_hold_what_was_taken(spark):
    rows = [(i, f"d{i}\n" + " ".join("w" for _ in range(i % 37 + 1)), "abc"[i % 3]) for i in range(200)]
    docs = documents(spark, rows).withColumn("key", F.lit("clash")).withColumn("taken", F.lit(1))
    want = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = collections.Counter()
    text = dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        have[r.doc_id] += len(r.text.split())
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(have)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "γάμμα", "it's", "x9!", "Straße."]) for _ in range(int(rng.lognormvariate(5, 1.2)))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000, None, "s"), (1001, "", "s"), (1002, "long " * 9000, "s"), (7, texts[7], "s"), (None, "null id", "s")]
    got = [r.asDict() for r in packing.pack(documents(spark, rows), tokenizer_path(), group_docs=150).collect()]
    tok = Tokenizer.from_file(tokenizer_path())
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, _ in rows]
    left = collections.Counter()
    for i, own in ids:
        left[i, len(own)] += len(own)
    known = dict(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        own = known[r["doc_id"]]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        left[r["doc_id"], len(own)] -= r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(left.values()) == {0}
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding < 0.03 * sum(len(o) for _, o in ids)
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


def test_packing_handles_very_long_texts_and_other_columns(spark):
    from tokenizers import Tokenizer

    text = "long words, " * 200_000  # beyond the bytes that are encoded at once
    docs = documents(spark, [(1, text, "s"), (2, None, None)]).withColumns({"start": F.lit("x"), "length": F.lit(1), "place": F.lit(2), "crcs": F.lit(3)})
    got = packing.pack(docs, tokenizer_path()).collect()
    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 2], "<u4")
    own = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 1)
    assert [a for a, _, _ in own] == np.cumsum([0, *(n for _, n, _ in own)])[:-1].tolist() and sum(n for _, n, _ in own) == len(ids)
    assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own) and [r.length for r in got if r.doc_id == 2] == [1]


@pytest.mark.parametrize("n", [1_000, 10_000])
def test_patterns_carry_most_items(n):
    rng = np.random.default_rng(n)
    rest = np.sort(np.clip(rng.lognormal(5.5, 1.1, n), 1, 4095).astype(np.int64))[::-1].copy()
    kinds = -(-rest // packing.UNIT)
    sizes, demand = np.unique(kinds, return_counts=True)
    patterns, uses = packing.cutting_stock(sizes, demand.astype(float), 4096 // packing.UNIT)
    bins, _ = packing.pack_group(rest, np.zeros(n, bool), sizes, patterns, uses, 4096, packing.UNIT)
    assert sorted(i for b in bins for i in b) == list(range(n)) and all(rest[b].sum() <= 4096 for b in bins)
    assert len(bins) <= 1.02 * np.ceil(rest.sum() / 4096) + 2


def test_cutting_stock_reaches_the_bound():
    sizes, demand = np.array([3, 5, 7, 12]), np.array([40.0, 33.0, 21.0, 10.0])
    patterns, uses = packing.cutting_stock(sizes, demand, 16)
    assert (patterns @ uses >= demand - 1e-3).all() and (sizes @ patterns <= 16).all()
    bins: list[int] = []  # first fit decreasing can't beat the program's optimum
    for size in sorted((int(s) for s, d in zip(sizes, demand, strict=True) for _ in range(int(d))), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= size), None)
        if at is None:
            bins.append(16)
            at = len(bins) - 1
        bins[at] -= size
    assert (sizes * demand).sum() / 16 <= uses.sum() + 1e-3 <= len(bins) + 1e-2


PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/p{i}", f"<p>{'é' * (i % 50)}</p>") for i in range(400)] + [(900, None, None), (901, "http://x", ""), (902, "http://\r\nx", None), (None, "u", "only"), (None, "v", "<p></p>")]
    got = {}
    for run in range(2):
        root = f"file://{tmp_path}/{run}"
        manifest = warc.write_archive(warc.typed(spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "size": F.lit("x"), "best": F.lit(2)})), root, 3, roll_bytes=4000)
        files = sorted((r.path, r.sha1) for r in manifest.collect())
        got.setdefault("files", files)
        assert files == got["files"] and len(files) > 6
        back = warc.read_archive(manifest, root).collect()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        body, b = (html or "").encode(), best[html or ""]
        revisit = (-1 if i is None else i) != b
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", b if revisit else None))
    key = lambda r: (r[0] is None, str(r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=key) == sorted(want, key=key)
    payload = {r.page_id: r.payload for r in back if r.record_type == "response"}
    assert all(payload[i] == (html or "").encode() for i, _, html in rows if i in payload and i is not None)
    import gzip

    one = gzip.decompress((tmp_path / "1" / files[0][0]).read_bytes())
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and b"WARC-Refers-To: <urn:uuid:" in b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "1").glob("part-*"))
    ids = {line for p in (tmp_path / "1").glob("part-*") for line in gzip.decompress(p.read_bytes()).split(b"\r\n")}
    assert all(b"WARC-Record-ID: " + x.partition(b": ")[2] in ids for x in ids if x.startswith(b"WARC-Refers-To: "))
    swapped = sorted((tmp_path / "1").glob("part-*"))[:2]
    raw = swapped[0].read_bytes()
    member = gzip.compress(gzip.decompress(raw).replace(b"WARC-Target-URI: http://h0", b"WARC-Target-URI: http://x0"), mtime=0)
    assert member != raw
    swapped[0].write_bytes(member)  # a header that no record's digest covers
    with pytest.raises(Exception, match="damaged|records"):
        warc.read_archive(spark.read.parquet(f"{tmp_path}/1/manifest"), f"file://{tmp_path}/1").collect()
    damaged = next((tmp_path / "0").glob("part-*"))
    raw = bytearray(damaged.read_bytes())
    raw[len(raw) // 2] ^= 1
    damaged.write_bytes(raw)
    with pytest.raises(Exception, match="damaged|Error|error|records"):
        warc.read_archive(spark.read.parquet(f"{tmp_path}/0/manifest"), f"file://{tmp_path}/0").collect()
    empty = warc.write_archive(warc.typed(spark.createDataFrame([], PAGES)), f"file://{tmp_path}/e", 2)
    assert empty.count() == 0 and warc.read_archive(empty, f"file://{tmp_path}/e").count() == 0


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(900)]
    vectors += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1050, []), (1100, [5.0]), (None, [1.0] * 6), (10, vectors[10][1]), (20, vectors[30][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = kdtree_search.top_k(kdtree_search.integer_vectors(df, "vec_id", "embedding"), "vec_id % 50 = 0", shard_rows=100, query_block=4)
    have = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    ok = [(i, np.floor(256 * np.array([np.float32(x) for x in v], float)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in ok:
        if q % 50 == 0:
            hits = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in ok if i != q)[:5]
            want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(hits)}
    assert have == want
    same = kdtree_search.integer_vectors(spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    assert sorted(map(tuple, kdtree_search.top_k(same, "vec_id % 50 = 0").collect())) == [(50, 1, 1, 3 * 65536), (50, 2, 2, 2 * 65536)]
    with pytest.raises(Exception, match="too large"):
        kdtree_search.top_k(kdtree_search.integer_vectors(spark.createDataFrame([(50, [1e9]), (1, [1e9])], "vec_id bigint, embedding array<float>"), "vec_id", "embedding"), "vec_id % 50 = 0").collect()
    few = kdtree_search.integer_vectors(df.where("vec_id in (0, 1)"), "vec_id", "embedding")
    assert kdtree_search.top_k(few, "vec_id % 50 = 0").count() == 1
    assert kdtree_search.top_k(few.where("vec_id < 0"), "vec_id % 50 = 0").count() == 0


def test_search_skips_cells_that_no_query_needs(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 8)) * 8
    points = np.concatenate([c + rng.normal(size=(60, 8)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<float>")
    vectors = kdtree_search.integer_vectors(df, "vec_id", "embedding")
    found, pairs = kdtree_search.planned(vectors, "vec_id % 50 = 0", 5, 60, 4, 40)
    pairs = pairs.select("home", "block", "cell", "shard").collect()
    n_blocks, n_cells = (len({k(r) for r in pairs}) for k in (lambda r: (r.home, r.block), lambda r: r.cell))
    assert len(pairs) < 0.5 * n_blocks * n_cells and len(set(pairs)) == len(pairs)
    whole = np.floor(256 * points.astype(np.float32).astype(float)).astype(int)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in kdtree_search.top_k(vectors, "vec_id % 50 = 0", 5, 60, 4, 40).collect()}
    want = {(q, r + 1): (i, -s) for q in range(0, len(whole), 50) for r, (s, i) in enumerate(sorted((-int(whole[q] @ x), i) for i, x in enumerate(whole) if i != q)[:5])}
    assert got == want


@pytest.mark.parametrize("percent,block", [(90, 4000), (80, 5), (60, 7)])
def test_links_are_counted(spark, percent, block):
    rows = [*near_copies(percent + 1), *near_copies(percent + 1, groups=2, copies=5), (-1, None, "a"), (-2, "lone words here", "a"), (None, "lone words here", "a")]
    rows = [(i if doc is not None else None, t, s) for i, (doc, t, s) in enumerate(rows)]
    sets = [shingles(t) for _, t, _ in rows]
    want = [sum(1 for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= percent * len(a | b)) for i, a in enumerate(sets)]
    got = jaccard_join.joined(documents(spark, rows), percent=percent, block_sets=block, links=True).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(d), n) for (d, _, _), n in zip(rows, want, strict=True)) and max(want) > 5


def test_answers_are_derived():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 300 + 20 * (i % 4), replace=False) if i % 7 == 0 else base[i % 30 :], rng.integers(0, 1 << 60, i % 9, dtype=np.uint64)))) for i in range(60)]
    lists = jaccard_join.Lists(sets, 90)
    for q, hits in jaccard_join.answers(sets, lists):
        assert sorted(lists.order[hits].tolist()) == [i for i, x in enumerate(sets) if jaccard_join.linked(sets[q], x, 90)]


@pytest.mark.parametrize("block,bucket", [(2_000_000, 24_000_000), (150, 600)])
def test_screen_counts_what_others_share(spark, block, bucket):
    rows = [*near_copies(3, groups=3), (1, None, "a"), (2, "", "a"), (3, "alone in the world", "a"), (None, "w1 w2 w3 w4", "a"), (7, "w1 w2 w3 w5", "a"), (7, "w1 w2 w3 w5", "a")]
    docs = documents(spark, rows).withColumns({"keys": F.lit(1), "own": F.lit("x"), "bucket": F.lit(2)})
    got = jaccard_join.screened(docs, 3, bucket, block).collect()
    sets = [shingles(t) for _, t, _ in rows]
    times = collections.Counter(g for own in sets for g in own)
    want = [(i, len(own), sum(times[g] > 1 for g in own)) for (i, _, _), own in zip(rows, sets, strict=True)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.shared) for r in got))) == sorted(map(str, want))
    assert jaccard_join.screened(documents(spark, []), 3).count() == 0


@pytest.mark.parametrize("n,parts", [(1, 1), (7, 7), (50, 6), (300, 300)])
def test_keys_are_dealt_evenly(spark, n, parts):
    keys = even_keys(n, parts)
    assert len(set(keys.tolist())) == n
    rows = spark.createDataFrame([(int(k),) for k in keys], "k bigint").repartition(parts, "k").select("k", F.spark_partition_id().alias("p")).collect()
    assert {r.k: r.p for r in rows} == dict(zip(keys.tolist(), partition_of(keys, parts).tolist(), strict=True))
    assert max(collections.Counter(r.p for r in rows).values()) == -(-n // parts)


def test_packed_keys_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        assert (jaccard_join.unpacked(jaccard_join.packed(keys)) == keys).all() and len(jaccard_join.packed(keys)) == 6 * n


def test_join_of_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(250_000))  # beyond the bytes that are hashed at once
    rows = [(1, long, "s"), (2, long.replace("w5000 ", "other "), "s"), (3, long[: len(long) // 2], "s")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.joined(documents(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("bucket,block", [(1 << 20, 1 << 20), (50, 300)])
def test_candidates_meet_in_packed_buckets(spark, bucket, block):
    rows = [(i, t) for i, (_, t, _) in enumerate(near_copies(11))]
    sets = {i: jaccard_join.shingle_set(t) for i, t in rows}
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items() if len(x)], "lo bigint, own binary").repartition(3)
    got = {(r.lo, r.least) for r in jaccard_join.candidate_edges(frame, 80, bucket, block).collect()}
    classes, lists = jaccard_join.Classes(80), collections.defaultdict(list)
    for i, x in sets.items():
        for key in jaccard_join.index_keys(x, classes).tolist():
            lists[key].append(i)
    want = {(i, min(held)) for held in lists.values() for i in held if i != min(held)}
    joined = lambda pairs: sorted(map(tuple, components.components(spark.createDataFrame(list(pairs), "a bigint, b bigint"), "a", "b").collect()))
    assert want and joined(got) == joined(want) and len(got) <= 4 * len(want)


def test_sets_are_told_apart_where_ids_repeat(spark):
    a, b, c = ("x%d " % k * 3 + " ".join(f"w{k}{i}" for i in range(30)) for k in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (2, c, "x"), (3, b, "x"), (None, a, "x"), (None, c, "x"), (4, c, "x"), (4, c, "x")]
    got = sorted((r.doc_id or 0, r.component_id, r.n_links) for r in jaccard_join.joined(documents(spark, rows), links=True).collect())
    assert got == sorted([(1, 1, 2), (1, 1, 1), (2, 1, 2), (2, 2, 3), (3, 1, 1), (0, 1, 2), (0, 2, 3), (4, 2, 3), (4, 2, 3)])


def test_messages_of_the_screen_travel_in_few_bits():
    screen = jaccard_join.Screen(3, np.arange(7), 0, 1 << 20, 36)
    for i, (_, text, _) in enumerate([*near_copies(4, words=300), (0, None, "x"), (0, "a", "x")]):
        list(screen.add(i, text))
    (batch,) = screen.flush()
    slim = jaccard_join._slim(batch)
    back = jaccard_join._whole(slim.to_pandas())
    want = batch.to_pandas()
    assert list(back["keys"]) == list(want["keys"]) and list(back["owners"]) == list(want["owners"])
    sent = lambda b: sum(len(x) for n in ("keys", "owners") for x in b.column(b.schema.get_field_index(n)).to_pylist() if x is not None)
    assert sent(slim) < 0.7 * sent(batch)
