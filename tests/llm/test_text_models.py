"""Quality rules, license scans, language models and classifiers against brute-force versions and held-out rows."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.llm import language_id, license_scan, pitman_yor, quality_rules, queries, toxicity
from inkstrata.llm._util import hash_of, raw_text, word_hashes

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One word\nOne word\none word\n\nOne word"), (5, "a b c a b c a b c " * 40), (6, "é#x $$ | <b>\x0bß\x1cz"), (7, "w " * 5000), (7, "w " * 5000), (None, "no id at all")]


def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force(spark):
    rng = random.Random(4)
    rows = ODD + [(100 + i, "".join(rng.choice(["a ", "b ", "cc\n", "d# ", "\n", "ee\t"]) for _ in range(rng.randrange(200)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], DOCS + ", n_words int, _w int")
    got = quality_rules.measured(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute_measures(t))) for i, t in rows)


def test_policies_and_ablation(spark):
    rows = [(i, t) for i, t in ODD] + [(50 + i, f"clean words number {i} here " * 1 + " ".join(f"v{j}" for j in range(60))) for i in range(5)]
    book = quality_rules.ledger(quality_rules.measured(spark.createDataFrame(rows, DOCS)))
    policy = quality_rules.POLICIES["v1"]
    kept = [r.kept for r in quality_rules.apply_policy(book, policy).collect()]
    bits = [r.fail_bits for r in book.collect()]
    assert kept == [b & policy.mask() == 0 for b in bits] and sum(kept) == 5
    for r in quality_rules.ablation(book, policy).collect():
        assert (r.n_docs, r.n_failed, r.n_only, r.n_kept_without) == (len(bits), sum(b & r.bit != 0 for b in bits), sum(b == r.bit for b in bits), sum(b & ~r.bit == 0 for b in bits))
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.measured(none).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(quality_rules.measured(none)), policy).count() == 0


def test_word_hashes():
    for text in ["", " ", "a", "A b\x0bc ", "é x\x1cy\n", "w" * 3000]:
        words = text.encode().lower().split()
        assert [int(x) for x in word_hashes(raw_text(text)).view(np.int64)] == [hash_of(w) for w in words]


def test_license_scan(spark):
    index = license_scan.build_index()
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("publish, ", "").replace("Software", "Program", 2)
    text = f"Intro words here. {changed} Trailing text goes on. Licensed under the Apache License, Version 2.0. End"
    found = license_scan.scan(text, index)
    assert [f["template"] for f in found] == ["MIT", "Apache-2.0-line"] and 90 < found[0]["coverage"] < 100
    assert text[found[1]["start"] : found[1]["end"]] == "Licensed under the Apache License, Version 2.0"
    assert text[found[0]["start"] :].startswith("Permission is hereby")
    rows = ODD + [(20, text), (21, "released UNDER the mit license."), (22, "We released the new album under a different label"), (23, ("filler " * 3000) + "All rights reserved."), (24, text + " " + text)]
    df = spark.createDataFrame(rows, DOCS).withColumn("matches", F.lit(0))
    got = {r.doc_id: [m.template for m in r.matches] for r in license_scan.scanned(df).collect()}
    assert got[20] == ["MIT", "Apache-2.0-line"] and got[21] == ["MIT-short"] and got[22] == [] and got[23] == ["All-rights-reserved"]
    assert got[24] == got[20] * 2 and all(got[i] == [] for i, _ in ODD)


def test_repeated_notices_are_all_found(spark):
    index = license_scan.build_index()
    names = lambda text: [f["template"] for f in license_scan.scan(text, index)]
    assert names("All rights reserved. " * 12) == ["All-rights-reserved"] * 12
    assert names("Released under the MIT License. Released under the MIT License.") == ["MIT-short"] * 2
    assert license_scan.scanned(spark.createDataFrame([], DOCS)).count() == 0
    mit = license_scan.TEMPLATES["MIT"].split()
    parts = license_scan.scan(" ".join([*mit[:60], *(f"foreign{i}" for i in range(30)), *mit[60:]]), index)
    assert [p["template"] for p in parts] == ["MIT", "MIT"] and sum(p["matched_tokens"] for p in parts) >= len(license_scan.token_spans(" ".join(mit))[0]) - 2


def test_templates_come_as_a_table_in_parts_and_short_ones_count(spark):
    rng = random.Random(8)
    made = {f"T{i}": " ".join(rng.choice(["share", "copy", "grant", "use", "sell", "notice"]) + str(rng.randrange(400)) for _ in range(rng.choice([12, 30, 80]))) for i in range(300)}
    rows = [*made.items(), ("GPLv2", "GPLv2"), ("Public", "public domain"), ("none", " -- "), ("null", None), (None, "nameless grant here")]
    table = spark.createDataFrame(rows, "name string, text string")
    texts = [(i, f"intro {made[f'T{7 * i}']} and {made[f'T{7 * i + 1}']} end") for i in range(30)]
    texts += [(100, "under GPLv2, or the Public Domain."), (101, "nameless grant here"), (102, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */"), (103, "SPDX-License-Identifier: LicenseRef-x.y"), (104, "SPDX-License-Identifier:"), (105, None)]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in texts], "doc_id bigint, text string, template string, start int")
    whole = {r.doc_id: [(m.template, m.start, m.end) for m in r.matches] for r in license_scan.scanned(docs, table).collect()}
    parts = list(license_scan.indexes_of(table, most=30_000))
    assert len(parts) > 3 and sum(len(p.names) for p in parts) == len(rows)
    assert {r.doc_id: [(m.template, m.start, m.end) for m in r.matches] for r in license_scan.scanned(docs, table, most=30_000).collect()} == whole
    assert all([t for t, _, _ in whole[i]] == [f"T{7 * i}", f"T{7 * i + 1}"] for i in range(30))
    assert [t for t, _, _ in whole[100]] == ["GPLv2", "Public"] and whole[101][0][0] is None and whole[104] == whole[105] == []
    assert whole[102][0][0] == "SPDX-(MIT OR Apache-2.0) AND BSD-3-Clause" and whole[103][0][0] == "SPDX-LicenseRef-x.y"


def brute_notices(codes, templates):
    """Whole-text alignments of every template, without bands or fingerprints: (start, end, name) in tokens."""
    found = []
    for name, template in templates.items():
        own = list(codes)
        while True:
            n, m = len(own), len(template)
            score = np.zeros((n + 1, m + 1), int)
            state = {}
            best = (0,)
            for j in range(1, m + 1):
                for i in range(1, n + 1):
                    same = own[i - 1] == template[j - 1]
                    options = [(score[i - 1, j - 1] + (2 if same else -1), state[i - 1, j - 1] if score[i - 1, j - 1] > 0 else (0, i - 1), same)]
                    options += [(score[i, j - 1] - 1, state.get((i, j - 1)), 0), (score[i - 1, j] - 1, state.get((i - 1, j)), 0)]
                    top = max(range(3), key=lambda k: (options[k][0], -k))
                    if options[top][0] > 0:
                        score[i, j] = options[top][0]
                        state[i, j] = (options[top][1][0] + options[top][2], options[top][1][1])
                        if score[i, j] > best[0]:
                            best = (score[i, j], state[i, j][0], state[i, j][1], i)
            if not best[0] or 100 * best[1] < (100 if m < license_scan.SHORT else license_scan.MIN_PERCENT) * m and best[1] < license_scan.MIN_TOKENS:
                break
            found.append((best[1], best[1] / m, best[2], best[3], name))
            own[best[2] : best[3]] = [None] * (best[3] - best[2])
    kept = []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        if all(f[3] <= g[2] or g[3] <= f[2] for g in kept):
            kept.append(f)
    return sorted((f[2], f[3], f[4]) for f in kept)


def test_scan_matches_whole_alignments():
    rng = random.Random(21)
    words = [f"v{i}" for i in range(60)]
    templates = {f"t{k}": [f"n{rng.randrange(40)}" for _ in range(n)] for k, n in enumerate((4, 5, 9, 16, 30))}
    index = license_scan.build_index({k: " ".join(t) for k, t in templates.items()})
    for _ in range(25):
        text: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            own = list(rng.choice(list(templates.values())))
            if len(own) >= 9:
                own[rng.randrange(len(own))] = "changed"
                if rng.random() < 0.5:
                    own.insert(rng.randrange(len(own)), "added")
            text += rng.choices(words, k=rng.choice((0, 0, 3, 15))) + own * rng.choice((1, 1, 2, 3))
        line = " ".join(text)
        _, spans = license_scan.token_spans(line)
        starts, ends = {s: i for i, (s, _) in enumerate(spans)}, {e: i + 1 for i, (_, e) in enumerate(spans)}
        got = [(starts[f["start"]], ends[f["end"]], f["template"]) for f in license_scan.scan(line, index)]
        assert got == brute_notices(text, templates), line


def test_every_template_is_found_whole():
    index = license_scan.build_index()
    for name, text in license_scan.TEMPLATES.items():
        best = max(license_scan.scan(f"before it {text} after it", index), key=lambda f: f["matched_tokens"])
        assert best["coverage"] == 100 and (best["template"] == name or len(license_scan.token_spans(license_scan.TEMPLATES[best["template"]])[0]) >= best["matched_tokens"])


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    follow = {w: rng.choices("abcdefghij", k=3) for w in "abcdefghij"}
    rows = []
    for i in range(300):
        w, out = rng.choice("abcdefghij"), []
        for _ in range(rng.randrange(1, 60)):
            out.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"r{rng.randrange(500)}"
            w = w if w in follow else rng.choice([w, *"abc"])
            if w not in follow:
                out.append(w)
                w = rng.choice("abcdefghij")
        rows.append((i, " ".join(out)))
    return [*rows, (1000, None), (1001, ""), (1002, "unseen words only"), (None, "a b c"), (5, rows[5][1])]


def test_language_model(spark, prose):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    learns = "crc32(coalesce(cast(doc_id as string), '')) % 5 <> 1"
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    count = collections.Counter(w for i, t in prose if not held(i) for w in tok(t))
    n, v = sum(count.values()), len(count)
    df = spark.createDataFrame(prose, DOCS).withColumn("score", F.lit(1))
    got = pitman_yor.scored(df, learns, block_chars=2000).collect()
    assert len(got) == len(prose)
    want = sorted((str(i), len(tok(t)), sum(count[w] > 0 for w in tok(t)), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t in prose)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    test = [r for r in got if held(r.doc_id)]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    again = pitman_yor.scored(df.repartition(3), learns, block_chars=2000).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    assert pitman_yor.scored(spark.createDataFrame([], DOCS), learns).count() == 0
    alone = pitman_yor.scored(spark.createDataFrame([(1, "x y")], DOCS), "doc_id < 0").collect()
    assert (alone[0].n_tokens, alone[0].n_known, alone[0].train_tokens) == (3, 0, 0) and math.isfinite(alone[0].score)


def test_language_model_knows_the_contexts_of_rare_words(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"p{k} q{k}" for k in rng.choices(range(60), k=20))) for i in range(80)]
    tests = [(-1 - k, f"p{k} q{j}") for k in range(20) for j in (k, (k + 7) % 60)]
    got = collections.defaultdict(list)
    for r in pitman_yor.scored(spark.createDataFrame(rows + tests, DOCS), "doc_id >= 0", block_chars=900, bucket_chars=700).collect():
        got[r.doc_id].append(r.score)
    for k in range(20):
        fits, other = sorted(got[-1 - k], reverse=True)
        assert fits > other + 1
    # the same as the sampler on one machine
    words = sorted({w for _, t in rows for w in t.split()} | {""})
    code = {w: i for i, w in enumerate(words)}
    cells = collections.Counter((code[a] if a else len(words), code[b]) for _, t in rows for ws in [t.split()] for a, b in zip(["", *ws], [*ws, ""], strict=True))
    (u, w), n = zip(*cells, strict=True), np.array(list(cells.values()))
    table = np.log10(pitman_yor.Dense(np.array(u), np.array(w), n, len(words) + 1, len(words) + 1).predictive())
    for i, t in rows[:20]:
        ws = [code[x] for x in t.split()]
        assert abs(got[i][0] - sum(table[a, b] for a, b in zip([len(words), *ws], [*ws, code[""]], strict=True))) < 0.02 * abs(got[i][0])


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    context, dish = np.divmod(np.unique(rng.integers(0, 5 * 20, 60)), 20)
    dense = pitman_yor.Dense(context, dish, rng.integers(1, 500, len(context)), 6, 20)
    p = dense.predictive()
    assert np.allclose(p.sum(1), 1) and (p > 0).all()


def test_seating_grows_as_the_process_does():
    customers = np.array([1, 2, 50, 5000])
    runs = np.array([pitman_yor.reseated(customers, np.full(4, 3.0), 0.5, np.random.default_rng(s)) for s in range(200)])
    slow = []
    for s in range(200):
        rng, t = np.random.default_rng(1000 + s), 1
        for i in range(1, 50):
            t += rng.random() < 3.0 / (3.0 + i - 0.5 * t)
        slow.append(t)
    assert (runs[:, 0] == 1).all() and abs(runs[:, 2].mean() - np.mean(slow)) < 1 and (runs <= customers).all()


LANGS = {"en": ["the", "and", "with", "house", "water"], "de": ["und", "der", "straße", "wasser", "haus"], "fr": ["le", "été", "avec", "maison", "eau"]}


def test_language_identification(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(LANGS[g], k=rng.randrange(3, 40))), g) for i in range(240) for g in [rng.choice(list(LANGS))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 ### !", "fr"), (903, "the and", None), (904, "зима и лето и снова зима", None), (905, "the house " * 20000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash")).withColumn("rejected", F.lit(1))
    model = language_id.fit(df.where("doc_id % 4 <> 2"), per_lang=40)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, g in rows[:240])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[905].lang_pred == "en" and got[904].rejected
    nothing = language_id.fit(df.where("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.where("doc_id < 0"), model).count() == 0


def test_language_vectors_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(LANGS[g], k=rng.randrange(3, 20))), g) for i in range(60) for g in [rng.choice(list(LANGS))]] + [(None, "der haus wasser", "de")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df, per_lang=1000, clusters=1)
    assert model.langs == sorted(LANGS)

    def grams(text):
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return collections.Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))

    own = [grams(t) for _, t, _ in rows]
    df_of = collections.Counter(g for c in own for g in c)
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df_of.items()}

    def vector(c):
        v = {g: math.log1p(n) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    centres = {}
    for lang in LANGS:
        total = collections.Counter()
        for c, (_, _, g) in zip(own, rows, strict=True):
            if g == lang:
                total.update(vector(c))
        norm = math.sqrt(sum(x * x for x in total.values()))
        centres[lang] = {g: x / norm for g, x in total.items()}
    for c, (_, text, _) in zip(own, rows, strict=True):
        cosine = {lang: sum(x * centre.get(g, 0) for g, x in vector(c).items()) for lang, centre in centres.items()}
        lang, score, rejected = model.predict(text)
        best = max(cosine, key=cosine.get)
        assert lang == best and abs(score - cosine[best]) < 0.02 and not rejected  # hashed places may clash


def test_chain_matches_forward_backward_and_enumeration():
    rng = np.random.default_rng(2)
    unary, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    valid = np.arange(5) < np.array([[5], [3], [1]])
    marginal, z, _ = toxicity.forward_backward(unary, valid, trans)
    for row in range(3):
        n = int(valid[row].sum())
        total, hot = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(unary[row, i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            hot += w * np.array(tags)
        assert np.allclose(marginal[row, :n], hot / total) and np.isclose(z[row], math.log(total))
    assert np.allclose(toxicity.chain(unary, valid, trans)[valid], marginal[valid])


def test_whole_chains_have_no_borders():
    rng = np.random.default_rng(5)
    trans = np.array([[2.0, -1.5], [-1.0, 2.5]])
    texts = [rng.normal(size=n) for n in (0, 1, 63, 64, 65, 200, 0, 700, 128)]
    for own, got in zip(texts, toxicity.whole_chains(texts, trans), strict=True):
        assert len(own) == len(got)
        if len(own):
            want, _, _ = toxicity.forward_backward(own[None, :], np.ones((1, len(own)), bool), trans)
            assert np.allclose(got, want[0])
    assert [len(x) for x in toxicity.whole_chains([np.zeros(0)] * 2, trans)] == [0, 0] and toxicity.whole_chains([], trans) == []


def test_features_of_long_texts_and_neighbours():
    words = [f"w{i}" for i in range(7)]
    text = " ".join(words * 60_000)  # beyond the bytes that are hashed at once
    places = toxicity.features(text)
    assert len(places) == 420_000 and (places[:7] == places[-7:]).all()
    x = toxicity.beside(places[:3])
    assert x[0, 0] == x[2, 1] == toxicity.DIMS and x[1, 0] == places[0, 0] and x[1, 1] == places[2, 1] and (x[:, 2:] == places[:3, 2:]).all()


def test_toxicity(spark):
    rng = random.Random(6)
    plain, bad = [f"wort{i}" for i in range(300)], ["scumbag", "loserish", "idiotic"]
    rows, labels = [], []
    for i in range(400):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(10, 150))
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ".", "!!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, *[(1000 + (i or 0), t) for i, t in ODD]], DOCS).withColumn("spans", F.lit(0))
    marks = spark.createDataFrame([*labels, (5000, 1), (None, 0), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 4 <> 2 or doc_id is null"))
    truth = dict(labels)
    got = {r.doc_id: r for r in toxicity.measured(docs, model).collect() if r.doc_id < 1000}
    test = [i for i in truth if i % 4 == 2]
    assert np.mean([(got[i].score >= 0.3) == bool(truth[i]) for i in test]) > 0.95
    hot = [rows[i][1][s.start : s.end].strip(".!") for i in test if truth[i] for s in got[i].spans]
    assert hot and np.mean([w in bad for w in hot]) > 0.95
    assert all(r.score < 0.3 for r in toxicity.measured(docs.where("doc_id in (1001, 1002, 1003)"), model).collect())
    none = toxicity.fit(docs, marks.where("toxic = 0"))
    assert {round(r.score, 6) for r in toxicity.measured(docs, none).collect()} == {0.0}
    nothing = toxicity.fit(docs.where("doc_id < 0"), marks.where("doc_id < 0"))
    assert toxicity.measured(docs.where("doc_id < 0"), model).count() == 0 and toxicity.measured(docs, nothing).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    lang = queries.op9_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in lang]) > 0.98
    toxic = queries.op10_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in toxic]) > 0.9
