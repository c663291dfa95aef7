"""The stages of the corpus pipeline, each on what the one before it kept."""

import collections
import os
import pathlib
import random

import pytest

import corpus_pipeline
from inkstrata.llm import _util, jaccard_join
from inkstrata.llm._util import stored

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = stored(stage(spark, docs, DATA), name)
    ids = {n: collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    columns = seen["start"].columns
    assert all(seen[n].columns == columns for n in ("toxicity", "language_id", "near_duplicates", "mixing"))
    assert set(ids["start"]) > set(ids["toxicity"]) >= set(ids["language_id"]) > set(ids["near_duplicates"]) >= set(ids["mixing"])
    assert len(ids["language_id"]) > 0.8 * len(ids["start"])
    groups = jaccard_join.joined(seen["language_id"], width=5, percent=80).collect()
    assert set(ids["near_duplicates"]) == {r.component_id for r in groups}
    words = lambda d: sum(len(r.text.split()) for r in d.select("text").collect())
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["near_duplicates"])) <= 2 * 20
    packed = seen["packing"].collect()
    per_row = collections.Counter()
    for r in packed:
        per_row[r.doc_id] += r.length
    assert set(per_row) == set(ids["mixing"]) and corpus_pipeline.run(spark, DATA).count() == len(packed)


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    rng, rows = random.Random(8), []
    for g in range(12):
        base = rng.choices([f"w{i}" for i in range(400)], k=240)
        for c in range(6):
            text = list(base)
            for at in rng.sample(range(240), rng.randrange(0, 9)):
                text[at] = f"x{rng.randrange(400)}"
            rows.append((100 * g + c, " ".join(text), "en", "s", 1))
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def linked(width, percent):
        own = {r[0]: {tuple(w[i : i + width]) for w in [r[1].split()] for i in range(len(w) - width + 1)} for r in rows}
        return {(a, b) for a in own for b in own if a < b and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])}

    assert linked(5, 80) - linked(3, 90)
    for a, b in linked(5, 80):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted({root(r[0]) for r in rows})


OWN = ["score", "n_tokens", "largest", "spans", "rejected", "lang_pred", "size", "key", "copy", "taken", "target", "source_size", "whole", "edge_key", "p_source", "d_id", "a_id", "_hi", "component_id", "a.b", "Matches"]


def test_stages_leave_own_columns_alone(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, "no id at all but some words", "en", "s", 5), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "twice the same row", "en", "s", 1), (9003, "twice the same row", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in OWN})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert [r[c] for c in OWN] == [f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in OWN], name
    none = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_a_stage_leaves_only_the_table_that_the_next_reads(spark):
    where = pathlib.Path(_util.shared_folder(spark).removeprefix("file:"))
    before = set(where.iterdir())
    corpus_pipeline.run(spark, DATA)
    assert sorted(x.name.rsplit("-", 1)[0] for x in set(where.iterdir()) - before if x.name.startswith("pipeline-")) == ["pipeline-mixing"]


def test_texts_are_not_shuffled_by_the_ids_that_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard_join.deduplicated(docs, width=5, percent=80)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan
