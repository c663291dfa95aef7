"""Overlapping layers, guarded links and total orders on small inputs with the answers written out."""

import random

from pyspark.sql import functions as F

from inkstrata.operators import layout, links, sequences


def test_layers_become_disjoint_intervals(spark):
    rows = [(1, 1, 0, 10, "size", "9"), (1, 2, 2, 6, "size", "12"), (1, 2, 4, 8, "size", "14"), (1, 3, 3, 5, "comment", "2"), (1, 3, 4, 9, "comment", "1"), (1, 3, 4, 9, "comment", "1"), (1, 9, 7, 7, "size", "x"), (1, 9, 0, 3, "bold", None), (2, 1, 0, 1, "bold", "true")]
    got = sorted(map(tuple, layout.overlaid(spark.createDataFrame(rows, "doc bigint, layer int, start int, end int, key string, value string"), "doc").collect()))
    comments = [(1, 3, 4, "comment", "2"), (1, 4, 5, "comment", "1,2"), (1, 5, 6, "comment", "1"), (1, 6, 8, "comment", "1"), (1, 8, 9, "comment", "1")]
    sizes = [(1, a, b, "size", v) for a, b, v in ((0, 2, "9"), (2, 3, "12"), (3, 4, "12"), (4, 5, "14"), (5, 6, "14"), (6, 8, "14"), (8, 9, "9"), (9, 10, "9"))]
    assert got == sorted([*comments, *sizes, (2, 0, 1, "bold", "true")])


def test_links_in_code_and_links_are_none(spark):
    texts = [
        (1, "see http://a/b. and /x/y, ok"), (2, "`http://a` ``/x ` /y`` /z"), (3, "[t http://a /b](u) http://c/~/d ./e"), (4, "```\nhttp://a\n /b\n````\n/c"), (5, "    x ~~~\n~~~\n/a\n"),
        (6, "and/or //x a/b ../up/it!"), (7, None), (8, ""), (9, "[a `b](/c) ` /d` http://e"),
    ]
    got = {}
    for r in links.autolinks(spark.createDataFrame(texts, "doc bigint, text string")).collect():
        got.setdefault(r.doc, []).append((r.kind, r.start, r.target))
        assert texts[r.doc - 1][1][r.start : r.end] == r.target
    assert {d: sorted(x) for d, x in got.items()} == {
        1: [("path", 20, "/x/y"), ("url", 4, "http://a/b")], 2: [("path", 23, "/z")], 3: [("path", 32, "./e"), ("url", 19, "http://c/~/d")], 4: [("path", 22, "/c")],
        6: [("path", 7, "//x"), ("path", 15, "../up/it")], 9: [("path", 13, "/d"), ("url", 17, "http://e")],
    }


def test_an_open_outer_guard_counts_behind_an_inner_one(spark):
    guards = spark.createDataFrame([(1, 0, 20), (1, 3, 5), (2, 0, 4)], "doc bigint, start bigint, end bigint")
    rows = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (1, 20, "c"), (2, 4, "d"), (2, 3, "e"), (3, 0, "f")], "doc bigint, start bigint, t string")
    assert sorted(r.t for r in links.outside(rows, guards, "doc").collect()) == ["c", "d", "f"]


def test_rows_are_numbered_through_all_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    got = sequences.numbered(df, ["k", F.desc("i")], "place").collect()
    assert {(r.k, r.i): r.place for r in got} == {row: n + 1 for n, row in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])))}
    assert sequences.numbered(df.where("i < 0"), ["k"]).collect() == []


def test_groups_of_a_union_of_windows_stay_whole(spark):
    from pyspark.sql import Window

    from inkstrata.operators import grouped

    numbered = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    rows = spark.range(60_000).select((F.col("id") % 5_000).alias("doc"), F.col("id").alias("n"))
    wide = rows.withColumn("pad", F.repeat(F.col("n").cast("string"), 200)).withColumn("n", numbered).select("doc", "n", F.length("pad").alias("size"))
    slim = rows.withColumn("n", numbered).where("n <= 2").select("doc", (F.col("n") + 100).alias("n"), F.lit(0).alias("size"))
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60k"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        out = grouped.stream_groups(wide.unionByName(slim).select("doc", "n", "size"), ["doc"], ["n"], lambda g: iter([(g[0][0], len(g))]), "doc bigint, n int")
        got = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plan = grouped.dealt(wide.unionByName(slim), ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(doc" in plan and plan.index("xxhash64(doc") < plan.index("Union")
    assert len(got) == 5_000 and {r.n for r in got} == {14}


def test_places_of_spans_are_found_once_for_all_layers(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["attributed_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(_len" not in plan  # the layers read a written table


def test_layers_laid_in_columns_equal_a_sweep_of_every_document():
    import random

    import pyarrow as pa

    rng = random.Random(7)
    rows = [(rng.choice((None, -4, 2, 1 << 40)), rng.randrange(3), a := rng.randrange(40), a + rng.randrange(1, 12), rng.choice(("bookmark", "size", None)), rng.choice(("é", "z", "10", "9", None)), rng.choice((None, "true")), rng.choice((None, [], ["b", None], ["é", "a"]))) for _ in range(400)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = set()
    for doc in {r[0] for r in rows}:
        every = [(lay, a, b, k, v) for d, lay, a, b, key, value, code, marks in rows if d == doc for k, v in [(key, value), ("code", code), *(("bookmark", m) for m in marks or [])] if k is not None and v is not None]
        cuts = sorted({x for r in every for x in r[1:3]})
        for at, until in zip(cuts, cuts[1:], strict=False):
            for key in {r[3] for r in every}:
                over = [(lay, a, v) for lay, a, b, k, v in every if k == key and a <= at and b >= until]
                if over:
                    want.add((doc, at, until, key, ",".join(sorted({x[2] for x in over})) if key in layout.ADDED else max(over)[2]))
    names = ["doc", "layer", "start", "end", "key", "value", "code", "bookmark"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    table = pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})
    for laid in (1 << 22, 50, 1):
        got = [tuple(r.values()) for r in layout._laid(table, "doc", ["code", "bookmark"], laid).to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want
    assert layout._laid(table.slice(0, 0), "doc", ["code", "bookmark"], 1).num_rows == 0


def test_a_span_is_one_row_of_its_layers(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["attributed_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(attributes" not in plan and "row_number()" not in plan  # neither a row per attribute nor the lines numbered again
