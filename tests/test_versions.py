"""Block tables that edits bring up to date: incremental equals full, and only changed documents are read."""

import random

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import versions

PIECES = ["text [a] and [b][a]", "# Head", "- item\n- more [b]", "[a]: http://x", "[b]: u", "```\ncode\n\n[a]: no\n```", "~~~", "", "*bold* `x`", "[a]: second", "plain\nlines 😀"]


def document(rng):
    return "".join(rng.choice(PIECES) + rng.choice(["\n\n", "\n", "\n\n\n"]) for _ in range(rng.randrange(12)))


def rows(df):
    return sorted((r.doc, r.start, r.length, r.kind, r.text, tuple(r.links)) for r in df.collect())


def test_random_edits_equal_a_full_render(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: document(rng) for i in range(60)}
    table = versions.BlockTable(spark, str(tmp_path / "t"), buckets=8)
    table.create(spark.createDataFrame(list(texts.items()), "doc bigint, text string"))
    full = lambda: rows(versions.from_texts(spark.createDataFrame(list(texts.items()), "doc bigint, text string")))
    assert rows(table.read("blocks")) == full()
    for _ in range(4):
        edits = []
        for doc in rng.sample(sorted(texts), 40):
            at = rng.randint(0, len(texts[doc]))
            removed = rng.randint(0, min(6, len(texts[doc]) - at))
            edits.append((doc, at, removed, rng.choice(["", "x", "\n", "\n\n", " [a] ", "[c]: z\n", "```\n", "\n\nnew [b]\n\n"])))
        table.apply(spark.createDataFrame(edits, "doc bigint, at int, removed int, added string"))
        for doc, at, removed, added in edits:
            texts[doc] = texts[doc][:at] + added + texts[doc][at + removed :]
        assert rows(table.read("blocks")) == full()
        assert {r.doc: r.text for r in table.read("texts").collect()} == texts
        ids = table.read("blocks").groupBy("doc", "block_id").count().where("count > 1")
        assert ids.isEmpty()


def test_blocks_outside_the_fragment_keep_their_ids_and_only_their_bucket_is_read(spark, tmp_path):
    text = "\n\n".join(f"block {i}" for i in range(50))
    table = versions.BlockTable(spark, str(tmp_path / "t"), buckets=16)
    table.create(spark.createDataFrame([(i, text) for i in range(40)], "doc bigint, text string"))
    bucket = {r.doc: r.b for r in spark.range(40).withColumnRenamed("id", "doc").select("doc", table._bucket().alias("b")).collect()}
    table.apply(spark.createDataFrame([(7, text.index("block 25"), 5, "B")], "doc bigint, at int, removed int, added string"))
    after = {r.start: (r.block_id, r.text) for r in table.read("blocks").where("doc = 7").collect()}
    texts = [t for _, (_, t) in sorted(after.items())]
    assert texts == [f"block {i}" if i != 25 else "B 25" for i in range(50)]
    ids = [i for _, (i, _) in sorted(after.items())]
    assert ids[:24] == list(range(24)) and ids[27:] == list(range(27, 50)) and ids[24:27] == [50, 51, 52]
    assert {b: v for b, v in table.manifest().items() if v} == {bucket[7]: 1}
    files = table.read("blocks", [bucket[7]]).inputFiles()
    read = table.read("blocks", [bucket[7]])
    assert {r.doc for r in read.collect()} == {d for d, b in bucket.items() if b == bucket[7]} and files
    with pytest.raises(ValueError, match="several edits"):
        table.apply(spark.createDataFrame([(7, 0, 0, "x"), (7, 1, 0, "y")], "doc bigint, at int, removed int, added string"))


def test_the_path_is_chosen_per_document(spark):
    cases = [("a\n\n[r]: u", 0, 1, "b", False), ("a\n\n[r]: u", 2, 0, "x", True), ("a\n\nb\n\nc\n\n[r]: u", 0, 1, "[s]: t\n", True), ("a\n\nb\n\nc", 3, 0, "```", True), ("[r]: u\n\na\n\nb\n\nc", 15, 0, "!", False)]
    texts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc bigint, text string")
    edits = spark.createDataFrame([(i, *c[1:4]) for i, c in enumerate(cases)], "doc bigint, at int, removed int, added string")
    changed = versions.edited_texts(texts, edits)
    assert [r.full for r in changed.orderBy("doc").collect()] == [c[4] for c in cases]
    got = rows(versions.updated(versions.from_texts(texts), changed))
    assert got == rows(versions.from_texts(changed.select("doc", "text"))) and changed.where(F.col("full")).count() == 3


def test_streamed_edits_apply_in_order_and_once(spark, tmp_path):
    from inkstrata.streaming import edits as streaming

    texts = {1: "one [a]\n\n[a]: x", 2: "two", 3: "three"}
    table = versions.BlockTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(spark.createDataFrame(list(texts.items()), "doc bigint, text string"))
    folder = tmp_path / "edits"
    folder.mkdir()
    ddl = "doc bigint, at int, removed int, added string, seq int"
    stream = spark.readStream.schema(ddl).parquet(str(folder))
    for batch in ([(1, 0, 3, "first", 1), (1, 5, 0, "!", 2), (2, 3, 0, "\n\nmore", 1)], [(1, 0, 1, "F", 3), (9, 0, 0, "nobody", 1)], []):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(str(folder))
        streaming.apply_stream(stream, table, str(tmp_path / "c"), once=True).awaitTermination(120)
        for doc, at, removed, added, _ in batch:
            if doc in texts:
                texts[doc] = texts[doc][:at] + added + texts[doc][at + removed :]
    assert {r.doc: r.text for r in table.read("texts").collect()} == texts
    want = rows(versions.from_texts(spark.createDataFrame(list(texts.items()), "doc bigint, text string")))
    assert rows(table.read("blocks")) == want
    last = table.versions()[-1]
    table.apply(spark.createDataFrame([(1, 0, 0, "again")], "doc bigint, at int, removed int, added string"), last)  # ran already
    gone = table.vacuum()
    assert gone and table.versions() == [last] and rows(table.read("blocks")) == want


def test_blocks_meet_their_edits_once(spark):
    """one join brings edited documents up to date, tells their path and keeps the others; before, the rows were joined and rendered apart and put together again."""
    rng = random.Random(9)
    texts = {i: document(rng) for i in range(80)}
    edits = [(i, (at := rng.randint(0, len(texts[i]))), rng.randint(0, min(3, len(texts[i]) - at)), rng.choice(["x", "\n\n", "[c]: z\n", "\n\nnew [b]\n\n"])) for i in range(0, 80, 2)]
    before = spark.createDataFrame(list(texts.items()), "doc bigint, text string")
    changed = versions.edited_texts(before, spark.createDataFrame(edits, "doc bigint, at int, removed int, added string"))
    got = versions.refreshed(versions.from_texts(before), changed)
    full = {r.doc: r.full for r in changed.collect()}
    assert {(r.doc, r.full) for r in got.collect()} <= {(i, full.get(i)) for i in texts} and set(full.values()) == {True, False}
    for doc, at, removed, added in edits:
        texts[doc] = texts[doc][:at] + added + texts[doc][at + removed :]
    want = rows(versions.from_texts(spark.createDataFrame(list(texts.items()), "doc bigint, text string")))
    assert rows(got.drop("full")) == want
    assert rows(versions.updated(versions.from_texts(before), changed)) == [r for r in want if r[0] % 2 == 0]


def test_lines_become_documents_by_one_shuffle(spark, tmp_path):
    """lines are ordered within their document's list; before, a window numbered them and a second shuffle collected them."""
    from inkstrata.plans import edit_queries

    lines = [(k, n, float(n % 3), 1.0) for k in (1, 2, 3) for n in (3, 1, 2, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = edit_queries._line_documents(spark, str(tmp_path))
    body = "b1 [r]\n\nb2 [r]\n\nb2 [r]\n\nb0 [r]"
    assert {r.doc: r.text for r in df.collect()} == {1: body, 2: f"{body}\n\n[r]: u2", 3: body}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_runs_need_no_spans():
    """what spans say, without a record per span."""
    from inkstrata.sources import markdown

    text, links = "a **b [r]** `c` [x][r] [none] \\* <http://z> ![p](q.png) _i_ ~~s~~  \nend", {"r": "u"}
    pictures, own = [], []
    spans, runs = markdown.inline(text, links, pictures, bold=False), markdown.runs(text, links, own, {"bold": False})
    assert [(s["text"], s["link"], s["bold"], s["italic"], s["strikethrough"], s["code"]) for s in spans] == [(t, *(m.get(k) for k in ("link", "bold", "italic", "strikethrough", "code"))) for t, m in runs]
    assert pictures == own == ["q.png"] and "".join(t for t, _ in runs) == "a b r c x [none] * http://z  i s\nend"
