"""Tables put together in chunks, inline Markdown within a row, and numbers by ranges."""

import random

from pyspark.sql import functions as F

from inkstrata.operators import sequences, spans
from inkstrata.plans import edit_queries, extract
from inkstrata.sources.blocks import BLOCK_DDL, SPAN


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _blocks(spark, rows):
    """Block rows of (path, block_id, table_id, row, col, kind, text or list of spans, ref, col_span)."""
    marked = [(*r[:6], [{"text": r[6]}] if isinstance(r[6], str) else r[6], *r[7:]) for r in rows]
    ddl = f"path string, block_id int, table_id int, row int, col int, kind string, spans array<{SPAN}>, ref string, col_span int"
    df = spark.createDataFrame([(*r[:6], None if r[6] is None else [tuple(s.get(f.split(":")[0]) for f in SPAN[7:-1].split(",")) for s in r[6]], *r[7:]) for r in marked], ddl)
    return spark.createDataFrame([], BLOCK_DDL).unionByName(df.withColumn("row_span", F.when(F.col("kind") == "cell", 1)), allowMissingColumns=True)


def _random_tables(rng):
    """Block rows of tables with empty cells, cells of several blocks, gaps in rows and columns, and what each must become."""
    rows, want = [], {}
    for table in range(40):
        simple, lines, number = rng.random() < 0.6, [], 1
        width = rng.randint(1, 4)
        for r in sorted(rng.sample(range(30), rng.randint(1, 12))):
            line = []
            for c in sorted(rng.sample(range(9), width)):
                rows.append((f"d{table}", number, 0, r, c, "cell", None, None, 1 if simple else 2))
                held = []
                for _ in range(rng.choice((0, 1, 1, 1, 3))):
                    number += 1
                    text = rng.choice(("", "a|b", "x\ny", "plain"))
                    picture = not simple and rng.random() < 0.3
                    rows.append((f"d{table}", number, 0, r, c, "image" if picture else "paragraph", None if picture else text, "p1" if picture else None, None))
                    held.append("[image p1]" if picture else text.replace("\n", " ").replace("|", "\\|") if simple else text.replace("\n", " "))
                number += 1
                line.append(" ".join(h for h in held if h))
            lines.append("| " + " | ".join(line) + " |" if simple else " | ".join(line))
        if simple:
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
        else:
            lines = ["<raw>", "[table — merged cells or block content; structure not mapped, cells below are literal]", *lines, "</raw>"]
        want[f"d{table}"] = "\n".join(lines)
    rng.shuffle(rows)
    return rows, want


def test_chunks_of_tables_are_the_tables(spark, monkeypatch):
    """a table is put together by rows of chunks, whatever their size; before, one task had all its lines."""
    rows, want = _random_tables(random.Random(5))
    blocks = _blocks(spark, rows)
    for together in (1, 7, 8192):
        monkeypatch.setattr(extract, "TOGETHER", together)
        grids = extract.grids_of(blocks)
        assert {r.path: r.markdown for r in extract.table_markdown(blocks, grids).collect()} == want
        most = extract.table_chunks(blocks, grids).groupBy("path").count().agg(F.max("count")).first()[0]
        assert most == 1 if together == 8192 else most > 2


def test_giant_tables_come_back_at_their_places_only(spark, monkeypatch):
    """chunks of a giant table are joined within their document; a giant within a cell shows nowhere, as it does in one job."""
    monkeypatch.setattr(extract, "TOGETHER", 50)
    rows = [("d", 0, None, None, None, "paragraph", "before", None, None), ("d", 1, None, None, None, "table", None, None, None), ("d", 9000, None, None, None, "paragraph", "after", None, None)]
    for r in range(130):
        for c in range(4):
            n = 2 + 8 * r + 2 * c
            rows += [("d", n, 1, r, c, "cell", None, None, 1), ("d", n + 1, 1, r, c, "paragraph", f"{r}.{c}", None, None)]
    rows += [("e", 0, None, None, None, "table", None, None, None), ("e", 1, 0, 0, 0, "cell", None, None, 1), ("e", 2, 0, 0, 0, "table", None, None, None)]
    for r in range(130):
        for c in range(4):
            rows.append(("e", 3 + 4 * r + c, 2, r, c, "cell", None, None, 1))
    blocks = _blocks(spark, rows)
    whole = {r.path: r.markdown for r in extract.markdown_of(blocks).collect()}
    work = extract.Deferred(blocks)
    first, second = {r.path: (r.n_deferred, r.markdown) for r in work.markdown().collect()}, {r.path: r.markdown for r in work.finished().collect()}
    assert first["d"] == (1, "before\n\n[table]\n\nafter") and first["e"] == (0, whole["e"])
    assert second == whole and whole["d"].startswith("before\n\n| 0.0 | 0.1 |") and whole["d"].endswith("| 129.2 | 129.3 |\n\nafter")


def test_inline_of_a_row_equals_merging_by_rows(spark):
    rng = random.Random(6)
    pick = lambda *xs: rng.choice(xs)
    blocks = [(i, [(pick("a", "b|c", "`", "", None, "x\ny"), *[pick(None, False, False, True) for _ in range(4)], pick(None, None, "u", "v")) for _ in range(rng.randrange(7))]) for i in range(400)]
    df = spark.createDataFrame(blocks, "i int, spans array<struct<text:string,bold:boolean,italic:boolean,strikethrough:boolean,code:boolean,link:string>>")
    rows = df.select("i", F.posexplode("spans").alias("o", "s")).select("i", "o", F.col("s.text").alias("text"), *[F.coalesce(f"s.{c}", F.lit(False)).alias(c) for c in ("bold", "italic", "strikethrough", "code")], "s.link")
    for in_cell in (False, True):
        want = {r.i: r.inline for r in spans.block_inline(rows, ["i"], "o", in_cell).collect()}
        got = {r.i: r.inline for r in df.select("i", spans.inline_of(F.col("spans"), in_cell).alias("inline")).collect()}
        assert got == {i: want.get(i) or "" for i, _ in blocks}
    assert spark.range(1).select(spans.inline_of(F.lit(None).cast(df.schema["spans"].dataType))).first()[0] == ""


def test_numbers_within_parts_need_no_window_by_part(spark, tmp_path):
    """orders are numbered by ranges; before, a window by document held most of them in one task."""
    rows = [(p, k) for p, n in (("a", 500), ("b", 3), (None, 40)) for k in range(n)]
    random.Random(7).shuffle(rows)
    got = sequences.numbered_within(spark.createDataFrame(rows, "p string, k int"), ["p"], ["k"], "n")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((p, k, k + 1)) for p, k in rows)
    assert sequences.numbered_within(spark.createDataFrame([], "p string, k int"), ["p"], ["k"]).collect() == []
    assert "Window" not in _plan(got)
    orders = spark.createDataFrame([(k, k % 7, "FOP"[k % 3]) for k in range(300)], "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    blocks = edit_queries._order_tables(spark, str(tmp_path))
    assert "Window" not in _plan(blocks) and blocks.where("kind = 'cell'").count() == 1200
