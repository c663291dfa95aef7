"""Plans whose tasks don't grow with the tables: their partitions follow from the rows."""

import math

from inkstrata.operators import grouped, office, pages, sequences, tables
from inkstrata.plans import sinks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paged_view_deals_documents_once_by_their_rows(spark, monkeypatch):
    """partitions follow from the rows, not from the session's setting, and no later join or sum shuffles pages by the session's."""
    monkeypatch.setattr(grouped, "PART_ROWS", 4)
    rows = spark.createDataFrame([(d, o, float(20 * d + o)) for d in (1, 2, 3, 9) for o in range(60)], "d long, o long, h double")
    docs = spark.createDataFrame([(d, 5.0 if d > 1 else None, 10.0, None, 12.0, 8.0, d == 2, True) for d in (1, 2, 3, 4)], "d long, top_margin double, bottom_margin double, head_distance double, head_height double, foot_height double, printing boolean, draws boolean")
    entries = spark.createDataFrame([(1, "first", [("a", None)]), (1, "default", [(None, "page")]), (2, "even", [(None, "numpages")])], "d long, applies string, pieces array<struct<text:string,field:string>>")
    got = pages.paged_view(rows, docs, entries, "d", "o", "h", 50.0)
    placed = sequences.settled(rows, "d", "o", "h", 50.0).join(rows, ["d", "o"]).where("d < 4").collect()
    want, last = {}, {}
    for r in placed:
        first, n = want.get((r.d, r.page), (r.o, 0))
        want[r.d, r.page] = min(first, r.o), n + 1
        last[r.d] = max(last.get(r.d, 0), r.page + 1, math.ceil((r.top + r.h) / 50.0))
    out = {(r.d, r.page): (r.first_row, r.n_rows, r.head) for r in got.collect()}
    head = lambda d, p: "a" if (d, p) == (1, 0) else str(p + 1) if d == 1 else str(last[d]) if d == 2 and p % 2 else None
    assert out == {(d, p): (*want.get((d, p), (None, 0)), head(d, p)) for d, n in last.items() for p in range(n)}
    assert ", 60), REPARTITION_BY_NUM" in _plan(got) and "ENSURE_REQUIREMENTS" not in _plan(got)


def test_giant_tables_are_dealt_by_their_rows(spark, monkeypatch):
    """F8: rows of tables are summed in partitions that follow from the cells, and cells meet the giants without being sorted."""
    monkeypatch.setattr(grouped, "PART_ROWS", 10)
    cells = spark.createDataFrame([(t, r, 10) for t, n in ((1, 60), (2, 20)) for r in range(n)], "t int, row int, col_span int")
    now, later = sinks.split_giants(cells, ["t"])
    assert (now.count(), later.count()) == (20, 60)
    assert ", 8), REPARTITION_BY_NUM" in _plan(tables.giant_tables(cells, ["t"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(now) and "SortMergeJoin" not in _plan(later)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cell_styles_deal_a_document_once(spark, monkeypatch):
    """one shuffle, by documents, in partitions that follow from the rows."""
    monkeypatch.setattr(grouped, "PART_ROWS", 2)
    rows = []
    for path in ("a", "b", "c"):
        rows += [(path, "style", f"table-cell/{n}", None, None, None) for n in ("O", "D")] + [(path, "style", "text/R", None, None, None)]
        rows += [(path, "column", "0/0", "0", "D", "C0"), (path, "column", "0/2", "0", "unknown", "C2")]
        rows += [(path, "cell", "0/0/0", "R", "O", "1"), (path, "cell", "0/0/1", None, "gone", "1"), (path, "cell", "0/1/2", "O", None, "3"), (path, "cell", "1/0/0", None, None, "1")]
    declared = spark.createDataFrame([(p, s, i, up, st, v) for p, s, i, up, st, v in rows], "path string, scope string, id string, parent string, style string, value string")
    got = office.cell_styles(declared)
    assert _plan(got).count("Exchange") == 1 and ", 14), REPARTITION_BY_NUM" in _plan(got)
    want = [(p, *x) for p in "abc" for x in ((0, 0, 0, 1, "O", "C0"), (0, 0, 1, 1, "D", "C0"), (0, 1, 2, 3, "O", "C2"), (1, 0, 0, 1, None, None))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
