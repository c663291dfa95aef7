"""Saved texts, the artifact cache and the page index."""

from pyspark.sql import functions as F

from inkstrata.plans import sinks


def test_saved_texts(spark):
    df = spark.createDataFrame([("a", "héllo", "utf-8", True), ("b", "한국", "cp949", False), ("c", "한국", "latin-1", False)], "path string, text string, encoding string, has_bom boolean")
    got = {r.path: (bytes(r.content) if r.content is not None else None, r.saved) for r in sinks.saved_texts(df).collect()}
    assert got == {"a": (b"\xef\xbb\xbfh\xc3\xa9llo", True), "b": ("한국".encode("cp949"), True), "c": (None, False)}


def test_artifacts_are_rendered_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "source string")
    render = F.encode(F.when(F.col("source") == "y", F.lit("tiny")).otherwise(F.repeat(F.col("source"), F.lit(600))), "UTF-8")
    assert sinks.add_artifacts(df, render, "v1", cache).count() == 1
    before = sinks.cached(spark, cache).count()
    more = spark.createDataFrame([("x",), ("z",)], "source string")
    sinks.add_artifacts(more, render, "v1", cache)
    assert (before, sinks.cached(spark, cache).count()) == (1, 2)


def test_page_index_and_giants(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (1, 90.0), (1, 130.0), (2, 250.0)], "d int, top double")
    sinks.page_index(rows, ["d"], "top", 0.0, 100.0, str(tmp_path / "pages"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "pages")).collect()) == [(1, 0, 0.0, 2), (1, 1, 130.0, 1), (2, 2, 250.0, 1)]
    cells = spark.createDataFrame([(1, r, 10) for r in range(50)] + [(2, 0, 10)], "t int, row int, col_span int")
    small, giant = sinks.split_giants(cells, ["t"])
    assert (small.count(), giant.count()) == (1, 50)
