"""File streams and debounced events."""

import functools
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkstrata.streaming import files


def test_extract_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / "b.md").write_text("# two")
    (source / "c.bin").write_bytes(b"x")
    query = files.extract_stream(files.arriving(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    query.awaitTermination(60)
    got = {r.path.rsplit("/", 1)[1]: (r.output, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.txt": ("one", 0), "b.md": ("# two", 0), "c.bin": (None, 1)}


def test_debounce(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s)) for s in (0, 1, 2, 10, 11)] + [("b", t0), ("z", t0 + timedelta(hours=1))]
    spark.createDataFrame(rows, "path string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("path string, at timestamp").parquet(str(tmp_path / "events"))
    query = files.debounced(stream, "path", "at", quiet="3 seconds", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    got = sorted((r.path, r.n_events) for r in spark.table("bursts").where(F.col("path") != "z").collect())
    assert got == [("a", 2), ("a", 3), ("b", 1)]


def test_a_damaged_version_leaves_the_last_good_one(spark, tmp_path):
    from inkstrata.plans import fixtures
    from inkstrata.streaming import reload

    good = functools.cache(lambda t: fixtures.zipped({"word/document.xml": f"<w:document><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>"}))
    t0 = datetime(2024, 1, 1)
    batches = [
        [("a.docx", 1, good("one")), ("b.docx", 1, b"broken"), ("c.txt", 1, b"text")],
        [("a.docx", 2, b"half written"), ("b.docx", 2, None)],
        [("a.docx", 4, good("three")), ("a.docx", 3, b"junk"), ("b.docx", 3, good("at last"))],
        [("a.docx", 2, b"late"), ("c.txt", 5, b"")],
    ]
    folder, seen = tmp_path / "versions", []
    folder.mkdir()
    stream = spark.readStream.schema("path string, at timestamp, content binary").parquet(str(folder))
    for rows in batches:
        df = spark.createDataFrame([(p, t0 + timedelta(hours=h), c) for p, h, c in rows], "path string, at timestamp, content binary")
        df.coalesce(1).write.mode("append").parquet(str(folder))
        query = reload.last_good(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.append({r.path: (r["at"].hour, bytes(r.content) if r.content is not None else None, r.error, r.stale) for r in b.collect()}))
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    seen = [s for s in seen if s]
    assert seen[0] == {"a.docx": (1, good("one"), None, False), "b.docx": (1, None, seen[0]["b.docx"][2], False), "c.txt": (1, b"text", None, False)} and seen[0]["b.docx"][2]
    assert seen[1]["a.docx"][:2] == (2, good("one")) and seen[1]["a.docx"][3] and seen[1]["b.docx"] == (2, None, "missing", False)
    assert seen[2] == {"a.docx": (4, good("three"), None, False), "b.docx": (3, good("at last"), None, False)}
    assert seen[3] == {"a.docx": (4, good("three"), None, False), "c.txt": (5, b"", None, False)}
