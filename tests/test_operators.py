"""Operators on small inputs with the answers written out."""

from pyspark.sql import functions as F

from inkstrata.functions import numbers, scripts, slots, styles, text, units
from inkstrata.operators import layout, sequences, spans, tables


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_inline_markdown(spark):
    rows = [("b", True, None, None, None, None), ("bi", True, True, None, None, None), ("s|", None, None, True, None, None), ("a`b", None, None, None, True, None), ("`x", None, None, None, True, None), ("l\nn", None, None, None, None, "u"), ("", True, None, None, None, None), ("p", None, None, None, None, " ")]
    df = spark.createDataFrame(rows, "t string, b boolean, i boolean, s boolean, c boolean, l string")
    got = [r[0] for r in df.select(text.inline_markdown(F.col("t"), F.col("b"), F.col("i"), F.col("s"), F.col("c"), F.col("l"), in_cell=True)).collect()]
    assert got == ["**b**", "***bi***", "~~s\\|~~", "``a`b``", "`` `x ``", "[l n](u)", "", "p"]


def test_text_functions(spark):
    assert one(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, text.slug(F.lit("A b\tC_d! é́"))) == "a-b-c_d-é́"
    assert one(spark, text.lines(F.lit("a\r\n\nb\n"))) == ["a", "", "b"]
    assert [tuple(p) for p in one(spark, text.pieces(F.lit("One. 3.14!\nx"), text.SENTENCE_STOP))] == [(0, "One. "), (5, "3."), (7, "14!\nx")]
    assert one(spark, text.math_spans(F.lit("$$\na\nb\n$$\nt\n $$x$$ \n$$\nopen"))) == ["a\nb", "x"]
    assert one(spark, text.autolinks(F.lit("see https://a.b/c?d=1, and /usr/lib/x.so."))) == ["https://a.b/c?d=1", "/usr/lib/x.so"]
    hint = lambda *parts: tuple(one(spark, text.image_hint(*map(F.lit, parts))))
    assert hint("alt|300x200") == ("alt", 300.0, None, "") and hint("a|b|50%") == ("a|b", None, 0.5, "") and hint("a|b", "{width=30px} x") == ("a|b", 30.0, None, " x")
    assert tuple(one(spark, text.image_tag(F.lit("<IMG src='u.png' width=40% alt=x>")))) == ("u.png", "x", None, 0.4) and one(spark, text.image_tag(F.lit("<b>"))) is None
    assert one(spark, text.preview_text(F.lit("a\n\n```\ncode\n\nmore"), 12, "…")) == "a…"
    assert one(spark, text.preview_text(F.lit("```\n" + "x" * 50), 20, "…")) == "```\n" + "x" * 16 + "\n```…"


def test_numbers(spark):
    n = F.col("n").cast("int")
    df = spark.createDataFrame([(n, k) for n in (0, 1, 4, 27, 49, 3999) for k in ("upperRoman", "lowerLetter", "ganada", "decimalEnclosedCircle", "odd")], "n int, k string")
    got = {(r.n, r.k): r.x for r in df.select("n", "k", numbers.format_number(n, F.col("k")).alias("x")).collect()}
    assert [got[i, "upperRoman"] for i in (0, 1, 4, 49, 3999)] == ["0", "I", "IV", "XLIX", "MMMCMXCIX"]
    assert (got[27, "lowerLetter"], got[27, "ganada"], got[4, "decimalEnclosedCircle"], got[27, "decimalEnclosedCircle"], got[4, "odd"]) == ("aa", "파파", "④", "27", "4")


def test_units(spark):
    assert one(spark, units.length_points(F.lit("2.54cm"))) == 72.0 and one(spark, units.length_points(F.lit("3em"))) is None
    assert one(spark, units.colour(F.lit("#a1B2c3"))) == "A1B2C3" and one(spark, units.colour(F.lit("auto"))) is None
    assert tuple(one(spark, units.border(F.lit("0.1pt solid #112233")))) == ("drawn", 0.25, "112233")
    assert tuple(one(spark, units.border(F.lit("none")))) == ("suppressed", None, None)
    assert one(spark, units.border(F.lit(None).cast("string"))) is None
    assert one(spark, units.toggle(F.lit(True), F.lit(None).cast("string"))) is True and one(spark, units.toggle(F.lit(True), F.lit("off"))) is False


def test_script_ranges():
    table = scripts.ranges()
    assert table[0][0] == 0 and table[-1][1] == scripts.LAST and all(a[1] + 1 == b[0] and a[2] != b[2] for a, b in zip(table, table[1:], strict=False))
    of = lambda c: next(k for a, b, k in table if a <= ord(c) <= b)
    assert [of(c) for c in "aé가漢かЖ\u03011Ⅰ"] == ["latin", "latin", "hangul", "han", "kana", "other", "extend", "common", "latin"]
    assert [of(c) for c in "\u094d\u0591\u0e31\u0483"] == ["extend"] * 4 and [of(c) for c in "\ue000\u05d0\u0f40\ua000"] == ["other", "complex", "complex", "eastAsianOther"]


def test_counters_restart_below(spark):
    rows = [(1, i, lvl) for i, lvl in enumerate([0, 1, 1, 2, 0, 1, 2, 2, 1])]
    got = sequences.list_counters(spark.createDataFrame(rows, "d int, o int, level int"), ["d"], "o", "level").orderBy("o").collect()
    assert [r.number for r in got] == [1, 1, 2, 1, 2, 1, 1, 2, 2]


def test_as_of_gap_and_default(spark):
    left, right = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 3)], "d int, at int"), spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "d int, at int, v string")
    got = lambda **k: sorted((r.d, r.at, r.v or "") for r in sequences.as_of(left, right, ["d"], "at", "v", **k).collect())
    assert got() == [(1, 0, ""), (1, 5, "x"), (1, 9, "y"), (2, 3, "")]
    assert got(default_first=True) == [(1, 0, "x"), (1, 5, "x"), (1, 9, "y"), (2, 3, "")]


def test_style_chain_guards_cycles(spark):
    styles = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", None)], "style string, parent string")
    props = spark.createDataFrame([("c", "size", "9"), ("b", "size", None), ("a", "bold", "1"), ("d", "size", "3")], "style string, prop string, value string")
    got = sorted(tuple(r) for r in sequences.style_values(styles, props).collect())
    assert got == [("a", "bold", "1"), ("a", "size", "9"), ("b", "size", "9"), ("c", "size", "9"), ("d", "size", "3")]


def test_row_spans_push_later_cells(spark):
    cells = [(1, 0, 0, 1, 2), (1, 0, 1, 1, 1), (1, 1, 0, 2, 1), (1, 2, 0, 0, 1)]
    got = tables.placed_with_row_spans(spark.createDataFrame(cells, "t bigint, row int, col int, col_span int, row_span int"), "t").orderBy("row", "col").collect()
    assert [r.grid_col for r in got] == [0, 1, 1, 0]


def test_pages_settle(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([60.0, 60.0, 150.0, 30.0])], "d bigint, o bigint, h double")
    got = [(r.top, r.page) for r in sequences.settled(rows, "d", "o", "h", 100.0).orderBy("o").collect()]
    assert got == [(0.0, 0), (100.0, 1), (160.0, 1), (310.0, 3)]


def test_definitions_outside_fences(spark):
    lines = ["[a]: u", "[b]: v", "text", "[c]: w", "", "[d]: x", "```", "[e]: y", "```", "[f]: z"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d bigint, n int, t string")
    assert sorted(r.n for r in layout.definition_lines(rows, "d", "n", "t").collect()) == [0, 1, 5, 9]


def test_document_markdown_joins_items(spark):
    rows = [(1, 0, "heading", "# h"), (1, 1, "listItem", "- a"), (1, 2, "listItem", "- b"), (1, 3, "paragraph", ""), (1, 4, "paragraph", "p")]
    got = spans.document_markdown(spark.createDataFrame(rows, "d int, o int, kind string, piece string"), ["d"], "o").first()
    assert got.markdown == "# h\n\n- a\n- b\n\np"


def test_slots(spark):
    chars = [("A", "latin"), (" ", "common"), ("\uac00", "hangul"), ("\u05d0", "hebrew"), ("\u2192", "common"), ("\u00b1", "common"), ("\U00020000", "han"), ("\u0301", "inherited"), ("\ue000", "common")]
    df = spark.createDataFrame([(c, ord(c), k) for c, k in chars], "ch string, cp int, class string")
    rows = slots.looked_up(slots.looked_up(df, slots.odf_table(spark), "cp", ["slot"]), slots.word_table(spark), "cp", ["plain", "hinted"])
    absorbs = scripts.absorbs(F.col("class"))
    cp = F.col("cp")
    got = {r[0]: tuple(r)[1:] for r in rows.select("ch", slots.odf_slot(cp, F.col("slot"), absorbs), slots.hangul_slot(cp, F.col("class"), absorbs), slots.word_slot(cp, F.col("plain"), F.col("hinted"), F.lit(False)), slots.word_slot(cp, F.col("plain"), F.col("hinted"), F.lit(True)), slots.sample_eligible(cp, absorbs)).collect()}
    assert got["A"] == ("latin", "latin", "ascii", "ascii", True) and got[" "] == (None, None, "ascii", "ascii", False)
    assert got["\uac00"] == ("asian", "hangul", "eastAsia", "eastAsia", True) and got["\u05d0"] == ("complex", "other", "ascii", "ascii", True)
    assert got["\u2192"] == (None, "symbol", "hAnsi", "eastAsia", False) and got["\u00b1"][2:4] == ("hAnsi", "eastAsia")
    assert got["\U00020000"] == ("asian", "hanja", "eastAsia", "eastAsia", True) and got["\u0301"][:2] == (None, None) and got["\ue000"][4] is False


def test_slot_tables_are_sorted():
    for table in (slots.ODF_TYPES, slots.WORD_SLOTS):
        assert all(a[0] <= a[1] < b[0] for a, b in zip(table, table[1:], strict=False))
    assert (len(slots.ODF_TYPES), sum(b - a + 1 for a, b, _ in slots.ODF_TYPES)) == (28, 92_879)


def test_style_values(spark):
    rows = [("dotDash", "start", True, 5), ("none", "both", False, 0)]
    df = spark.createDataFrame(rows, "u string, a string, r boolean, v int")
    got = [tuple(x) for x in df.select(styles.underline(F.col("u")), styles.alignment(F.col("a"), F.col("r")), styles.line_height(F.lit("auto"), F.col("v") * 48.0)["value"]).collect()]
    assert got == [("dotted", "right", 1.0), (None, "justify", None)]
    assert one(spark, styles.first_family(F.lit(" , 'A, B', c"))) == "A, B"
    assert one(spark, styles.resolved_path(F.lit("~/x"), "/home/u", F.lit("/d/"))) == "/home/u/x" and one(spark, styles.resolved_path(F.lit("x"), "/h", F.lit("/d/"))) == "/d/x"
    stops = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("position"), F.lit(x).alias("leader")) for k, p, x in (("right", 400, "dot"), ("clear", 100, "none"), ("left", 200, "none"))])
    assert [tuple(s) for s in one(spark, styles.tab_stops(stops))] == [(10.0, "left", None), (20.0, "right", "dot")]
    assert [s.position for s in one(spark, styles.filled_margin(styles.tab_stops(stops), F.lit(100.0)))] == [10.0, 88.0]
    assert tuple(one(spark, styles.relative_size(F.lit(5000.0), F.lit(400.0), F.lit(10.0), F.lit(20.0)))) == (200.0, 400.0)
