"""Chains within documents, counters at any depth, themes and nested scales, on small inputs with the answers written out."""

import pytest

from inkstrata.operators import chains, sequences
from inkstrata.plans import fixtures
from inkstrata.sources import docx, markdown

SHEET = "path string, scope string, id string, parent string, prop string, value string"


def chain_rows(path, length, closed=False):
    """Style i stands on style i - 1; the first states a size (and, closed, stands on the last)."""
    rows = [(path, "style", str(i), str(i - 1) if i else str(length - 1) if closed else None, None, None) for i in range(length)]
    return rows + [(path, "style", "0", None, "size", "9"), (path, "style", str(length // 2), str(length // 2 - 1), "bold", "1"), (path, "default", "", None, "color", "x")]


@pytest.mark.parametrize("length", [2, 64, 100, 5000])
def test_chains_have_no_length_at_which_they_end(spark, length):
    df = spark.createDataFrame(chain_rows("open", length) + chain_rows("closed", length, True), SHEET).repartition(3)
    got = {(r.path, r.style): r.props for r in chains.sheets(df, "path").collect()}
    assert len(got) == 2 * (length + 1)
    for i in range(length):
        bold = {"bold": "1"} if i >= length // 2 else {}
        assert got["open", str(i)] == {"size": "9", "color": "x"} | bold
        assert got["closed", str(i)] == {"size": "9", "color": "x", "bold": "1"}
    assert got["open", None] == {"color": "x"}
    plan = chains.sheets(df, "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_cycle_gives_the_nearest_value_of_each_start():
    parents = {"a": "b", "b": "c", "c": "a", "t": "a", "u": "gone", "s": "s"}
    own = {"b": {"p": 1}, "c": {"p": 2, "q": 3}, "u": {"p": 4}}
    got = chains.inherited(parents, own)
    assert got == {"a": {"p": 1, "q": 3}, "b": {"p": 1, "q": 3}, "c": {"p": 2, "q": 3}, "t": {"p": 1, "q": 3}, "u": {"p": 4}, "s": {}}


@pytest.mark.parametrize("length", [64, 70, 100])
def test_one_sheet_over_a_cluster_has_no_limit_either(spark, length):
    styles = spark.createDataFrame([(i, i - 1 if i else None) for i in range(length)] + [(1000, 1001), (1001, 1002), (1002, 1000)], "style int, parent int")
    props = spark.createDataFrame([(0, "size", "9"), (0, "size", "8"), (1002, "size", "7")], "style int, prop string, value string")
    got = {r.style: r.value for r in sequences.style_values(styles, props).collect()}
    assert got == {i: "8" for i in range(length)} | {1000: "7", 1001: "7", 1002: "7"}


@pytest.mark.parametrize("levels, numbers", [([0, 9, 9, 0, 9], [1, 1, 2, 2, 1]), ([10, 11, 10, 11], [1, 1, 2, 1]), ([3, None, 3, -1, 3, 3], [1, 1, 1, 1, 1, 2])])
def test_counters_restart_at_any_depth(spark, levels, numbers):
    df = spark.createDataFrame([(d, i, level, "own") for d in range(2) for i, level in enumerate(levels)], "d int, o int, level int, text string")
    got = sequences.list_counters(df, ["d"], "o", "level").orderBy("d", "o").collect()
    assert [r.number for r in got] == numbers * 2 and got[0].text == "own"


def test_scales_multiply_and_cycles_end(spark):
    rows = [("p", 0, None, 2.0, 3.0, (7.0, 8.0)), ("p", 1, 0, 0.5, 1.0, None), ("p", 2, 1, 5.0, 1.0, None), ("p", 3, 99, 4.0, 4.0, None), ("p", 4, 5, 1.0, 1.0, None), ("p", 5, 4, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "path string, node int, parent int, x double, y double, whole struct<width:double,height:double>")
    got = {r.node: (r.x, r.y, r.whole and tuple(r.whole)) for r in chains.scaled(df, "path").collect()}
    assert got[2] == (5.0, 3.0, (7.0, 8.0)) and got[3] == (4.0, 4.0, None) and set(got) == set(range(6))


def words(body, **parts):
    return docx.read(fixtures.zipped({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", **{k.replace("_", "/") + ".xml": v for k, v in parts.items()}}))


def said(rows):
    return [(r["kind"], "".join(s["text"] for s in r["spans"])) for r in rows]


def test_text_boxes_keep_tables_and_each_other_apart():
    box = lambda inner: f"<w:drawing><w:x><w:txbxContent>{inner}</w:txbxContent></w:x></w:drawing>"
    p = lambda inner: f"<w:p><w:r>{inner}</w:r></w:p>"
    body = p("<w:t>before</w:t>" + box(p("<w:t>outer</w:t>" + box(p("<w:t>inner</w:t>"))) + "<w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    assert said(words(body)) == [("paragraph", "before"), ("paragraph", "outer"), ("paragraph", "inner"), ("table", ""), ("cell", ""), ("paragraph", "cell")]


def test_own_outline_level_nine_leaves_the_styles_and_suffixes_count():
    style = '<w:styles><w:style w:type="paragraph" w:styleId="H"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/>{s}<w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i, s in ((1, ""), (2, '<w:suff w:val="space"/>'), (3, '<w:suff w:val="nothing"/>')))
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="H"/><w:outlineLvl w:val="9"/><w:numPr><w:numId w:val="{i}"/></w:numPr></w:pPr><w:r><w:t>t</w:t></w:r></w:p>' for i in (1, 2, 3))
    rows = words(body, word_styles=style, word_numbering=f"<w:numbering>{numbering}</w:numbering>")
    assert said(rows) == [("heading", "1.\tt"), ("heading", "1. t"), ("heading", "1.t")] and rows[0]["level"] == 2


def test_alternatives_give_the_picture_that_can_be_drawn():
    alternative = '<w:p><w:r><mc:AlternateContent><mc:Choice><w:drawing><wp:inline><wp:extent cx="12700" cy="25400"/><c:chart/></wp:inline></w:drawing></mc:Choice>{0}</mc:AlternateContent></w:r></w:p>'
    picture = '<mc:Fallback><w:pict><v:shape style="width:1in;height:10px"><v:imagedata r:id="r"/></v:shape></w:pict></mc:Fallback>'
    (drawn,), (stands_in,) = words(alternative.format(picture)), words(alternative.format(""))
    assert (drawn["kind"], drawn["width"], drawn["height"]) == ("image", 72.0, 7.5)
    assert (stands_in["kind"], stands_in["ref"], stands_in["height"]) == ("unsupportedGraphic", "Chart", 2.0)


def test_markdown_lists_go_on_and_quotes_keep_theirs():
    rows = markdown.read(b"1. x\n\n   more\n\n2. y\n\nend\n\n1. z")
    assert [(r["kind"], r.get("marker")) for r in rows] == [("listItem", "1."), ("paragraph", None), ("listItem", "2."), ("paragraph", None), ("listItem", "1.")]
    assert said(markdown.read(b"> - a\n> - b\n>\n> c")) == [("listItem", "a"), ("listItem", "b"), ("paragraph", "c")]
    rows = markdown.read(b"![a](b.png){width=50%} `` ` `` ` c `")
    assert said(rows) == [("paragraph", " ` c"), ("image", "")]


def test_sheets_of_many_documents_at_once_say_what_a_walk_says(spark, monkeypatch):
    import random

    import pyarrow as pa

    from inkstrata.operators import grouped

    draw, rows, want = random.Random(7), [], {}
    for d in range(60):
        n = draw.randint(0, 12)
        parents = {str(i): draw.choice([None, "gone", *map(str, range(n))]) for i in range(n)}
        own = {s: {p: f"{d}{s}{p}" for p in "abc" if draw.random() < 0.3} for s in parents}
        defaults = {p: f"{d}{p}" for p in "bcd" if draw.random() < 0.5}
        rows += [(f"d{d}", "default", "", None, p, v) for p, v in defaults.items()] or [(f"d{d}", "default", "", None, None, None)]
        rows += [(f"d{d}", "style", s, up, p, v) for s, up in parents.items() for p, v in (own[s].items() or [(None, None)])]
        want[f"d{d}", None] = defaults
        want |= {(f"d{d}", s): {**defaults, **values} for s, values in chains.inherited(parents, own).items()}
    for together in (1, 50, 1 << 17):  # tables that end inside of a batch, and one of all
        calls = []
        work = lambda t: calls.append(t.num_rows) or chains._resolved(t, "path")  # noqa: E731, B023
        monkeypatch.setattr(grouped, "dealt", lambda r, keys: r.coalesce(1))
        ddl = f"path string, style string, props {chains.SHEET}"
        out = grouped.stream_tables(spark.createDataFrame(rows, SHEET), "path", ["scope", "id", "prop"], work, ddl, together).collect()
        assert {(r.path, r.style): r.props for r in out} == want and len(out) == len(want)
    assert pa.types.is_map(chains._resolved(pa.table(dict(zip(["path", "scope", "id", "parent", "prop", "value"], map(list, zip(*rows)), strict=True))), "path").schema.field("props").type)
