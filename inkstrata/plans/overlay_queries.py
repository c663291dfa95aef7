"""Registered queries of attributed text, guarded links and total orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import styles
from ..operators import layout, links, sequences, spans
from .catalogue import LINES, lines_of, query, t

# an order's lines as spans of a document: three to a block, the first block a heading
_SPAN_SQL = f"""
WITH {LINES}, s AS (SELECT l_orderkey AS doc, line, (line - 1) // 3 AS block, l_orderkey % 2 = 0 AS paged, 's' || CAST(l_quantity AS INTEGER) AS raw, l_linenumber % 4 = 0 AS caps, l_quantity AS q, l_returnflag AS rf, l_linestatus AS ls, l_suppkey AS supp FROM lines),
z AS (SELECT *, CASE WHEN caps THEN upper(raw) ELSE raw END AS text, CASE WHEN q % 3 = 0 THEN NULL WHEN paged THEN greatest(1.0, q / 4 * 1.5) ELSE greatest(1.0, round(q / 4 * 1.5)) END AS size, rf = 'R' AS raised, rf <> 'R' AND ls = 'O' AS lowered, q > 40 AS code,
  CASE WHEN supp % 5 = 0 THEN '#a' || supp WHEN supp % 5 = 1 THEN 'http://' || supp END AS link FROM s),
p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(length(text)) OVER (PARTITION BY doc ORDER BY line) AS b FROM z),
r AS (SELECT doc, block, min(a) AS a, max(b) AS b FROM p GROUP BY doc, block),
c AS (SELECT doc, line AS id, row_number() OVER (PARTITION BY doc ORDER BY line) AS number FROM p WHERE line % 2 = 0),
m AS (SELECT doc, a, b, line + x AS id FROM p, (VALUES (0), (1)) AS v(x)),
l AS (SELECT doc, 2 AS layer, a, b, unnest([{{'k': 'code', 'v': CASE WHEN code THEN 'true' END}}, {{'k': 'family', 'v': CASE WHEN NOT code THEN 'F' || supp % 3 END}}, {{'k': 'size', 'v': CAST(CASE WHEN raised OR lowered THEN size * CAST(0.7 AS DOUBLE) ELSE size END AS VARCHAR)}},
    {{'k': 'baseline', 'v': CAST(CASE WHEN raised THEN size * CAST(0.35 AS DOUBLE) WHEN lowered THEN size * CAST(-0.15 AS DOUBLE) END AS VARCHAR)}}, {{'k': 'bold', 'v': CASE WHEN q % 2 = 0 THEN 'true' END}}, {{'k': 'color', 'v': CASE WHEN NOT code AND supp % 2 = 0 THEN 'ABC' END}},
    {{'k': 'underline', 'v': CASE WHEN link IS NOT NULL THEN 'true' END}}, {{'k': 'link', 'v': CASE WHEN NOT starts_with(link, '#') THEN link END}}, {{'k': 'anchor', 'v': CASE WHEN starts_with(link, '#') THEN substring(link, 2) END}}]) AS x FROM p),
y AS (SELECT doc, layer, a, b, x.k AS key, x.v AS value FROM l WHERE x.v IS NOT NULL UNION ALL SELECT doc, 1, a, b, 'block_id', CAST(100 + block AS VARCHAR) FROM r UNION ALL SELECT doc, 1, a, b, 'heading', '2' FROM r WHERE block = 0
  UNION ALL SELECT doc, 3, a, b, 'bookmark', 'b' || supp % 4 FROM p UNION ALL SELECT m.doc, 3, a, b, 'comment', CAST(number AS VARCHAR) FROM m JOIN c ON c.doc = m.doc AND c.id = m.id
  UNION ALL SELECT doc, 9, 1, 4, 'highlight', 'yellow' FROM p WHERE line = 1 AND doc % 3 = 0 UNION ALL SELECT doc, 8, 2, 9, 'highlight', 'red' FROM p WHERE line = 1 AND doc % 3 = 0)
"""


@query(_SPAN_SQL + """, e AS (SELECT doc, a AS pos FROM y UNION SELECT doc, b FROM y), n AS (SELECT doc, pos, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS until FROM e),
i AS (SELECT n.doc, n.pos, n.until, y.key, y.value, y.layer, y.a FROM n JOIN y ON y.doc = n.doc AND y.a <= n.pos AND y.b >= n.until)
SELECT doc AS l_orderkey, CAST(pos AS BIGINT) AS start, CAST(until AS BIGINT) AS "end", key, CASE WHEN key IN ('bookmark', 'comment') THEN string_agg(DISTINCT value, ',' ORDER BY value) ELSE max_by(value, layer * 1000000 + a) END AS value FROM i GROUP BY doc, pos, until, key
""")
def attributed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of documents' texts as disjoint intervals: spans over blocks, bookmarks and comments that overlap, and a mark laid over them."""
    supp, q = F.col("l_suppkey"), F.col("l_quantity")
    link = F.when(supp % 5 == 0, F.concat(F.lit("#a"), supp.cast("string"))).when(supp % 5 == 1, F.concat(F.lit("http://"), supp.cast("string")))
    span = F.struct(
        (q > 40).alias("code"), F.concat(F.lit("F"), (supp % 3).cast("string")).alias("font"), F.when(q % 3 != 0, q / 4).alias("size"), (q % 2 == 0).alias("bold"), F.lit(None).cast("boolean").alias("italic"), (F.col("l_returnflag") == "R").alias("superscript"),
        (F.col("l_linestatus") == "O").alias("subscript"), F.when(supp % 2 == 0, F.lit("ABC")).alias("color"), F.lit(None).cast("string").alias("highlight"), F.lit(False).alias("underline"), F.lit(False).alias("strikethrough"), (F.col("l_linenumber") % 4 == 0).alias("caps"), link.alias("link"),
    )
    rows = lines_of(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc"), "line", F.floor((F.col("line") - 1) / 3).alias("block"), F.concat(F.lit("s"), q.cast("int").cast("string")).alias("text"), span.alias("span"),
        F.array(F.concat(F.lit("b"), (supp % 4).cast("string"))).alias("bookmarks"), F.array(F.col("line"), F.col("line") + 1).alias("comment_ids"),
    )
    # how many lines an order has says which blocks and comments it has, without numbering them again
    docs = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("n"))
    blocks = docs.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 3))).alias("block"))
    blocks = blocks.select("doc", "block", (100 + F.col("block")).alias("block_id"), F.when(F.col("block") == 0, 2).alias("heading"))
    comments = docs.where("n > 1").select("doc", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))).alias("number")).select("doc", (F.col("number") * 2).alias("id"), "number")
    text = layout.attribute_layers(rows, blocks, comments, "doc", ["line"], F.lit(1.5), F.col("doc") % 2 == 0)
    over = lambda layer, start, end, color: docs.where("doc % 3 = 0").select("doc", F.lit(layer).alias("layer"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.lit("highlight").alias("key"), F.lit(color).alias("value"))
    out = layout.overlaid(text.unionByName(over(9, 1, 4, "yellow").unionByName(over(8, 2, 9, "red")), allowMissingColumns=True), "doc")
    return out.withColumnRenamed("doc", "l_orderkey")


@query("""
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS n, p_retailprice / 100 AS v, p_partkey % 4 AS rule FROM part)
SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN n * 1.5 END AS before, CASE WHEN k % 5 = 0 THEN 0.0 WHEN k % 5 = 1 THEN greatest(n / 10 * 1.5, 6.0) END AS after, CASE WHEN rule = 1 THEN v END AS multiple,
       CASE rule WHEN 1 THEN 14.0 WHEN 2 THEN v * 1.5 WHEN 3 THEN v * 1.5 END AS least, CASE rule WHEN 2 THEN v * 1.5 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END AS most,
       CASE k % 3 WHEN 0 THEN n * 1.5 WHEN 1 THEN 0.0 END AS head, CASE k % 3 WHEN 0 THEN n * 1.5 + 0.0 - 4.5 WHEN 1 THEN 0.0 + 7.5 - 0.0 END AS first, CASE WHEN k % 3 = 0 THEN -(n * 1.5) END AS tail FROM p
""")
def paragraph_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with their floor, the three line rules, and indents, scaled."""
    k, n, v = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    rule = F.when(k % 4 == 1, F.lit("multiple")).when(k % 4 == 2, F.lit("exact")).when(k % 4 == 3, F.lit("at least"))
    said = F.struct(
        F.when(k % 2 == 0, n).alias("before"), F.when(k % 5 == 0, F.lit(0.0)).when(k % 5 == 1, n / 10).alias("after"), F.struct(rule.alias("rule"), v.alias("value")).alias("line"), F.when(k % 3 == 0, n).alias("start"),
        F.when(k % 3 == 0, n).alias("end"), F.when(k % 3 == 1, F.lit(5.0)).alias("first"), F.when(k % 3 == 0, F.lit(3.0)).alias("hanging"),
    )
    return t(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(styles.paragraph_layout(said, F.lit(1.5), F.lit(14.0), F.lit(6.0)))))


@query("""
WITH p AS (SELECT page_id, url, page_id % 3 AS k, 'x `' || url || '` and ' AS a, length(url) AS n FROM pages),
q AS (SELECT *, length(a) AS s, a || url || '. [' || url || '](' || url || ') ' AS b FROM p), r AS (SELECT *, length(b) AS s2 FROM q)
SELECT page_id, 'url' AS kind, s AS start, s + n AS "end", url AS target FROM r
UNION ALL SELECT page_id, 'path', s2, s2 + length('/usr/p' || page_id || '/b.md'), '/usr/p' || page_id || '/b.md' FROM r
""")
def guarded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and paths with their places: none in code spans or fences, none over a link, no path in an address."""
    n, url = F.col("page_id").cast("string"), F.col("url")
    line = F.concat(F.lit("x `"), url, F.lit("` and "), url, F.lit(". ["), url, F.lit("]("), url, F.lit(") /usr/p"), n, F.lit("/b.md; and/or `see /not/"), n, F.lit("` [a /b/c](d)\n~~~\n /in/code "), url, F.lit("\n~~~\nend"))
    rows = links.autolinks(t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), line.alias("text")))
    return rows.withColumnRenamed("doc", "page_id")


@query("""
WITH o AS (SELECT 'outline' AS output, conv_id AS doc, turn AS place, trim(text) AS label FROM conversations WHERE role = 'user' AND trim(text) <> ''),
f AS (SELECT 'failure' AS output, page_id AS doc, 0 AS place, url AS label FROM pages WHERE page_id % 7 = 0)
SELECT output, doc, place, label, row_number() OVER (ORDER BY doc, place) AS rank FROM o UNION ALL SELECT output, doc, place, label, row_number() OVER (ORDER BY label, doc) FROM f
""")
def ordered_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline entries in the order of their documents and places, failures in that of their names: numbered through."""
    outline = t(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''").select(F.lit("outline").alias("output"), F.col("conv_id").alias("doc"), F.col("turn").alias("place"), F.trim("text").alias("label"))
    failures = t(spark, sf_dir, "pages").where("page_id % 7 = 0").select(F.lit("failure").alias("output"), F.col("page_id").alias("doc"), F.lit(0).alias("place"), F.col("url").alias("label"))
    return sequences.numbered(outline, ["doc", "place"]).unionByName(sequences.numbered(failures, ["label", "doc"]))


@query("SELECT l_orderkey, l_linestatus, max(l_quantity - 25) FILTER (WHERE l_quantity > 25) AS size FROM lineitem GROUP BY 1, 2")
def largest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size that a paragraph's spans state; none where no size is more than nothing."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", (F.col("l_quantity") - 25).alias("size"))
    return spans.largest_run(rows, ["l_orderkey", "l_linestatus"])
