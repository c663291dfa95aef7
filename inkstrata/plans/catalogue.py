"""The registered queries of the document engine: each operator over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, scripts, slots, styles, text, units
from ..operators import chains, grouped, layout, sequences, spans, tables
from ..operators import units as text_units
from ..sources import kinds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text units -----------------------------------------------------------------------------------------------------

U16 = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


@query(f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM p),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS block_id FROM q)
SELECT doc_id, CAST(block_id AS INTEGER) AS block_id,
       CAST(coalesce(sum({U16.format('line')} + 1) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS src_start,
       CAST({U16.format('line')} AS INTEGER) AS src_len, line
FROM l
""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text as one block per source line, with its range in the source."""
    return text_units.units(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", text_units.lines, ("block_id", "src_start", "src_len", "line"))


CRLF = "regexp_replace({0}, '[\\n]([a-m])', '\r\n\\1', 'g')"


@query(f"""
WITH p AS (SELECT doc_id, string_split({CRLF.format('text')}, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, CASE WHEN parts[-1] = '' AND len(parts) > 1 THEN parts[:-2] ELSE parts END AS parts, len(parts) AS n FROM p),
l AS (SELECT doc_id, n, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS block_id FROM q),
m AS (SELECT *, CASE WHEN block_id < n - 1 AND suffix(raw, chr(13)) THEN raw[:-2] ELSE raw END AS line FROM l)
SELECT doc_id, CAST(block_id AS INTEGER) AS block_id,
       CAST(coalesce(sum({U16.format('raw')} + 1) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS src_start,
       CAST({U16.format('line')} AS INTEGER) AS src_len
FROM m
""")
def crlf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts with mixed terminators: each line feed before one of a to m becomes two characters, which both count."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n([a-m])", "\r\n$1").alias("text"))
    return text_units.units(rows, "text", text_units.lines, ("block_id", "src_start", "src_len", "line"), keep_text=False)


@query(f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT lang, count(*) AS n_blocks, CAST(sum({U16.format('line')}) AS BIGINT) AS n_utf16, count(*) FILTER (WHERE trim(line) = '') AS n_blank FROM l GROUP BY lang
""")
def blocks_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.sum(text.utf16_length(F.col("line"))).cast("long").alias("n_utf16"), F.count(F.when(F.trim("line") == "", 1)).alias("n_blank"))


def _unit_sql(stop: str) -> str:
    return f"""
WITH p AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?s)(.*?(?:{stop})|.+$)', 1), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS n FROM p)
SELECT doc_id, CAST(n AS INTEGER) AS unit,
       CAST(coalesce(sum({U16.format('piece')}) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
       CAST({U16.format("rtrim(piece, ' ' || chr(10))")} AS INTEGER) AS len
FROM u
"""


def _units(spark: SparkSession, sf_dir: str, cut: text_units.Cut) -> DataFrame:
    rows = text_units.units(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", cut, ("unit", "start", "len", "piece"), keep_text=False)
    return rows.select("doc_id", (F.col("unit") + 1).alias("unit"), F.col("start").cast("int").alias("start"), "len")


@query(_unit_sql(r"\.[ \n]*"))
def sentence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, text_units.stretches(text_units.SENTENCE))


@query(_unit_sql(r"\n{2,}"))
def paragraph_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, text_units.stretches(text_units.PARAGRAPH))


@query(r"""
SELECT p_partkey, regexp_replace(translate(lower(p_name || ' (' || p_brand || ')'), ' ' || chr(9), '--'), '[^\p{L}\p{M}\p{N}_-]', '', 'g') AS slug FROM part
""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t(spark, sf_dir, "part").select("p_partkey", text.slug(title).alias("slug"))


@query("""
WITH e AS (SELECT page_id, lower(regexp_extract(url, '[^/][.]([^./]+)$', 1)) AS ext FROM pages)
SELECT page_id, ext, CASE WHEN ext IN ('md','markdown') THEN 'markdown' WHEN ext IN ('docx','docm','dotx','dotm','odt','hwp','hwpx') THEN 'office' ELSE 'plainText' END AS kind,
       ext IN ('md','markdown','docx','docm','dotx','dotm','odt','hwp','hwpx') OR ext IN (%s) AS opens FROM e
""" % ",".join(f"'{x}'" for x in kinds.PLAIN_TEXT))
def ext_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = kinds.extension(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), kinds.kind(ext).alias("kind"), kinds.opens(ext).alias("opens"))


@query(f"SELECT doc_id, CAST({U16.format('text')} AS INTEGER) AS n_utf16, CAST(length(text) AS INTEGER) AS n_code_points FROM documents")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("n_utf16"), F.length("text").alias("n_code_points"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\$\$[^\n$]+\$\$')) AS INTEGER) AS n_math, CAST(len(regexp_extract_all(text, '[|]')) AS INTEGER) AS n_bars FROM documents""")
def inline_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\$\$[^\n$]+\$\$")).alias("n_math"), F.regexp_count("text", F.lit("[|]")).alias("n_bars"))


@query("""
SELECT p_partkey, 0 AS n, CASE WHEN p_partkey % 3 = 0 THEN 'x_' || p_size ELSE p_brand || chr(10) || p_size END AS latex FROM part
""")
def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display math of texts: a block on lines of its own, one line, or an open end, which is none."""
    block = F.concat(F.lit("see\n$$\n"), F.col("p_brand"), F.lit("\n"), F.col("p_size").cast("string"), F.lit("\n  $$ \nand $$ open"))
    line = F.concat(F.lit("costs $5\n  $$x_"), F.col("p_size").cast("string"), F.lit("$$\n$$ $$\n"))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, line).otherwise(block).alias("text"))
    return rows.select("p_partkey", F.posexplode(text.math_spans(F.col("text"))).alias("n", "latex"))


@query("""
SELECT page_id, CAST(n AS INTEGER) AS n, link FROM (SELECT page_id, unnest([url || '/a', '/usr/p' || page_id || '/b.md', './d' || page_id || '/x.md']) AS link, unnest([0, 1, 2]) AS n FROM pages)
""")
def path_autolinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and paths in prose; not in code, in links, or within words."""
    n = F.col("page_id").cast("string")
    line = F.concat(F.lit("and/or see "), F.col("url"), F.lit("/a, /usr/p"), n, F.lit("/b.md; then ./d"), n, F.lit("/x.md. [t](/no/"), n, F.lit(") but `/not/code` // no\n```\n/nor/fenced\n```\nend"))
    return t(spark, sf_dir, "pages").select("page_id", F.posexplode(text.autolinks(line)).alias("n", "link"))


@query("""
WITH d AS (SELECT DISTINCT sha256(text || '|v1') AS key FROM documents)
SELECT key FROM d WHERE key NOT IN (SELECT sha256(text || '|v1') FROM documents WHERE source = 'src0')
""")
def new_artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct artifacts by content that a cache (here: one source's) lacks."""
    docs = t(spark, sf_dir, "documents").select("source", text.artifact_key(F.col("text"), "v1").alias("key"))
    return sequences.new_artifacts(docs.select("key"), docs.where("source = 'src0'"), "key")


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '```' || chr(10) || text ELSE replace(text, '. ', '.' || chr(10) || chr(10)) END AS text FROM documents),
c AS (SELECT doc_id, text, substring(text, 1, 2000) AS cut FROM t), b AS (SELECT *, string_split(cut, chr(10) || chr(10)) AS parts FROM c),
k AS (SELECT *, CASE WHEN len(parts) > 1 AND array_to_string(parts[:-2], chr(10) || chr(10)) <> '' THEN array_to_string(parts[:-2], chr(10) || chr(10)) ELSE cut END AS kept FROM b)
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE kept || CASE WHEN (len(string_split(kept, '```')) - 1) % 2 = 1 THEN chr(10) || '```' ELSE '' END || chr(10) || chr(10) || '[preview ends here]' END AS preview FROM k
""")
def preview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut for a preview: back to a blank line if there is one, an open fence closed."""
    own = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\n"), "text")).otherwise(F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return t(spark, sf_dir, "documents").select("doc_id", text.preview_text(own, 2000).alias("preview"))


# --- numbers and units ----------------------------------------------------------------------------------------------


def _roman_sql() -> str:
    rest, out = "n", []
    for value, symbol in numbers.ROMAN:
        out.append(f"repeat('{symbol}', CAST({rest} // {value} AS BIGINT))")
        rest = f"({rest} % {value})"
    return "CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) ELSE " + " || ".join(out) + " END"


ROMAN_SQL = _roman_sql()


@query(f"""
WITH p AS (SELECT p_partkey, CAST(p_partkey % 4000 AS INTEGER) AS n FROM part)
SELECT p_partkey, CASE WHEN n BETWEEN 0 AND 9 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS "decimalZero", {ROMAN_SQL} AS "upperRoman", lower({ROMAN_SQL}) AS "lowerRoman",
       CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) ELSE repeat(chr(CAST(65 + (n - 1) % 26 AS INTEGER)), (n - 1) // 26 + 1) END AS "upperLetter",
       CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) ELSE repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), (n - 1) // 26 + 1) END AS "lowerLetter",
       translate(CAST(n AS VARCHAR), '0123456789', '{numbers.CHINESE_DIGITS}') AS "ideographDigital",
       translate(CAST(n AS VARCHAR), '0123456789', '{numbers.KOREAN_DIGITS}') AS "koreanDigital",
       CASE WHEN n BETWEEN 1 AND 20 THEN chr(CAST(9311 + n AS INTEGER)) ELSE CAST(n AS VARCHAR) END AS "decimalEnclosedCircle",
       CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) ELSE repeat(substring('{numbers.GANADA}', CAST((n - 1) % 14 + 1 AS BIGINT), 1), (n - 1) // 14 + 1) END AS ganada
FROM p
""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 4000).cast("int")
    return t(spark, sf_dir, "part").select("p_partkey", *[f(n).alias(name) for name, f in numbers.FORMATS.items()])


@query("""
WITH p AS (SELECT p_partkey, p_size, ['pt','in','cm','mm','pc','px','em'][p_partkey % 7 + 1] AS unit FROM part)
SELECT p_partkey, CASE unit WHEN 'pt' THEN 1.0 WHEN 'in' THEN 72.0 WHEN 'cm' THEN 72.0 / 2.54 WHEN 'mm' THEN 72.0 / 25.4 WHEN 'pc' THEN 12.0 WHEN 'px' THEN 0.75 END * CAST(p_size AS DOUBLE) AS points,
       upper(substring(md5(CAST(p_partkey AS VARCHAR)), 1, 6)) AS colour, CAST(p_size AS DOUBLE) / 20 AS from_twips
FROM p
""")
def office_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("pt", "in", "cm", "mm", "pc", "px", "em")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", units.length_points(F.concat(F.col("p_size").cast("string"), unit)).alias("points"), units.colour(F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6))).alias("colour"), units.scaled(F.col("p_size"), 20).alias("from_twips"))


@query("""
WITH c AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part),
v AS (SELECT p_partkey, CAST(('0x' || substring(h, 1, 2)) AS INTEGER) AS r, CAST(('0x' || substring(h, 3, 2)) AS INTEGER) AS g, CAST(('0x' || substring(h, 5, 2)) AS INTEGER) AS b, CAST(('0x' || substring(h, 1, 4)) AS INTEGER) AS look FROM c)
SELECT p_partkey, greatest(r, g, b) = 0 OR (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) < 0.12 AS near_neutral,
       look & 32 <> 0 AS first_row, look & 64 <> 0 AS last_row, look & 128 <> 0 AS first_column, look & 256 <> 0 AS last_column, look & 512 <> 0 AS no_h_band, look & 1024 <> 0 AS no_v_band FROM v
""")
def colour_and_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("p_partkey").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", units.near_neutral(F.substring(h, 1, 6)).alias("near_neutral"), units.table_look(F.substring(h, 1, 4)).alias("l")).select("p_partkey", "near_neutral", "l.*")


# --- outline and navigation -----------------------------------------------------------------------------------------

HEADINGS_SQL = """h AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS level, text AS title,
      (SELECT max(turn) + 1 FROM conversations AS x WHERE x.conv_id = c.conv_id) AS n_turns FROM conversations AS c)"""


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations")
    level = F.when(F.col("turn") == 0, 1).when(F.col("role") == "user", 2).otherwise(3)
    return rows.select("conv_id", "turn", level.alias("level"), F.col("text").alias("title"), (F.max("turn").over(Window.partitionBy("conv_id")) + 1).alias("n_turns"))


@query("SELECT conv_id, turn, trim(text) AS title, 1 + (turn > 0)::INTEGER AS level FROM conversations WHERE trim(text) <> '' AND role = 'user'")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("title"), F.when(F.col("turn") > 0, 2).otherwise(1).alias("level"))
    return rows.where("title <> ''")


@query(f"""
WITH {HEADINGS_SQL}
SELECT a.conv_id, a.turn, a.level, coalesce(min(b.turn), a.n_turns) AS section_end FROM h AS a LEFT JOIN h AS b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level
GROUP BY a.conv_id, a.turn, a.level, a.n_turns
""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sections(_headings(spark, sf_dir), ["conv_id"], "turn", "level", "n_turns").select("conv_id", "turn", "level", "section_end")


@query(f"""
WITH {HEADINGS_SQL}
SELECT conv_id, turn, lag(turn) OVER w AS previous_at, lead(turn) OVER w AS next_at, level = min(level) OVER (PARTITION BY conv_id) AS top FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def heading_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.neighbours(_headings(spark, sf_dir), ["conv_id"], "turn")
    return rows.select("conv_id", "turn", "previous_at", "next_at", (F.col("level") == F.min("level").over(Window.partitionBy("conv_id"))).alias("top"))


@query("""
WITH k AS (SELECT user_id, ts, event_id, event_type FROM events), h AS (SELECT user_id, ts, min(event_id) AS heading FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT k.event_id, h.heading FROM k ASOF LEFT JOIN h ON k.user_id = h.user_id AND k.ts >= h.ts
""")
def current_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading at or before a position: events as positions, purchases as headings, per user."""
    events = t(spark, sf_dir, "events")
    heads = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("heading"))
    return sequences.as_of(events.select("user_id", "ts", "event_id"), heads, ["user_id"], "ts", "heading").select("event_id", "heading")


@query("""
WITH l AS (SELECT n_nationkey, n_regionkey, lower(n_name) AS slug FROM nation), b AS (SELECT lower(r_name) AS name, max(r_regionkey) AS at FROM region GROUP BY 1),
w AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(r_name) WHEN c_custkey % 3 = 1 THEN lower(n_name) ELSE 'none' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT w.c_custkey, coalesce(b.at, min(l.n_nationkey)) AS target FROM w LEFT JOIN b ON b.name = w.name LEFT JOIN l ON l.slug = w.name GROUP BY w.c_custkey, b.at
""")
def anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolve to a bookmark of their name, else to the first heading with that slug."""
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    one = F.lit(0).alias("doc")
    which = F.when(F.col("c_custkey") % 3 == 0, F.lower("r_name")).when(F.col("c_custkey") % 3 == 1, F.lower("n_name")).otherwise(F.lit("none"))
    links = t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(one, "c_custkey", which.alias("name"))
    marks = region.select(one, F.lower("r_name").alias("name"), F.col("r_regionkey").alias("at"))
    heads = nation.select(one, F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("at"))
    return sequences.anchor_targets(links, marks, heads, ["doc"]).select("c_custkey", "target")


# --- lines of an order have no unique number, so they are ranked by all their columns

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINES = f"lines AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INTEGER) AS line FROM lineitem)"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    return grouped.spread(rows, grouped.parts_of(rows), "l_orderkey").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


# --- spans, runs, census --------------------------------------------------------------------------------------------


@query("""
WITH %s, l AS (SELECT l_orderkey, line, l_returnflag || l_linestatus AS text, l_returnflag = 'R' AS bold, l_linestatus = 'O' AS italic FROM lines),
s AS (SELECT *, CASE WHEN bold IS NOT DISTINCT FROM lag(bold) OVER w AND italic IS NOT DISTINCT FROM lag(italic) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY line) AS island FROM s)
SELECT l_orderkey, min(line) AS line, bold, italic, string_agg(text, '' ORDER BY line) AS text FROM i GROUP BY l_orderkey, island, bold, italic
""" % LINES)
def span_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_returnflag") == "R").alias("bold"), (F.col("l_linestatus") == "O").alias("italic"))
    return spans.coalesced(rows, ["l_orderkey"], "line", ["bold", "italic"])


@query("""
WITH %s, m AS (SELECT l_orderkey, line, CASE WHEN l_returnflag = 'R' THEN '**' ELSE '' END AS b, replace(l_returnflag || '|' || l_linestatus, '|', chr(92) || '|') AS text FROM lines),
s AS (SELECT *, CASE WHEN b = lag(b) OVER w THEN 0 ELSE 1 END AS starts FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY line) AS island FROM s),
g AS (SELECT l_orderkey, island, b || string_agg(text, '' ORDER BY line) || b AS piece FROM i GROUP BY l_orderkey, island, b)
SELECT l_orderkey, string_agg(piece, '' ORDER BY island) AS inline FROM g GROUP BY l_orderkey
""" % LINES)
def inline_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("text"), (F.col("l_returnflag") == "R").alias("bold"), no.alias("italic"), no.alias("strikethrough"), no.alias("code"), F.lit(None).cast("string").alias("link"))
    return spans.block_inline(rows, ["l_orderkey"], "line", in_cell=True)


@query("""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) SELECT lang, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY lang, ch
""")
def char_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units.char_counts(t(spark, sf_dir, "documents").select("lang", "text"), "text")


@query("""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT lang, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY lang, ch)
SELECT lang, ch, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, unicode(ch)) AS r FROM n) WHERE r = 1
""")
def census_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.modes(char_census(spark, sf_dir), ["lang"], "ch")


RANGES = [(0x30, 0x39, None), (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0xFF, "latin-1"), (0x100, 0x24F, "latin-ext"), (0xAC00, 0xD7A3, "hangul")]
RANGES_SQL = ", ".join(f"({a}, {b}, {f"'{c}'" if c else 'CAST(NULL AS VARCHAR)'})" for a, b, c in RANGES)


@query(f"""
WITH r(a, b, class) AS (VALUES {RANGES_SQL}), c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT class, sum(n)::BIGINT AS n FROM n LEFT JOIN r ON unicode(ch) BETWEEN a AND b GROUP BY class
""")
def script_ranges_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per class: distinct characters meet the ranges, then their counts are summed."""
    ranges = spark.createDataFrame(RANGES, "start int, end int, class string")
    chars = _distinct_chars(spark, sf_dir)
    return sequences.range_lookup(chars, ranges, "cp", "class").groupBy("class").agg(F.sum("n").alias("n"))


@query("""
WITH c AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) AS pos, unnest(string_split(p_name, '')) AS ch FROM part),
k AS (SELECT *, CASE WHEN ch IN ('a','e','i','o','u') THEN 'vowel' WHEN ch BETWEEN 'a' AND 'z' THEN 'consonant' END AS class FROM c),
f AS (SELECT p_partkey, pos, ch, coalesce(last_value(class IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY pos), first_value(class IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS class FROM k),
s AS (SELECT *, CASE WHEN class IS NOT DISTINCT FROM lag(class) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM f WINDOW w AS (PARTITION BY p_partkey ORDER BY pos)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY p_partkey ORDER BY pos) AS island FROM s)
SELECT p_partkey, CAST(min(pos) - 1 AS INTEGER) AS pos, class, string_agg(ch, '' ORDER BY pos) AS ch FROM i GROUP BY p_partkey, island, class
""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by class where classless characters join the run before them (at the start: the one after)."""
    rows = t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.filter(F.split("p_name", ""), lambda c: c != "")).alias("pos", "ch"))
    rows = rows.withColumn("class", F.when(F.col("ch").isin(*"aeiou"), F.lit("vowel")).when(F.col("ch").between("a", "z"), F.lit("consonant")))
    return spans.filled_runs(rows, ["p_partkey"], "pos", "class", "ch")


@query(f"""
WITH r(a, class) AS (VALUES {", ".join(f"({a}, '{c}')" for a, _, c in scripts.ranges())}), c AS (SELECT conv_id, turn, unnest(range(1, length(text) + 1)) AS pos, text FROM (SELECT conv_id, turn, text || ' 한글(ㄱ) 漢字カナ ' || turn AS text FROM conversations)),
k AS (SELECT conv_id, turn, pos, substring(text, pos, 1) AS ch, unicode(substring(text, pos, 1)) AS cp FROM c), s AS (SELECT k.*, CASE WHEN class NOT IN ('common', 'inherited', 'extend') THEN class END AS class FROM k ASOF JOIN r ON k.cp >= r.a),
f AS (SELECT *, coalesce(last_value(class IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos), first_value(class IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS run FROM s),
i AS (SELECT *, CASE WHEN run = lag(run) OVER w THEN 0 ELSE 1 END AS starts FROM f WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)), n AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS island FROM i)
SELECT conv_id, turn, CAST(island - 1 AS INTEGER) AS n, run AS class, CAST(length(string_agg(ch, '' ORDER BY pos)) AS INTEGER) AS len, string_agg(ch, '' ORDER BY pos) AS piece FROM n GROUP BY 1, 2, 3, 4
""")
def unicode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut where the script class changes; what absorbs never begins a piece."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" 한글(ㄱ) 漢字カナ "), F.col("turn").cast("string")).alias("text"))
    return spans.script_pieces(rows, "text").select("conv_id", "turn", "n", "class", F.length("piece").alias("len"), "piece")


# --- counters and numbering -----------------------------------------------------------------------------------------


@query(f"""
WITH {LINES}, i AS (SELECT l_orderkey, line, l_linenumber % 3 AS level FROM lines),
g AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN sum((level < 1)::INTEGER) OVER w ELSE sum((level < 2)::INTEGER) OVER w END AS grp FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)),
n AS (SELECT l_orderkey, line, level, CAST(row_number() OVER (PARTITION BY l_orderkey, level, grp ORDER BY line) AS INTEGER) AS n FROM g)
SELECT l_orderkey, line, level, n AS number, CASE level WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN chr(CAST(97 + (n - 1) % 26 AS INTEGER)) ELSE {{roman}} END AS marker FROM n
""".replace("{roman}", "lower(" + ROMAN_SQL + ")"))
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested list numbers and their markers: decimal, letter, Roman by level."""
    items = lines_of(spark, sf_dir).select("l_orderkey", "line", (F.col("l_linenumber") % 3).alias("level"))
    rows = sequences.list_counters(items, ["l_orderkey"], "line", "level")
    kind = F.element_at(F.array(F.lit("decimal"), F.lit("lowerLetter"), F.lit("lowerRoman")), F.col("level") + 1)
    return rows.select("l_orderkey", "line", "level", "number", numbers.format_number(F.col("number"), kind).alias("marker"))


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, first, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS INTEGER) AS number FROM f
""")
def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_seen_numbers(t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""
SELECT event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS n_open FROM events
""")
def comment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return sequences.open_ranges(t(spark, sf_dir, "events").withColumn("change", change), ["user_id"], "event_id", "change").select("event_id", "n_open")


@query(f"""
WITH {LINES}, a AS (SELECT l_orderkey, line AS id, min(l_suppkey * 100 + line) AS first FROM lines WHERE l_linestatus = 'O' OR l_returnflag = 'R' GROUP BY 1, 2),
s AS (SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, id) AS n FROM a),
j AS (SELECT l.l_orderkey, l.line AS id, s.n FROM lines AS l LEFT JOIN s ON s.l_orderkey = l.l_orderkey AND s.id = l.line)
SELECT l_orderkey, id, CAST(coalesce(n, coalesce(max(n) OVER (PARTITION BY l_orderkey), 0) + sum((n IS NULL)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY id)) AS INTEGER) AS number FROM j
""")
def comment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's comments (an order's lines): anchored ones by first appearance, then the others in file order."""
    rows = lines_of(spark, sf_dir).withColumn("id", F.col("line"))
    anchors = rows.where("l_linestatus = 'O' or l_returnflag = 'R'").select("l_orderkey", "id", (F.col("l_suppkey") * 100 + F.col("line")).alias("at"))
    return sequences.comment_numbers(rows.select("l_orderkey", "id", F.col("line").alias("ord")), anchors, ["l_orderkey"]).select("l_orderkey", "id", "number")


@query("""
WITH RECURSIVE styles AS (SELECT p_partkey AS style, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
props AS (SELECT p_partkey AS style, unnest(['size', 'brand']) AS prop, unnest([CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END, CASE WHEN p_size % 7 = 0 THEN p_brand END]) AS value FROM part),
chain AS (SELECT style, style AS at, 0 AS depth FROM styles UNION ALL SELECT c.style, s.parent, depth + 1 FROM chain AS c JOIN styles AS s ON c.at = s.style WHERE s.parent IS NOT NULL AND depth < 32)
SELECT c.style, prop, arg_min(value, depth) AS value FROM chain AS c JOIN props AS p ON p.style = c.at WHERE value IS NOT NULL GROUP BY 1, 2
""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest definition of each property up the chain of parents (here: half of a part's key)."""
    part = t(spark, sf_dir, "part")
    styles = part.select(F.col("p_partkey").alias("style"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).alias("parent"))
    size, brand = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")), F.when(F.col("p_size") % 7 == 0, F.col("p_brand"))
    props = part.select(F.col("p_partkey").alias("style"), F.inline(F.array(F.struct(F.lit("size").alias("prop"), size.alias("value")), F.struct(F.lit("brand").alias("prop"), brand.alias("value")))))
    return sequences.style_values(styles, props)


@query(f"""
WITH {LINES}, i AS (SELECT l_orderkey, line, CAST(l_suppkey * 7 % 30 AS INTEGER) AS level FROM lines),
b AS (SELECT i.l_orderkey, i.line, i.level, coalesce(max(s.line), 0) AS boundary FROM i LEFT JOIN i AS s ON s.l_orderkey = i.l_orderkey AND s.line < i.line AND s.level < i.level GROUP BY 1, 2, 3)
SELECT l_orderkey, line, level, CAST(row_number() OVER (PARTITION BY l_orderkey, level, boundary ORDER BY line) AS INTEGER) AS number FROM b
""")
def deep_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of items at any of 30 levels: a shallower item restarts all deeper ones."""
    items = lines_of(spark, sf_dir).select("l_orderkey", "line", (F.col("l_suppkey") * 7 % 30).cast("int").alias("level"))
    return sequences.list_counters(items, ["l_orderkey"], "line", "level")


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), e AS (SELECT l_orderkey AS doc, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
styles AS (SELECT s.doc, s.n * 12 + k AS style, CASE WHEN s.n * 12 + k > 12 THEN s.n * 12 + k - 1 WHEN s.doc % 3 = 0 THEN e.n * 12 + 11 END AS parent,
  CASE WHEN k = 0 AND q % 5 = 0 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) END AS size, CASE WHEN s.n = 1 AND k = 0 THEN 'F' || s.doc END AS font FROM s JOIN e ON e.doc = s.doc, range(12) AS r(k)),
props AS (SELECT doc, style, unnest(['size', 'font']) AS prop, unnest([size, font]) AS value FROM styles),
own AS (SELECT * FROM props WHERE value IS NOT NULL),
chain AS (SELECT doc, style, style AS at, 0 AS depth FROM styles UNION ALL SELECT c.doc, c.style, s.parent, depth + 1 FROM chain AS c JOIN styles AS s ON s.doc = c.doc AND s.style = c.at WHERE s.parent IS NOT NULL AND s.parent <> c.style AND depth < 200)
SELECT c.doc AS l_orderkey, c.style, prop, arg_min(value, depth) AS value FROM chain AS c JOIN own AS p ON p.doc = c.doc AND p.style = c.at GROUP BY 1, 2, 3
""")
def document_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains within documents, some of over eighty styles, some closed to a cycle: twelve styles per line of an order, each based on the one before."""
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    rows = rows.withColumn("last", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    number = F.col("l_linenumber") * 12 + F.col("k")
    parent = F.when(number > 12, number - 1).when(F.col("l_orderkey") % 3 == 0, F.col("last") * 12 + 11)
    size = F.when((F.col("k") == 0) & (F.col("q") % 5 == 0), F.col("q").cast("int").cast("string"))
    font = F.when((F.col("l_linenumber") == 1) & (F.col("k") == 0), F.concat(F.lit("F"), F.col("l_orderkey").cast("string")))
    stated = F.array(F.struct(F.lit("size").alias("prop"), size.alias("value")), F.struct(F.lit("font").alias("prop"), font.alias("value")))
    declared = rows.select(F.col("l_orderkey").cast("string").alias("doc"), F.lit("style").alias("scope"), number.cast("string").alias("id"), parent.cast("string").alias("parent"), F.inline_outer(F.when(size.isNotNull() | font.isNotNull(), F.filter(stated, lambda s: s["value"].isNotNull()))))
    found = chains.long_form(chains.sheets(declared, "doc"), "doc", "style")
    return found.select(F.col("doc").cast("long").alias("l_orderkey"), F.col("style").cast("long").alias("style"), "prop", "value")


@query("""
SELECT o_orderkey, coalesce(c_name, 'unresolvable:' || o_custkey) AS target FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey
""")
def rel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship ids resolve to their targets; those without one keep a marker with the id."""
    known = t(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    rows = t(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("unresolvable:"), F.col("o_custkey").cast("string"))).alias("target"))


# --- tables and serialisation ---------------------------------------------------------------------------------------


def _nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per region: a header row, then key and name of each nation."""
    nation = t(spark, sf_dir, "nation")
    cells = F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("n_nationkey").cast("string").alias("text")), F.struct(F.lit(1).alias("col"), F.concat("n_name", F.lit("|"), "n_name").alias("text"))))
    body = nation.select("n_regionkey", (F.col("n_nationkey") + 1).alias("row"), cells)
    head = nation.select("n_regionkey").distinct().select("n_regionkey", F.lit(0).alias("row"), F.inline(F.array(F.struct(F.lit(0).alias("col"), F.lit("key").alias("text")), F.struct(F.lit(1).alias("col"), F.lit("name").alias("text")))))
    return body.unionByName(head)


@query("""
SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name || '|' || n_name, '|', chr(92) || '|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1
""")
def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pipe_tables(_nation_cells(spark, sf_dir), ["n_regionkey"])


@query(f"""
SELECT n_regionkey, '<raw>' || chr(10) || '{text.RAW_NOTE}' || chr(10) || 'key | name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name || '|' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) || '</raw>' AS markdown FROM nation GROUP BY 1
""")
def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_tables(_nation_cells(spark, sf_dir), ["n_regionkey"])


def _line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a table: a row per three lines, a cell per line; the line number gives the width, the return flag the kind."""
    rows = lines_of(spark, sf_dir)
    return rows.select("l_orderkey", F.expr("cast((line - 1) div 3 as int)").alias("row"), ((F.col("line") - 1) % 3).alias("col"), F.least(F.col("l_linenumber"), F.lit(2)).alias("col_span"), F.lit(1).alias("row_span"), (F.col("l_returnflag") != "A").alias("only_paragraphs"), "line")


CELLS = LINES + ", cells AS (SELECT l_orderkey, CAST((line - 1) // 3 AS INTEGER) AS row, CAST((line - 1) % 3 AS INTEGER) AS col, least(l_linenumber, 2) AS col_span, l_returnflag <> 'A' AS only_paragraphs, line FROM lines)"


@query(f"""
WITH {CELLS}, r AS (SELECT l_orderkey, row, count(*) AS n, bool_and(col_span = 1 AND only_paragraphs) AS plain FROM cells GROUP BY 1, 2)
SELECT l_orderkey, min(n) = max(n) AND bool_and(plain) AS simple FROM r GROUP BY 1
""")
def simple_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.simple_grids(_line_cells(spark, sf_dir), ["l_orderkey"])


@query("""
WITH r AS (SELECT l_suppkey, l_orderkey AS row, sum(least(l_linenumber, 2)) AS width FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, count(*) AS n_rows, max(width) AS width FROM r GROUP BY 1)
SELECT l_suppkey, n_rows, CAST(n_rows * width AS BIGINT) AS n_cells, n_rows >= 50 AND n_rows * width >= 500 AS giant FROM s
""")
def giant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("row"), F.least(F.col("l_linenumber"), F.lit(2)).alias("col_span"))
    return tables.giant_tables(cells, ["l_suppkey"])


@query(f"""
WITH {CELLS} SELECT l_orderkey, line, CAST(coalesce(sum(col_span) OVER (PARTITION BY l_orderkey, row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS grid_col FROM cells
""")
def grid_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.placed(_line_cells(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "line", "grid_col")


@query(f"""
WITH RECURSIVE {CELLS}, c AS (SELECT *, CASE WHEN only_paragraphs THEN 1 ELSE 2 END AS row_span, row_number() OVER (PARTITION BY l_orderkey ORDER BY row, col) AS k, max(row) OVER (PARTITION BY l_orderkey) + 1 AS n_rows FROM cells),
s(l_orderkey, k, row, col, grid_col, taken) AS (
  SELECT l_orderkey, k, row, col, 0, list_transform(range(col_span * least(row_span, n_rows - row)), lambda i: [row + i // col_span, i % col_span]) FROM c WHERE k = 1
  UNION ALL
  SELECT l_orderkey, k, row, col, place, list_concat(taken, list_transform(range(col_span * least(row_span, n_rows - row)), lambda i: [row + i // col_span, place + i % col_span]))
  FROM (SELECT n.*, s.taken, list_min(list_filter(range(60), lambda x: NOT list_contains(s.taken, [CAST(n.row AS BIGINT), x]))) AS place FROM s JOIN c AS n ON n.l_orderkey = s.l_orderkey AND n.k = s.k + 1))
SELECT l_orderkey, row, col, CAST(grid_col AS INTEGER) AS grid_col FROM s
""")
def grid_place_row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _line_cells(spark, sf_dir).withColumn("row_span", F.when(F.col("only_paragraphs"), 1).otherwise(2))
    return tables.placed_with_row_spans(cells, "l_orderkey")


@query(f"""
WITH {CELLS}, m AS (SELECT *, CASE WHEN line % 4 = 0 THEN NULL WHEN line % 2 = 0 THEN 'continue' ELSE 'restart' END AS merge FROM cells),
a AS (SELECT *, sum(CASE WHEN merge IS NOT DISTINCT FROM 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey, col ORDER BY row) AS anchor FROM m),
g AS (SELECT l_orderkey, col AS grid_col, anchor, min(row) AS row, arg_min(coalesce(merge, ''), row) AS merge, count(*) AS n FROM a WHERE anchor > 0 GROUP BY 1, 2, 3)
SELECT l_orderkey, grid_col, row, CAST(CASE WHEN merge = 'restart' THEN n ELSE 1 END AS INTEGER) AS row_span FROM g
""")
def merged_row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    merge = F.when(F.col("line") % 4 == 0, F.lit(None).cast("string")).when(F.col("line") % 2 == 0, F.lit("continue")).otherwise(F.lit("restart"))
    cells = _line_cells(spark, sf_dir).select("l_orderkey", F.col("col").alias("grid_col"), "row", merge.alias("merge"))
    return tables.merged_row_spans(cells, ["l_orderkey"])


@query("""
WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, o_orderstatus = 'F' AS header FROM orders)
SELECT o_custkey, CAST(coalesce(min(row) FILTER (WHERE NOT header), max(row) + 1) - min(row) AS INTEGER) AS header_rows FROM r GROUP BY 1
""")
def leading_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return tables.leading_headers(t(spark, sf_dir, "orders").select("o_custkey", row.alias("row"), (F.col("o_orderstatus") == "F").alias("header")), ["o_custkey"], "row", "header")


@query(f"""
WITH {LINES}, c AS (SELECT l_orderkey, line, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY line) AS upto, lead(line) OVER (PARTITION BY l_orderkey ORDER BY line) IS NULL AS last FROM lines)
SELECT l_orderkey, line, CAST(CASE WHEN last THEN least(floor(CAST(451.5 AS DOUBLE) * upto / total + 0.5), 451) ELSE floor(CAST(451.5 AS DOUBLE) * upto / total + 0.5) END AS BIGINT) AS edge FROM c
""")
def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table (an order) whose columns (its lines) share a width by their quantities."""
    return tables.column_edges(lines_of(spark, sf_dir), ["l_orderkey"], "line", "l_quantity", 451.5).select("l_orderkey", "line", "edge")


@query("""
WITH r(region, prop, value, priority) AS (VALUES ('whole', 'fill', 'FFFFFF', 0), ('band2Horz', 'fill', 'EEEEEE', 4), ('firstRow', 'fill', '000000', 7), ('lastRow', 'fill', '777777', 8), ('firstCol', 'bold', 'true', 5), ('nwCell', 'fill', 'FF0000', 9)),
c AS (SELECT n_nationkey AS cell, n_nationkey // 5 AS row, n_nationkey % 5 AS col FROM nation),
h AS (SELECT cell, prop, value, priority FROM c JOIN r ON region = 'whole' OR (region = 'band2Horz' AND row % 2 = 1) OR (region = 'firstRow' AND row = 0) OR (region = 'lastRow' AND row = 4) OR (region = 'firstCol' AND col = 0) OR (region = 'nwCell' AND row = 0 AND col = 0))
SELECT cell, prop, arg_max(value, priority) AS value FROM h GROUP BY 1, 2
""")
def style_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.expr("n_nationkey div 5").alias("row"), (F.col("n_nationkey") % 5).alias("col"), F.lit(5).alias("n_rows"), F.lit(5).alias("n_cols"))
    regions = spark.createDataFrame([("whole", "fill", "FFFFFF"), ("band2Horz", "fill", "EEEEEE"), ("firstRow", "fill", "000000"), ("lastRow", "fill", "777777"), ("firstCol", "bold", "true"), ("nwCell", "fill", "FF0000")], "region string, prop string, value string")
    return tables.style_regions(cells, regions)


@query("""
WITH b AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'heading' WHEN role = 'user' THEN 'listItem' ELSE 'paragraph' END AS kind, replace(text, chr(10), ' ') AS inline FROM conversations),
p AS (SELECT conv_id, turn, kind, CASE kind WHEN 'heading' THEN '# ' || inline WHEN 'listItem' THEN '- ' || inline ELSE inline END AS piece FROM b),
g AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'listItem' AND lag(kind) OVER w = 'listItem' THEN chr(10) ELSE chr(10) || chr(10) END AS glue FROM p WHERE piece <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg(glue || piece, '' ORDER BY turn) AS markdown FROM g GROUP BY 1
""")
def md_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document: its first turn a heading, the user's turns list items, the others paragraphs."""
    kind = F.when(F.col("turn") == 0, F.lit("heading")).when(F.col("role") == "user", F.lit("listItem")).otherwise(F.lit("paragraph"))
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), text.escaped(F.col("text"), False).alias("inline"))
    level = F.when(F.col("kind") == "heading", 1).otherwise(0)
    piece = spans.block_markdown(F.col("kind"), level, F.lit(False), F.lit(None).cast("string"), F.col("inline"), F.lit(None).cast("string"))
    return spans.document_markdown(rows.withColumn("piece", piece), ["conv_id"], "turn")


@query("""
SELECT page_id, '<!-- Extracted from ' || url || ' by inkstrata. Best-effort Markdown. -->' || chr(10)
  || CASE WHEN contains(html, '<raw>') THEN '<!-- <raw>…</raw> marks content whose original structure could not be mapped; treat it as literal. -->' || chr(10) ELSE '' END || chr(10) AS header FROM pages
""")
def extract_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", text.extract_header(F.col("url"), F.col("html")).alias("header"))


@query("""
SELECT kind, lang, count(*) AS n FROM (SELECT lang, CASE WHEN trim(line) = '' THEN 'blank' WHEN contains(line, '|') THEN 'table' WHEN length(line) > 200 THEN 'paragraph' ELSE 'short' END AS kind FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1, 2
""")
def corpus_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    kind = F.when(F.trim("line") == "", F.lit("blank")).when(F.contains("line", F.lit("|")), F.lit("table")).when(F.length("line") > 200, F.lit("paragraph")).otherwise(F.lit("short"))
    return rows.select("lang", kind.alias("kind")).groupBy("kind", "lang").agg(F.count("*").alias("n"))


# --- budgets, pages, edits ------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT conv_id, turn, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, CAST(len AS INTEGER) AS len, CAST(before AS BIGINT) AS before FROM b WHERE before < 400
""")
def preview_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return sequences.budgeted(rows, ["conv_id"], "turn", "len", 400)


@query(f"""
WITH {LINES}, y AS (SELECT l_orderkey, line, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS height FROM lines)
SELECT l_orderkey, line, CAST(floor((top - 2.0) / 60.0 + 0.000001) AS INTEGER) AS page, CAST(greatest(1, ceil(height / 60.0)) AS INTEGER) AS n_pages FROM y
""")
def pages_for_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    top, height = F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)), F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", top.alias("top"), height.alias("height"))
    return rows.select("l_orderkey", "line", sequences.page_of(F.col("top"), 2.0, 60.0).alias("page"), sequences.page_count(F.col("height"), 60.0).alias("n_pages"))


@query(f"""
WITH {LINES}, m AS (SELECT *, sum(CASE WHEN line = 1 OR l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY line) AS grp FROM lines),
g AS (SELECT l_orderkey, grp, min(line) AS first_row, count(*) AS n_rows, sum(l_quantity) AS height FROM m GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY l_orderkey ORDER BY first_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM g),
r AS (SELECT *, 60.0 - (top - floor(top / 60.0) * 60.0) AS room FROM p)
SELECT l_orderkey, first_row, n_rows, height, top, height > room AS crosses, CASE WHEN height > room AND height <= 60 THEN room ELSE 0.0 END AS push FROM r
""")
def push_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbreakable row groups, and how far each is pushed to the next page in one round."""
    rows = lines_of(spark, sf_dir).withColumn("can_break", F.col("l_returnflag") == "N")
    groups = sequences.row_groups(rows, ["l_orderkey"], "line", "can_break", "l_quantity")
    return sequences.pushes(groups, ["l_orderkey"], "first_row", "height", 60.0).select("l_orderkey", "first_row", "n_rows", "height", "top", "crosses", "push")


@query(f"""
WITH RECURSIVE {LINES}, s(l_orderkey, line, h, top) AS (
  SELECT l_orderkey, line, l_quantity, CAST(0 AS DOUBLE) FROM lines WHERE line = 1
  UNION ALL
  SELECT n.l_orderkey, n.line, n.l_quantity, CASE WHEN 60 - (s.top + s.h) % 60 < n.l_quantity AND n.l_quantity <= 60 THEN s.top + s.h + 60 - (s.top + s.h) % 60 ELSE s.top + s.h END
  FROM s JOIN lines AS n ON n.l_orderkey = s.l_orderkey AND n.line = s.line + 1)
SELECT l_orderkey, CAST(line AS BIGINT) AS line, top, CAST(floor(top / 60) AS INTEGER) AS page FROM s
""")
def settled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir).select("l_orderkey", F.col("line").cast("long").alias("line"), "l_quantity")
    return sequences.settled(rows, "l_orderkey", "line", "l_quantity", 60.0)


@query("""
WITH e AS (SELECT c_nationkey AS doc, min(c_custkey) FILTER (WHERE c_custkey % 3 = 0) AS first, min(c_custkey) FILTER (WHERE c_custkey % 3 = 1) AS even, min(c_custkey) FILTER (WHERE c_custkey % 3 = 2) AS dflt FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey % 3 = 2 GROUP BY 1),
p AS (SELECT n_nationkey AS doc, unnest([0, 1, 2, 3]) AS page FROM nation)
SELECT doc, page, coalesce(CASE WHEN page = 0 THEN first END, CASE WHEN page % 2 = 1 THEN even END, dflt) AS entry FROM p JOIN e USING (doc) WHERE coalesce(CASE WHEN page = 0 THEN first END, CASE WHEN page % 2 = 1 THEN even END, dflt) IS NOT NULL
""")
def header_footer_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    applies = F.when(F.col("c_custkey") % 3 == 0, F.lit("first")).when(F.col("c_custkey") % 3 == 1, F.lit("even")).otherwise(F.lit("default"))
    entries = t(spark, sf_dir, "customer").where("c_nationkey % 2 = 0 or c_custkey % 3 = 2").groupBy(F.col("c_nationkey").alias("doc"), applies.alias("applies")).agg(F.min("c_custkey").alias("entry"))
    pages = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("page"))
    return sequences.picked_headers(pages, entries, ["doc"])


@query(f"""
WITH {LINES}, p AS (SELECT l_orderkey, line, l_returnflag, l_quantity, lag(l_returnflag) OVER w AS prev, lead(l_returnflag) OVER w AS next FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
SELECT l_orderkey, line, CASE WHEN prev = l_returnflag THEN 0.0 ELSE l_quantity END AS space_before, CASE WHEN next = l_returnflag THEN 0.0 ELSE l_quantity / 2 END AS space_after FROM p
""")
def contextual_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", "l_returnflag", F.col("l_quantity").alias("space_before"), (F.col("l_quantity") / 2).alias("space_after"))
    return sequences.contextual_spacing(rows, ["l_orderkey"], "line", "l_returnflag", "space_before", "space_after").drop("l_returnflag")


@query("""
WITH b AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT conv_id, turn, next || chr(10) || chr(10) || text AS swapped FROM b WHERE next IS NOT NULL
""")
def edit_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("\n\n").alias("gap"))
    return sequences.swapped_with_next(rows, ["conv_id"], "turn", "text", "gap").select("conv_id", "turn", "swapped")


@query("""
WITH o AS (SELECT conv_id, turn, length(text) AS len, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
n AS (SELECT *, lead(start) OVER w AS next, lag(start + len) OVER w AS prev_end FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(CASE WHEN next IS NOT NULL THEN start ELSE coalesce(prev_end, start) END AS BIGINT) AS cut_start, CAST(coalesce(next, start + len) AS BIGINT) AS cut_end FROM n
""")
def edit_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("long")
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"), start.alias("start"))
    return sequences.deletion_ranges(rows, ["conv_id"], "turn", "start", "len").select("conv_id", "turn", "cut_start", "cut_end")


@query("""
WITH g AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN chr(10) WHEN 1 THEN ' ' ELSE NULL END AS gap FROM conversations),
s AS (SELECT *, lag(gap) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM g)
SELECT conv_id, turn, text || coalesce(CASE WHEN contains(gap, chr(10)) THEN gap END, CASE WHEN contains(before, chr(10)) THEN before END, chr(10) || chr(10)) || 'new block' AS edited FROM s
""")
def edit_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.when(F.col("turn") % 3 == 0, F.lit("\n")).when(F.col("turn") % 3 == 1, F.lit(" "))
    rows = sequences.separator(t(spark, sf_dir, "conversations").withColumn("gap", gap), ["conv_id"], "turn", "gap")
    return rows.select("conv_id", "turn", F.concat("text", "separator", F.lit("new block")).alias("edited"))


@query("SELECT doc_id, 'edited' || substring(text, CAST(least(length(text), 10) + 1 AS BIGINT)) AS edited FROM documents")
def edit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.least(F.length("text"), F.lit(10))
    return t(spark, sf_dir, "documents").select("doc_id", sequences.replaced(F.col("text"), F.lit(0), size, F.lit("edited")).alias("edited"))


# --- layout, attributes, splices ------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS top, p_retailprice / 100 AS header, CAST(1 + p_size % 4 AS INTEGER) AS n_pages FROM part),
b AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE greatest(coalesce(top, 0.0) + 20.0, header + 15.0) + 24.0 END AS band FROM d)
SELECT p_partkey, page, band, page * (700.0 + band) AS top FROM (SELECT *, unnest(range(n_pages)) AS page FROM (SELECT p_partkey, n_pages, band FROM b))
""")
def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of each document with the band between them."""
    top = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    band = layout.band_height(top, F.lit(20.0), F.col("p_retailprice") / 100, F.lit(15.0), 24.0, F.col("p_partkey") % 7 != 0)
    rows = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("n_pages"), F.lit(700.0).alias("body"), band.alias("band"))
    return layout.sheets(rows, "n_pages", "body", "band").select("p_partkey", F.col("page").cast("long").alias("page"), "band", "top")


@query("""SELECT n_nationkey, n_name || ' — page ' || (n_nationkey + 1) || ' of ' || 25 AS running_head FROM nation""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = lambda text, field=None: F.struct(text.alias("text"), F.lit(field).cast("string").alias("field"))
    pieces = F.array(piece(F.col("n_name")), piece(F.lit(" — page ")), piece(F.lit("?"), "page"), piece(F.lit(" of ")), piece(F.lit("?"), "numpages"))
    return t(spark, sf_dir, "nation").select("n_nationkey", layout.with_page_fields(pieces, F.col("n_nationkey") + 1, F.lit(25)).alias("running_head"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 OR o_orderstatus = 'O' AS opens FROM orders),
s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sheet FROM p)
SELECT o_custkey, CAST(sheet AS BIGINT) AS sheet, min(o_orderkey) AS first_page, count(*) AS n_pages FROM s GROUP BY 1, 2
""")
def joined_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "O").alias("opened"))
    return layout.joined_sheets(pages, ["o_custkey"], "o_orderkey", "opened")


@query("""
WITH b AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), w AS (SELECT DISTINCT conv_id, unnest([1, 3, 50]) AS n FROM conversations)
SELECT conv_id, n, coalesce(min(turn) FILTER (WHERE turn + 1 >= n), max(turn)) AS target FROM w LEFT JOIN b USING (conv_id) GROUP BY 1, 2
""")
def line_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").withColumn("skip", F.col("role") != "user")
    wanted = rows.select("conv_id").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(50))))
    return layout.line_targets(rows, wanted, ["conv_id"], "turn", "skip")


@query(f"""
WITH {LINES}, s AS (SELECT l_orderkey, line, l_returnflag = 'R' AS bold, CASE WHEN l_linestatus = 'O' THEN '#' || l_suppkey END AS link, length(l_returnflag || l_partkey) AS len FROM lines),
o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT l_orderkey, 'bold' AS key, 'true' AS value, CAST(start AS BIGINT) AS start, CAST(start + len AS BIGINT) AS "end" FROM o WHERE bold
UNION ALL SELECT l_orderkey, 'link', link, CAST(start AS BIGINT), CAST(start + len AS BIGINT) FROM o WHERE link IS NOT NULL
""")
def attribute_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(spark, sf_dir).select("l_orderkey", "line", (F.col("l_returnflag") == "R").alias("bold"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("#"), F.col("l_suppkey").cast("string"))).alias("link"), F.length(F.concat("l_returnflag", F.col("l_partkey").cast("string"))).cast("long").alias("len"))
    return layout.attribute_intervals(rows, ["l_orderkey"], ["line"], "len", ["bold", "link"])


@query("""
WITH o AS (SELECT conv_id, turn, length(text) AS len, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
e AS (SELECT conv_id, 10 AS edit_at, 4 AS removed, 7 AS added FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0)
SELECT conv_id, turn, CAST(len AS BIGINT) AS len, CAST(CASE WHEN edit_at IS NOT NULL AND start > edit_at + removed THEN start + added - removed ELSE start END AS BIGINT) AS start,
       coalesce(start <= edit_at + removed AND start + len >= edit_at, false) AS touched FROM o LEFT JOIN e USING (conv_id)
""")
def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block ranges after an edit: later ones shift, touched ones render anew."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"), F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("long").alias("start"))
    edits = rows.select("conv_id").distinct().where("conv_id % 3 <> 0").select("conv_id", F.lit(10).alias("edit_at"), F.lit(4).alias("removed"), F.lit(7).alias("added"))
    return layout.spliced(rows, edits, ["conv_id"], "start", "len")


@query("""
WITH RECURSIVE l AS (SELECT conv_id, turn, CASE (turn + conv_id) % 7 WHEN 0 THEN '[' || turn || ']: http://x' WHEN 1 THEN '[b]: u "t"' WHEN 2 THEN '' WHEN 3 THEN 'prose' WHEN 4 THEN '```py' WHEN 5 THEN '[c]: v' ELSE '```' END AS line,
                           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s(conv_id, turn, k, fenced, free, hit) AS (
  SELECT conv_id, turn, k, starts_with(line, '`'), line = '' OR starts_with(line, '['), starts_with(line, '[') FROM l WHERE k = 1
  UNION ALL
  SELECT n.conv_id, n.turn, n.k, CASE WHEN s.fenced THEN n.line <> '```' ELSE starts_with(n.line, '`') END,
         CASE WHEN s.fenced THEN n.line = '```' WHEN starts_with(n.line, '`') THEN false WHEN starts_with(n.line, '[') THEN s.free ELSE n.line = '' END,
         NOT s.fenced AND s.free AND starts_with(n.line, '[')
  FROM s JOIN l AS n ON n.conv_id = s.conv_id AND n.k = s.k + 1)
SELECT conv_id, CAST(turn AS INTEGER) AS turn FROM s WHERE hit
""")
def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link definitions among blank lines, prose and fences."""
    kind = (F.col("turn") + F.col("conv_id")) % 7
    line = F.when(kind == 0, F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]: http://x"))).when(kind == 1, F.lit('[b]: u "t"')).when(kind == 2, F.lit("")).when(kind == 3, F.lit("prose")).when(kind == 4, F.lit("```py")).when(kind == 5, F.lit("[c]: v")).otherwise(F.lit("```"))
    rows = t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), line.alias("line"))
    return layout.definition_lines(rows, "conv_id", "turn", "line")


@query("""
WITH s AS (SELECT p_brand AS name, p_type AS prop, p_partkey AS priority, p_name AS value FROM part) SELECT name, prop, arg_min(value, priority) AS value FROM s GROUP BY 1, 2
""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("prop"), F.col("p_partkey").alias("priority"), F.col("p_name").alias("value"))
    return layout.first_wins(rows, ["name", "prop"], "priority", "value")


@query("""
WITH o AS (SELECT conv_id, turn, role, length(text) AS len, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
s AS (SELECT conv_id, start, start + 150 AS stop FROM o WHERE turn % 4 = 1)
SELECT o.conv_id, o.turn, (SELECT max(s.start) FROM s WHERE s.conv_id = o.conv_id AND s.start <= o.start) IS NOT NULL
  AND (SELECT max(s.start) FROM s WHERE s.conv_id = o.conv_id AND s.start <= o.start) + 150 >= o.start + o.len AS inside FROM o
""")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that lie wholly within a span."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("long").alias("start"), F.length("text").alias("len"))
    rows = rows.withColumn("end", F.col("start") + F.col("len"))
    held = rows.where("turn % 4 = 1").select("conv_id", "start", (F.col("start") + 150).alias("end"))
    return layout.contained(rows, held, ["conv_id"]).select("conv_id", "turn", F.col("span").isNotNull().alias("inside"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN event_id END AS mark FROM events)
SELECT user_id, mark, min(event_id) FILTER (WHERE event_type <> 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS span_at FROM e QUALIFY mark IS NOT NULL
""")
def pending_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark belongs to the next span that follows it: purchases as bookmarks, all other events as spans."""
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "purchase").alias("is_span"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("mark"))
    return layout.pending(rows, ["user_id"], "event_id", "is_span", "mark")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, CASE WHEN p_size % 5 = 0 THEN p_name END, CASE WHEN p_partkey % 2 = 0 THEN 'F2F2F2' END) AS fill,
       CAST(floor(coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, CASE WHEN p_size % 3 = 0 THEN 3.7 END, 7.0)) AS BIGINT) AS padding FROM part
""")
def cell_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's fill and padding: its own, its table's, its style's, the header's theme."""
    own = lambda n, c: F.when(F.col("p_size") % n == 0, c)
    fill = layout.background(own(2, F.col("p_brand")), own(3, F.col("p_type")), own(5, F.col("p_name")), F.col("p_partkey") % 2 == 0, "F2F2F2")
    return t(spark, sf_dir, "part").select("p_partkey", fill.alias("fill"), layout.padding(own(2, F.col("p_retailprice")), own(3, F.lit(3.7))).cast("long").alias("padding"))


SCRIPT_VALUES = ", ".join(f"({a}, '{c}')" for a, _, c in scripts.ranges())


@query(f"""
WITH r(a, class) AS (VALUES {SCRIPT_VALUES}), c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT lang, unicode(ch) AS cp, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT lang, class, CAST(sum(n) AS BIGINT) AS n FROM n ASOF JOIN r ON n.cp >= r.a GROUP BY 1, 2
""")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per language and script class, over the full Unicode table: distinct characters meet the ranges."""
    chars = text_units.char_counts(t(spark, sf_dir, "documents").select("lang", "text"), "text").withColumn("cp", F.ascii("ch"))
    return sequences.range_lookup(chars, scripts.range_table(spark), "cp", "class").groupBy("lang", "class").agg(F.sum("n").alias("n"))


# --- style values ---------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, ['none','double','dottedHeavy','dash','wavyDouble','words'][p_partkey % 6 + 1] AS u, ['start','end','both','center','left'][p_partkey % 5 + 1] AS a, p_partkey % 2 = 0 AS rtl, ['auto','exact','atLeast'][p_partkey % 3 + 1] AS rule, p_size FROM part)
SELECT p_partkey, CASE u WHEN 'none' THEN NULL WHEN 'double' THEN 'double' WHEN 'dottedHeavy' THEN 'dotted' WHEN 'dash' THEN 'dashed' WHEN 'wavyDouble' THEN 'wavy' ELSE 'single' END AS underline,
       CASE a WHEN 'center' THEN 'center' WHEN 'both' THEN 'justify' WHEN 'left' THEN 'left' WHEN 'start' THEN CASE WHEN rtl THEN 'right' ELSE 'left' END ELSE CASE WHEN rtl THEN 'left' ELSE 'right' END END AS alignment,
       CASE rule WHEN 'auto' THEN 'multiple' ELSE rule END AS mode, CASE rule WHEN 'auto' THEN p_size / 240.0 ELSE p_size / 20.0 END AS height FROM p
""")
def style_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % n + 1).cast("int"))
    height = styles.line_height(pick(("auto", "exact", "atLeast"), 3), F.col("p_size").cast("double"))
    return t(spark, sf_dir, "part").select("p_partkey", styles.underline(pick(("none", "double", "dottedHeavy", "dash", "wavyDouble", "words"), 6)).alias("underline"), styles.alignment(pick(("start", "end", "both", "center", "left"), 5), F.col("p_partkey") % 2 == 0).alias("alignment"), height["mode"].alias("mode"), height["value"].alias("height"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_partkey % 8 + 1 AS level, p_partkey % 3 = 0 AS paged, CASE WHEN p_partkey % 5 = 0 THEN 31.0 END AS own FROM part)
SELECT p_partkey, coalesce(own, CASE WHEN paged THEN size ELSE size * [1.875, 1.5, 1.25, 1.15, 1.0, 1.0][least(level, 6)] END) AS heading_size,
       CASE WHEN paged THEN size * 1.25 ELSE round(size * 1.25) END * CASE WHEN level = 2 THEN 0.7 ELSE 1.0 END AS span_size,
       CASE WHEN level = 1 THEN size * 0.35 WHEN level = 2 THEN size * -0.15 ELSE 0.0 END AS baseline, least(greatest(size + 1, 10), 36) AS reading_size,
       ['•', '◦', '▪'][level % 3 + 1] AS bullet, size + 3.0 - CASE WHEN paged THEN size ELSE 0.0 END AS first_indent FROM p
""")
def layout_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, level, paged = F.col("p_size").cast("double"), F.col("p_partkey") % 8 + 1, F.col("p_partkey") % 3 == 0
    return t(spark, sf_dir, "part").select(
        "p_partkey", styles.heading_size(level, F.when(F.col("p_partkey") % 5 == 0, F.lit(31.0)), size, paged).alias("heading_size"), styles.span_size(size, F.lit(1.25), paged, level == 2).alias("span_size"),
        styles.baseline(size, level == 1, level == 2).alias("baseline"), styles.reading_size(size, F.lit(1)).alias("reading_size"), styles.bullet(level, F.lit(None).cast("boolean")).alias("bullet"), styles.first_indent(size, F.lit(3.0), F.when(paged, size)).alias("first_indent"),
    )


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS a, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_brand END AS b, p_type AS c, p_partkey % 4 AS slot FROM part)
SELECT p_partkey, coalesce(nullif([a, b, c][slot + 1], ''), nullif(a, ''), nullif(b, ''), c) AS font, CASE WHEN p_partkey % 2 = 0 THEN a ELSE 'Times New Roman' END AS east_asian,
       upper(CASE slot WHEN 0 THEN '111111' WHEN 1 THEN 'eeeeee' WHEN 2 THEN 'abcdef' END) AS colour FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN coalesce(a, '') END AS q, a, b, c, slot FROM p)
""")
def font_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts by slot with their fallbacks, the East Asian rule, and theme colours."""
    a, b = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_name")), F.when(F.col("p_size") % 6 != 0, F.col("p_brand"))
    slot = (F.col("p_partkey") % 4).cast("int")
    scheme = F.create_map(F.lit("dk1"), F.lit("111111"), F.lit("lt1"), F.lit("EEEEEE"))
    name = F.when(slot == 0, F.lit("text1")).when(slot == 1, F.lit("background1")).otherwise(F.lit("accent9"))
    east = styles.east_asian_slot(F.lit("Times New Roman"), a, F.when(F.col("p_partkey") % 2 == 0, a).otherwise(F.lit("-")))
    return t(spark, sf_dir, "part").select("p_partkey", styles.slot_font(F.array(a, b, F.col("p_type")), slot, F.lit("fallback")).alias("font"), east.alias("east_asian"), styles.theme_colour(name, scheme, F.when(slot == 2, F.lit("abcdef")).otherwise(F.lit("auto"))).alias("colour"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, regexp_matches(line, '^ {0,3}#|^ {0,3}>|\||^ {0,3}(?:[-*_=][ \t]*)+$|^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]') AS interrupts, regexp_matches(line, '^ {0,3}(`{3,}|~{3,})') AS fence FROM l
""")
def paragraph_interrupts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.select("doc_id", "n", styles.interrupts_paragraph(F.col("line")).alias("interrupts"), F.col("line").rlike("^ {0,3}(`{3,}|~{3,})").alias("fence"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS top, max(l_extendedprice) AS bottom, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, min(top) AS top, max(bottom) AS bottom, max(l_linenumber) AS columns, CAST(sum(n) AS BIGINT) AS n_cells FROM r GROUP BY 1
""")
def table_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A laid-out table's top and bottom, over those of its rows, and its column count."""
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("top"), F.max("l_extendedprice").alias("bottom"), F.count("*").alias("n"))
    return rows.groupBy("l_orderkey").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max("l_linenumber").alias("columns"), F.sum("n").alias("n_cells"))


@query("""
SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars, max(CASE WHEN length(line) > 0 THEN length(line) END) AS longest, count(*) FILTER (WHERE trim(line) <> '') AS n_drawn
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1
""")
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: length of all blocks, the longest one, and how many draw something."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line")
    return rows.groupBy("doc_id").agg(F.sum(n).alias("n_chars"), F.max(F.when(n > 0, n)).cast("long").alias("longest"), F.count(F.when(styles.draws_something(F.col("line"), F.lit(False), F.lit("paragraph")), 1)).alias("n_drawn"))


# --- font slots -----------------------------------------------------------------------------------------------------

WORD_VALUES = ", ".join(f"({a}, {b}, '{p}', '{h}')" for a, b, p, h in slots.WORD_SLOTS)


def _distinct_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_units.char_counts(t(spark, sf_dir, "documents").select("text"), "text").withColumn("cp", F.ascii("ch"))


@query(f"""
WITH r(a, b, plain, hinted) AS (VALUES {WORD_VALUES}), c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT CASE WHEN unicode(ch) > 65535 THEN 'eastAsia' ELSE coalesce(plain, 'hAnsi') END AS slot, CASE WHEN unicode(ch) > 65535 THEN 'eastAsia' ELSE coalesce(hinted, 'hAnsi') END AS hinted_slot, CAST(sum(n) AS BIGINT) AS n
FROM n LEFT JOIN r ON unicode(ch) BETWEEN a AND b GROUP BY 1, 2
""")
def word_slot_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by the slot that Word takes their font from, without and with the East Asian hint."""
    rows = slots.looked_up(_distinct_chars(spark, sf_dir), slots.word_table(spark), "cp", ["plain", "hinted"])
    slot = lambda hint: slots.word_slot(F.col("cp"), F.col("plain"), F.col("hinted"), F.lit(hint))
    return rows.select(slot(False).alias("slot"), slot(True).alias("hinted_slot"), "n").groupBy("slot", "hinted_slot").agg(F.sum("n").alias("n"))


ODF_VALUES = ", ".join(f"({a}, {b}, '{c}')" for a, b, c in slots.ODF_TYPES)
_in = lambda blocks: " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in blocks)


@query(f"""
WITH s(a, class) AS (VALUES {SCRIPT_VALUES}), o(a, b, slot) AS (VALUES {ODF_VALUES}), c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents),
n AS (SELECT unicode(ch) AS cp, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1),
k AS (SELECT n.*, class, slot, class IN ('common', 'inherited', 'extend') AS soft FROM (SELECT n.*, s.class FROM n ASOF JOIN s ON n.cp >= s.a) AS n LEFT JOIN o ON cp BETWEEN o.a AND o.b)
SELECT CASE WHEN cp <= 32 OR cp BETWEEN 127 AND 159 OR (cp >= 128 AND soft) THEN NULL ELSE slot END AS odf,
       CASE WHEN soft THEN CASE WHEN {_in(slots.SYMBOL_BLOCKS)} THEN 'symbol' END ELSE CASE class WHEN 'hangul' THEN 'hangul' WHEN 'latin' THEN 'latin' WHEN 'han' THEN 'hanja' WHEN 'kana' THEN 'japanese' ELSE 'other' END END AS hangul,
       NOT ({_in(slots.PRIVATE)}) AND NOT soft AS eligible, CAST(sum(n) AS BIGINT) AS n
FROM k GROUP BY 1, 2, 3
""")
def slot_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by OpenDocument slot, Hangul slot and whether they may stand for a font."""
    rows = slots.looked_up(_distinct_chars(spark, sf_dir), slots.odf_table(spark), "cp", ["slot"])
    rows = sequences.range_lookup(rows, scripts.range_table(spark), "cp", "class")
    absorbs = scripts.absorbs(F.col("class"))
    odf, hangul = slots.odf_slot(F.col("cp"), F.col("slot"), absorbs), slots.hangul_slot(F.col("cp"), F.col("class"), absorbs)
    return rows.select(odf.alias("odf"), hangul.alias("hangul"), slots.sample_eligible(F.col("cp"), absorbs).alias("eligible"), "n").groupBy("odf", "hangul", "eligible").agg(F.sum("n").alias("n"))
