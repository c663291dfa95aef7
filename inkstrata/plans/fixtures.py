"""Documents built from table rows: what the reader queries read, so that SQL over the same rows knows the answer."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import kinds

Build = Callable[[int, list[dict]], bytes]

#: Rows whose documents one task builds and reads, as long as that makes no more tasks than MOST_TASKS.
TASK_ROWS, MOST_TASKS = 2_000, 2_048
#: Documents that a worker builds at once.
BUILT_AT_ONCE = 64


def dealt_by_count(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many partitions as their number asks for: by their bytes, which are few before the documents are built, the adaptive plan would merge them into
    a few tasks that do all the work."""
    return rows.repartition(max(1, min(MOST_TASKS, -(-rows.count() // TASK_ROWS))), key)


def built(rows: DataFrame, key: str, order: str, fields: list[str], ext: str, build: Build) -> DataFrame:
    """path (key.ext), content: a document per key from its rows in order."""
    groups = dealt_by_count(rows.select(key, order, *fields), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rows"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BUILT_AT_ONCE):
                keys, lists = (c.to_pylist() for c in batch.slice(at, BUILT_AT_ONCE).columns)
                made = [build(k, r) for k, r in zip(keys, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{k}.{ext}" for k in keys]), pa.array(made, pa.binary())], schema=schema)

    return groups.select(key, "rows").mapInArrow(run, "path string, content binary")


def as_files(contents: DataFrame) -> DataFrame:
    """With ext, kind and opens, as a scan of a folder has them."""
    ext = kinds.extension(F.col("path"))
    return contents.select("path", ext.alias("ext"), kinds.kind(ext).alias("kind"), kinds.opens(ext).alias("opens"), "content")


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


# conversations: the first turn is a heading, other turns of the user are list items, the rest paragraphs with a bold first word

RUN = '<w:r><w:rPr>{1}</w:rPr><w:t xml:space="preserve">{0}</w:t></w:r>'
STYLES = '<w:styles><w:style w:type="paragraph" w:styleId="Heading2"/><w:style w:type="paragraph" w:styleId="Top"><w:basedOn w:val="Heading2"/></w:style></w:styles>'
NUMBERING = '<w:numbering><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="8"><w:abstractNumId w:val="3"/></w:num></w:numbering>'


def depth(turn: int) -> int:
    return int((turn // 2 - 1) % 3 > 0)


def word_talk(key: int, rows: list[dict]) -> bytes:
    out = []
    for r in rows:
        text = escape(r["text"])
        if r["turn"] == 0:
            out.append(f'<w:p><w:pPr><w:pStyle w:val="Top"/></w:pPr>{RUN.format(text, "")}</w:p>')
        elif r["role"] == "user":
            out.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{depth(r["turn"])}"/><w:numId w:val="8"/></w:numPr></w:pPr>{RUN.format(text, "")}</w:p>')
        else:
            first, gap, rest = text.partition(" ")
            out.append(f'<w:p>{RUN.format(first, "<w:b/>")}<w:del>{RUN.format("gone", "")}</w:del>{RUN.format("hidden", "<w:vanish/>")}{RUN.format(gap + rest, "<w:i/>")}</w:p>')
    return zipped({"word/document.xml": f"<w:document><w:body>{''.join(out)}</w:body></w:document>", "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING})


ODT_STYLES = '<style:style style:name="B" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="I" style:family="text"><style:text-properties fo:font-style="italic"/></style:style><text:list-style style:name="L"><text:list-level-style-number text:level="1"/><text:list-level-style-bullet text:level="2"/></text:list-style>'


def odt_body(body: str, styles: str = ODT_STYLES) -> bytes:
    return zipped({"content.xml": f"<office:document-content><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def open_talk(key: int, rows: list[dict]) -> bytes:
    out = []
    for r in rows:
        text = escape(r["text"])
        if r["turn"] == 0:
            out.append(f'<text:h text:outline-level="2">{text}</text:h>')
        elif r["role"] == "user":
            item = f"<text:p>{text}</text:p>"
            out.append(f'<text:list text:style-name="L"><text:list-item>{f"<text:list><text:list-item>{item}</text:list-item></text:list>" if depth(r["turn"]) else item}</text:list-item></text:list>')
        else:
            first, gap, rest = text.partition(" ")
            out.append(f'<text:hidden-paragraph text:is-hidden="true">no</text:hidden-paragraph><text:p><text:span text:style-name="B">{first}</text:span><text:span text:style-name="I">{"<text:s/>" if gap else ""}{rest}</text:span></text:p>')
    return odt_body("".join(out))


def hangul_talk(key: int, rows: list[dict]) -> bytes:
    out: list[dict] = []
    for r in rows:
        text = r["text"]
        if r["turn"] == 0:
            out.append({"t": "para", "styleName": "개요 2", "spans": [{"text": text}]})
        elif r["role"] == "user":
            out.append({"t": "para", "list": {"level": depth(r["turn"]), "ordered": depth(r["turn"]) == 0, "marker": "-"}, "spans": [{"text": text}]})
        else:
            first, gap, rest = text.partition(" ")
            style = "각 절 제목" if r["turn"] % 4 == 3 else "표의 제목"
            out.append({"t": "para", "styleLocalName": style, "spans": [{"text": first, "bold": True}, {"text": gap + rest, "italic": True, "size": 1200}]})
    return json.dumps({"v": 1, "blocks": out}).encode()


def marked_talk(key: int, rows: list[dict]) -> bytes:
    out = []
    for r in rows:
        first, gap, rest = r["text"].partition(" ")
        out.append(f"## {r['text']}" if r["turn"] == 0 else f"- {r['text']}" if r["role"] == "user" else f"**{first}**{gap}{f'*{rest}*' if rest else ''}")
    return "\n\n".join(out).encode()


# customers: a table with a header and a row per order, whose first cell merges with equal ones above it


def word_orders(key: int, rows: list[dict]) -> bytes:
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{RUN.format(text, '')}</w:p></w:tc>"
    out, above = [f"<w:tr><w:trPr><w:tblHeader/></w:trPr>{cell('status')}{cell('order')}</w:tr>"], None
    for r in rows:
        merge = '<w:vMerge w:val="restart"/>' if r["o_orderstatus"] != above else "<w:vMerge/>"
        above = r["o_orderstatus"]
        wide = '<w:gridSpan w:val="2"/>' if r["o_orderkey"] % 3 == 0 else ""
        out.append(f"<w:tr>{cell(above, merge)}{cell(r['o_orderkey'], wide)}</w:tr>")
    return zipped({"word/document.xml": f"<w:document><w:body><w:tbl>{''.join(out)}</w:tbl></w:body></w:document>"})


def open_orders(key: int, rows: list[dict]) -> bytes:
    cell = lambda text, more="": f"<table:table-cell{more}><text:p>{text}</text:p></table:table-cell>"
    out = [f"<table:table-header-rows><table:table-row>{cell('status')}{cell('order')}</table:table-row></table:table-header-rows>"]
    for r in rows:
        k = r["o_orderkey"]
        row_times = f' table:number-rows-repeated="{k % 2 + 1}"' if k % 2 else ""
        out.append(f'<table:table-row{row_times}>{cell(r["o_orderstatus"], f""" table:number-columns-repeated="{k % 3 + 1}" """)}{cell(k, " table:number-columns-spanned=\'2\'")}<table:covered-table-cell/></table:table-row>')
    return odt_body(f"<table:table>{''.join(out)}</table:table>")


# parts: one paragraph with everything that a span may carry


def word_part(key: int, rows: list[dict]) -> bytes:
    r = rows[0]
    run = lambda inner, props="": f"<w:r><w:rPr>{props}</w:rPr>{inner}</w:r>"
    text = lambda t: f'<w:t xml:space="preserve">{escape(t)}</w:t>'
    field = lambda code, shown: run('<w:fldChar w:fldCharType="begin"/>') + run(f"<w:instrText>{code}</w:instrText>") + run('<w:fldChar w:fldCharType="separate"/>') + run(text(shown)) + run('<w:fldChar w:fldCharType="end"/>')
    body = (
        f'<w:p><w:bookmarkStart w:name="_GoBack"/><w:bookmarkStart w:name="b{key}"/><w:hyperlink r:id="r1">{run(text(r["p_brand"]), "<w:u w:val=\'single\'/>")}</w:hyperlink><w:hyperlink w:anchor="a{key}">{run(text("jump"))}</w:hyperlink>'
        f'<w:commentRangeStart w:id="{key}"/>{run(text(r["p_name"]), "<w:color w:val=\'FF0000\'/><w:sz w:val=\'21\'/>")}<w:commentRangeEnd w:id="{key}"/>{run("<w:footnoteReference w:id=\'4\'/>")}{run("<w:endnoteReference w:id=\'2\'/>")}'
        f'{run("<w:tab/>", "<w:strike/>")}{run("<w:sym w:font=\'Wingdings\' w:char=\'F06E\'/>", "<w:i/>")}{field(" PAGE ", "1")}{run(text("x2"), "<w:vertAlign w:val=\'superscript\'/>")}</w:p>'
    )
    note = lambda kind, id_, t: f'<w:{kind}s><w:{kind} w:id="0" w:type="separator"><w:p/></w:{kind}><w:{kind} w:id="{id_}"><w:p>{run(text(t))}</w:p></w:{kind}></w:{kind}s>'
    rels = f'<Relationships><Relationship Id="r1" Target="http://x/{key}" TargetMode="External"/></Relationships>'
    return zipped({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/footnotes.xml": note("footnote", 4, r["p_type"]), "word/endnotes.xml": note("endnote", 2, "end")})


def word_pages(key: int, rows: list[dict]) -> bytes:
    """A document per part with comments, running heads and page geometry."""
    r = rows[0]
    w, margin = 8000 + 20 * r["p_size"], 20 * (r["p_size"] % 40)
    sect = f'<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:titlePg/><w:pgSz w:w="{w}" w:h="15840"/><w:pgMar w:left="{margin}" w:right="{margin}" w:top="1440" w:bottom="720" w:header="720" w:footer="720"/></w:sectPr>'
    p = lambda t: f"<w:p>{RUN.format(escape(t), '')}</w:p>"
    comments = f'<w:comments><w:comment w:id="3" w:author="A">{p("late")}</w:comment><w:comment w:id="7" w:author="B" w:date="2024-01-01T00:00:00Z">{p(r["p_name"])}{p(r["p_type"])}</w:comment></w:comments>'
    parts = {"word/comments.xml": comments, "word/header1.xml": f"<w:hdr>{p(r['p_brand'])}</w:hdr>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="h" Target="header1.xml"/></Relationships>'}
    parts["word/styles.xml"] = f'<w:styles><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="{r["p_size"] + 1}"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>'
    return zipped({"word/document.xml": f'<w:document><w:body><w:p><w:commentRangeStart w:id="7"/></w:p>{sect}</w:body></w:document>', **parts})


def picture(kind: int, w: int, h: int) -> bytes:
    """The head of a picture file: PNG, GIF, BMP, JPEG behind a long segment, or one of the kinds that viewers don't show."""
    match kind:
        case 0:
            return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"rest"
        case 1:
            return b"GIF89a" + struct.pack("<HH", w, h) + b"rest"
        case 2:
            return b"BM" + bytes(16) + struct.pack("<ii", w, -h) + bytes(8)
        case 3:
            return b"\xff\xd8\xff\xe1" + struct.pack(">H", 65_000) + bytes(64_998) + b"\xff\xe2" + struct.pack(">H", 9_000) + bytes(8_998) + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", h, w) + bytes(12)
        case 4:
            return bytes.fromhex("D7CDC69A") + bytes(20)
        case 5:
            return bytes.fromhex("01000000") + bytes(36) + b" EMF"
        case 6:
            return b"\n <?xml version='1.0'?><svg width='1'/>"
        case 7:
            return bytes.fromhex("D0CF11E0A1B11AE1")
        case _:
            return bytes.fromhex("0A05") + bytes(9)


def math(kind: int, a: str, b: str) -> str:
    """An office math element."""
    r = lambda t: f"<m:r><m:t>{escape(t)}</m:t></m:r>"
    match kind:
        case 0:
            return f"<m:f><m:num>{r(a)}</m:num><m:den>{r(b)}</m:den></m:f>"
        case 1:
            return f"<m:sSubSup><m:e>{r('x')}</m:e><m:sub>{r(a)}</m:sub><m:sup>{r(b)}</m:sup></m:sSubSup>"
        case 2:
            return f"<m:rad><m:deg>{r(a)}</m:deg><m:e>{r(b)}</m:e></m:rad>"
        case 3:
            return f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r(a)}</m:sub><m:sup/><m:e>{r(b)}</m:e></m:nary>"
        case 4:
            return f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val='}}'/></m:dPr><m:e>{r(a)}</m:e><m:e>{r(b)}</m:e></m:d>"
        case 5:
            return f"<m:func><m:fName>{r('sin')}</m:fName><m:e>{r(a)}</m:e></m:func><m:acc><m:e>{r(b)}</m:e></m:acc>"
        case _:
            return ""


def word_math(key: int, rows: list[dict]) -> bytes:
    r = rows[0]
    body = f"<w:p><m:oMathPara><m:oMath>{math(key % 7, r['a'], r['b'])}</m:oMath></m:oMathPara></w:p>"
    return zipped({"word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"})


def coded(text: str, kind: int) -> tuple[bytes, str]:
    """A text in one of the encodings that the cascade tells apart, and that one's name."""
    name = ("utf-8", "utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "cp949")[kind]
    if kind == 5:
        return ("한글 " + "".join(c for c in text if c.isascii())).encode(name), name
    return (text if kind == 0 else "\ufeff" + text).encode(name), name
