"""Documents as files of several encodings and formats, stored as a table of (path, content) and parsed from it."""

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from folioflow.plans.extracts import sql_trim
from folioflow.plans.registry import query
from folioflow.sources import files as S
from folioflow.sources import tables as T
from folioflow.sources.batches import by_row

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h" Target="header1.xml"/><Relationship Id="f" Target="footer1.xml"/></Relationships>'


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def paragraph(text: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def docx(text: str, lang: str, source: str, doc_id: int) -> bytes:
    """A table, a paragraph for each line, a header and a footer; every fourth package lacks its list of types."""
    table = f"<w:tbl><w:tr>{''.join(f'<w:tc>{paragraph(c)}</w:tc>' for c in (lang, '', source))}</w:tr></w:tbl>"
    ends = '<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
    body = f"<w:document {WORD}><w:body>{table}{''.join(map(paragraph, text.split(chr(10))))}{ends}</w:body></w:document>"
    parts = {"[Content_Types].xml": "<Types/>", "word/_rels/document.xml.rels": LINKS, "word/document.xml": body}
    parts |= {"word/header1.xml": f"<w:hdr {WORD}>{paragraph(f'No. {doc_id}')}</w:hdr>", "word/footer1.xml": f"<w:ftr {WORD}>{paragraph('end')}</w:ftr>"}
    if doc_id % 4 == 3:
        del parts["[Content_Types].xml"]
    return zipped(parts)


def pptx(text: str) -> bytes:
    """A slide for each line."""
    slide = '<p:sld xmlns:p="x" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    return zipped({f"ppt/slides/slide{i}.xml": slide.format(escape(x)) for i, x in enumerate(text.split(chr(10)), 1)})


def stored(t, name, make):
    """The files that `make` builds of the rows (doc_id, text, lang, source): (extension, bytes); written as a table and read again."""

    def rows(i, text, lang, source):
        ext, data = make(i, text, lang, source)
        yield f"{i}.{ext}", data

    schema = "path string, content binary"
    found = t.documents.select("doc_id", "text", "lang", "source")
    return T.refresh(found.mapInArrow(by_row(rows, schema), schema), T.fresh_path(t.spark, name))


def numbered(df):
    return df.select(F.split_part("path", F.lit("."), F.lit(1)).cast("bigint").alias("doc_id"), "extension", "text", "error")


ENCODINGS = ("utf-8", "utf-8-sig", "gb18030")


@query("src5_encodings", "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN chr(65279) || text ELSE text END AS text FROM documents")
def src5(t):
    """Texts in three encodings, tried in turn; the first that fits a byte order mark keeps it as a character."""
    made = stored(t, "encoded", lambda i, text, lang, source: ("txt" if i % 2 else "md", text.encode(ENCODINGS[i % 3])))
    return numbered(S.parse(made)).select("doc_id", "text")


LINES = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> ''), chr(10))"
DOCX = f"CASE WHEN doc_id % 4 = 3 THEN concat_ws(chr(10), lang || chr(9) || source, nullif({LINES}, ''), 'No. ' || doc_id, 'end') ELSE concat_ws(chr(10), nullif({LINES}, ''), lang || chr(9) || source, 'No. ' || doc_id, 'end') END"
SLIDES = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN {sql_trim('x')} <> '' THEN '[幻灯片 ' || i || ']' || chr(10) || {sql_trim('x')} END), lambda x: x IS NOT NULL), chr(10) || chr(10))"


@query("src8_docx", f"SELECT doc_id, {DOCX} AS text FROM documents")
def src8(t):
    """Paragraphs, tables, headers and footers; packages that aren't complete are read as they stand."""
    return numbered(S.parse(stored(t, "docx", lambda i, text, lang, source: ("docx", docx(text, lang, source, i))))).select("doc_id", "text")


@query("src9_pptx", f"SELECT doc_id, {SLIDES} AS text FROM documents")
def src9(t):
    return numbered(S.parse(stored(t, "pptx", lambda i, text, lang, source: ("pptx", pptx(text))))).select("doc_id", "text")


@query("udf3_parsers", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'docx' WHEN 2 THEN 'rev' WHEN 3 THEN 'xyz' ELSE 'pptx' END AS extension, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN {DOCX} WHEN 2 THEN reverse(text) END AS text, CASE doc_id % 5 WHEN 3 THEN 'unsupported file type xyz' WHEN 4 THEN 'BadZipFile: File is not a zip file' END AS error FROM documents")
def udf3(t):
    """A parser a file type, one of them plugged in; unknown types and broken files are rows with an error."""

    def make(i, text, lang, source):
        return (("json", text.encode()), ("docx", docx(text, lang, source, i)), ("rev", text.encode()), ("xyz", b""), ("pptx", b"broken"))[i % 5]

    return numbered(S.parse(stored(t, "mixed", make), {"rev": lambda data: data.decode()[::-1]}))
