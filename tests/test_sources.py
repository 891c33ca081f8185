import io
import zipfile

from folioflow.sources import files

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
SLIDE = '<p:sld xmlns:p="x" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Slide {}</a:t></a:r></a:p></p:sld>'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_files_are_parsed_by_type(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.md").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.docx").write_bytes(archive(**{"word__document.xml": DOCX}))
    (tmp_path / "d.pptx").write_bytes(archive(**{f"ppt__slides__slide{i}.xml": SLIDE.format(i) for i in (1, 2, 10)}))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.xyz").write_bytes(b"?")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "naïve" and got["b.md"]["text"] == "中文"
    assert got["c.docx"]["text"] == "Hello\na\tb"
    assert got["d.pptx"]["text"] == "[幻灯片 1]\nSlide 1\n\n[幻灯片 2]\nSlide 2\n\n[幻灯片 3]\nSlide 10"
    assert got["e.docx"]["error"].startswith("BadZipFile") and got["f.xyz"]["error"] == "unsupported file type xyz"
    more = files.read_files(spark, str(tmp_path), {"xyz": lambda b: b.decode()}).filter("extension = 'xyz'").first()
    assert more["text"] == "?"


def test_append_missing_is_idempotent(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 3 AS v")
    for _ in range(2):
        files.append_missing(df, f"{tmp_path}/t", ["id"])
    files.append_missing(spark.range(5, 15).selectExpr("id", "0L AS v"), f"{tmp_path}/t", ["id"])
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.count() == 15 and got.filter("id < 10").agg({"v": "sum"}).first()[0] == 9


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_docx_sections_inherit_headers():
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    section = '<w:sectPr><w:headerReference w:type="{}" r:id="{}"/></w:sectPr>'
    body = f"<w:document {WORD}><w:body>{p('one<w:tab/>')}<w:p><w:pPr>{section.format('default', 'h1')}</w:pPr></w:p>{p(' ')}<w:p><w:pPr>{section.format('first', 'h2')}</w:pPr></w:p>{p('two')}</w:body></w:document>".replace("<w:t>one<w:tab/></w:t>", "<w:t>one</w:t><w:tab/><w:t>1</w:t>")
    links = '<R><Relationship Id="h1" Target="header1.xml"/><Relationship Id="h2" Target="header2.xml"/></R>'
    parts = {"[Content_Types].xml": "<T/>", "word/_rels/document.xml.rels": links, "word/document.xml": body, "word/header1.xml": f"<w:hdr {WORD}>{p('top')}</w:hdr>", "word/header2.xml": f"<w:hdr {WORD}>{p('first page')}</w:hdr>"}
    pack = lambda d: archive(**{k.replace("/", "__"): v for k, v in d.items()})
    assert files.docx_text(pack(parts)) == "one\t1\ntwo\ntop\ntop"
    without = {k: v for k, v in parts.items() if k != "word/header1.xml"}  # its link leads nowhere: read as it stands
    assert files.docx_text(pack(without)) == "one\t1\ntwo\nfirst page"


def test_blobs_without_content_or_type_are_errors(spark):
    rows = [("a.txt", None), ("b", b"x"), (None, b"x"), ("c.TXT", b"up")]
    got = {r["path"]: (r["text"], r["error"]) for r in files.parse(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"] == ("", None) and got["c.TXT"] == ("up", None) and got["b"][1].startswith("unsupported") and got[None][1].startswith("unsupported")
    assert files.parse(spark.createDataFrame([], "path string, content binary")).collect() == []
