"""File sources: Spark reads the bytes wherever they lie, a small helper parses one file."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.batches import by_row

# Encodings tried in turn (the last one never fails), and what stands above a slide's text.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "latin-1")
SLIDE = "[幻灯片 {}]"
PARSED = "path string, extension string, size bigint, sha256 string, text string, error string"
PLAIN = ("txt", "md", "markdown", "py", "json")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def decode(data: bytes) -> str:
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode(ENCODINGS[-1])


def words_of(element: ElementTree.Element) -> str:
    """The text below an element; tabs and breaks are kept."""
    held = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{W}t" else held.get(e.tag, "") for e in element.iter()).strip()


def row_lines(table: ElementTree.Element) -> list[str]:
    """A line for each row with text, its cells joined by tabs."""
    rows = [["\n".join(filter(None, map(words_of, cell.iterfind(f"{W}p")))) for cell in row.iterfind(f"{W}tc")] for row in table.iterfind(f"{W}tr")]
    return ["\t".join(filter(None, row)) for row in rows if any(row)]


def lines_of(root: ElementTree.Element) -> list[str]:
    """Paragraphs and table rows as they stand."""
    body = root.find(f"{W}body")
    lines = []
    for e in root if body is None else body:
        lines += [words_of(e)] if e.tag == f"{W}p" else row_lines(e) if e.tag == f"{W}tbl" else []
    return [x for x in lines if x]


def margins(package: zipfile.ZipFile, body: ElementTree.Element) -> list[str]:
    """Lines of each section's header, then footer; a section without one of its own has that of the section before."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(package.read("word/_rels/document.xml.rels"))}
    held, out = {}, []
    for section in body.iter(f"{W}sectPr"):
        for kind in ("header", "footer"):
            named = [e.get(f"{R}id") for e in section.iterfind(f"{W}{kind}Reference") if e.get(f"{W}type", "default") == "default"]
            if named:
                root = ElementTree.fromstring(package.read(f"word/{links[named[0]]}"))
                held[kind] = [x for x in map(words_of, root.iterfind(f"{W}p")) if x]
            out += held.get(kind, [])
    return out


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with tab-joined cells, then the sections' headers and footers.

    A package that lacks its list of types or its links is read part by part as it stands, headers and footers last.
    """
    package = zipfile.ZipFile(io.BytesIO(data))
    names = package.namelist()
    root = ElementTree.fromstring(package.read("word/document.xml"))
    body = root.find(f"{W}body")
    if body is not None and {"[Content_Types].xml", "word/_rels/document.xml.rels"} <= set(names):
        try:
            plain = [x for x in map(words_of, body.iterfind(f"{W}p")) if x]
            tables = [line for table in body.iterfind(f"{W}tbl") for line in row_lines(table)]
            return "\n".join([*plain, *tables, *margins(package, body)])
        except (KeyError, ElementTree.ParseError):
            pass  # a link leads nowhere
    more = [n for n in names if re.fullmatch(r"word/(header|footer)[^/]*\.xml", n.lower())]
    return "\n".join(line for part in [root, *(ElementTree.fromstring(package.read(n)) for n in more)] for line in lines_of(part))


def pptx_text(data: bytes) -> str:
    """The slides with text, each under its number, a line for each paragraph that isn't blank."""
    deck = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in deck.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    pages = []
    for i, (_, name) in enumerate(slides, 1):
        lines = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in ElementTree.fromstring(deck.read(name)).iter(f"{A}p")]
        if any(lines):
            pages.append("\n".join([SLIDE.format(i), *filter(None, lines)]))
    return "\n\n".join(pages)


PARSERS = {**dict.fromkeys(PLAIN, decode), "docx": docx_text, "pptx": pptx_text}


def parse(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """(path, extension, size, sha256, text, error) of each row (path, content); a parser a file type, others are errors.

    parsers adds or replaces helpers of bytes -> text, such as one for PDF or recognition of images.
    """
    chosen = {**PARSERS, **(parsers or {})}

    def rows(path, ext, size, digest, data):
        try:
            yield path, ext, size, digest, chosen[ext](data), None
        except KeyError as e:
            yield path, ext, size, digest, None, f"unsupported file type {ext}" if ext not in chosen else f"KeyError: {e}"
        except Exception as e:  # a broken file is a row with an error, not a lost job
            yield path, ext, size, digest, None, f"{type(e).__name__}: {e}"

    found = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"), F.coalesce("content", F.lit(b"")).alias("content"))
    return found.mapInArrow(by_row(rows, PARSED), PARSED)


def read_files(spark: SparkSession, path: str, parsers: dict | None = None) -> DataFrame:
    """parse() of all files below a folder, wherever Spark can read; a task holds a file at a time whole."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), parsers)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Idempotent append: rows whose keys aren't stored yet, each key once."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)


def write_json_by(df: DataFrame, key: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)
