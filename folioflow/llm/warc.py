"""WARC archives: a writer with revisit records and a salvaging reader.

Writing goes through Spark's own text writer, so it reaches any file system: a row is one gzip
member less its last byte, which is zero for members of under 16 MiB, and the "line separator" is
that zero byte. The files are ordinary archives of a gzip member per record; a longer record is
spread over several members.

Reading takes each file whole and walks it. A record must be complete, end in two line ends and
match its digests, a member its checksum. After a failed check the reader searches on for the next
member or version line that is valid, goes on from there, and logs the bytes between as a gap. Inside
a member it does the same with the bytes inflated, up to where inflating fails: valid records on both
sides of the damage are kept. A gap inside a member has the member's offset and length, and the place
among the inflated bytes in its reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = (1 << 24) - 1
UNFINISHED = ("truncated record", "no end of record", "no end of header")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def decided(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT, most: int = 1000) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type and refers_to.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is the
    response; rows that repeat that page_id are responses too. Payloads are equal if their length and
    both digests, SHA-1 and SHA-256, are. A null html is an empty payload; a null page_id refers to
    the response like others, and is a response where all of a payload's are null. Other columns,
    whatever their names, are left out. A row per payload that occurs again is pre-aggregated and
    written. Payloads with more than one in `most` of all such rows are broadcast (at most `most`
    rows), so their pages stay where they lie; only the other rows of at least `least` bytes meet by
    digest, and the rest is dealt at random.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    same = F.concat_ws(":", "payload_digest", "payload_bytes", "sha256")
    again = rows.filter(F.col("payload_bytes") >= least).groupBy(same.alias("_k")).agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("n"))
    again = scratch.save(again.filter("n > 1"), "again", keep=True)
    hot = F.col("n") * most > (again.agg(F.sum("n")).first()[0] or 0)
    few = again.filter(hot).select("_k", F.col("_top").alias("_hot"), F.lit(True).alias("_found"))
    held = rows.withColumn("_key", F.when(F.col("payload_bytes") >= least, same)).join(F.broadcast(few), F.col("_key") == F.col("_k"), "left").drop("_k")
    # rows that need no other are spread; a seeded rand is the same again when a lost task is repeated
    meets = F.when(F.col("_found").isNull() & F.col("_key").isNotNull(), F.col("_key")).otherwise(F.rand(11).cast("string"))
    joined = held.withColumn("_key", meets).join(again.filter(~hot).select("_k", "_top"), F.col("_key") == F.col("_k"), "left")
    top = F.coalesce("_hot", "_top")
    revisit = top.isNotNull() & ~F.col("page_id").eqNullSafe(top)
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, top).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    block = HTTP + payload if kind == "response" else HTTP
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(batches):
    """mapInArrow over the columns of decided(): each record's members, less the last byte."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                data = record(*row)
                out.append(b"".join(gzip_member(data[i : i + MEMBER]) for i in range(0, len(data), MEMBER))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, records_in_file: int = 4000) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzip-compressed WARC files in path."""
    scratch = Scratch(pages.sparkSession, "warc-again")
    lines = decided(pages, scratch).mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", "\x00").option("maxRecordsPerFile", records_in_file).text(path)
    scratch.drop(scratch.path)


class Broken(Exception):
    pass


def same_digest(labelled: str, data: bytes) -> bool:
    kind, _, value = labelled.partition(":")
    if kind.lower() != "sha1":
        return True
    digest = hashlib.sha1(data)
    return value.lower() == digest.hexdigest() or value.upper() == base64.b32encode(digest.digest()).decode()


def plain_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record at a version line: its end, header fields and block."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("no end of header")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Broken("no length")
    start = stop + 4
    end = start + int(fields["content-length"])
    if end > len(data):
        raise Broken("truncated record")
    block = data[start:end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("no end of record")
    if "warc-block-digest" in fields and not same_digest(fields["warc-block-digest"], block):
        raise Broken("block digest")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and not same_digest(fields["warc-payload-digest"], payload_of(fields, block)):
        raise Broken("payload digest")
    return end + 4, fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def inflate(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The gzip member at `at`: its end, content and, if it is damaged, why; then as much as could be inflated, and the end is unknown."""
    unpack, out, fed = zlib.decompressobj(31), [], at
    while not unpack.eof:
        if fed >= len(data):
            return fed, b"".join(out), "truncated member"
        piece, fed = data[fed : fed + 65536], min(fed + 65536, len(data))
        before = unpack.copy()
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            for i in range(0, len(piece)):  # byte by byte: what comes before the fault counts
                try:
                    out.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    break
            return fed, b"".join(out), "member checksum or format"
    return fed - len(unpack.unused_data), b"".join(out), ""


def is_whole(data: bytes, at: int) -> bool:
    try:
        plain_record(data, at)
    except Broken:
        return False
    return True


def finished(data: bytes, end: int, inner: bytes, pos: int) -> tuple[int, bytes] | None:
    """The end and content of the members up to that which ends the record at inner[pos:], if they do."""
    while data.startswith(b"\x1f\x8b", end):
        end, more, fault = inflate(data, end)
        if fault:
            return None
        inner += more
        try:
            plain_record(inner, pos)
            return end, inner
        except Broken as why:
            if str(why) not in UNFINISHED:
                return None
    return None


def parse(data: bytes, at: int) -> tuple[int | None, list[tuple[dict[str, str], bytes]], list[str]]:
    """What starts at `at`: its end (None if a damaged member hides it), records and gaps inside.

    A record that one member breaks off goes on in the next.
    """
    if data.startswith(b"WARC/", at):
        end, fields, block = plain_record(data, at)
        return end, [(fields, block)], []
    if not data.startswith(b"\x1f\x8b", at):
        raise Broken("neither a member nor a version line")
    end, inner, fault = inflate(data, at)
    found, gaps, pos = [], [], 0
    while pos < len(inner):
        try:
            pos, fields, block = plain_record(inner, pos)
            found.append((fields, block))
            continue
        except Broken as why:
            reason = str(why)
        if not fault and reason in UNFINISHED and len(inner) - pos >= MEMBER - (1 << 16) and (longer := finished(data, end, inner, pos)):
            end, inner = longer
            continue
        start, pos = pos, next((m.start() for m in VERSION.finditer(inner, pos + 1) if is_whole(inner, m.start())), len(inner))
        gaps.append((start, pos, fault if fault and pos == len(inner) else reason))
    if fault and not (gaps and gaps[-1][1] == len(inner)):
        gaps.append((len(inner), len(inner), fault))
    if gaps and not found:
        raise Broken(gaps[0][2])
    return None if fault else end, found, [f"{reason}: bytes {a} to {b} of the member" for a, b, reason in gaps]


def next_valid(data: bytes, at: int) -> int:
    """The next member or version line at or after `at` from which something can be read; else the end."""
    for m in START.finditer(data, at):
        try:
            parse(data, m.start())
        except Broken:
            continue
        return m.start()
    return len(data)


def walk(data: bytes):
    """(offset, length, records, "") for what is valid, (offset, length, [], reason) for each gap."""
    pos = 0
    while pos < len(data):
        try:
            end, found, gaps = parse(data, pos)
        except Broken as why:
            after = next_valid(data, pos + 1)
            yield pos, after - pos, [], str(why)
            pos = after
            continue
        if end is None:
            end = next_valid(data, pos + 2)
        yield pos, end - pos, found, ""
        for reason in gaps:
            yield pos, end - pos, [], reason
        pos = end


READ = "file string, offset bigint, length bigint, reason string, record_type string, record_id string, url string, refers_to string, payload binary, payload_digest string, payload_bytes bigint"
NAMES = [x.split()[0] for x in READ.split(", ")]
TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string(), pa.int64()]


def salvage(batches):
    """mapInArrow over (file, content)."""
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            file, rows, held = file.as_py(), [], 0
            for offset, length, found, reason in walk(content.as_py()):
                if reason:
                    rows.append((file, offset, length, reason, *[None] * 7))
                for fields, block in found:
                    kind = fields.get("warc-type", "")
                    payload = payload_of(fields, block) if kind != "revisit" else None
                    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
                    size = len(payload) if payload is not None else int(fields.get("warc-payload-length", 0))
                    rows.append((file, offset, length, None, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), payload, digest, size))
                    held += len(block)
                if len(rows) >= 500 or held > 1 << 23:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows for the records of the archives in path, and for the gaps (reason is not null) between them.

    Files are read whole, each by one task: up to 2 GB, and best a few tens of MB. An empty file gives
    no rows.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select(F.col("path").alias("file"), "content").mapInArrow(salvage, READ)


def records_of(archives: DataFrame) -> DataFrame:
    return archives.filter("reason is null")


def gaps_of(archives: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, length and the check that failed first."""
    return archives.filter("reason is not null").select("file", "offset", "length", "reason")


def page_number(column: str):
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = records_of(read_archives(spark, path))
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.lower("payload_digest"))
    return read.select(page_number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page_number("refers_to").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
