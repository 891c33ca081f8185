"""Secret scans: patterns, and zstandard novelty of strings in a sensitive context.

A candidate is a long run of key-like characters soon after a word such as "key" or "bearer". Its
marginal cost is what it adds to the compressed size of the text around it, under a raw dictionary
of common identifiers and code: words and names that fit the surroundings cost little, random
material costs about its own entropy. Every candidate is measured, whatever its characters, with
copies of it in the surroundings masked; where it stands partly in a pattern's span, the rest beside
an assignment, or the whole run around other spans. Candidates whose cost per character reaches the threshold are
reported as kind "novel", beside the patterns' spans. Digits or letters of one case cannot cost so much;
a run of these is reported if it costs most of its alphabet's entropy, and no less than the same characters shuffled.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import text_or_empty, worker_cache

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these must stand in a text for ASSIGN to match.
NAMED = re.compile(r"[dDtTnNyY][\"']?\x20*[:=]")
# Words that make their surroundings sensitive.
SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|api|key|auth|bearer|credential|private|signature|cookie|session", re.IGNORECASE | re.ASCII)
NAME = re.compile(r"[A-Za-z0-9_-]{0,15}=")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Runs of few kinds of characters, and how many there are of each kind.
NARROW = [(re.compile("[0-9]+"), 10), (re.compile("[a-z]+"), 26), (re.compile("[A-Z]+"), 26), (re.compile("[a-z0-9]+"), 36), (re.compile("[A-Z0-9]+"), 36)]
# Identifiers and code that primes the dictionary.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 access_token refresh_token client_id client_secret
api_key apiKey API_KEY secret_key SECRET_KEY access_key AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY private_key public_key
password passwd username user_name database connection_string authorization Authorization: Bearer Basic session_id cookie
application/json content-type Content-Type x-api-key https://www.example.com/api/v1/users?id= http://localhost:8080/
import from return function const let var public private static final void string integer boolean true false null None
self. this. def class if else elif for while try except finally raise throw new delete update insert select where group
getElementById addEventListener toString hashCode equals println console.log logger.info logging.getLogger __init__ __main__
BEGIN PUBLIC KEY END CERTIFICATE REQUEST example placeholder changeme your-key-here your_token_here xxxxxxxxxxxxxxxx
configuration environment development production staging testing document identifier description parameters response request
"""


def novelty(text: str, start: int, end: int, before: int = 512, after: int = 256) -> float:
    """Marginal compressed bytes per character of text[start:end] amid its surroundings."""
    import zstandard

    cache = worker_cache()
    if "zstd" not in cache:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        cache["zstd"] = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
    pack = cache["zstd"]
    run, size = text[start:end], end - start
    left, right = text[max(0, start - before - size) : start], text[end : end + after + size]
    # a key that occurs again close by is no less a key: its copies, also under another name, are masked
    for copy in [run, *[x for x in run.split("=") if 16 <= len(x) < size]]:
        left, right = left.replace(copy, " " * len(copy)), right.replace(copy, " " * len(copy))
    left, right = left[-before:].encode(), right[:after].encode()
    whole = len(pack.compress(left + run.encode() + right))
    return (whole - len(pack.compress(left + right))) / size


def incompressible(text: str, start: int, end: int, threshold: float, share: float = 0.9, order: float = 0.9, shuffles: int = 4) -> bool:
    """Whether text[start:end] costs the threshold; a run of a narrow alphabet, as much as random characters of it do.

    The latter: at least `share` of the alphabet's entropy, and at least `order` of the mean cost of its
    characters in another order, so that what words, dates or counting save tells. A rare long word, or a
    date without other text around it, costs as much as random characters do, and is reported.
    """
    cost, run = novelty(text, start, end), text[start:end]
    kinds = next((n for kind, n in NARROW if kind.fullmatch(run)), 0)
    if not kinds:
        return cost >= threshold
    if cost < share * math.log2(kinds) / 8:
        return False
    rng, total = random.Random(run), 0.0
    for _ in range(shuffles):
        total += novelty(text[:start] + "".join(rng.sample(run, len(run))) + text[end:], start, end)
    return cost >= order * total / shuffles


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of start..end that no span (they are sorted) covers."""
    parts = []
    for x, y in spans:
        if start < end and x < end and start < y:
            if start < x:
                parts.append((start, x))
            start = y
    return [*parts, (start, end)] if start < end else parts


def scan(text: str, threshold: float = 0.68, near: int = 48) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind: code points, end exclusive."""
    found = []
    if NAMED.search(text):
        found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    assigned = sorted((a, b) for a, b, kind in found if kind == "assign")
    others = sorted((a, b) for a, b, kind in found if kind != "assign")
    novel = []
    for m in CANDIDATE.finditer(text):
        for a, b in outside(*m.span(), assigned):
            if b - a < 16 or not SENSITIVE.search(text, max(0, a - near), a):
                continue
            rest = outside(a, b, others)
            # nothing but a short name before a reported value, or padding after it
            if all(NAME.fullmatch(text[x:y]) if x == a and y < b else not text[x:y].strip("=") for x, y in rest) and rest != [(a, b)]:
                continue
            if incompressible(text, a, b, threshold):
                novel.append((a, b, "novel"))
    found += novel
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"


def scan_batches(threshold: float):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                spans = scan(text.as_py(), threshold)
                counts = [sum(s[2] == kind for s in spans) for kind in KINDS]
                base = joined([s for s in spans if s[2] != "novel"])
                rows.append((doc.as_py(), *counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return run


def scan_secrets(docs: DataFrame, threshold: float = 0.68, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its secrets' counts and spans.

    Spans are "kind:start:end" by start, then kind, comma-joined; base_sha256 is the digest of those
    of the three pattern kinds (of the empty string if there are none). A null text is empty; repeated
    rows and null ids give a row each; an empty table gives none; other columns are left out.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(scan_batches(threshold), OUT)


def secret_spans(scanned: DataFrame) -> DataFrame:
    """A row (doc_id, kind, start, end) for each span."""
    one = F.split("span", ":")
    return scanned.filter("spans != ''").select("doc_id", F.explode(F.split("spans", ",")).alias("span")).select(
        "doc_id", one[0].alias("kind"), one[1].cast("bigint").alias("start"), one[2].cast("bigint").alias("end")
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
