import base64
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import alignment, conversations, language
from folioflow.llm.common import Scratch
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LANGS = {"de": "der hund und die katze schlafen nicht im garten weil es regnet", "en": "the dog and the cat will not sleep in the garden because of rain", "fr": "le chien et le chat ne dorment pas dans le jardin parce que la pluie"}


# 11 language identification


def spoken(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.op11_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, spoken(rng, lang, 30), lang) for i, lang in enumerate(["de", "en", "fr"] * 40)]
    odd = [(500, None, "en"), (501, "", "en"), (502, " 12 %% \n", None), (503, "\u3042\u308a", None), (504, spoken(rng, "fr", 60_000), None), (None, spoken(rng, "de", 9), None), (505, "the dog and the cat", "en"), (505, "the dog and the cat", "en"), (506, "THE DOG AND THE CAT", None)]
    docs = spark.createDataFrame([(i, t, x, "clash", 2.0) for i, t, x in rows + odd], "doc_id bigint, text string, lang string, lang_pred string, score double").repartition(4)
    with Scratch(spark, "t") as scratch:
        got = language.identify(docs, language.learn(docs, scratch)).collect()
        by_id = {r["doc_id"]: r for r in got}
        assert len(got) == len(rows) + len(odd)
        assert [by_id[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and all(by_id[i]["rejected"] and by_id[i]["score"] == 0 for i in (500, 501, 502))
        assert by_id[503]["lang_pred"] in LANGS and by_id[503]["rejected"] and by_id[503]["cosine"] < 0.05  # no n-gram is known, though a bin may be shared
        assert [by_id[i]["lang_pred"] for i in (504, None, 505, 506)] == ["fr", "de", "en", "en"]
        assert by_id[None]["held_out"]
        assert by_id[505]["cosine"] == pytest.approx(by_id[506]["cosine"])
        empty = docs.limit(0)
        assert language.identify(empty, language.learn(empty, scratch)).collect() == []
        untaught = language.identify(docs, None).collect()
        assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


def test_ids_labels_and_held_out_rows_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang, 20), lang) for i, lang in enumerate(["de", "en", "fr"] * 30)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    found = []
    for some in (rows, wrong):
        docs = spark.createDataFrame(some, "doc_id bigint, text string, lang string")
        with Scratch(spark, "t") as scratch:
            found.append(sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(docs, language.learn(docs, scratch)).collect()))
    assert found[0] == found[1]


def test_grams_are_those_of_the_letters():
    texts = ["Ab  c!", "", "\u00e9", "--", "x"]
    seen = {}
    for row, counts in language.counted(pa.array(texts)):
        for k, c in enumerate(counts):
            seen[row + k] = c

    def plain(text):
        raw = bytes(language.LETTER[list(text.encode())].astype(np.uint8)) if text else b""
        short = bytearray()
        for c in raw:
            if c or not short or short[-1]:
                short.append(c)
        out = np.zeros(language.BINS, int)
        for size in range(1, 5):
            for i in range(len(short) - size + 1):
                value = int.from_bytes(short[i : i + size], "big")
                if value:
                    out[((value + (size << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> 50] += 1
        return out

    for i, text in enumerate(texts):
        assert (seen[i] == plain(text)).all(), text


# 12 alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        raw = {int(n): base64.b64decode(x) for x, n in map(bytes.split, lines)}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()

    return lambda t: [(i, raw[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PATHS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))


def test_alignment_is_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.alignment([(r["doc_id"], r["text"][:2000]) for r in docs.select("doc_id", "text").collect()], *tokenizers)
    with Scratch(spark, "t") as scratch:
        out, _ = alignment.align(docs.withColumn("text", F.substring("text", 1, 2000)), scratch, *PATHS)
        assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()} == want


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_alignment_edge_cases(spark, tokenizers, monkeypatch, most):
    monkeypatch.setattr(alignment, "MOST_SENT", most)  # counts joined by a shuffle, and by broadcast
    texts = [None, "", " ", "  a  b ", "\n\n x", "\u3042\u308a\u304c\u3068\u3046 \U0001f600\U0001f600", "<|endoftext|> </s> <s>", "\u2581a", "a\u2581", "\ufb01 \uff21", "e\u0301", "x" * 4000, "the the the", "the the the", "caf\u00e9 na\u00efve", "\x00\x01 \t", "word " * 30_000, "0123456789" * 9]
    rows = list(enumerate(texts))
    want = brute.alignment([r for r in rows if len(r[1] or "") < 10_000], *tokenizers)
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id bigint, text string, n_a int, groups_sha256 string").repartition(3)
    with Scratch(spark, "t") as scratch:
        out, pairs = alignment.align(docs, scratch, *PATHS, spell=True)
        got = {r["doc_id"]: r for r in out.collect()}
        counts = {(r["a_id"], r["b_id"]): r for r in pairs.collect()}
        assert set(got) == set(range(len(texts)))
        static = [c for c in COLUMNS if c not in ("n_best", "count_sum")]  # the long text adds to these
        for i, row in want.items():
            assert tuple(got[i][c] for c in static) == tuple(v for c, v in zip(COLUMNS, row) if c in static), texts[i]
            assert (got[i]["groups"] == "") == (got[i]["groups_sha256"] == "")
        assert got[16]["n_links"] == got[16]["n_groups"] >= 30_000
        assert sum(r["count"] for r in counts.values()) == sum(r["n_links"] for r in got.values())
        last = {}
        for (_, b), r in counts.items():
            last[b] = max(last.get(b, 0), r["count"])
        assert all(r["best"] == (r["count"] == last[b]) for (_, b), r in counts.items())
        twice = docs.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("bigint"))
        out, _ = alignment.align(twice.union(twice), scratch, *PATHS)
        assert [(r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in out.collect()] == [(None, 3, 3, 18)] * 2
        assert alignment.align(docs.limit(0), scratch, *PATHS)[0].collect() == []


def test_components_are_those_of_plain_union_find():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randrange(1, 60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n))]
        parent = list(range(n))
        for x, y in edges * n:
            parent[x] = parent[y] = min(parent[x], parent[y])
        left, right = (np.array(x, np.int64) for x in (zip(*edges) if edges else ([], [])))
        assert alignment.components(n, left, right).tolist() == parent


# 13 conversations

CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def repaired(spark, df):
    with Scratch(spark, "t") as scratch:
        return {r[0]: tuple(r)[1:] for r in conversations.structure(df, scratch).collect()}


def test_repair_is_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute.conversations(tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect())
    assert repaired(spark, df) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(conversations.OP13_SQL).fetchall()} == want


@pytest.fixture(scope="module")
def damaged_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = [None, "", " \n", "a b", "c.", "x y!", "d?", "e. ", "long " * 5000, *[f"t{i}." for i in range(40)]]
    rows = []
    for i in range(3000):
        conv = 7 if i % 3 == 0 else None if i % 7 == 0 else rng.randrange(150)  # a third of the rows are one conversation's
        rows.append((conv, None if rng.random() < 0.05 else rng.randrange(1500) if conv == 7 else rng.randrange(12), rng.choice(roles), rng.choice(texts)))
    return [*rows, *[(7, 5, "user", "same.")] * 800, (900, 1, "system", "only."), (901, None, None, None)]


@pytest.mark.parametrize("parts", [3, 40])
def test_repair_of_nulls_ties_copies_and_a_hot_conversation(spark, damaged_rows, parts):
    df = spark.createDataFrame([(*r, 1, "clash") for r in damaged_rows], CONVERSATION + ", cost int, audit string").repartition(5)
    want = brute.conversations(damaged_rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark, df) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_spell_the_digest(spark, damaged_rows):
    df = spark.createDataFrame(damaged_rows, CONVERSATION).repartition(5)
    with Scratch(spark, "t") as scratch:
        out, rows = conversations.repair(conversations.damage(df).filter("draw != 0"), scratch, with_rows=True)
        lines, edits = {}, {}
        for r in sorted(rows.collect(), key=lambda r: r["place"]):
            edits[r["conv_id"]] = edits.get(r["conv_id"], "") + r["edit"]
            if r["edit"] != "D":
                lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for r in out.collect():
            assert edits.get(r["conv_id"], "") == r["audit"]
            assert brute.hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert conversations.structure(df.limit(0), scratch).collect() == []


def test_pieces_chained_are_the_whole(monkeypatch):
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(0, 14)
        initials, faults = [rng.choice("suax") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        monkeypatch.setattr(conversations, "PIECE", 1000)
        whole = next(iter(conversations.best_paths(initials, faults, (0,), True).values()))
        for size in (1, 2, 3):
            monkeypatch.setattr(conversations, "PIECE", size)
            assert next(iter(conversations.best_paths(initials, faults, (0,), True).values())) == whole
