import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from plumbline.llm import edits, tokens
from plumbline.llm.queries import BPE_RANKS, op3_byte_bpe, op7_edit_aware_counts
from tests.conftest import SMALL

PATH = P.path(BPE_RANKS)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = "ab '\n\t.1é漢😀lvsr thed"


def texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 700))) for _ in range(n)]


def test_chunks_give_the_library_s_ids(encoding):
    code = tokens.coder(PATH, P.PATTERN)
    for t in [*texts(60), "", " ", "a" * 3000, " " * 2000 + "x", "\n\n\t " * 300, "it's we'll " * 90, "<|endoftext|>"]:
        for chunk, overlap in ((1 << 15, 512), (100, 40), (7, 5), (50, 200)):
            ids = code.encode(t, chunk, overlap)
            assert list(memoryview(ids).cast("I")) == encoding.encode_ordinary(t)
            assert code.decode(ids) == t.encode()


def test_long_texts_are_dealt_out(spark, encoding):
    rows = [(i, t) for i, t in enumerate([*texts(12, 1), "x" * 900, " " * 700 + "y", None, "", "short"])] + [(0, "again " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.encode_texts(df, PATH, P.PATTERN, chunk=64, overlap=24, long_chars=300).collect()
    assert len(got) == len(rows)
    want = sorted((i, struct.pack(f"<{len(x)}I", *x)) for i, t in rows for x in [encoding.encode_ordinary(t or "")])
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == want
    for r in got:
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
    assert tokens.encode_texts(df.where("false"), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        tokens.encode_texts(df.withColumnRenamed("doc_id", "ids"), PATH, P.PATTERN)


def test_op3_against_the_library(spark, encoding):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op3_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_trees_follow_edits(encoding, monkeypatch):
    code, draw = tokens.coder(PATH, P.PATTERN), random.Random(3)
    for leaf in (2, 64):
        monkeypatch.setattr(edits, "LEAF", leaf)
        for t in texts(60, leaf):
            tree = edits.TokenTree(t, code)
            for _ in range(5):
                a = draw.randint(0, len(t))
                b = min(len(t), a + draw.choice([0, 1, 3, 50, 700]))
                new = "".join(draw.choice(LETTERS) for _ in range(draw.choice([0, 1, 9, 200])))
                tree.edit(a, b, new)
                t = t[:a] + new + t[b:]
                assert tree.text() == t and tree.n_chars == len(t) and tree.n_tokens == len(encoding.encode_ordinary(t))


def test_edits_encode_little(encoding):
    tree = edits.TokenTree("some words in a long text " * 4000, tokens.coder(PATH, P.PATTERN))
    tree.edit(50_000, 50_003, "new")
    assert 0 < tree.encoded < 20 and tree.rebuilt == 0


def test_op7_against_recount(spark, encoding):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "abc def"), (2, None), (2, ""), (None, "x y z" * 50)], "doc_id long, text string")
    todo = F.array(F.struct(F.lit(2).cast("long").alias("at"), F.lit(4).cast("long").alias("upto"), F.lit("Q").alias("new")), F.lit(None), F.struct(F.lit(99999).cast("long").alias("at"), F.lit(None).cast("long").alias("upto"), F.lit(None).cast("string").alias("new")))
    got = sorted(edits.count_under_edits(docs, todo, PATH, P.PATTERN, keep=["doc_id"]).collect(), key=lambda r: r["n_chars"])
    for r, t in zip(got, ("", "", "abc def", "x y z" * 50)):
        after = t[:2] + "Q" + t[4:]
        assert (r["n_edits"], r["n_chars"], r["n_tokens"], r["n_chars_after"], r["n_tokens_after"]) == (2, len(t), len(encoding.encode_ordinary(t)), len(after), len(encoding.encode_ordinary(after)))
    texts_of = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    import zlib

    for r in op7_edit_aware_counts(spark, SMALL).collect():
        t = texts_of[r["doc_id"]]
        n = len(t)
        assert r["n_tokens"] == len(encoding.encode_ordinary(t))
        for i, (cut, new) in enumerate(((0, " (revised)"), (12, ""), (8, "\n\nUpdate: it's 2024."))):
            at = zlib.crc32(f"{r['doc_id']}:{i}".encode()) % (n + 1)
            at = min(at, len(t))
            t = t[:at] + new + t[at + cut :]
        assert (r["n_chars_after"], r["n_tokens_after"]) == (len(t), len(encoding.encode_ordinary(t)))
