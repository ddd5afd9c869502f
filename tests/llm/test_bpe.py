import hashlib

import public_tokenizers as P
import pytest

from orbitframe.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_documents(docs):
    enc = bpe.encoding(FILE, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.bpe_digest(docs, FILE, P.PATTERN).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        ids = enc.encode_ordinary(text)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), digest(ids))
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_digest(docs.where("doc_id < 0"), FILE, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a b  c 's 12 !! \n\n  x" * 50, "word" * 100, " " * 300 + "x", "é" * 200 + " \t\n" * 90, "a 'll b ' s  1 2\n 3" * 40, "中文 字符，测试 😀 x" * 30])
def test_cut_texts_equal_whole_ones(text):
    assert bpe.encode(text, FILE, P.PATTERN, 16) == bpe.encoding(FILE, P.PATTERN).encode_ordinary(text)


def test_run_of_blanks_that_the_library_alone_cannot_take():
    text = "a" + " " * 1_200_000 + "b"
    ids = bpe.encode(text, FILE, P.PATTERN)
    assert bpe.encoding(FILE, P.PATTERN).decode_bytes(ids) == text.encode()


def test_ids_inside_a_character(spark):
    ids = bpe.encoding(FILE, P.PATTERN).encode_ordinary("😀")
    df = spark.createDataFrame([(1, ids[:1]), (2, ids[1:]), (3, None)], "doc_id long, ids array<int>")
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode_documents(df, FILE, P.PATTERN).collect()}
    assert raw[1] + raw[2] == "😀".encode() and raw[3] == b""
