import zlib

import hypothesis
import hypothesis.strategies as st
import numpy as np
import public_tokenizers as P
import pytest
import regex

from orbitframe.llm import tokenfile as K

FILE = P.path("byte_bpe_50k.json")


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    start, out = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(df, path):
    got = [tuple(r) for r in K.token_digest(df, str(path), FILE).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_edge_cases(docs, tmp_path):
    check(docs, tmp_path / "a")
    check(docs.union(docs), tmp_path / "b")
    check(docs.where("doc_id < 0"), tmp_path / "c")


def test_small_table_in_many_blocks(small, tmp_path, monkeypatch):
    check(small, tmp_path / "a")


@pytest.mark.parametrize("text", ["a  b\n\n c <|endoftext|> 's 12", "中文 字符 😀", "é" * 50 + "\t x", "‘quoted’ — dash…", "   lead and trail   "])
def test_pieces_equal_whole_text(text):
    enc = K.encoder(FILE)
    assert enc.ids([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@hypothesis.settings(max_examples=400, deadline=None)
@hypothesis.given(st.lists(st.text(alphabet=st.sampled_from("aZs tréveldmÿĀ  \n\t'''''9 0!.x\x00\x0b¿²—"), max_size=40), min_size=1, max_size=5))
def test_pieces_are_those_of_the_library(texts):
    enc = K.encoder(FILE)
    assert [x.tolist() for x in enc.ids(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [t for t, ok in zip(texts, enc.plain(texts)) if t and ok]
    for t in plain:
        data = np.frombuffer(t.encode(), np.uint8)
        found = [m.start() for m in regex.finditer(P.PATTERN, t)]
        assert K.pieces(data, np.array([0, len(data)])).tolist() == [len(t[:k].encode()) for k in found]


@hypothesis.settings(max_examples=80, deadline=None)
@hypothesis.given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=60), min_size=1, max_size=8))
def test_round_trip_and_random_access(docs):
    ids = [np.array(x, np.uint32) for x in docs]
    counts = np.array([len(x) for x in ids])
    rules, symbols, starts = K.repair(np.concatenate(ids), np.cumsum(counts) - counts, 6, least=2)
    assert K.expand(symbols, rules, 6).tolist() == np.concatenate(ids).tolist()
    ends = np.append(starts[1:], len(symbols))
    assert [K.expand(symbols[a:b], rules, 6).tolist() for a, b in zip(starts, ends)] == [x.tolist() for x in ids]
    row = K.pack_shard(0, 0, list(range(len(ids))), ids, 6)
    for k, x in enumerate(ids):
        assert K.read_document(row, k).tolist() == x.tolist()
        for a, b in ((0, 1), (len(x) // 3, len(x) // 2), (len(x) - 1, len(x)), (2, 2), (1, 99)):
            assert K.read_document(row, k, a, b).tolist() == x[a:b].tolist()


def test_plain_texts():
    strange = regex.compile(r"[^\x00-\x1B\x20-\x7F\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]|<\|endoftext\|>")
    texts = ["", "a", "a <|endoftext|>", *(f"x{chr(c)}y" for c in [*range(0x300), 0x4E2D, 0x1F600]), "\u00c3", "\u0249"]
    assert K.encoder(FILE).plain(texts) == [not strange.search(t) for t in texts]


def test_rules_shorten_repeats():
    ids = np.tile(np.arange(64, dtype=np.uint32), 200)
    rules, symbols, _ = K.repair(ids, np.array([0]), 100)
    assert len(symbols) < 64
    pairs = np.unique(symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:], return_counts=True)[1]
    assert pairs.max() < K.LEAST


def test_a_range_of_ids_opens_few_symbols(monkeypatch):
    ids = np.tile(np.arange(500, dtype=np.uint32), 300)
    row = K.pack_shard(0, 0, [1, 2], [ids, ids[:70]], 500)
    opened, repeat = [], np.repeat

    def seen(a, n, *rest):
        opened.append(len(a))
        return repeat(a, n, *rest)

    monkeypatch.setattr(np, "repeat", seen)
    assert K.read_document(row, 0, 70_123, 70_140).tolist() == ids[70_123:70_140].tolist()
    assert 0 < sum(opened) < 1500  # of 150,000 ids


def test_special_tokens_and_null_ids(spark, tmp_path):
    rows = [(None, "a <|endoftext|> b"), (None, None), (-(2**63), "x"), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (2, "plain <| endoftext|>")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "a")
    assert 50256 in K.encoder(FILE).ids(["a <|endoftext|> b"])[0]
