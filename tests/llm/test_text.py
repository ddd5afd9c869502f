"""Equality of byte spans: two texts on which polynomials modulo 2 ** 64 agree must never count as one."""

import numpy as np
import public_tokenizers as P

from orbitframe.llm import neardup, rules, tokenfile
from orbitframe.llm import text as T
from tests.llm import test_neardup, test_suffixdedup, test_tokenfile

#: The Thue-Morse word of 1,024 letters and its complement.
ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def spans(*texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(t) for t in raw], ends


def test_hashes_and_codes():
    assert len(set(T.span_hashes(*spans(ONE, TWO, ONE)).tolist())) == 2
    assert T.codes(*spans(ONE, TWO, ONE, ONE[:-1], "")).tolist() == [0, 1, 0, 2, 3]


def test_codes_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(T, "span_hashes", lambda data, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    got = T.codes(*spans("abc", "abd", "abc", "", "a" * 30, "a" * 29 + "b", "a" * 30)).tolist()
    assert got == [0, 1, 0, 2, 3, 4, 3]


def test_random_spans_against_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 100, 3000) % rng.integers(1, 100, 3000)
    raw, known = data.tobytes(), {}
    want = [known.setdefault(raw[a:b], len(known)) for a, b in zip(starts, ends)]
    assert T.codes(data, starts, ends).tolist() == want
    same = T.same_spans(data, starts, starts[::-1], np.minimum(ends - starts, (ends - starts)[::-1]))
    assert same.tolist() == [raw[a : a + n] == raw[b : b + n] for a, b, n in zip(starts, starts[::-1], np.minimum(ends - starts, (ends - starts)[::-1]))]


def test_suffix_dedup(spark):
    test_suffixdedup.check(spark.createDataFrame([(1, ONE), (2, TWO), (3, ONE + "x" * 60), (4, "x" * 60 + TWO)], "doc_id long, text string"))


def test_near_duplicates(spark):
    tail = " two three four five"
    df = spark.createDataFrame([(1, ONE + tail), (2, TWO + tail), (3, ONE + tail), (4, ONE), (5, TWO)], "doc_id int, text string")
    test_neardup.check(df)
    assert neardup.near_duplicates(df).schema["doc_id"].dataType.simpleString() == "bigint"


def test_token_files(spark, tmp_path):
    test_tokenfile.check(spark.createDataFrame([(1, ONE), (2, TWO), (3, f"{ONE} {TWO}")], "doc_id long, text string"), tmp_path / "a")


def test_pieces_with_one_hash_go_to_the_library_whole(monkeypatch):
    enc = tokenfile.Encoder(P.path("byte_bpe_50k.json"))
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in ("one two", "six ten", "one ten")]
    monkeypatch.setattr(T, "span_hashes", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    assert [x.tolist() for t in ("one two", "six ten", "one ten") for x in enc.ids([t])] == want


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, f"{ONE}\n{TWO}"), (2, f"{ONE}\n{ONE}\n{TWO}"), (3, " ".join([ONE] * 4 + [TWO] * 4)), (4, " ".join(([ONE] * 4 + [TWO] * 4) * 2))], "doc_id long, text string")
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in rules.rule_features(df).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 16)}
