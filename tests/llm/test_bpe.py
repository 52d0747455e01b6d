import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hourline.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_as_tiktoken(both, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = both[0].encode(text)
    assert ids == both[1].encode_ordinary(text)
    assert both[0].decode([str(i) for i in ids]).decode() == text


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "\n \t" * 700, "é" * 999, "nthereoftheinthereof" * 400, "\U0001f600\U0001f600 x"])
def test_long_pieces(both, text):
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_backtrack_alone(both):
    import random

    r = random.Random(3)
    for _ in range(2000):
        s = "".join(r.choice(["th", "er", "on", "ing", "é", "tion", "s", "a"]) for _ in range(r.randint(1, 9)))
        raw = s.encode().decode("latin-1")
        assert both[0].backtrack(raw, [], next(both[0].find.iter_long(raw))[1]) == both[1].encode_ordinary(s)


def test_long_texts_in_parts(both, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "BATCH", 3)
    text = "The house of the ring, and 33 more words."
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_digests(spark, both):
    rows = [(1, None, 0), (2, "", 0), (3, "Hello there", 0), (3, "Hello there", 0), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.digests(df, PATH, P.PATTERN).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    ids = both[1].encode_ordinary("Hello there")
    assert by[3].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert by[3].decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    assert by[1].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    enc = bpe.encode(df, PATH, P.PATTERN)
    assert {bytes(r.decoded) for r in bpe.decode(enc, PATH, P.PATTERN).collect()} == {b"", b"Hello there", b"x"}
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
