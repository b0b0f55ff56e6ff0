import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_tiktoken(text):
    assert CODEC.encode(text) == TIK.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, " " * 5000 + "x", "ab" * 9000, "\n \n\t  \n", "é" * 3000, "🙂" * 2000, "0123456789" * 300, "$%&" * 2000, "<|endoftext|>"])
def test_long_and_odd(text):
    assert CODEC.encode(text) == TIK.encode_ordinary(text)


def test_random_letters():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abcdeghinorstu") for _ in range(rng.randint(1, 400)))
        assert CODEC.encode(text) == TIK.encode_ordinary(text)


def test_query(spark, sf):
    rows = bpe.op2(spark, sf).collect()
    texts = {r.doc_id: r.text for r in bpe.documents(spark, sf).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIK.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_empties_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "x", 6), (3, "", 7), (3, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.id or 0, r.n_tokens) for r in bpe.digests(df, PATH, P.PATTERN).collect())
    assert got == [(0, 1), (1, 0), (3, 0), (3, 0)]
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df.select("doc_id", "text"), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == [b"", b"", b"", b"x"]
