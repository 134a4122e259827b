"""BPE: ids equal tiktoken's, the round trip, long texts and odd rows."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hydroframe.llm import bpe, wordstore
from hydroframe.llm.workload import op1_byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text_equals_tiktoken(texts):
    got = bpe.Replay(RANKS, P.PATTERN).block(texts)
    assert [ids(x) for x in got] == [ENCODING.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=12), max_size=4), st.randoms(use_true_random=False))
def test_ranks_in_which_a_late_merge_enables_an_earlier_one(texts, rng):
    made = [bytes([b]) for b in range(256)]
    extra = sorted({bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(25)})
    rng.shuffle(extra)
    ranks = {t: n for n, t in enumerate(made + extra)}
    want = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.Replay(ranks, P.PATTERN).block(texts)
    assert [ids(x) for x in got] == [want.encode_ordinary(t) for t in texts]


def test_operator_over_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 3000, "<|endoftext|>", "né  😀\n\n x", "x\x1cy\u0085z "]
    texts += ["".join(rng.choices("ab \nÜ字9'st", k=500)) for _ in range(30)] * 2
    rows = [(n if n % 7 else None, t, "clash") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    want = sorted(((i, ENCODING.encode_ordinary(t or "")) for i, t, _ in rows), key=repr)
    assert sorted(((r.doc_id, ids(r.ids)) for r in got), key=repr) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in texts)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_a_text_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    monkeypatch.setattr(bpe, "WORDS", 77)
    monkeypatch.setattr(bpe.Replay, "remembered", 50)
    monkeypatch.setattr(wordstore, "WORDS", 31)
    text = " ".join(f"word{n % 913} né" for n in range(3000))
    replay = bpe.Replay(RANKS, P.PATTERN)
    assert ids(replay.block([text])[0]) == ENCODING.encode_ordinary(text)
    assert ids(replay.block([text[:900], "né"])[1]) == ENCODING.encode_ordinary("né")
    assert list(wordstore.blocks(["a" * 900, "b" * 200, "c" * 5000, "d"], 1000)) == [(0, 1), (1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_equals_tiktoken(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_byte_bpe(spark, f"/root/testdata/{sf}").collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = ENCODING.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(want)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
