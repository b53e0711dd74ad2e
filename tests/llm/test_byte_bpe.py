from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from streetbook.llm import byte_bpe, queries

VOCAB = byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ENCODING = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(VOCAB.tokens)}, special_tokens={}
)
ODD = ["", " ", "  a", "a  b", "it's\n\n x ", "\t \n", "  a b", "x" * 5000, "ab" * 3000, "日本語 テスト", "\x1c \x1f", "1234567 89", "👩‍👩‍👧 é", "<|endoftext|>"]


def test_perfect_hash_holds_every_token_once():
    assert sorted(VOCAB.hash.slots) == list(range(len(VOCAB.tokens)))
    assert all(VOCAB.hash.slot(t) == i for i, t in enumerate(VOCAB.tokens))
    assert VOCAB.codec().whole(b"no such token at all") == -1


@pytest.mark.parametrize("keys", [[], [b"a"], [b"a", b"b"], [bytes([i, j]) for i in range(40) for j in range(40)]])
def test_small_perfect_hashes(keys):
    made = byte_bpe.PerfectHash(keys)
    assert [made.slot(k) for k in keys] == list(range(len(keys)))
    assert made.slot(b"else") in range(-1, len(keys))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = VOCAB.codec().encode(text)
    assert ids == ENCODING.encode_ordinary(text)
    assert VOCAB.codec().decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aábc'stré1 \n\t .!?日")) | st.text())
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert VOCAB.codec().encode(text) == ENCODING.encode_ordinary(text)


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    codec = byte_bpe.Codec(VOCAB.tokens, VOCAB.pattern, VOCAB.hash)
    text = "one two threeish fourish one two fivish sixish " * 5
    assert codec.encode(text) == ENCODING.encode_ordinary(text)
    assert len(codec.memo) <= 3


def test_columns(frame):
    df = frame([(1, None, "x"), (2, "Hello  wörld", None), (2, "Hello  wörld", None)], "doc_id long, text string, token_ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, VOCAB), VOCAB)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    rows = sorted(out.collect())
    assert rows[0].token_ids == [] and rows[0].decoded == b""
    assert rows[1].decoded.decode() == "Hello  wörld" and rows[1] == rows[2]
    assert byte_bpe.encode(df.limit(0), VOCAB).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
