from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from streetbook.llm import queries
from streetbook.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def brute():
    """The definition, token by token, with the libraries' own encoders."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = T.byte_alphabet()

    def bytes_b(i):
        piece = other.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("▁", " ").encode()

    def aligned(text):
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = other.encode(text)
        x, y = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(x) != b" " + text.encode() or b"".join(y) != b" " + text.encode():
            return None
        groups, i, j = [], 0, 0
        while i < len(a):
            p, q, left, right = len(x[i]), len(y[j]), [a[i]], [b[j]]
            while p != q:
                if p < q:
                    i += 1
                    p += len(x[i])
                    left.append(a[i])
                else:
                    j += 1
                    q += len(y[j])
                    right.append(b[j])
            groups.append((left, right))
            i, j = i + 1, j + 1
        return a, b, groups

    def run(rows):
        found = {t: aligned(t) if t else None for _, t in rows}
        links = {t: Counter((a, b) for left, right in f[2] for a in left for b in right) for t, f in found.items() if f}
        count = Counter(p for _, t in rows if t in links for p in links[t])
        most = defaultdict(int)
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        out = []
        for d, t in rows:
            if t not in links:
                out.append((d, *EMPTY))
                continue
            a, b, groups = found[t]
            body = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            sums = sum(links[t].values()), sum(n for p, n in links[t].items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links[t].items())
            out.append((d, len(a), len(b), len(groups), *sums, hashlib.sha256(body.encode()).hexdigest()))
        return sorted(out, key=str), count

    return run


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", *T.COLUMNS).collect()), key=str)


HARD = [
    (1, "Hello world"), (2, "Hello world"), (3, None), (4, ""), (5, " "), (6, "a  b\n\n\tc \n d   "), (7, "</s> <s> <|endoftext|> <unk> <0x41>"),
    (8, "▁a ▁"), (9, "\x00\x01 é ﬁ Ω 你好 🙂👩‍👩‍👧 é"), (10, "don't WE'LL 12345 3.14"), (None, "Hello world"), (11, "Hello"), (11, "Hello"),
    (12, "x" * 3000 + " " * 900 + "Ünï" * 700), (13, "  \u0085 a​b"), (14, "\n"), (15, "ab" * 20000), (16, "zq" * 100 + "🙂" * 300),
]


@pytest.mark.parametrize("chunk", [1, 200, 500_000])
def test_hard_texts(spark, frame, brute, chunk):
    schema = "doc_id long, text string, sha string, rows string, chunk string, a string, count string, n string"
    df = frame([(*r, *"xxxxxx") for r in HARD], schema)
    out, counts = T.measure(df, A, B, chunk=chunk)
    want, pairs = brute(HARD)
    assert collected(out) == want
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == dict(pairs)


def test_a_text_that_most_rows_share(spark, brute):
    rows = [(i, "the same text over and over") for i in range(3000)] + [(5000 + i, f"text {i % 40} over") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(T.measure(df, A, B)[0]) == brute(rows)[0]


def test_empty_table(spark):
    out, counts = T.measure(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.columns == ["doc_id", *T.COLUMNS] and out.count() == 0 and counts.count() == 0


def test_wide_groups(monkeypatch):
    """A group of many tokens on both sides gives the same entries whether its ids are counted first or not."""
    known = T.load(A, B)
    a, b, _ = T.encoded(["zq" * 300 + "🙂" * 50, "Ünï" * 100], known)
    whole = T.align(a, b, known)
    monkeypatch.setattr(T, "WIDE", 1)
    monkeypatch.setattr(T, "CHUNK", 3)
    parts = T.align(a, b, known)
    assert all((x == y).all() for x, y in ((whole.text, parts.text), (whole.pair, parts.pair), (whole.times, parts.times)))
    assert whole.digests == parts.digests


def test_fast_encoder_is_used_and_equal():
    one = T.ByteLevel(A)
    assert one.fast is not None
    texts = [t for _, t in HARD if t]
    assert one.encode(texts) == [e.ids for e in one.library.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, brute):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collected(queries.QUERIES["op12_token_alignment"](spark, folder)) == brute(rows)[0]
