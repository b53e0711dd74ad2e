from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from streetbook.llm import queries
from streetbook.llm import suffix_dedup as S


def plain(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The definition: every window of every document in a dictionary."""
    first: dict[bytes, int] = {}
    for d, t in docs:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - 49):
                w = raw[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw) + 1)
        if d is not None:
            for i in range(len(raw) - 49):
                if first[raw[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def made(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()), key=str)


def corpus(seed: int, n: int, letters: str = "abcdé ") -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.randint(40, 200)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else word(rng.randint(0, 120)) for _ in range(rng.randint(0, 5))]
        docs.append((i * 3, "".join(parts)))
    return docs + [(1000 + i, docs[i % 5][1]) for i in range(10)]


@pytest.mark.parametrize("seed, chunk, sorted_", [(1, 1 << 21, 1 << 20), (2, 300, 1 << 20), (3, 1000, 64), (4, 120, 10), (5, 1 << 22, 1 << 19)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, sorted_):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "SORTED", sorted_)
    monkeypatch.setattr(S, "BLOCK", 70 * seed)
    docs = corpus(seed, 40)
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    runs = S.cut([(d, 0, 0, t.encode()) for d, t in docs])
    assert int((runs.length - 49).sum()) == sum(max(0, len(t.encode()) - 49) for _, t in docs)
    assert made(df) == plain(docs)


def test_hard_rows(spark):
    unit = "abcdefghij" * 6
    docs = [(5, None), (6, ""), (9, unit), (8, unit), (8, unit), (None, unit), (7, "x" * 49), (4, "x" * 49), (10, "a" * 5000), (11, "a" * 3000 + unit)]
    docs += [(12, "é" * 40 + unit[:49]), (13, "z" + unit + "z" + unit), (8, "other " + unit), (-1, "start " * 20), (20, "start " * 20 + "y")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, kept string").repartition(4)
    assert made(df) == plain(docs)
    out = S.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_previous_factors_are_the_longest():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    at = np.sort(rng.choice(340, 150, replace=False))
    doc = np.sort(rng.integers(0, 9, 150))
    got = S.previous_factors(data, at, doc)
    raw = data.tobytes()
    for i in range(len(at)):
        best = 0
        for j in range(len(at)):
            if doc[j] < doc[i]:
                k = 0
                while k < 50 and raw[at[i] + k] == raw[at[j] + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best
    values = rng.integers(0, 50, 500)
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(500)]
    assert S.nearest_smaller(values).tolist() == want


@pytest.mark.parametrize("letters", [(0, 1), (0, 255), (97, 97)])
def test_suffixes_are_sorted_in_few_passes(monkeypatch, letters):
    """Null bytes and equal suffixes included. No sort by eight keys: it was the dearest step of all."""
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.choice(np.array(letters, np.uint8), 300), np.zeros(60, np.uint8)])
    data = np.concatenate([data, data[:150], np.zeros(60, np.uint8)])
    at, raw = np.arange(len(data) - 49), data.tobytes()
    doc = rng.integers(0, 9, len(at))
    monkeypatch.setattr(np, "lexsort", None)
    got = S.previous_factors(data, at, doc)
    same = lambda i, j: next((k for k in range(50) if raw[i + k] != raw[j + k]), 50)
    for i in range(0, len(at), 7):
        assert got[i] == max((same(i, j) for j in range(len(at)) if doc[j] < doc[i]), default=0)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = queries.QUERIES["op3_suffix_dedup"](spark, folder).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(docs)
