from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from streetbook.llm import queries
from streetbook.llm import simhash_dedup as S


def plain_fingerprint(text: str | None, shingle: int = 3) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict, max_bits: int) -> dict:
    ids, forest = list(prints), S.Forest(len(prints))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= max_bits:
                forest.join(i, j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(forest.root(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É é Z z a\x1cb", "w " * 500, "x" * 10**6])
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 100)
    assert S.fingerprint(text, 3) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h & (2**64 - 1) == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
@pytest.mark.parametrize("dense", [4, 2048])
def test_links_equal_brute_force(spark, monkeypatch, max_bits, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    random.seed(max_bits)
    prints, bases = set(), [random.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    for base in bases:
        for _ in range(12):
            for bit in random.sample(range(64), random.randint(0, 5)):
                base ^= 1 << bit
            prints.add(base)
    values = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "_fp long").repartition(3)
    edges = S.linked(df, max_bits)
    labels = {r.node: r.label for r in S.components(edges).collect()} if max_bits else {}
    want = plain_components({v: v & (2**64 - 1) for v in values}, max_bits)
    got = {v: labels.get(v, v) for v in values}
    assert {frozenset(k for k in got if got[k] == g) for g in got.values()} == {
        frozenset(k for k in want if want[k] == g) for g in want.values()
    }


def test_chain_is_sound_for_all_small_differences():
    for max_bits in (1, 2, 3):
        rng = np.random.default_rng(1)
        for _ in range(2000):
            diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, max_bits + 1), replace=False)))
            assert any(
                diff & mask == 0 and S.in_chain(np.array([diff]), first, max_bits)[0] for first, mask in S.key_masks(max_bits)
            )


def test_hard_rows(frame):
    rows = [(5, None, "x"), (3, " ", "y"), (7, "a b c d e", "z"), (7, "a b c d e", "z"), (None, "A B C D E", "n"), (9, "other words here", None)]
    rows += [(100 + i, "the same long line " * 50, "c") for i in range(40)]
    docs = frame(rows, "doc_id long, text string, fingerprint string")
    out = S.near_groups(docs)
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert sorted(got, key=str) == sorted(
        [(5, 3), (3, 3), (7, 7), (7, 7), (None, 7), (9, 9)] + [(100 + i, 100) for i in range(40)], key=str
    )
    assert {r.doc_id for r in S.keep_first(docs).collect()} == {3, 7, None, 9, 100}
    assert S.near_groups(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(prints, 2)
    rows = queries.QUERIES["op8_simhash_dedup"](spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(d, f"{p:016x}", want[d]) for d, p in prints.items()}
