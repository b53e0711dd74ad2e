from __future__ import annotations

import math

import numpy as np

from streetbook.llm import ann_hnsw as A
from streetbook.llm import queries


def brute(rows, asked, top):
    """Exact neighbours, with Python sums that keep every bit."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q in asked:
            found = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, -x) for x, i in found[:top]]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_several_shards_and_lengths(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    vectors = (centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 24))) * rng.uniform(0.2, 5, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.filter("vec_id % 10 = 0")
    got = collected(A.search_index(A.build_index(df, 10, shard=400), asked, 10))
    want = brute(rows, set(range(0, 1500, 10)), 10)
    assert recall(got, want) >= 0.9
    scores = {i: v for i, v in rows}
    for q, found in got.items():
        assert q not in [i for i, _ in found]
        assert all(abs(s - float(np.dot(scores[q], scores[i]))) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_single_long_vectors_hide_no_others(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1200, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] *= 1e6
    vectors[70] *= 1e20
    vectors[700] *= 1e-30
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = df.filter("vec_id % 10 = 0")
    got = collected(A.search_index(A.build_index(df, 20), asked, 20))
    want = brute(rows, set(range(0, 1200, 10)), 20)
    assert {q: len(f) for q, f in got.items()} == {q: len(f) for q, f in want.items()}
    assert recall(got, want) >= 0.95


def test_copies_bad_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(40, 0, -1)] + [(i, [1.0, 2.0]) for i in range(5)]  # repeated rows too
    rows += [(100, None), (101, []), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [None, 1.0]), (None, [3.0, 3.0])]
    rows += [(106, [5.0, 5.0]), (107, [-1.0, -2.0]), (108, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = collected(A.nearest(df, df, top=4))
    assert got == {q: w for q, w in brute(rows, {r[0] for r in rows}, 4).items() if w}
    assert 108 not in got and got[40] == [(106, 15.0), (0, 5.0), (1, 5.0), (2, 5.0)]
    assert A.nearest(df.limit(0), df, top=4).count() == 0 and A.nearest(df, df.limit(0), top=4).count() == 0


def test_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = collected(queries.QUERIES["op4_ann_hnsw"](spark, folder))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert {q: len(f) for q, f in got.items()} == {q: len(f) for q, f in want.items()}
    assert recall(got, want) >= 0.95
