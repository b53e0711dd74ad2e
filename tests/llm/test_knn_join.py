from __future__ import annotations

import math

import numpy as np
import pytest

from streetbook.llm import knn_join as K
from streetbook.llm import queries


def brute(rows, asked, top):
    """Every pair, in Python integers."""
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    good = {(i, v) for i, v in good if sum(x * x for x in v) < 1 << 62}
    out = set()
    for q, v in good:
        if q in asked:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:top], 1)}
    return out


def collected(df):
    rows = [tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("pivots,block,slice_rows", [(1, 5, 7), (16, 40, 100), (128, 1024, 8192)])
def test_clusters_of_several_lengths(spark, pivots, block, slice_rows):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(8, 12)) * 4
    vectors = (centres[rng.integers(0, 8, 700)] + 0.2 * rng.normal(size=(700, 12))) * rng.uniform(0.5, 2, (700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(i, [1.5, -2.25, float(i % 5)]) for i in range(700, 760)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = collected(K.nearest(df, df.filter("vec_id % 3 = 0"), 5, pivots=pivots, block=block, slice_rows=slice_rows))
    assert got == brute(rows, {i for i, _ in rows if i % 3 == 0}, 5)


def test_bounds_prune_separate_clusters():
    rng = np.random.default_rng(1)
    pivots = np.array([[1000.0, 0.0], [0.0, 1000.0], [999.0, 0.0], [998.0, 1.0], [997.0, 0.0], [996.0, 0.0], [995.0, 0.0]])
    near, norm = K.bounds(np.array([[500.0, 0.0]]) + rng.normal(size=(4, 2)), pivots, [1] * 7, 5)
    assert near[0] <= 0 and near[1] > 900 and norm > 900


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(400, 0, -1)] + [(i, [1.0, 2.0]) for i in range(5)]  # repeated rows too
    rows += [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [nan, 1.0]), (1004, [inf, 1.0]), (1005, [None, 1.0]), (None, [3.0, 3.0])]
    rows += [(1006, [5.0, 5.0]), (1007, [-1.0, -2.0]), (1008, [1.0, 1.0, 1.0]), (1009, [1e20, 1.0]), (1010, [3e6, 1.0]), (1010, [-3e6, 1.0])]
    schema = "vec_id long, embedding array<double>, v string, ids string, dim string, cell string, id string, _rank string"
    df = spark.createDataFrame([(*r, *"xxxxxx") for r in rows], schema).repartition(3)
    got = collected(K.nearest(df, df, 4, block=50, slice_rows=3, pivots=3))
    assert got == brute(rows, {r[0] for r in rows}, 4)
    assert not [g for g in got if g[0] in (1000, 1001, 1003, 1004, 1005, 1008, 1009, None)] and (1002, 1, 0, 0) in got
    for some in (K.nearest(df.limit(0), df), K.nearest(df, df.limit(0))):
        assert some.count() == 0 and some.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_fewer_candidates_than_asked_for(spark):
    rows = [(50, [0.5, 0.25]), (100, [0.125, -0.5]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert collected(K.nearest(df, df.filter("vec_id % 50 = 0"))) == brute(rows, {50, 100}, 5)


def test_scores_beyond_double_precision(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-(10**6), 10**6, 6) / 1.0).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(K.nearest(df, df, 5, block=7)) == brute(rows, set(range(60)), 5)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert collected(queries.QUERIES["op11_knn_join"](spark, folder)) == brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
