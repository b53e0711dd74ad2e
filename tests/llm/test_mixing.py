from __future__ import annotations

import hashlib
import re

import pytest

from streetbook.llm import mixing as M
from streetbook.llm import queries


def targets(sizes: dict) -> dict:
    """Weights 5, 2, 1 by rank; the excess over three times a source is shared out again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows, whole=False):
    """Documents of a source one after the other, as often as the target needs: doc_id to words taken."""
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    goal = {s: round(t) for s, t in targets(sizes).items()}
    order = lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % 1024, hashlib.md5(str(r[0]).encode()).hexdigest())
    taken = {r[0]: 0 for r in rows}
    for source in sizes:
        left = goal[source]
        while left > 0 and sizes[source]:
            for d, _, text in sorted((r for r in rows if r[1] == source), key=order):
                n = words(text)
                part = min(n, max(left, 0))
                left -= n
                if whole:
                    part = n if 2 * part >= n else 0
                taken[d] += part
    return taken, targets(sizes), sizes


ROWS = [(i, f"s{i % 7}" if i % 11 else None, "w " * ((i * 37) % 50)) for i in range(200)]
ROWS += [(900, "tiny", "one"), (901, "none", None), (902, "none", " \n"), (903, "é", "a\x1cb c d " * 3), (904, "big", "word " * 20_000)]


@pytest.mark.parametrize("whole", [False, True])
def test_equals_brute_force(frame, whole):
    docs = frame([(*r, "clash") for r in ROWS], "doc_id long, source string, text string, taken string", 5)
    out = M.mix(docs, whole=whole)
    rows = {r.doc_id: r for r in out.collect()}
    taken, goal, sizes = plain(ROWS, whole)
    assert {d: r.taken for d, r in rows.items()} == taken
    for d, source, text in ROWS:
        r = rows[d]
        assert r.size == words(text) and r.source_size == sizes[source] and abs(r.target - goal[source]) < 1e-6
        assert r.taken <= 3 * r.size and 0 <= r.position <= 1
    if not whole:
        for source, t in goal.items():
            assert abs(sum(rows[d].taken for d, s, _ in ROWS if s == source) - t) <= 0.5


def test_curriculum_follows_the_schedule(frame):
    docs = frame(ROWS, "doc_id long, source string, text string", 5)
    out = M.curriculum(docs, whole=True).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    mixed = {r.doc_id: r.copies for r in M.mix(docs, whole=True).collect()}
    seen = {}
    for r in out:
        seen.setdefault(r.doc_id, []).append(r.copy)
    assert {d: len(c) for d, c in seen.items()} == {d: n for d, n in mixed.items() if n}
    # the first source's weight falls from 7.5 to 2.5, so its middle word comes early; the third's rises
    names = sorted({s for _, s, _ in ROWS if s}, key=str)
    mean = lambda s: sum(r.position for r in out if r.source == s) / sum(r.source == s for r in out)
    assert mean(names[names.index("s0")]) != mean("s2")


@pytest.mark.parametrize("knots", [*M.SCHEDULES, ((0.0, 0.0), (1.0, 2.0)), ((0.0, 3.0), (0.25, 0.0), (0.75, 0.0), (1.0, 1.0))])
def test_inverse_of_the_integral(spark, knots):
    def area(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t > t0:
                x = min(t, t1) - t0
                total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total

    rows = spark.range(101).select((M.F.col("id") / 100).alias("u")).select("u", M.inverse(knots, M.F.col("u")).alias("t")).collect()
    for r in rows:
        assert 0 <= r.t <= 1 and abs(area(r.t) / M.integral(knots) - r.u) < 1e-9


def test_hard_tables(frame):
    schema = "doc_id long, source string, text string"
    assert M.mix(frame(ROWS, schema).limit(0)).count() == 0
    assert {r.taken for r in M.mix(frame([(1, None, None), (None, "a", "")], schema)).collect()} == {0}
    twice = M.mix(frame([(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z")], schema)).collect()
    assert sum(r.taken for r in twice) == 5


def test_query_runs_no_python(spark):
    plan = queries.QUERIES["op9_mixing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
