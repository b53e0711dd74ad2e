from __future__ import annotations

import hashlib

import pytest

from streetbook.llm import exact_dedup as E
from streetbook.llm import queries

ROWS = [(3, "Abc"), (1, "aBC"), (2, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (None, "abc"), (None, "lone"), (8, "kK"), (9, "kk")]
ROWS += [(100 + i, "hot") for i in range(300)] + [(900, "long " * 100_000), (901, "LONG " * 100_000)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, best=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = best((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep, best", [("last", max), ("first", min)])
@pytest.mark.parametrize("runs, fan_in", [(1, 8), (7, 2), (64, 8)])
def test_groups(frame, keep, best, runs, fan_in):
    docs = frame([(*r, "clash") for r in ROWS], "doc_id long, text string, kept string", 6)
    out = E.exact_groups(docs, E.normalised(docs.text), keep=keep, runs=runs, fan_in=fan_in)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r._key.sha).hex()) for r in out.collect()), key=str)
    assert got == plain(ROWS, best)
    assert [c for c in out.columns if c != "_key"] == ["doc_id", "text", "keep_id", "group_size", "kept"]


def test_hot_key_is_broadcast_not_shuffled(frame, monkeypatch):
    import streetbook.llm.shared as shared

    rows = [(i, "hot" if i % 3 else f"t{i // 6}") for i in range(6000)]
    monkeypatch.setattr(shared, "HOT_PARTS", 100)
    out = E.exact_groups(frame(rows, "doc_id long, text string", 6), E.F.col("text"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "Union" in plan and "Python" not in plan
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())) == sorted(p[:4] for p in plain(rows))


def test_empty_table(frame):
    docs = frame(ROWS, "doc_id long, text string").limit(0)
    assert E.exact_groups(docs, E.normalised(docs.text)).count() == 0


def test_query_runs_no_python(spark):
    plan = queries.QUERIES["op6_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_are_sorted_and_merged_with_verification(frame):
    rows = [(i, bytes([i % 5]), i % 2, i % 3) for i in range(300)] + [(None, b"a", 1, 1), (7, b"b", 1, 1), (None, b"b", 1, 1)]
    keyed = frame(rows, "_id long, sha binary, n int, x long", 5)
    keyed = keyed.select(E.F.struct("sha", "n", "x").alias("_key"), "_id")
    for runs, fan_in in ((1, 8), (8, 2), (60, 3)):
        merged = E.merge_runs(keyed, runs, fan_in)
        got = {(bytes(r._key.sha), r._key.n, r._key.x): (r.first_id, r.last_id, r.group_size) for r in merged.collect()}
        assert len(got) == merged.count() == 32  # equal digests of another length or second hash stay apart
        assert got[b"a", 1, 1] == (None, None, 1) and got[b"b", 1, 1] == (7, 7, 2)
        assert got[b"\0", 0, 0] == (0, 270, 10)
    plan = E.merge_runs(keyed, 64, 8)._jdf.queryExecution().executedPlan().toString()
    # one exchange for the first runs, one for each round, which merges its sorted rows where they are
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Window [") == 2
