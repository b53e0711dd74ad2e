from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from streetbook.llm import prefix_trie as P
from streetbook.llm import queries


def brute(rows):
    """The trie as a dictionary of tuples, totals by recursion over sorted depths."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children, leaves, saved = defaultdict(int), {}, {}
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        leaves[p] = int(not children[p])
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p in sorted(members, key=len, reverse=True):
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        text = ",".join(map(str, ends[p])) if p in ends else ""
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def run(df, watch=None):
    return P.trie(P.with_shared_start(P.numbered(df)), watch)


def plain(df, watch=None):
    """Without shared starts."""
    turns = P.numbered(df)
    sizes = turns.groupBy("conv_id").agg({"place": "max"}).withColumnRenamed("max(place)", "length")
    return P.trie(turns.join(sizes, "conv_id"), watch)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_hard_rows(spark, frame):
    rows = [(c, t, r, x) for c in (0, 100, 101, 102, 155, 207, 300) for t, (r, x) in enumerate([("user", "hi"), ("assistant", "hello 🙂"), ("user", "")])]
    rows += [(7, None, "user", "null turn"), (7, 0, None, None), (7, 3, "b", "tie"), (7, 3, "a", "tie"), (7, 3, "a", "tie")]  # ties and a repeated row
    rows += [(None, 0, "user", "no conversation"), (9, 0, "us", "erhi"), (10, 0, "user", "hi"), (401, 5, "user", "x" * 70_000), (12, 0, "", "")]
    rows += [(c, 0, "system", "the same") for c in range(1000, 1100)]
    schema = f"{SCHEMA}, node string, parent string, place string, digest string, length string, base string"
    df = frame([(*r, *"xxxxxx") for r in rows], schema)
    assert collected(run(df)) == brute(rows)
    empty = run(df.limit(0))
    assert empty.count() == 0 and [c for c in empty.columns if c != "node"] == list(COLUMNS)


def test_random_forests(spark, frame):
    draw = random.Random(4)
    rows = []
    for c in range(400):
        rows += [(c, t, "user", draw.choice("ab") * draw.randint(1, 2)) for t in range(draw.randint(1, 9))]
    assert collected(run(frame(rows, SCHEMA))) == brute(rows)


def test_long_chains_take_few_rounds(spark, frame, monkeypatch):
    """Nested and long conversations: chains of hundreds of nodes with an end, a fork or nothing at each."""
    rows = [(1, t, "user", f"turn {t}") for t in range(300)]
    rows += [(2 + i, t, "user", f"turn {t}") for i in range(12) for t in range(20 * i + 5)]  # ends on the way
    rows += [(50 + i, t, "user", f"turn {t}" if t < 30 * i else f"branch {i} {t}") for i in range(8) for t in range(30 * i + 40)]
    monkeypatch.setattr(zlib, "crc32", lambda _: 0)
    seen = []
    df = frame(rows, SCHEMA)
    assert collected(plain(df, lambda *x: seen.append(x))) == brute(rows)
    assert len(seen) <= 6 and seen[0][2] > 300  # of a tree 300 deep


def test_hot_conversation_and_lists_of_ends(spark, frame):
    rows = [(c, t, "user", f"same {t}") for c in range(2000) for t in range(2)] + [(5000 + c, 0, "user", str(c)) for c in range(300)]
    df = frame(rows, SCHEMA)
    assert collected(run(df)) == brute(rows)
    ends = spark.createDataFrame([(b"a", c) for c in (5, -3, 100, 20, 7)] + [(b"b", 1)], "node binary, conv_id long")
    want = {b"a": hashlib.sha256(b"-3,5,7,20,100").hexdigest(), b"b": hashlib.sha256(b"1").hexdigest()}
    assert {bytes(r.node): r.ends_sha256 for r in P.end_lists(ends, span=10).collect()} == want


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op13_prefix_trie"](spark, folder)) == brute(rows)


def test_conversations_of_a_union_stay_whole(spark, frame, capsys):
    """Parts that are dealt by conversation already are dealt again, by an expression that no part is dealt by."""
    rows = [(c, t, "user", f"{c % 7} {t}") for c in range(300) for t in range(8)]
    turns = P.with_shared_start(P.numbered(frame(rows, SCHEMA)))
    found = P.prefixes(turns.filter("place <= 3").unionByName(turns.filter("place > 3")))
    found.explain()
    assert "hashpartitioning(xxhash64(conv_id" in capsys.readouterr().out
    assert found.filter("depth = 0").count() == 300
