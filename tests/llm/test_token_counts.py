from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from streetbook.llm import queries
from streetbook.llm import token_counts as C
from streetbook.llm.byte_bpe import read_ranks

EOD = 50_256
PATH = P.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding(
    "own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(PATH))}, special_tokens={}
)


def plain(ids: list[int]) -> list[tuple]:
    """Documents of a file by one pass: start, length, closed."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == EOD:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_boundaries_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {"a": [EOD], "b": [], "c": [5, 6, 7], "d": [EOD, EOD, 1, EOD, 2, 3], "e": [1, 2, 3, EOD, EOD], "f": [4] * 30 + [EOD]}
    files |= {f"r{k}": rng.choice([EOD, 1, 2, 3, 0x50C4, 0xC400], 60, p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.1]).tolist() for k in range(4)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    out = C.count_tokens(spark, str(tmp_path), EOD, head=2, block=block).collect()
    for name, ids in files.items():
        mine = sorted((r.number, r.start, r.n_tokens + len(r.head), r.closed, list(r.head)) for r in out if r.file.endswith("/" + name))
        assert mine == [(k, s, n, c, ids[s : s + min(n, 2)]) for k, (s, n, c) in enumerate(plain(ids))]


def test_hard_rows(spark):
    rows = [(0, None), (1, ""), (-5, "Hello, wörld"), (2**63 - 1, "x y z" * 2000), (-(2**63), " "), (None, "no id"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string").repartition(3)
    path = C.write_tokens(docs, PATH, P.PATTERN, EOD)
    out = C.count_tokens(spark, path, EOD, C.HEADER, block=64).withColumn("id", C.header_id(C.F.col("head")))
    got = sorted(((r.id, r.n_tokens, r.closed) for r in out.collect()), key=str)
    assert got == sorted(((i, len(ENCODING.encode_ordinary(t or "")), True) for i, t in rows), key=str)
    none = C.write_tokens(docs.limit(0), PATH, P.PATTERN, EOD)
    assert C.count_tokens(spark, none, EOD).count() == 0
    with pytest.raises(ValueError):
        C.write_tokens(docs, PATH, P.PATTERN, 50_255)


def test_odd_file(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within an identifier"):
        C.count_tokens(spark, str(tmp_path), EOD).collect()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op7_token_counts"](spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert sorted(rows) == sorted((r.doc_id, len(ENCODING.encode_ordinary(r.text or "")), True) for r in texts)
