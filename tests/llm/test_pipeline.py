from __future__ import annotations

import hashlib

import tiktoken
from test_byte_bpe import ENCODING
from test_exact_dedup import lowered
from test_mixing import plain as mixed
from test_simhash_dedup import plain_components, plain_fingerprint

import corpus_pipeline


def test_pipeline_equals_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if any(map(str.isalpha, r.text or ""))]
    last = {}
    for r in docs:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), r.doc_id))
    docs = [r for r in docs if last[lowered(r.text)] == r.doc_id]
    groups = plain_components({r.doc_id: plain_fingerprint(r.text) for r in docs}, 2)
    docs = [r for r in docs if groups[r.doc_id] == r.doc_id]
    taken, _, _ = mixed([(r.doc_id, r.source, r.text) for r in docs], whole=True)
    want = []
    for r in docs:
        ids = ENCODING.encode_ordinary(r.text)
        row = (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        want += [row] * (taken[r.doc_id] // len(r.text.encode().split()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert all(len(r.token_ids) == r.n_tokens for r in got)
    assert isinstance(ENCODING, tiktoken.Encoding)


def test_stages_keep_columns_and_bear_hard_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, None, None, None, "k"), (2, "", "en", "a", 0, None), (3, "The cat", "en", None, 7, "k"), (None, "the cat", None, "a", 7, "k")]
    rows += [(4, "le chat dort bien", "fr", "a", 3, "k"), (4, "le chat dort bien", "fr", "a", 3, "k"), (5, "!!", "fr", "b", 2, "k")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns[:5] == [c.split()[0] for c in schema.split(", ")][:5], name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in out} <= {3, 4, None} and bool(out) == bool(table)
