from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from streetbook.llm import language_id as L
from streetbook.llm import queries

ROWS = [
    (1, "The cat and the hen, the dog and the fox.", "en"),
    (2, "le chat et la poule, le chien et le renard été", "fr"),
    (3, "THE then that this other", "en"),
    (4, None, "en"),
    (5, "12 !! 34", None),
    (6, "la le les été chien", None),
    (7, "", "fr"),
    (8, "x", None),
    (8, "x", None),
]


def plain_vector(text: str, dim: int) -> np.ndarray:
    """The definition, n-gram by n-gram."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " " if words else " "
    out = np.zeros(dim)
    for gram, n in Counter(line[i : i + 3] for i in range(len(line) - 2)).items():
        v = np.ones(dim)
        for k, c in enumerate(gram):
            v *= np.roll(L.letter(ord(c), dim), 2 - k)
        out += n * v
    return out


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_vectors_follow_the_definition(monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "ROWS", 7)
    texts = [r[1] for r in ROWS if r[1]] + ["", " ", "a", "ab, cd  --  Éf", "ß" * 40, "日本語テスト"]
    assert np.allclose(L.bundles(texts, 256), [plain_vector(t, 256) for t in texts])


def test_small_table(frame):
    docs = frame(ROWS, "doc_id long, text string, lang string")
    profiles = L.learn(docs)
    assert profiles.languages == ["en", "fr"]
    want = sum(plain_vector(t, L.DIM) for _, t, lang in ROWS if lang == "en" and t)
    assert np.allclose(profiles.prototypes[0], want)
    out = L.identify(docs.withColumn("score", docs.lang), profiles)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {i: r.lang_pred for i, r in rows.items() if i in (1, 2, 3, 6)} == {1: "en", 2: "fr", 3: "en", 6: "fr"}
    for i in (4, 5, 7):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[8].lang_pred in ("en", "fr") and 0 <= rows[8].score <= 1


def test_nothing_to_learn_or_to_tell(frame):
    docs = frame(ROWS, "doc_id long, text string, lang string")
    none = L.learn(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.learn(docs)).count() == 0
    with pytest.raises(Exception, match="more than 1 languages"):
        L.learn(docs, max_languages=1)


def test_query_holds_out_and_is_accurate(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in unseen) / len(unseen) > 0.98
