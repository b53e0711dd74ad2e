"""Text search by an index of grams against the plain search."""

from __future__ import annotations

import pytest

from streetbook.operators import browse as B
from streetbook.sources import catalog as S

ROWS = [
    (1, "Кафе У Дома", "Вкусно и близко", "ул. Мира"), (2, "cafe", None, None), (3, None, None, None), (4, "", "ab", "abc"),
    (5, "abcabcabc", "x" * 5000 + "Конец", "bca"), (6, "a_b%c", "100% хлеб", "аб"), (7, "ABC", "abd", "КАФЕ"), (8, "кафедра", "мир 😀😀а", "dom"),
]


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame(ROWS, "id long, name string, description string, address string").repartition(3)


@pytest.mark.parametrize("q", ["кафе", "КАФЕ", "ab", "abc", "ABCabc", "конец", "x" * 40, "каф%дом", "к_фе", "%", "", "ab%abc", "у дома", "😀😀а", "none"])
def test_same_rows_as_the_plain_search(companies, q):
    want = sorted(r.id for r in B.text_matches(companies, q).collect())
    found = B.text_matches(companies, q, B.text_index(companies))
    assert found.columns == companies.columns
    assert sorted(r.id for r in found.collect()) == want


def test_index_has_each_gram_once(companies):
    got = {}
    for r in B.text_index(companies).collect():
        got.setdefault(r.id, []).append(r.gram)
    for i, *texts in ROWS:
        want = {t.lower()[k : k + 3] for t in texts if t for k in range(len(t) - 2)}
        assert sorted(got.get(i, [])) == sorted(want)


def test_texts_are_looked_at_after_the_join(spark, companies, tmp_path):
    S.save_texts(B.text_index(companies), f"{tmp_path}/texts")
    companies.write.parquet(f"{tmp_path}/companies")
    stored = spark.read.parquet(f"{tmp_path}/companies")
    found = B.text_matches(stored, "abc", S.load_texts(spark, f"{tmp_path}/texts"))
    assert sorted(r.id for r in found.collect()) == [4, 5, 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    checks = [i for i, line in enumerate(plan) if "LIKE" in line or "Contains(" in line]
    assert checks and max(checks) <= join
    assert "In(gram" in plan[-1] + found._jdf.queryExecution().executedPlan().toString() or "EqualTo(gram,abc)" in found._jdf.queryExecution().executedPlan().toString()


def test_grams_are_computed_once(companies):
    plan = B.text_index(companies)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(concat(") == 1


def test_texts_are_dealt_before_they_are_cut(companies):
    plan = B.text_index(companies.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan
