"""Columns of a user that are named like an operator's own come back as they were."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streetbook.llm import exact_dedup, line_dedup, mixing, simhash_dedup, suffix_dedup

LONG = "one passage of more than fifty bytes that stands in several documents of this table"
ROWS = [(1, f"a {LONG}\nx", "s"), (2, f"b {LONG}\ny", "s"), (3, f"a {LONG}\nx", None), (4, None, "t"), (5, "", "t")]
OPERATORS = {
    "exact": (lambda d: exact_dedup.exact_groups(d, F.col("text")), ("_key", "_HOT", "_hot_keep_id")),
    "first": (lambda d: simhash_dedup.keep_first(d), ("_later", "_fp", "_low")),
    "mix": (lambda d: mixing.mix(d), mixing.OWN),
    "curriculum": (lambda d: mixing.curriculum(d), (*mixing.OWN, "copy")),
    "repeats": (lambda d: suffix_dedup.remove_repeats(d), ("_row", "_twice", "doc", "bucket")),
    "lines": (lambda d: line_dedup.remove_repeated_lines(d), ("_doc", "_row", "doc", "line")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns(frame, name):
    operator, columns = OPERATORS[name]
    docs = frame(ROWS, "doc_id long, text string, source string")
    mine = docs
    for c in columns:
        mine = mine.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    out = operator(mine)
    assert [c for c in out.columns if c in mine.columns] == mine.columns
    rows = [r.asDict() for r in out.collect()]
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in columns)
    rest = [c for c in operator(docs).columns if c.lower() not in {x.lower() for x in columns}]
    assert sorted(map(str, out.select(rest).collect())) == sorted(map(str, operator(docs).select(rest).collect()))
