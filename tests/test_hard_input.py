"""Single inputs that must neither stop a job nor take long."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from streetbook.functions import html as H
from streetbook.functions.contacts import extract_website
from streetbook.operators import extract as X


def site(spark, text, strict=False):
    rows = spark.createDataFrame([(text,)], "t string")
    return rows.select(extract_website("t", strict=strict).alias("s")).select("s.*").first()


@pytest.fixture(scope="module")
def warm(spark):
    for strict in (False, True):
        site(spark, "see www.site.example now", strict)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(
    "text, website",
    [("1." * 100_000, None), ("1." * 100_000 + " www.site.example", "https://www.site.example"), ("a" * 1_000_000 + " b@x.site.example", None)],
)
def test_long_runs(spark, warm, text, website, strict):
    begin = time.time()
    found = site(spark, text, strict)
    assert time.time() - begin < 4
    assert strict or found["website"] == website
    assert "@" not in text or strict or found["text"].startswith("aaa")


@pytest.mark.parametrize(
    "text, website, rest",
    [
        ("go foo.com2 x", "https://foo.com", "go 2 x"),
        ("a.b.c and d-e.example/p?q, x", "https://d-e.example/p?q", "a.b.c and , x"),
        ("see abc/foo.com/z", "https://foo.com/z", "see abc/"),
        ("no host. here", None, "no host. here"),
        ("me@mail.example", None, "me@"),
        (None, None, None),
    ],
)
def test_hosts(spark, text, website, rest):
    found = site(spark, text)
    assert (found["website"], found["text"]) == (website, rest)


@pytest.mark.parametrize("markup", ["<p><![foo bar]>x", "<![%x;[", "<![CDATA[ a ]]>y", "<!doctype", "<![", "<a <b>", "</", "<!-- x", "&#xZZ;"])
def test_odd_markup(spark, markup):
    row = spark.createDataFrame([(f"<title>T</title>{markup}",)], "html string").select(H.page_tree("html").alias("t")).first()
    assert row["t"]["nodes"][0]["tag"] == "title"


def test_strange_end_tags_are_linear(spark):
    begin = time.time()
    H._parse("<i>" * 20_000 + "</b>" * 20_000)
    assert time.time() - begin < 4


def test_repeated_menu_key_takes_the_last(spark):
    page = '{"menu": {"A": [{"name": "x", "price": 1}], "B": [{"name": "z"}], "A": [{"name": "y", "price": 2.5}]}, "k": 1}'
    rows = X.with_tree(spark.createDataFrame([(page,)], "html string"))
    menu = rows.select(X.full_menu(F.col("tree"), F.col("html")).alias("m")).first()["m"]
    assert [(k, [(i["name"], i["price"]) for i in v]) for k, v in menu.items()] == [("A", [("y", "2.5 руб.")]), ("B", [("z", None)])]


def test_dedupe_of_many_items(spark):
    n = 50_000
    items = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((i % 20_000).alias("k"), i.alias("v"))).alias("x"))
    begin = time.time()
    row = items.select(H.keep_first(F.col("x"), lambda s: s["k"]).alias("a"), H.keyed(F.col("x"), lambda s: s["k"]).alias("b")).first()
    assert time.time() - begin < 6
    assert [s["v"] for s in row["a"]] == list(range(1, 20_001))
    assert [s["k"] for s in row["b"]] == [s["k"] for s in row["a"]]
    assert [s["v"] for s in row["b"]][:2] == [40_001, 40_002] and row["b"][-1]["v"] == 40_000
