from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog_queries import site_pages as S
from streetbook.functions import html as H
from streetbook.operators import extract as X


def pages(spark, *markup):
    rows = [(f"u{i}", m) for i, m in enumerate(markup)]
    return spark.createDataFrame(rows, "url string, html string").repartition(2)


def value(spark, markup, build):
    return X.with_tree(pages(spark, markup)).select(build(F.col("tree")).alias("x")).first()["x"]


def test_tree_of_unclosed_markup(spark):
    markup = "<div class='a'><p>one<p>two<br>three<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></div><i>out</i></b>"
    tree = value(spark, markup, lambda t: t)
    by_tag = {}
    for node in tree["nodes"]:
        by_tag.setdefault(node["tag"], []).append("".join(tree["texts"][node["t0"]:node["t1"]]))
    assert by_tag["p"] == ["one", "twothree"] and by_tag["li"] == ["x", "y"]
    assert by_tag["tr"] == ["12", "3"] and by_tag["div"] == ["onetwothreexy123"] and by_tag["i"] == ["out"]
    for i, node in enumerate(tree["nodes"]):
        assert node["id"] == i and i <= node["last"] < len(tree["nodes"])


def test_scripts_are_no_text(spark):
    assert value(spark, "<body><script>var a='<p>x</p>'</script><style>p{}</style>t</body>",
                 lambda t: H.raw_text(t, H.first(t["nodes"]))) == "t"


def test_listing_links(spark):
    markup = """<a href="/spb/com/a_1/"> A  a </a><a href="/spb/com/b_2/">B</a><a href="/msk/com/c_3/">C</a>
                <a href="/spb/com/a_1/">A2</a><a href="/spb/com/d_4/"> </a><a href="/spb/com/e">E</a>
                <a href="/spb/com/f_6/">F</a>"""
    rows = X.listing_links(pages(spark, markup, None), "/spb/com/", "https://x", 2).orderBy("pos").collect()
    assert [(r["external_id"], r["name"], r["link"]) for r in rows] == [
        ("1", "A2", "https://x/spb/com/a_1/"), ("2", "B", "https://x/spb/com/b_2/"),
    ]


def test_listing_cards(spark):
    markup = """<div class="company-card wide"><h2 class="company-name"><a href="/f/1"> N1 </a></h2>
                <div class="address"> A1 </div><span class="rating">4.5 stars</span></div>
                <div class="company-card"><a class="company-title" href="http://z/2">N2</a><span class="rating">none</span></div>
                <div class="company-card"><p>nothing</p></div>"""
    rows = X.listing_cards(pages(spark, markup), F.lit("msk")).orderBy("pos").collect()
    assert [(r["name"], r["address"], r["phone"], r["rating"], r["link"]) for r in rows] == [
        ("N1", "A1", None, 4.5, "https://msk.yp.ru/f/1"), ("N2", None, None, 0.0, "http://z/2"),
    ]


def test_microdata_last_match_wins(spark):
    markup = """<h1>a</h1><h1>b</h1><b itemprop="telephone">1</b><b itemprop="telephone">2</b>
                <b itemprop="ratingValue">4.5</b><b itemprop="ratingValue">n/a</b><meta itemprop="reviewCount" content="x">
                <div class="company__contacts-item"><a href="https://own.example">w</a><a href="http://yell.ru/x">d</a></div>
                <a href="mailto:a@b.c">m</a>"""
    row = X.detail_fields(pages(spark, markup), "microdata").first().asDict()
    assert row == {"url": "u0", "name": "b", "phone": "2", "address": None, "rating": 4.5, "review_count": None,
                   "website": "https://own.example", "email": "a@b.c"}


def test_cards_first_match_wins(spark):
    markup = """<h1> a </h1><h1>b</h1><div class="phones"> 1 </div><div class="phone"></div><div class="phone">2</div>
                <span class="reviews-count">1 234 отзыва</span><a class="website" href="http://w">w</a>"""
    row = X.detail_fields(pages(spark, markup), "cards").first().asDict()
    assert row["name"] == "a" and row["phones"] == ["1", "2"] and row["review_count"] == 1234
    assert row["website"] == "http://w" and row["rating"] is None and row["schedule"] is None


def test_rendered_fields(spark):
    markup = """<a href="http://2gis.ru/q">own</a><a href="tel:+7912">c</a><span data-testid="address"> Main 1 </span>
                <a href="https://w.example/">w</a>"""
    row = X.detail_fields(pages(spark, markup), "rendered").first().asDict()
    assert row == {"url": "u0", "phone": "+7912", "address": "Main 1", "website": "https://w.example/"}


def test_hours_shapes(spark):
    assert value(spark, '<i itemprop="openingHours" content="Mo: 1-2"></i><i itemprop="openingHours"></i>', X.hours_column) == ["Mo: 1-2"]
    item = '<p class="company__worktime-item"><b class="company__worktime-day">{}</b><b class="company__worktime-time">{}</b></p>'
    assert value(spark, item.format("Пн", "1-2") + item.format("Вт", "") + item.format("Пн", "3-4"), X.hours_column) == ["Пн: 3-4"]
    assert value(spark, "<p>", X.hours_column) == []


def test_social_links(spark):
    markup = """<a href="https://vk.com/yellru">1</a><a href="https://www.yell.ru/x">2</a><a href="http://t.me/facebook.com">3</a>
                <a href="https://VK.com/a">4</a><a href="https://VK.com/a">5</a><a href="/local">6</a>"""
    assert value(spark, markup, X.social_column) == {
        "vk": ["https://VK.com/a"], "telegram": ["http://t.me/facebook.com"], "facebook": ["http://t.me/facebook.com"],
    }


def test_gallery(spark):
    markup = """<div class="company__gallery"><img src="/imager/a/10x20/responses/p/1.jpg"><p><img data-src="/imager/b/1x1/responses/p/1.jpg">
                <img src="/other/2.jpg"></p></div><img src="/imager/a/1x1/responses/3.jpg">
                <img itemprop="image" src="/imager/a/5x5/responses/4.jpg">"""
    assert [(i["preview_size"], i["original"][-8:]) for i in value(spark, markup, X.gallery_column)] == [
        ("10x20", "/p/1.jpg"), ("5x5", "es/4.jpg"),
    ]


def test_feature_groups(spark):
    section = '<div class="company__service__section"><b class="company__service__title">{}</b>{}</div>'
    item = '<i class="company__service__item">{}</i>'
    markup = section.format("Кухня", item.format("a") + item.format(" ") + item.format("b")) + section.format("", item.format("c"))
    markup += section.format("Пусто", "") + section.format("Тип", item.format("a")) + section.format("Кухня", item.format("z"))
    groups = value(spark, markup, X.feature_groups_column)
    assert {k: v["items"] for k, v in groups.items()} == {"Кухня": ["z"], "Тип": ["a"]}
    assert value(spark, markup, lambda t: F.map_keys(X.feature_groups_column(t))) == ["Кухня", "Тип"]


MENU = """<div class="price__list-group"><h3 class="price__list-title">T<span>Суп</span></h3>
          <p class="price__list-row"><b class="price__list-left">Борщ</b><b class="price__list-right">1 250 руб. за 300 мл</b></p>
          <p class="price__list-row"><b class="price__list-left">Без цены</b></p>
          <p class="price__list-row"><b class="price__val">Уха</b><b class="price__list-right">дорого</b></p></div>
          <div class="price__list-group"><p class="price__list-row"><b class="price__list-left">x</b></p></div>"""
EMBEDDED = '<script>a={"menu": {"Чай":[{"name":"Зелёный","price":100},{"title":"Чёрный","weight":"5 г"}],"Нет":null}, "b":1}</script>'
LISTED = '<script>a={"priceList":[{"category":"Чай","items":[{"name":"Улун","price":"7"}]},{"title":"Сок","dishes":[{"title":"Яблоко"}]},{"category":"","items":[]}]}</script>'


def shown(menu):
    return {k: [(i["name"], i["price"], i["portion"]) for i in v] for k, v in menu.items()}


@pytest.mark.parametrize(
    "markup, want",
    [
        (MENU + EMBEDDED, {"Суп": [("Борщ", "1250 руб.", "300 мл"), ("Уха", None, None)]}),
        (EMBEDDED, {"Чай": [("Зелёный", "100 руб.", None), ("Чёрный", None, "5 г")]}),
        (LISTED, {"Чай": [("Улун", "7 руб.", None)], "Сок": [("Яблоко", None, None)]}),
        (EMBEDDED + LISTED, {"Чай": [("Улун", "7 руб.", None)], "Сок": [("Яблоко", None, None)]}),
        ("<p>nothing", {}),
        ('"menu": {broken}, "x"', {}),
    ],
)
def test_menu(spark, markup, want):
    rows = X.with_tree(pages(spark, markup)).select(X.full_menu(F.col("tree"), F.col("html")).alias("m")).first()
    assert shown(rows["m"]) == want


def test_looser_menu_of_the_refresh(spark):
    markup = """<div class="price__list-group"><b class="price__list-title">A</b><p class="price__list-row">
                <i class="price__list-name">x</i><i class="price__list-price">5</i></p></div>"""
    assert shown(value(spark, markup, X.smart_menu_column)) == {"A": [("x", "5", "")]}


def test_description(spark):
    markup = '<div class="company__description">Пер<b>вое</b> слово.Второе\n<br>Описание  скопировано с yell.ru вчера</div>'
    assert value(spark, markup, X.description_column) == "Первое слово. Второе"
    assert value(spark, "<p>", X.description_column) is None


def test_extract_pages_skips_guards_and_parses_once(spark):
    df = X.extract_pages(pages(spark, "<title>DDoS-Guard</title><h1>x</h1>", "<title>ok</title><h1>y</h1>", None))
    assert [r["name"] for r in df.collect()] == ["y"]
    query = df._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert "Exchange hashpartitioning" not in query.executedPlan().toString()


def test_menu_long(spark):
    tree = X.with_tree(pages(spark, MENU)).select("url", X.menu_column(F.col("tree")).alias("menu"))
    rows = X.menu_long(tree, "url").orderBy("section_pos", "pos").collect()
    assert [(r["section"], r["section_pos"], r["pos"], r["name"]) for r in rows] == [("Суп", 1, 1, "Борщ"), ("Суп", 1, 2, "Уха")]


def test_a_batch_is_parsed_piece_by_piece(monkeypatch):
    monkeypatch.setattr(H, "PIECE_BYTES", 100)
    markup = ["<p>x</p>" * 5, None, "<b>y</b>" * 7, "", "<i>z" * 90, "<p>end"] * 20
    taken = []

    def batches():
        for part in (markup, [], markup[:3]):
            taken.append(len(part))
            yield pa.array(part, type=pa.string())

    trees, sizes = [], []
    for out in H._parse_batches(batches()):
        assert len(sizes) or taken == [len(markup)]
        sizes.append(len(out))
        trees += out.to_pylist()
    whole = markup + markup[:3]
    assert trees == pa.array([H._parse(m) for m in whole], type=H._TREE).to_pylist()
    assert len(sizes) > 40 and max(sizes) <= 4


def test_pages_of_pieces_stay_with_their_rows(spark):
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "concat(repeat('<p>', cast(id % 97 as int)), repeat('a', 2000), id) html")
    got = X.with_tree(rows).select("id", F.size("tree.nodes").alias("n"), F.element_at("tree.texts", -1).alias("t")).collect()
    assert len(got) == 4000 and all(r.n == r.id % 97 and r.t == "a" * 2000 + str(r.id) for r in got)


def test_rendered_pages_are_spread_before_they_are_parsed(spark):
    companies = spark.range(8, numPartitions=1).selectExpr("id", "'u' url", "'1' phone", "'s' address", "'w' website")
    plan = S.rendered_pages(companies)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan


def test_scanned_pages_are_those_of_the_library_parser():
    """Odd pieces in random order: what the scanner takes, and where it hands over, gives the tree that the library's parser gives."""
    pieces = ["<p>", "</P>", "<div class='a  b'>", "</div>", '<a href="x?a=1&amp;b">', "</a >", "<br/>", "<img src=x/>", "<img data-src=q src>",
              "<i content='' content=z>", "<script>", "</script>", "<style>p>a{}</style>", "</ script>", "<script/>", "a & b", "&lt;", "&#x41;", "&",
              " < ", ">", "<!DOCTYPE html>", "<!-- c -->", "<!---->", "<!-->", "<!-- a -- > b -->", "<![CDATA[ a ]]>", "<?p ?>", "</>", "<li>", "<tr>",
              "<td>", "<td", "<a b = c>", "<a b='1'c=2>", '<a b="1', "<a\nB='>'>", "<a:b>", "<h1/ >", "<\u017fcript>", "\x0b"]
    draw, whole = random.Random(7), 0
    for _ in range(3000):
        markup = "".join(draw.choices(pieces, k=draw.randint(1, 8)))
        scanned, read = H._Trees(), H._Trees()
        whole += scanned.scan(markup) == len(markup)
        read.scan = lambda html: 0
        read.add(markup)
        assert H._parse(markup) == read.array()[0].as_py(), markup
    assert whole > 300
    assert H._Trees().scan(MENU) == len(MENU)
