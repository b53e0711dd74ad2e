"""Golden rows and properties of the merges, menus and moderation."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from streetbook.dicts import categories as C
from streetbook.functions.keywords import load_rules
from streetbook.operators import classify as K
from streetbook.operators import menus as U
from streetbook.operators import merge as M
from streetbook.operators import work as H
from streetbook.operators.common import allocate_ids, cut_lineage, max_id
from streetbook.operators.report import ingest_rollup
from streetbook.plans.moderation import moderate_existing, review
from streetbook.sources.catalog import Catalog, load_catalog, save_catalog

AS_OF = "2024-01-01"
COMPANY = "id bigint, external_id string, url string, name string, city_id bigint, phone string, review_count int, parsed_at string"
INCOMING = "external_id string, url string, name string, city_id bigint, phone string, review_count int, seq int"


@pytest.fixture(scope="module")
def current(spark):
    rows = [
        (1, "a", "u1", "One", 1, "p1", 3, None), (2, "b", "u2", "Two", 1, None, 4, None), (3, None, "u3", "Three", None, "p3", 5, None),
    ]
    return spark.createDataFrame(rows, COMPANY)


def upsert(spark, current, rows, **options):
    inc = spark.createDataFrame(rows, INCOMING)
    return M.upsert_companies(current, inc, F.lit(AS_OF), order=F.col("seq"), **options)


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_upsert_golden(spark, current):
    rows = [
        ("a", "u9", "One!", 1, None, None, 1),       # id hit: URL is written
        (None, "u3", "Three!", 2, "x", 7, 2),        # URL hit
        ("b", "u1", "Two!", 1, "y", 8, 3),           # id and URL meet two companies: id wins
        ("b", "u2", "Two!!", 1, "z", 9, 4),          # second row of one company: the last wins
        ("n", "v1", "New", 1, None, None, 5),        # new by id
        (None, "v1", "New too", 1, None, 1, 6),      # joins the new company that carries its URL
        (None, "v2", "Other", 1, None, 1, 7),        # new by URL
        (None, None, "Loose", 1, None, 1, 8),        # no key: a company of its own
        (None, None, "Loose", 1, None, 1, 8),        # and its equal twin
    ]
    done = upsert(spark, current, rows)
    got = table(done.snapshot, "external_id", "url", "name", "phone", "review_count", "parsed_at")
    assert got == sorted(
        [
            ("a", "u9", "One!", None, 0, AS_OF), ("b", "u2", "Two!!", "z", 9, AS_OF), (None, "u3", "Three!", "x", 7, AS_OF),
            ("n", "v1", "New too", None, 1, AS_OF), (None, "v2", "Other", None, 1, AS_OF),
            (None, None, "Loose", None, 1, AS_OF), (None, None, "Loose", None, 1, AS_OF),
        ],
        key=str,
    )
    assert sorted(r["id"] for r in done.snapshot.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert table(done.conflicts, "external_id", "id_by_external_id", "id_by_url") == [("b", 2, 1)]


def test_upsert_twice_is_once(spark, current):
    rows = [("a", "u1", "One!", 1, "q", 1, 1), ("n", "v1", "New", 1, None, 2, 2), (None, "v2", "By url", 2, None, 3, 3)]
    once = upsert(spark, current, rows).snapshot
    twice = upsert(spark, once, rows).snapshot
    assert table(once, *once.columns) == table(twice, *twice.columns)


def test_fill_empty_keeps_values(spark, current):
    done = upsert(spark, current, [("b", "u7", "X", 9, "new", 1, 1)], mode="fill_empty").snapshot
    assert table(done.filter("id = 2"), "url", "name", "phone") == [("u2", "Two", "new")]


def test_upsert_plan_has_no_nested_loops(spark, current):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = upsert(spark, current, [("a", "u1", "x", 1, None, 1, 1)]).snapshot._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ids_are_consecutive(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k")).repartition(7)
    start = max_id(spark.createDataFrame([(41,)], "id bigint"))
    ids = sorted(r["id"] for r in allocate_ids(df, start, F.col("k")).collect())
    assert ids == list(range(42, 1042))


def test_upsert_by_name(spark, current):
    inc = spark.createDataFrame([("One", 1, "new", "l1"), ("One", 2, "x", "l2"), ("One", None, "y", "l3")],
                                "name string, city_id bigint, phone string, link string")
    done = M.upsert_by_name(current.withColumn("source", F.lit("old")), inc, F.lit(AS_OF))
    got = table(done.snapshot, "name", "city_id", "phone", "source")
    assert ("One", 1, "new", "old") in got and ("One", 2, "x", "yp.ru") in got and ("One", None, "y", "yp.ru") in got
    assert len(got) == 5


def test_merge_menu_keeps_every_old_item(spark):
    schema = "company_id bigint, section string, pos bigint, name string, price string"
    old = spark.createDataFrame([(1, "A", 1, "x", "1"), (1, "B", 1, "y", "2")], schema)
    fresh = spark.createDataFrame([(1, "A", 1, "x", "9"), (1, "A", 2, "z", "3"), (1, "A", 3, "z", "4"), (2, "C", 1, "q", "5")], schema)
    got = table(U.merge_menu(old, fresh), "company_id", "section", "name", "price")
    assert got == sorted([(1, "A", "x", "1"), (1, "B", "y", "2"), (1, "A", "z", "3"), (1, "A", "z", "4"), (2, "C", "q", "5")], key=str)


MENUS = "company_id bigint, section string, section_pos bigint, pos bigint, name string"


def test_compare_menus(spark):
    old = [(1, "A", 1, 1, "x"), (2, "A", 1, 1, "x"), (3, "A", 1, 1, "x"), (4, "A", 1, 1, "x"), (4, "A", 1, 2, "y"),
           (5, "A", 1, 1, "x"), (5, "B", 2, 1, "y"), (6, "A", 1, 1, "x")]
    fresh = [(1, "A", 1, 1, "x"), (1, "B", 2, 1, "n"), (2, "B", 1, 1, "x"), (3, "A", 1, 1, "z"), (4, "A", 1, 1, "x"),
             (5, "B", 1, 1, "y"), (5, "A", 2, 1, "x"), (6, "A", 1, 1, "x")]
    frames = [spark.createDataFrame(rows, MENUS) for rows in (old, fresh)]
    got = {r["company_id"]: r["reason"] for r in U.compare_menus(*frames).collect()}
    assert got == {1: "more_items (+1)", 2: "different_categories", 3: "items_changed", 4: "current_has_equal_or_more",
                   5: "different_categories", 6: "current_has_equal_or_more"}
    unordered = U.compare_menus(*[f.drop("section_pos") for f in frames])
    assert {r["company_id"]: r["reason"] for r in unordered.collect()}[5] == "current_has_equal_or_more"
    empty = spark.createDataFrame([(1, "E", None, None, None)], MENUS)
    assert table(U.menu_diff(frames[0], frames[1].unionByName(empty)).filter("company_id = 1"), "section", "change") == [
        ("B", "+1"), ("E", "new (0)"),
    ]


CATEGORIES = [(1, "medicina"), (2, "restorany-i-kafe"), (3, "uslugi-dom"), (4, "bary-i-kluby"), (5, "raznoe"), (6, "krasota")]


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame([(i, s, s) for i, s in CATEGORIES], "id bigint, name string, slug string")


@pytest.mark.parametrize(
    "name, description, outcome, slug",
    [
        ("[МОДЕРАЦИЯ] Стриптиз-холл", "", "stay", None),
        ("[МОДЕРАЦИЯ] Бар Стрип", "", "reassigned", "restorany-i-kafe"),
        ("Кальян", "Отдых", "stay", None),
        ("Стоматология", "врач и лечение зубов", "reassigned", "medicina"),
        ("Ветеринар-врач", "", "no_match", None),
        ("Паб", "", "reassigned", "restorany-i-kafe"),
        ("Химчистка", "", "reassigned", "uslugi-dom"),
        ("Фитнес", "", "unresolved", None),
        ("Пусто", None, "no_match", None),
    ],
)
def test_review(spark, categories, name, description, outcome, slug):
    df = spark.createDataFrame([(1, name, description)], "id bigint, name string, description string")
    row = K.review_moderated(df, categories).first()
    assert (row["outcome"], row["category_slug"]) == (outcome, slug)
    assert row["new_name"] == (name.replace("[МОДЕРАЦИЯ] ", "") if outcome == "reassigned" else name)


def test_moderation_round_trip(spark, categories):
    companies = spark.createDataFrame(
        [(1, "Клиника sex", "врач"), (2, "Кафе", ""), (3, "[МОДЕРАЦИЯ] Casino", "")], "id bigint, name string, description string"
    )
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 4)], "company_id bigint, category_id bigint")
    after = moderate_existing(Catalog(companies=companies, company_categories=links, categories=categories))
    assert table(after.companies, "id", "name") == [(1, "[МОДЕРАЦИЯ] Клиника sex"), (2, "Кафе"), (3, "[МОДЕРАЦИЯ] Casino")]
    assert table(after.company_categories, "company_id", "category_id") == [(1, 5), (2, 2), (3, 5)]
    done = review(after)
    assert table(done.catalog.companies, "id", "name")[0] == (1, "Клиника sex")
    assert table(done.catalog.company_categories, "company_id", "category_id") == [(1, 1), (2, 2), (3, 5)]
    assert {(r["outcome"], r["n"]) for r in done.summary().collect()} == {("reassigned", 1), ("stay", 1), ("total", 2)}


def test_flagging_russian(spark):
    df = spark.createDataFrame([("Отдых", "Есть КАЛЬЯН и лото"), ("Чайная", None)], "name string, description string")
    assert [r["matched"] for r in K.flag_sensitive(df).collect()] == ["кальян", None]


def test_cascade(spark):
    table_ = spark.createDataFrame([("magaziny", "книг", 0), ("sport", "йога", 1)], "rule string, keyword string, priority int")
    rows = [("Мир КНИГ", "ресторан", "bary", None, None), ("x", "Наш повар", "bary", None, None), ("x", "", "bary", None, None),
            ("x", "", None, {"Тип ресторана": 1}, None), ("x", None, None, None, ["Стрижка"]), ("x", None, None, None, None)]
    df = spark.createDataFrame(
        rows, "name string, description string, source_category string, feature_groups map<string,int>, features array<string>"
    ).coalesce(1)
    got = [r["detected_slug"] for r in K.detect_category(df, load_rules(table_)).collect()]
    assert got == ["magaziny", "restorany-i-kafe", "bary-i-kluby", "restorany-i-kafe", "krasota", None]


def test_maps():
    assert C.FIRST_SITE["bouling"] == "razvlecheniya" and len(C.CRAWL_GRID) == 13


def test_build_tags(spark):
    features = spark.createDataFrame([(1, "Кухня народов", "Русская"), (1, "Прочее", "Wi Fi"), (2, "Кухня", "русская")],
                                     "company_id bigint, title string, name string")
    tags = spark.createDataFrame([(7, "Wi-Fi", "wi-fi", None)], "id bigint, name string, slug string, category string")
    links = spark.createDataFrame([(1, 99), (3, 99)], "company_id bigint, tag_id bigint")
    all_tags, after = K.build_tags(features, tags, links)
    assert table(all_tags, "id", "slug", "category") == [(7, "wi-fi", None), (8, "russkaya", "кухня")]
    assert table(after, "company_id", "tag_id") == [(1, 7), (1, 8), (2, 8), (3, 99)]


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", None), (4, "a", None), (5, None, 1), (6, None, 1)],
                               "id bigint, name string, city_id bigint")
    once = M.drop_duplicates_min_id(df)
    assert [r[0] for r in table(once, "id")] == [1, 3, 4, 5, 6]
    assert table(M.drop_duplicates_min_id(once), "id") == table(once, "id")


def test_rollup_totals_add_up(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("city"), (F.col("id") % 4).cast("string").alias("category"),
                                 F.when(F.col("id") % 5 == 0, "failed").otherwise("saved").alias("outcome"))
    rows = ingest_rollup(df).collect()
    by_level = {level: sum(r["found"] for r in rows if r["level"] == level) for level in (0, 1, 3)}
    assert by_level == {0: 200, 1: 200, 3: 200}


def test_quality_gate(spark):
    cand = spark.createDataFrame(
        [(1, "c", p, 2, 5.0 if p != 1 else None, 9, p == 2) for p in range(8)],
        "city_id int, category string, pos int, quota int, rating double, review_count int, failed boolean",
    )
    got = {r["pos"]: r["outcome"] for r in H.select_quality(cand).collect()}
    assert got == {0: "saved", 1: "skipped", 2: "failed", 3: "saved"}
    more = H.select_quality(cand.withColumn("quota", F.lit(3)))
    assert {r["pos"]: r["outcome"] for r in more.collect()} == {0: "saved", 1: "skipped", 2: "failed", 3: "saved", 4: "saved", 5: "not_reached"}


def test_close_runs(spark):
    log = spark.createDataFrame([(1, "t", "started", 0, 10), (2, "t", "started", 0, 20), (3, "s", "done", 5, 5)],
                                "id bigint, task_type string, status string, items int, started_at int")
    results = spark.createDataFrame([("t", "completed", 7, 30), ("s", "completed", 1, 30)],
                                    "task_type string, status string, items int, completed_at int")
    got = table(H.close_runs(log, results), "id", "status", "items", "completed_at")
    assert got == [(1, "started", 0, None), (2, "completed", 7, 30), (3, "done", 5, None)]


def test_catalog_round_trip(spark, tmp_path):
    companies = spark.createDataFrame(
        [(1, "x", ["Mon: 1-2"], {"A": [("n", "1 руб.", None)]}, {"vk": ["u"]}), (2, "y", None, None, None)],
        "id bigint, name string, working_hours array<string>, menu map<string,array<struct<name:string,price:string,portion:string>>>,"
        " social_links map<string,array<string>>",
    )
    cities = spark.createDataFrame([(1, "C", "c")], "id bigint, name string, slug string")
    save_catalog(Catalog(companies=companies, cities=cities), str(tmp_path / "cat"))
    back = load_catalog(spark, str(tmp_path / "cat"), ("companies", "cities"))
    rows = back.companies.orderBy("id").collect()
    assert rows[0]["working_hours"] == ["Mon: 1-2"] and rows[0]["menu"]["A"][0]["price"] == "1 руб."
    assert rows[0]["social_links"] == {"vk": ["u"]} and rows[1]["menu"] is None and rows[1]["is_normalized"] is False
    assert back.cities.count() == 1


def test_stale_needs_a_clock(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 9)), (3, None)], "id int, parsed_at timestamp")
    got = H.stale(df, F.lit(datetime(2024, 1, 10)), 7, 10)
    assert [r["id"] for r in got.collect()] == [1, 3]


@pytest.mark.parametrize("merge", ["by_key", "by_name", "absent"])
def test_merges_read_each_input_few_times(spark, current, tmp_path, merge):
    """All plans of a merge together, those of the stored frames included, read no input more than four times."""
    rows = [("a", "u9", "One!", 1, None, None, 1), (None, None, "Loose", None, None, 1, 2), ("n", "v", "New", 2, None, 1, 3)]
    spark.createDataFrame(rows, INCOMING).write.parquet(f"{tmp_path}/inc")
    current.write.parquet(f"{tmp_path}/cur")
    cur, inc = spark.read.parquet(f"{tmp_path}/cur"), spark.read.parquet(f"{tmp_path}/inc")
    plans = []

    def settle(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    run = {
        "by_key": lambda: M.upsert_companies(cur, inc, F.lit(AS_OF), order=F.col("seq"), settle=settle),
        "by_name": lambda: M.upsert_by_name(cur, inc, F.lit(AS_OF), order=F.col("seq"), settle=settle),
        "absent": lambda: M.insert_absent(cur, inc, "s", order=F.col("seq"), settle=settle),
    }
    done = run[merge]()
    one = done.snapshot.select("id").unionByName(done.assigned.select("id"))
    if done.matched is not None:
        one = one.unionByName(done.matched.select("id"))
    plans.append(one._jdf.queryExecution().optimizedPlan().toString())
    relations = [line for plan in plans for line in plan.splitlines() if "Relation [" in line]
    assert relations and len([r for r in relations if "parsed_at#" in r]) <= 4
    assert len([r for r in relations if "seq#" in r]) == 1


def test_rules_of_a_keyword_table(spark):
    rules = spark.createDataFrame(
        [("tools", "Rod", 2), ("art", "blue", 1), ("late", "d b", 9), ("one", "z", 5), ("two", "zz", 5), ("blank", "", 0), ("far", "needle", 1)],
        "rule string, keyword string, priority int",
    )
    names = ["Rod", "BLUE rod", "red box", "izzy", "x", "", None, "hay " * 2000 + "needle", "y" * 255 + "needle"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r.id: r.rule for r in K.match_rules(df, rules).collect()}
    assert got == {0: "tools", 1: "art", 2: "late", 3: "one", 4: None, 5: None, 6: None, 7: "far", 8: "far"}
    assert K.match_rules(df, rules.limit(0)).filter("rule is not null").count() == 0
    plain = {"art": ["blue"], "tools": ["rod"], "one": ["z"]}
    table = spark.createDataFrame([(r, w, i) for i, (r, ws) in enumerate(plain.items()) for w in ws], "rule string, keyword string, priority int")
    one, other = (sorted(map(str, K.detect_category(df, x).collect())) for x in (plain, table))
    assert one == other


def test_keywords_that_begin_alike_meet_only_texts_that_hold_them(spark):
    words = [(f"r{i % 7}", f"Street {i}", i % 5 if i % 11 else None) for i in range(300)]
    words += [("long", "q" * 400 + "!", 0), ("far", "конец", 0), ("one", "z", 9), ("two", "zy", 9), ("none", "", 0), ("none", None, 0)]
    texts = [f"at street {i * 3}" for i in range(100)] + ["a" * 300 + "q" * 400 + "!", "я" * 254 + "КОНЕЦ", "xzy", "xz", "", None, "xzy"]
    rules = spark.createDataFrame(words * 2, "rule string, keyword string, priority int")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, name string")
    out = K.match_rules(df, rules)
    assert "Contains(" not in out._jdf.queryExecution().optimizedPlan().toString()
    none_first = lambda w: (w[2] is not None, w[2] or 0, w[0])
    for r in out.collect():
        held = [w for w in words if w[1] and r.name and w[1].lower() in r.name.lower()]
        assert r.rule == (min(held, key=none_first)[0] if held else None), r
