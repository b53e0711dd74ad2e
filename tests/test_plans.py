"""Plans that must stay as they are meant."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from streetbook.fixtures import Fixture
from streetbook.operators.classify import review_moderated
from streetbook.operators.browse import company_detail
from streetbook.operators.menus import compare_menus, menu_decisions, replace_menus
from streetbook.operators.report import audit
from streetbook.operators.work import select_quality
from streetbook.plans.menu_refresh import refresh_menus
from streetbook.sources.catalog import Catalog

FOLDER = "/root/testdata/sf0.001"


def detail(spark, folder):
    tables = ("companies", "cities", "categories", "company_categories", "tags", "company_tags")
    return company_detail(Fixture(spark, folder).catalog(*tables), [1, 2, 3])


@pytest.mark.parametrize("query", [entry.queries()["page_catalog"], entry.queries()["f13_companies_with_categories"], detail])
def test_companies_are_read_once(spark, query):
    plan = query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c_custkey") == 1


def test_review_leaves_companies_in_place(spark):
    companies = spark.range(1000).selectExpr("id", "cast(id as string) name", "'text' description")
    categories = spark.createDataFrame([(1, "cafe")], "id int, slug string")
    plan = review_moderated(companies, categories)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning(_rule" not in plan


def test_audit_reads_each_table_once(spark, tmp_path):
    tables = {
        "cities": ("id bigint, name string, slug string", [(1, "A", "a"), (2, None, "a"), (3, "C", None), (4, "D", None)]),
        "categories": ("id bigint, name string, slug string", [(1, "x", "x")]),
        "companies": (
            "id bigint, external_id string, url string, name string, phone string, city_id bigint",
            [(1, "e", "u", "n", "p", 1), (2, "e", "u", None, "p" * 51, 9), (3, "e", None, "n" * 501, None, None), (4, None, None, "n", None, 9)],
        ),
        "company_categories": ("company_id bigint, category_id bigint", [(1, 1), (1, 1), (1, 7), (8, 1), (None, 1), (None, 1)]),
        "reviews": ("id bigint, company_id bigint, rating int", [(1, 1, 5), (2, 8, 6), (3, 8, 0), (4, None, None)]),
    }
    made = {}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        made[name] = spark.read.parquet(f"{tmp_path}/{name}")
    found = audit(Catalog(**made))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation [" in line]) == len(tables)
    got = {r.check: r.violations for r in found.collect()}
    assert {k: v for k, v in got.items() if v} == {
        "unique cities(slug)": 1, "unique companies(external_id)": 2, "unique companies(url)": 1, "unique company_categories(company_id,category_id)": 1,
        "not null cities(name)": 1, "not null cities(slug)": 2, "not null companies(name)": 1, "length companies(name)": 1, "length companies(phone)": 1,
        "rating reviews": 2, "reference company_categories(company_id)": 1, "reference company_categories(category_id)": 1,
        "reference reviews(company_id)": 2, "reference companies(city_id)": 2,
    }
    assert len(got) == 18


def gate(rows):
    """The quality gate, list by list."""
    lists, out = {}, []
    for row in rows:
        if None in (row[0], row[1], row[3]):
            out.append((*row, "failed"))
        else:
            lists.setdefault(row[:2], []).append(row)
    for rows in lists.values():
        saved, quota = 0, max(r[3] for r in rows)
        for row in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0))[: 2 * quota]:
            good = (row[4] or 0) >= 4 and (row[5] or 0) >= 5 and not row[6]
            what = "not_reached" if saved >= quota else "saved" if good else "failed" if row[6] else "skipped"
            saved += good
            out.append((*row, what))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 7, 1024])
def test_long_lists_are_ranked_in_parts(spark, span):
    schema = "city_id long, category string, pos long, quota int, rating double, review_count int, failed boolean"
    rows = [(c, k, p, 3 * c, 3.0 + p % 7 / 4, p % 9, p % 11 == 0) for c in range(4) for k in "ab" for p in range(-5, 60 * c, 1 + c)]
    rows += [(1, "a", None, 3, 5.0, 9, False), (None, "a", 1, 3, 5.0, 9, False), (1, None, 1, 3, 5.0, 9, False), (1, "a", 999, None, 5.0, 9, None)]
    done = select_quality(spark.createDataFrame(rows, schema).repartition(3), span=span)
    assert sorted((tuple(r) for r in done.collect()), key=str) == gate(rows)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line]
    assert sorts and all("_part" in line.split("row_number()")[1] for line in sorts)


def relations(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in line]


def menu_tables(spark, tmp_path):
    items = "company_id bigint, section string, pos bigint, name string, price string"
    made = {
        "old": (items, [(1, "a", 1, "x", "1"), (2, "a", 1, "x", "1"), (3, "a", 1, "x", "1"), (None, "a", 1, "x", "1"), (4, "a", 1, "x", "1")]),
        "fresh": (items, [(1, "a", 1, "x", "2"), (1, "a", 2, "y", "2"), (2, "a", 1, "x", "2"), (None, "a", 2, "z", "2"), (5, "a", 1, "x", "2")]),
        "companies": ("id bigint, name string", [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E"), (5, "E")]),
        "read": ("id bigint", [(1,), (2,), (3,), (5,)]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    return [spark.read.parquet(f"{tmp_path}/{name}") for name in made]


def test_decisions_read_each_menu_once(spark, tmp_path):
    old, fresh, companies, read = menu_tables(spark, tmp_path)
    log = menu_decisions(companies, old, fresh, read)
    assert len(relations(log)) == 4
    assert sorted((r.id, r.status, r.reason) for r in log.collect()) == [
        (1, "updated", "more_items (+1)"), (2, "skipped", "current_is_better"), (3, "skipped", "no_menu_on_page"),
        (4, "error", "fetch_failed"), (5, "updated", "more_items (+1)"), (5, "updated", "more_items (+1)"),
    ]


def test_replaced_menus_read_the_decisions_once(spark, tmp_path):
    old, fresh, companies, read = menu_tables(spark, tmp_path)
    out = replace_menus(old, fresh, menu_decisions(companies, old, fresh, read))
    assert len(relations(out)) == 6
    assert sorted((r.company_id or 0, r.section, r.pos, r.name, r.price) for r in out.collect()) == [
        (0, "a", 1, "x", "1"), (1, "a", 1, "x", "2"), (1, "a", 2, "y", "2"), (2, "a", 1, "x", "1"), (3, "a", 1, "x", "1"),
        (4, "a", 1, "x", "1"), (5, "a", 1, "x", "2"),
    ]


def test_refresh_stores_the_listed_companies(spark, tmp_path):
    menu = "map<string,array<struct<name:string,price:string,portion:string>>>"
    rows = [(1, "A", "u1", {"a": [("x", "1", None)]}), (2, "B", "u2", {}), (3, "C", None, {"a": [("x", "1", None)]})]
    spark.createDataFrame(rows, f"id bigint, name string, url string, menu {menu}").write.parquet(f"{tmp_path}/companies")
    spark.createDataFrame([("u1", "<p>"), ("u2", "<p>")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    made = refresh_menus(spark.read.parquet(f"{tmp_path}/companies"), spark.read.parquet(f"{tmp_path}/pages"))
    assert relations(made.log) == []
    assert [(r.id, r.reason) for r in made.log.collect()] == [(1, "no_menu_on_page")]


def test_details_group_links_without_their_company(spark):
    plan = detail(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "any_value(" in line and "collect_set(" in line]
    assert plan.count("collect_set(") == 2


def test_details_of_rows_that_repeat_or_lack_links(spark):
    table = spark.createDataFrame
    cat = Catalog(
        companies=table([(1, "A", 7), (1, "A", 7), (2, "B", None), (3, "C", 7), (None, "D", 7)], "id long, name string, city_id long"),
        cities=table([(7, "T", "t"), (7, "T", "t")], "id long, name string, slug string"),
        categories=table([(1, "c"), (2, "b"), (2, "b"), (3, None)], "id long, name string"),
        company_categories=table([(1, 1), (1, 2), (1, 2), (2, 3), (3, 9), (None, 1)], "company_id long, category_id long"),
        tags=table([(5, "t")], "id long, name string"),
        company_tags=table([(2, 5), (2, 5), (9, 5)], "company_id long, tag_id long"),
    )
    want = [(1, "A", "T", ["b", "c"], []), (2, "B", None, [], ["t"])]
    for ids in ([1, 2], table([(1,), (2,), (2,), (None,), (8,)], "id long")):
        got = company_detail(cat, ids).select("id", "name", "city_name", "category_names", "tag_names").collect()
        assert sorted(tuple(r) for r in got) == want


def test_a_section_is_sent_once_to_be_compared(spark, tmp_path):
    """Menus that are compared are sent by company and section, then by company; rows numbered so are not sent again to be grouped."""
    rows = spark.range(200).selectExpr("id % 7 company_id", "cast(id % 5 as string) section", "id pos", "cast(id as string) name")
    plan = compare_menus(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(company_id" in plan and plan.count("Exchange hashpartitioning") == 2
    tables = {
        "orders": "SELECT id o_orderkey, id % 3 o_custkey FROM range(20)",
        "lineitem": "SELECT id % 20 l_orderkey, id % 4 l_partkey, cast(id as int) l_linenumber FROM range(60)",
        "part": "SELECT id p_partkey, concat('t', id % 2) p_type, concat('n', id) p_name, id + 1.5D p_retailprice FROM range(4)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    fx = Fixture(spark, str(tmp_path))
    assert sorted(fx.menu_old.collect()) == sorted(fx.sql("SELECT * FROM menu_old").collect()) and fx.menu_old.count() == 60
    grouped = fx.menu_old.groupBy("company_id", "section").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(company_id" in grouped and "hashpartitioning(o_custkey" not in grouped
    assert grouped.count("hashpartitioning(company_id") == 1
