"""Catalog queries F1 to F27."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog_queries import register
from catalog_queries.reports import EMPTY, with_empty
from streetbook.operators import browse as B
from streetbook.operators.menus import with_menu

MONDAY = datetime(2024, 1, 1, 11, 30)
NIGHT = datetime(2024, 1, 6, 1, 15)


@register(
    "f01_search",
    """SELECT c.id, c.name, c.rating, c.review_count, ci.name AS city_name
        FROM companies c LEFT JOIN cities ci ON c.city_id = ci.id
        WHERE (c.name ILIKE '%er#%' OR c.description ILIKE '%er#%' OR c.address ILIKE '%er#%')
          AND c.id IN (SELECT company_id FROM company_tags WHERE tag_id IN (2, 3)
                       GROUP BY company_id HAVING COUNT(DISTINCT tag_id) = 2)
        ORDER BY c.rating DESC NULLS LAST, c.review_count DESC, c.id LIMIT 50""",
)
def f01(fx):
    cat = fx.catalog("companies", "cities", "company_tags")
    return B.search(cat, "er#", tag_ids=[2, 3], n=50).select("id", "name", "rating", "review_count", "city_name")


@register(
    "f01_search_text_in_city",
    """SELECT c.id, c.name, c.rating, ci.name AS city_name FROM companies c LEFT JOIN cities ci ON c.city_id = ci.id
       WHERE (c.name ILIKE '%THE%' OR c.description ILIKE '%THE%' OR c.address ILIKE '%THE%') AND c.city_id = 7
       ORDER BY c.rating DESC NULLS LAST, c.review_count DESC, c.id LIMIT 20""",
)
def f01_city(fx):
    return B.search(fx.catalog("companies", "cities"), "THE", city_id=7).select("id", "name", "rating", "city_name")


@register(
    "f01_text_index",
    """SELECT gram, COUNT(DISTINCT id) AS companies FROM (
           SELECT id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS gram
           FROM (SELECT id, lower(unnest([name, description, address])) AS t FROM companies) q) g GROUP BY gram""",
)
def f01_index(fx):
    return B.text_index(fx.companies).groupBy("gram").agg(F.count("*").alias("companies"))


@register(
    "f01_search_by_index",
    """SELECT c.id, c.name, c.rating, ci.name AS city_name FROM companies c LEFT JOIN cities ci ON c.city_id = ci.id
       WHERE c.name ILIKE '%toMER#0%1_%5%' OR c.description ILIKE '%toMER#0%1_%5%' OR c.address ILIKE '%toMER#0%1_%5%'
       ORDER BY c.rating DESC NULLS LAST, c.review_count DESC, c.id LIMIT 100""",
)
def f01_by_index(fx):
    cat = fx.catalog("companies", "cities")
    found = B.search(cat, "toMER#0%1_%5", n=100, texts=B.text_index(fx.companies))
    return found.select("id", "name", "rating", "city_name")


@register(
    "f02_by_tag",
    """SELECT c.id, c.name, c.rating, ci.name AS city_name
       FROM companies c JOIN company_tags ct ON c.id = ct.company_id JOIN tags t ON ct.tag_id = t.id
                        LEFT JOIN cities ci ON c.city_id = ci.id
       WHERE t.slug = 'blue-bolt' ORDER BY c.rating DESC NULLS LAST, c.review_count DESC, c.id LIMIT 200""",
)
def f02(fx):
    cat = fx.catalog("companies", "cities", "tags", "company_tags")
    return B.by_tag(cat, "blue-bolt", n=200).select("id", "name", "rating", "city_name")


FILTERED = """
    FROM companies c LEFT JOIN company_categories cc ON c.id = cc.company_id
                     LEFT JOIN categories cat ON cc.category_id = cat.id
    WHERE cat.slug = 'brand-3' AND (c.name ILIKE '%1%' OR c.description ILIKE '%1%' OR c.address ILIKE '%1%')"""


@register(
    "f03_catalog",
    f"""SELECT q.id, q.name, q.rating, ci.name AS city_name
        FROM (SELECT DISTINCT c.id, c.name, c.rating, c.city_id {FILTERED}) q LEFT JOIN cities ci ON q.city_id = ci.id
        ORDER BY q.rating DESC NULLS LAST, q.id LIMIT 100""",
)
def f03(fx):
    cat = fx.catalog("companies", "cities", "categories", "company_categories")
    return B.catalog(cat, category="brand-3", q="1", n=100).select("id", "name", "rating", "city_name")


@register("f04_catalog_count", f"SELECT COUNT(DISTINCT c.id) AS total {FILTERED}")
def f04(fx):
    return B.catalog_count(fx.catalog("companies", "categories", "company_categories"), category="brand-3", q="1")


def _sorted(name: str, sort: str, order: str, column: str, direction: str) -> None:
    sql = f"""SELECT id, CAST({column} AS STRING) AS sort_value FROM companies
              ORDER BY {column} {direction} NULLS LAST, id LIMIT 40"""

    @register(name, sql)
    def run(fx):
        df = fx.companies.withColumn("created_at", F.col("parsed_at"))
        top = B.sort_catalog(df, sort, order).limit(40)
        return top.select("id", F.col(column).cast("string").alias("sort_value"))


_sorted("f05_sort_name_asc", "name", "asc", "name", "ASC")
_sorted("f05_sort_date_desc", "date", "desc", "parsed_at", "DESC")
_sorted("f05_sort_rating_desc", "rating", "desc", "rating", "DESC")
_sorted("f05_sort_reviews_asc", "reviews", "asc", "review_count", "ASC")


def _open_sql(day_tokens: str, seconds: int) -> str:
    return f"""
        WITH lines AS (SELECT id, split_part(hours_line, ': ', 1) AS days, split_part(hours_line, ': ', 2) AS t
                       FROM companies),
             spans AS (SELECT id, days,
                              CAST(substr(t, 1, 2) AS INT) * 3600 + CAST(substr(t, 4, 2) AS INT) * 60 AS o,
                              CAST(substr(t, 7, 2) AS INT) * 3600 + CAST(substr(t, 10, 2) AS INT) * 60 AS c
                       FROM lines)
        SELECT id FROM spans WHERE regexp_matches(days, '{day_tokens}') AND o <= {seconds} AND c >= {seconds}"""


@register("f06_open_at", _open_sql("Mo|Daily|All|Every", 41400))
def f06(fx):
    return B.open_at(fx.companies, MONDAY).select("id")


@register("f06_open_at_long_names", _open_sql("Mon|Daily", 41400))
def f06_long(fx):
    return B.open_at(fx.companies, MONDAY, every=("Daily",), two_letter=False).select("id")


@register(
    "f06_open_overnight",
    """SELECT id FROM companies WHERE hours_line LIKE 'Fri,Sat%'""",
)
def f06_overnight(fx):
    return B.open_at(fx.companies, NIGHT, overnight=True).select("id")


# Opening times of each day of the week; a line past midnight has a part on each of two days.
SPANS = """
    days(day, code) AS (VALUES (0, 'Mo'), (1, 'Tu'), (2, 'We'), (3, 'Th'), (4, 'Fr'), (5, 'Sa'), (6, 'Su')),
    lines AS (SELECT id, split_part(hours_line, ': ', 1) AS names, split_part(hours_line, ': ', 2) AS t FROM companies),
    times AS (SELECT id, names, CAST(substr(t, 1, 2) AS INT) * 3600 + CAST(substr(t, 4, 2) AS INT) * 60 AS o,
                     CAST(substr(t, 7, 2) AS INT) * 3600 + CAST(substr(t, 10, 2) AS INT) * 60 AS c FROM lines),
    named AS (SELECT id, day, o, c FROM times JOIN days ON contains(names, code) OR contains(names, 'Daily')),
    spans AS (SELECT id, day, o AS "begin", CASE WHEN c < o THEN 86399 ELSE c END AS "end" FROM named
              UNION SELECT id, (day + 1) % 7, 0, c FROM named WHERE c < o)"""


@register("f06_hours_index", f"""WITH {SPANS} SELECT id, day, "begin", "end" FROM spans""")
def f06_index(fx):
    return B.hours_index(fx.companies, overnight=True)


@register("f06_open_by_index", f"""WITH {SPANS} SELECT DISTINCT id FROM spans WHERE day = 5 AND "begin" <= 4500 AND "end" >= 4500""")
def f06_by_index(fx):
    return B.open_in(fx.companies, B.hours_index(fx.companies, overnight=True), NIGHT).select("id")


@register(
    "f06_catalog_open_now",
    """SELECT id, rating FROM companies
       WHERE (hours_line LIKE 'Daily%' OR hours_line LIKE 'Mo%') AND city_id = 3
       ORDER BY rating DESC NULLS LAST, id LIMIT 25""",
)
def f06_catalog(fx):
    return B.catalog(fx.catalog("companies", "cities"), city_id=3, n=25, open_now=MONDAY).select("id", "rating")


@register(
    "f07_open_status",
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'Открыто до 18:00' WHEN id % 4 = 1 THEN 'Открыто до 22:00'
                       ELSE NULL END AS status_label FROM companies""",
)
def f07(fx):
    return B.with_open_status(fx.companies, MONDAY).select("id", "status_label")


@register(
    "f07_open_status_closed",
    """SELECT id, CASE WHEN id % 4 = 1 THEN 'Закрыто до 10:00 сегодня' WHEN id % 4 = 3 THEN 'Закрыто до 20:00 сегодня'
                       ELSE NULL END AS status_label FROM companies""",
)
def f07_closed(fx):
    return B.with_open_status(fx.companies, NIGHT).select("id", "status_label")


@register(
    "f08_next_opening",
    """SELECT id, id % 4 IN (0, 1) AS is_open, CASE WHEN id % 4 = 3 THEN 'Пт' ELSE NULL END AS next_day,
              CASE WHEN id % 4 = 3 THEN '20:00' ELSE NULL END AS next_time FROM companies""",
)
def f08(fx):
    return B.with_next_opening(fx.companies, MONDAY).select("id", "is_open", "next_day", "next_time")


@register(
    "f08_next_opening_night",
    """SELECT id, FALSE AS is_open,
              CASE id % 4 WHEN 0 THEN 'Пн' WHEN 1 THEN 'сегодня' WHEN 2 THEN NULL ELSE 'сегодня' END AS next_day,
              CASE id % 4 WHEN 0 THEN '09:00' WHEN 1 THEN '10:00' WHEN 2 THEN NULL ELSE '20:00' END AS next_time
       FROM companies""",
)
def f08_night(fx):
    return B.with_next_opening(fx.companies, NIGHT).select("id", "is_open", "next_day", "next_time")


@register(
    "f09_format_hours",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'Пн-Вт-Ср' WHEN 1 THEN 'Пн-Вт-Ср-Чт-Пт-Сб-Вс' WHEN 2 THEN ''
                  ELSE 'Пт-Сб' END AS days, split_part(hours_line, ': ', 2) AS times FROM companies""",
)
def f09(fx):
    from streetbook.functions.hours import format_hours

    rows = fx.companies.select("id", F.explode(format_hours("working_hours")).alias("h"))
    return rows.select("id", "h.days", "h.times")


COUNTED = """SELECT c.id, c.name, COUNT(comp.id) AS count FROM cities c
             LEFT JOIN companies comp ON c.id = comp.city_id"""


@register("f10_city_list", COUNTED + " GROUP BY c.id, c.name")
def f10(fx):
    return B.city_list(fx.catalog("companies", "cities"), sort="count_desc").select("id", "name", "count")


@register(
    "f10_city_list_without",
    f"""SELECT c.id, c.name, CAST(0 AS BIGINT) AS count FROM {EMPTY.format("cities")} c LEFT JOIN companies comp ON c.id = comp.city_id
        WHERE comp.id IS NULL""",
)
def f10_without(fx):
    cat = fx.catalog("companies", cities=with_empty(fx.cities))
    return B.city_list(cat, only="without", sort="weight_desc").select("id", "name", "count")


@register(
    "f11_city_list_in",
    f"""SELECT c.id, c.name, COUNT(comp.id) AS count FROM {EMPTY.format("cities")} c LEFT JOIN companies comp ON c.id = comp.city_id
        WHERE c.id IN (SELECT DISTINCT city_id FROM companies) GROUP BY c.id, c.name""",
)
def f11_in(fx):
    cat = fx.catalog("companies", cities=with_empty(fx.cities))
    return B.city_list(cat, only="with", null_aware=True).select("id", "name", "count")


@register(
    "f11_city_list_not_in",
    f"""SELECT c.id, c.name, COUNT(comp.id) AS count FROM {EMPTY.format("cities")} c LEFT JOIN companies comp ON c.id = comp.city_id
        WHERE c.id NOT IN (SELECT DISTINCT city_id FROM companies) GROUP BY c.id, c.name""",
)
def f11_not_in(fx):
    cat = fx.catalog("companies", cities=with_empty(fx.cities))
    return B.city_list(cat, only="without", null_aware=True).select("id", "name", "count")


@register(
    "f12_category_facet",
    """SELECT c.id, c.name, COUNT(cc.company_id) AS count FROM categories c
       LEFT JOIN company_categories cc ON c.id = cc.category_id LEFT JOIN companies comp ON cc.company_id = comp.id
       WHERE comp.city_id = 4 GROUP BY c.id, c.name""",
)
def f12(fx):
    return B.category_facet(fx.catalog("companies", "categories", "company_categories"), 4)


def _f13_sql(where: str = "", order: str = "rating DESC NULLS LAST, name, id", n: int = 100) -> str:
    return f"""
        SELECT comp.id, comp.name, comp.rating,
               coalesce(string_agg(cat.name, '|' ORDER BY cat.name), '') AS categories,
               coalesce(string_agg(CAST(cat.id AS STRING), '|' ORDER BY cat.id), '') AS category_ids
        FROM companies comp LEFT JOIN company_categories cc ON comp.id = cc.company_id
                            LEFT JOIN categories cat ON cc.category_id = cat.id
        WHERE comp.city_id = 4 {where}
        GROUP BY comp.id, comp.name, comp.rating, comp.review_count
        ORDER BY {order} LIMIT {n}"""


def _f13(fx, **args):
    cat = fx.catalog("companies", "categories", "company_categories")
    return B.companies_with_categories(cat, 4, **args).select(
        "id",
        "name",
        "rating",
        F.array_join("categories", "|").alias("categories"),
        F.array_join(F.transform("category_ids", lambda x: x.cast("string")), "|").alias("category_ids"),
    )


@register("f13_companies_with_categories", _f13_sql())
def f13(fx):
    return _f13(fx)


@register("f13_one_category", _f13_sql("AND cc.category_id = 9"))
def f13_one(fx):
    return _f13(fx, category_id=9)


@register(
    "f14_list_text_filter",
    _f13_sql("AND (contains(lower(comp.name), '7') OR contains(lower(comp.address), '7'))", "name, id", 15),
)
def f14(fx):
    return _f13(fx, q="7", sort="name", n=15)


@register("f14_list_by_reviews", _f13_sql(order="comp.review_count DESC NULLS LAST, id", n=20))
def f14_reviews(fx):
    return _f13(fx, sort="reviews", n=20)


@register(
    "f15_city_top",
    "SELECT id, name, rating FROM companies WHERE city_id = 11 ORDER BY rating DESC NULLS LAST, name, id LIMIT 100",
)
def f15(fx):
    return B.city_top(fx.catalog("companies"), 11).select("id", "name", "rating")


@register(
    "f16_company_detail",
    """SELECT c.id, c.name, ci.name AS city_name, ci.slug AS city_slug, c.hours_line AS hours,
              coalesce((SELECT string_agg(cat.name, '|' ORDER BY cat.name) FROM categories cat
                        JOIN company_categories cc ON cat.id = cc.category_id WHERE cc.company_id = c.id), '')
                  AS category_names,
              coalesce((SELECT string_agg(t.name, '|' ORDER BY t.name) FROM tags t
                        JOIN company_tags ct ON t.id = ct.tag_id WHERE ct.company_id = c.id), '') AS tag_names
       FROM companies c LEFT JOIN cities ci ON c.city_id = ci.id
       WHERE c.id IN (SELECT company_id FROM favorites)""",
)
def f16(fx):
    cat = fx.catalog("companies", "cities", "categories", "company_categories", "tags", "company_tags")
    ids = fx.favorites.select(F.col("company_id").alias("id"))
    return B.company_detail(cat, ids).select(
        "id",
        "name",
        "city_name",
        "city_slug",
        F.array_join("working_hours", "|").alias("hours"),
        F.array_join("category_names", "|").alias("category_names"),
        F.array_join("tag_names", "|").alias("tag_names"),
    )


@register(
    "f17_company_tags",
    """SELECT ct.company_id, ct.tag_id, t.name, coalesce(t.category, 'другое') AS heading,
              CAST(row_number() OVER (PARTITION BY ct.company_id ORDER BY t.category NULLS LAST, t.name, t.id)
                   AS BIGINT) AS pos
       FROM tags t JOIN company_tags ct ON t.id = ct.tag_id""",
)
def f17(fx):
    return B.company_tags(fx.catalog("tags", "company_tags")).select("company_id", "tag_id", "name", "heading", "pos")


@register(
    "f18_tags_by_category",
    """SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) AS pos, id, name, slug
       FROM tags WHERE category IS NOT NULL""",
)
def f18(fx):
    return B.tags_by_category(fx.catalog("tags"))


@register(
    "f19_city_category",
    """SELECT c.id, c.name, c.rating, cat.name AS category_name
       FROM companies c JOIN company_categories cc ON cc.company_id = c.id JOIN categories cat ON cat.id = cc.category_id
                        JOIN cities city ON city.id = c.city_id
       WHERE city.slug = (SELECT slug FROM cities WHERE id = 5) AND cat.slug = 'brand-12'""",
)
def f19(fx):
    cat = fx.catalog("companies", "cities", "categories", "company_categories")
    slug = fx.cities.filter("id = 5").select("slug").scalar()
    return B.city_category(cat, slug, "brand-12").select("id", "name", "rating", "category_name")


@register(
    "f20_by_phone",
    """SELECT c.id, c.name, c.phone, city.name AS city FROM companies c JOIN cities city ON city.id = c.city_id
       WHERE c.phone LIKE '%-1%'""",
)
def f20(fx):
    return B.by_phone(fx.catalog("companies", "cities"), "-1")


@register(
    "f21_with_favorites",
    """SELECT c.id, f.company_id IS NOT NULL AS is_favorite
       FROM companies c LEFT JOIN (SELECT DISTINCT company_id FROM favorites WHERE user_id = 8) f ON f.company_id = c.id""",
)
def f21(fx):
    return B.with_favorites(fx.companies, fx.favorites, 8).select("id", "is_favorite")


@register(
    "f22_primary_category",
    """SELECT q.company_id, q.category_id, cat.slug, cat.name
       FROM (SELECT company_id, MIN(category_id) AS category_id FROM company_categories GROUP BY company_id) q
            JOIN categories cat ON cat.id = q.category_id""",
)
def f22(fx):
    return B.primary_category(fx.catalog("categories", "company_categories"))


@register(
    "f23_moderated",
    """SELECT c.id, c.name, c.source AS source_category, cat.id AS current_category_id, cat.name AS current_category
       FROM companies c JOIN company_categories cc ON c.id = cc.company_id JOIN categories cat ON cc.category_id = cat.id
       WHERE cat.slug = 'brand-5'""",
)
def f23(fx):
    from streetbook.operators.classify import moderated

    rows = moderated(fx.companies, fx.company_categories, fx.categories, catch_all="brand-5")
    return rows.select(
        "id", "name", F.col("source").alias("source_category"), "current_category_id", "current_category"
    )


@register(
    "f24_resolve_city",
    """WITH asked AS (SELECT DISTINCT lower(replace(n_name, '_', '')) AS slug FROM nation
                      UNION SELECT DISTINCT concat('city-', CAST(n_nationkey AS STRING)) FROM nation
                      UNION SELECT DISTINCT lower(r_name) FROM region),
            own AS (SELECT id, name, concat('city-', CAST(id AS STRING)) AS slug,
                           CASE WHEN id % 3 = 0 THEN NULL ELSE url END AS url FROM cities),
            sub AS (SELECT regexp_extract(url, 'https?://([^.]+)\\.example\\.org', 1) AS s, MIN(id) AS id FROM own
                    WHERE url IS NOT NULL GROUP BY 1),
            hit AS (SELECT a.slug, coalesce(sub.id, own.id) AS city_id FROM asked a LEFT JOIN sub ON sub.s = a.slug
                    LEFT JOIN own ON own.slug = a.slug)
       SELECT h.slug, h.city_id, o.name AS city_name,
              coalesce(nullif(regexp_extract(o.url, 'https?://([^.]+)\\.example\\.org', 1), ''), h.slug) AS site_slug
       FROM hit h LEFT JOIN own o ON o.id = h.city_id""",
)
def f24(fx):
    asked = fx.sql(
        """SELECT DISTINCT lower(replace(n_name, '_', '')) AS slug FROM nation
           UNION SELECT DISTINCT concat('city-', CAST(n_nationkey AS STRING)) FROM nation
           UNION SELECT DISTINCT lower(r_name) FROM region"""
    )
    own = fx.cities.withColumn("slug", F.concat(F.lit("city-"), F.col("id").cast("string")))
    own = own.withColumn("url", F.when(F.col("id") % 3 != 0, F.col("url")))
    return B.resolve_city(own, asked, "example.org")


@register(
    "f25_with_menu",
    """SELECT c.id, c.name, m.sections FROM companies c
       JOIN (SELECT company_id, COUNT(DISTINCT section) AS sections FROM menu_old GROUP BY company_id) m
         ON m.company_id = c.id
       WHERE c.id % 6 <> 0""",
)
def f25(fx):
    menus = fx.menu_old.groupBy("company_id", "section").agg(F.count("*").alias("n"))
    menus = menus.groupBy(F.col("company_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("menu")
    )
    rows = fx.companies.withColumn("url", F.when(F.col("id") % 6 != 0, F.col("url"))).join(menus, "id", "left")
    return with_menu(rows).select("id", "name", F.size("menu").cast("bigint").alias("sections"))


@register(
    "f26_card_view",
    """SELECT id, CASE WHEN id % 3 > 0 THEN concat('a', CAST(id AS STRING), '.jpg') ELSE NULL END AS image,
              CAST(id % 3 AS INT) AS photo_count, substr('w|x|y|z', 1, 5) AS card_tags,
              CASE WHEN strlen(coalesce(description, '')) > 100 THEN concat(substr(description, 1, 100), '...')
                   ELSE coalesce(description, '') END AS short_text
       FROM companies""",
)
def f26(fx):
    pictures = F.transform(
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("id") % 3).cast("int")),
        lambda p: F.struct(F.concat(p, F.col("id").cast("string"), F.lit(".jpg")).alias("preview")),
    )
    rows = fx.companies.withColumn("images", pictures)
    rows = rows.withColumn("features", F.array(*[F.lit(x) for x in "wxyz"]))
    return B.card_view(rows).select(
        "id", "image", "photo_count", F.array_join("card_tags", "|").alias("card_tags"), "short_text"
    )


@register("f27_categories_first_12", "SELECT id, name, slug FROM categories ORDER BY id LIMIT 12")
def f27(fx):
    return B.dimension_list(fx.categories, "id", 12).select("id", "name", "slug")


@register("f27_cities_by_name", "SELECT id, name FROM cities ORDER BY name, id")
def f27_cities(fx):
    return B.dimension_list(fx.cities).select("id", "name")


@register(
    "page_catalog",
    """SELECT q.id, q.name, ci.name AS city_name, cat.slug AS category_slug,
              CASE WHEN q.id % 4 = 0 THEN 'Открыто до 18:00' WHEN q.id % 4 = 1 THEN 'Открыто до 22:00' ELSE NULL END
                  AS status_label
       FROM (SELECT * FROM companies WHERE hours_line LIKE 'Daily%' OR hours_line LIKE 'Mo%'
             ORDER BY rating DESC NULLS LAST, id LIMIT 50) q
            LEFT JOIN cities ci ON ci.id = q.city_id
            LEFT JOIN (SELECT company_id, MIN(category_id) AS category_id FROM company_categories GROUP BY company_id) p
                   ON p.company_id = q.id
            LEFT JOIN categories cat ON cat.id = p.category_id""",
)
def page(fx):
    from streetbook.plans.catalog_page import catalog_page

    cat = fx.catalog("companies", "cities", "categories", "company_categories")
    return catalog_page(cat, MONDAY, open_now=True).select("id", "name", "city_name", "category_slug", "status_label")
