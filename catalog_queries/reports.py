"""Report and audit queries G1 to G12."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from catalog_queries.merges import DIRTY, MENU_SIDES
from streetbook.operators import menus as U
from streetbook.operators import report as R


@register(
    "g01_stats",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", COUNT(*) AS rows FROM {t}" for t in ("companies", "reviews", "categories", "cities", "tags")
    ),
)
def g01(fx):
    return R.stats(fx.catalog("companies", "reviews", "categories", "cities", "tags"))


@register("g02_by_source", "SELECT source, COUNT(*) AS count FROM companies GROUP BY source")
def g02(fx):
    return R.by_source(fx.catalog("companies"))


EMPTY = "(SELECT id, name, slug FROM {0} UNION ALL SELECT -id, concat(name, ' empty'), concat(slug, '-empty') FROM {0})"


def with_empty(rows):
    """``rows`` and as many that nothing belongs to."""
    return rows.unionByName(
        rows.withColumns({"id": -F.col("id"), "name": F.concat("name", F.lit(" empty")), "slug": F.concat("slug", F.lit("-empty"))})
    )


@register(
    "g03_top_cities",
    f"""SELECT c.id, c.name, COUNT(comp.id) AS companies FROM {EMPTY.format("cities")} c LEFT JOIN companies comp ON comp.city_id = c.id
        GROUP BY c.id, c.name ORDER BY companies DESC, c.name, c.id LIMIT 23""",
)
def g03(fx):
    return R.top_cities(fx.catalog("companies", cities=with_empty(fx.cities)), 23)


@register(
    "g04_by_category",
    f"""SELECT cat.id, cat.name, COUNT(cc.company_id) AS count FROM {EMPTY.format("categories")} cat
       LEFT JOIN company_categories cc ON cc.category_id = cat.id
       GROUP BY cat.id, cat.name""",
)
def g04(fx):
    return R.by_category(fx.catalog("company_categories", categories=with_empty(fx.categories)))


@register(
    "g05_city_stats",
    f"""SELECT city.id AS city_id, city.name, COUNT(DISTINCT c.id) AS total_companies,
               COUNT(DISTINCT CASE WHEN cat.slug = 'brand-7' THEN c.id END) AS in_category
        FROM {EMPTY.format("cities")} city LEFT JOIN companies c ON c.city_id = city.id
             LEFT JOIN company_categories cc ON cc.company_id = c.id LEFT JOIN categories cat ON cat.id = cc.category_id
        GROUP BY city.id, city.name""",
)
def g05(fx):
    cat = fx.catalog("companies", "categories", "company_categories", cities=with_empty(fx.cities))
    return R.city_stats(cat, "brand-7")


@register("g06_progress_status", "SELECT status, COUNT(*) AS count FROM progress GROUP BY status")
def g06(fx):
    return R.progress_status(fx.progress)


@register(
    "g07_duplicate_groups",
    f"SELECT name, city_id, COUNT(*) AS count FROM ({DIRTY}) d GROUP BY name, city_id HAVING COUNT(*) > 1",
)
def g07(fx):
    return R.duplicate_groups(fx.sql(f"SELECT * FROM ({DIRTY}) d"))


ORPHANS = """SELECT company_id, category_id FROM company_categories
             UNION ALL SELECT id + 5000000, 1 FROM companies WHERE id % 300 = 7"""


@register(
    "g08_orphan_links",
    f"SELECT COUNT(*) AS orphans FROM ({ORPHANS}) o WHERE company_id NOT IN (SELECT id FROM companies)",
)
def g08(fx):
    return R.orphan_links(fx.sql(f"SELECT * FROM ({ORPHANS}) o"), fx.companies)


OUTCOMES = """SELECT c.id, ci.name AS city, c.source AS category, c.rating, c.review_count,
                     CASE WHEN c.id % 23 = 0 THEN 'failed' WHEN coalesce(c.rating, 0) >= 2.8 AND c.review_count >= 5
                          THEN 'saved' ELSE 'skipped' END AS outcome
              FROM companies c JOIN cities ci ON ci.id = c.city_id"""


@register(
    "g09_ingest_summary",
    f"""SELECT COUNT(CASE WHEN outcome = 'saved' THEN 1 END) AS saved,
               COUNT(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped,
               COUNT(CASE WHEN outcome = 'failed' THEN 1 END) AS failed,
               coalesce(round(AVG(CASE WHEN outcome = 'saved' THEN rating END), 2), 0) AS avg_rating,
               CAST(SUM(CASE WHEN outcome = 'saved' THEN review_count ELSE 0 END) AS BIGINT) AS total_reviews
        FROM ({OUTCOMES}) q""",
)
def g09(fx):
    return R.ingest_summary(fx.sql(f"SELECT * FROM ({OUTCOMES}) o"))


@register(
    "g10_ingest_rollup",
    f"""SELECT city, category, CAST(grouping(city) * 2 + grouping(category) AS INT) AS level, COUNT(*) AS found,
               COUNT(CASE WHEN outcome = 'saved' THEN 1 END) AS saved,
               COUNT(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped,
               COUNT(CASE WHEN outcome = 'failed' THEN 1 END) AS failed
        FROM ({OUTCOMES}) q GROUP BY ROLLUP (city, category)""",
)
def g10(fx):
    return R.ingest_rollup(fx.sql(f"SELECT * FROM ({OUTCOMES}) o"))


LISTED = "SELECT id, name FROM companies WHERE id IN (SELECT company_id FROM menu_old)"
DECIDED = f"""{MENU_SIDES},
    log AS (SELECT l.id, l.name,
                   CASE WHEN l.id % 10 = 9 THEN 'error' WHEN f.n IS NULL THEN 'skipped'
                        WHEN c.reason <> 'current_has_equal_or_more' THEN 'updated' ELSE 'skipped' END AS status,
                   CASE WHEN l.id % 10 = 9 THEN 'fetch_failed' WHEN f.n IS NULL THEN 'no_menu_on_page'
                        WHEN c.reason <> 'current_has_equal_or_more' THEN c.reason ELSE 'current_is_better' END AS reason
            FROM ({LISTED}) l LEFT JOIN f ON f.company_id = l.id LEFT JOIN compared c ON c.company_id = l.id)"""


def _decisions(fx):
    listed = fx.sql(f"SELECT * FROM ({LISTED}) q")
    read = listed.filter("id % 10 <> 9")
    return U.menu_decisions(listed, fx.menu_old, fx.menu_fresh, read)


@register("g11_menu_log", f"WITH {DECIDED} SELECT id, name, status, reason FROM log")
def g11(fx):
    return _decisions(fx)


@register(
    "g11_menu_summary",
    f"""WITH {DECIDED} SELECT status, regexp_extract(reason, '^[a-z_]+', 0) AS reason, COUNT(*) AS n FROM log
        GROUP BY status, regexp_extract(reason, '^[a-z_]+', 0)""",
)
def g11_summary(fx):
    return U.menu_summary(_decisions(fx))


@register(
    "g11_menus_after",
    f"""WITH {DECIDED}
        SELECT company_id, section, pos, name, price FROM menu_old
        WHERE company_id NOT IN (SELECT id FROM log WHERE status = 'updated')
        UNION ALL SELECT company_id, section, pos, name, price FROM menu_fresh
        WHERE company_id IN (SELECT id FROM log WHERE status = 'updated')""",
)
def g11_after(fx):
    return U.replace_menus(fx.menu_old, fx.menu_fresh, _decisions(fx))


AUDITED = """SELECT CASE WHEN id % 50 = 1 THEN id + 1 ELSE id END AS id,
                    CASE WHEN id % 20 = 0 THEN 'x1' WHEN id % 30 = 0 THEN NULL ELSE external_id END AS external_id,
                    CASE WHEN id % 25 = 0 THEN concat(url, '/') ELSE url END AS url,
                    CASE WHEN id % 40 = 0 THEN NULL ELSE name END AS name, phone,
                    CASE WHEN id % 60 = 0 THEN 999 ELSE city_id END AS city_id FROM companies"""
RATED = "SELECT id, company_id, CASE WHEN id % 100 = 0 THEN 9 ELSE rating END AS rating FROM reviews"


@register(
    "g12_audit",
    f"""WITH a AS ({AUDITED}), r AS ({RATED})
        SELECT 'unique cities(slug)' AS "check", COUNT(slug) - COUNT(DISTINCT slug) AS violations FROM cities
        UNION ALL SELECT 'unique categories(slug)', COUNT(slug) - COUNT(DISTINCT slug) FROM categories
        UNION ALL SELECT 'unique companies(external_id)', COUNT(external_id) - COUNT(DISTINCT external_id) FROM a
        UNION ALL SELECT 'unique companies(url)', COUNT(url) - COUNT(DISTINCT url) FROM a
        UNION ALL SELECT 'unique company_categories(company_id,category_id)',
                         COUNT(*) - COUNT(DISTINCT (company_id, category_id)) FROM ({ORPHANS}) o
        UNION ALL SELECT 'not null cities(name)', COUNT(*) - COUNT(name) FROM cities
        UNION ALL SELECT 'not null cities(slug)', COUNT(*) - COUNT(slug) FROM cities
        UNION ALL SELECT 'not null categories(name)', COUNT(*) - COUNT(name) FROM categories
        UNION ALL SELECT 'not null categories(slug)', COUNT(*) - COUNT(slug) FROM categories
        UNION ALL SELECT 'not null companies(name)', COUNT(*) - COUNT(name) FROM a
        UNION ALL SELECT 'length companies(external_id)', COUNT(CASE WHEN length(external_id) > 100 THEN 1 END) FROM a
        UNION ALL SELECT 'length companies(name)', COUNT(CASE WHEN length(name) > 500 THEN 1 END) FROM a
        UNION ALL SELECT 'length companies(phone)', COUNT(CASE WHEN length(phone) > 50 THEN 1 END) FROM a
        UNION ALL SELECT 'rating reviews', COUNT(CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 1 END) FROM r
        UNION ALL SELECT 'reference company_categories(company_id)', COUNT(*) FROM ({ORPHANS}) o
                  WHERE company_id NOT IN (SELECT id FROM a)
        UNION ALL SELECT 'reference company_categories(category_id)', COUNT(*) FROM ({ORPHANS}) o
                  WHERE category_id NOT IN (SELECT id FROM categories)
        UNION ALL SELECT 'reference reviews(company_id)', COUNT(*) FROM r WHERE company_id NOT IN (SELECT id FROM a)
        UNION ALL SELECT 'reference companies(city_id)', COUNT(*) FROM a
                  WHERE city_id IS NOT NULL AND city_id NOT IN (SELECT id FROM cities)""",
)
def g12(fx):
    cat = fx.catalog(
        "cities",
        "categories",
        companies=fx.sql(f"SELECT * FROM ({AUDITED}) a"),
        reviews=fx.sql(f"SELECT * FROM ({RATED}) r"),
        company_categories=fx.sql(f"SELECT * FROM ({ORPHANS}) o"),
    )
    return R.audit(cat)
