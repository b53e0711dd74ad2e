"""Merge queries E1 to E18."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from streetbook.dicts.sites import CITY_HOSTS, SUBDOMAIN_HOST
from streetbook.operators import menus as U
from streetbook.operators import merge as M

DAY = "2024-01-01"

# Incoming rows: known by id, by URL, by both, by neither; some come twice, some share a new external id or URL.
INC = """
    SELECT external_id, url, name, address, city_id, website, rating, review_count, 1 AS seq FROM incoming
    UNION ALL
    SELECT external_id, concat(url, 'again/'), concat(name, ' again'), address, city_id, NULL, rating,
           review_count + 1, 2 FROM incoming WHERE external_id IS NOT NULL
    UNION ALL
    SELECT concat('n', CAST(review_count % 50 AS STRING)), concat(url, 'n/'), concat(name, ' n'), address, city_id,
           website, rating, review_count, 3 FROM incoming
    UNION ALL
    SELECT NULL, concat(url, 'n/'), concat(name, ' m'), address, city_id, website, NULL, review_count, 4 FROM incoming
    WHERE review_count % 3 = 0"""
NUMBER = "CAST((SELECT MAX(id) FROM companies) + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) AS BIGINT)"
UPSERT = f"""
    inc AS ({INC}),
    met AS (SELECT inc.*, coalesce(a.id, b.id) AS target FROM inc
            LEFT JOIN companies a ON a.external_id = inc.external_id LEFT JOIN companies b ON b.url = inc.url),
    upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq DESC, name DESC, url DESC) AS rn
                           FROM met WHERE target IS NOT NULL) q WHERE rn = 1),
    owner AS (SELECT url, MIN(external_id) AS own FROM met WHERE target IS NULL AND external_id IS NOT NULL GROUP BY url),
    fresh AS (SELECT coalesce(m.external_id, o.own) AS external_id, m.url, m.name, m.address, m.city_id, m.website,
                     m.rating, m.review_count, m.seq,
                     coalesce('x' || m.external_id, 'x' || o.own, 'u' || m.url) AS k
              FROM met m LEFT JOIN owner o ON o.url = m.url WHERE m.target IS NULL),
    ins AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, name DESC, url DESC) AS rn
                           FROM fresh) q WHERE rn = 1)"""
UPSERTED = ("id", "external_id", "url", "name", "address", "city_id", "website", "rating", "review_count", "phone",
            "source", "parsed_at")


def _shown(df):
    return df.select(*[F.col(c).cast("string").alias(c) if c == "parsed_at" else F.col(c) for c in UPSERTED])


def _upsert(fx, mode="overwrite"):
    as_of = F.lit(DAY).cast("date")
    cur = fx.companies.drop("hours_line")
    return M.upsert_companies(cur, fx.sql(f"SELECT * FROM ({INC}) i"), as_of, mode, F.struct("seq", "name", "url"))


@register(
    "e01_upsert_overwrite",
    f"""WITH {UPSERT}
        SELECT c.id, c.external_id, CASE WHEN u.target IS NULL THEN c.url ELSE u.url END AS url,
               CASE WHEN u.target IS NULL THEN c.name ELSE u.name END AS name,
               CASE WHEN u.target IS NULL THEN c.address ELSE u.address END AS address,
               CASE WHEN u.target IS NULL THEN c.city_id ELSE u.city_id END AS city_id,
               CASE WHEN u.target IS NULL THEN c.website ELSE u.website END AS website,
               CASE WHEN u.target IS NULL THEN c.rating ELSE u.rating END AS rating,
               CASE WHEN u.target IS NULL THEN c.review_count ELSE u.review_count END AS review_count,
               CASE WHEN u.target IS NULL THEN c.phone END AS phone, c.source,
               CASE WHEN u.target IS NULL THEN CAST(c.parsed_at AS STRING) ELSE '{DAY}' END AS parsed_at
        FROM companies c LEFT JOIN upd u ON u.target = c.id
        UNION ALL
        SELECT {NUMBER}, external_id, url, name, address, city_id, website, rating, review_count, NULL, NULL, '{DAY}'
        FROM ins""",
)
def e01(fx):
    return _shown(_upsert(fx).snapshot)


@register(
    "e01_upsert_fill_empty",
    f"""WITH {UPSERT}
        SELECT c.id, c.external_id, coalesce(nullif(c.url, ''), u.url) AS url,
               coalesce(nullif(c.name, ''), u.name) AS name, coalesce(nullif(c.address, ''), u.address) AS address,
               coalesce(c.city_id, u.city_id) AS city_id, coalesce(nullif(c.website, ''), u.website) AS website,
               coalesce(c.rating, u.rating) AS rating, coalesce(c.review_count, u.review_count) AS review_count,
               c.phone, c.source,
               CASE WHEN u.target IS NULL THEN CAST(c.parsed_at AS STRING) ELSE '{DAY}' END AS parsed_at
        FROM companies c LEFT JOIN upd u ON u.target = c.id
        UNION ALL
        SELECT {NUMBER}, external_id, url, name, address, city_id, website, rating, review_count, NULL, NULL, '{DAY}'
        FROM ins""",
)
def e01_fill(fx):
    return _shown(_upsert(fx, "fill_empty").snapshot)


CROSSED = """SELECT external_id, lead_url AS url, name, address, city_id, website, rating, review_count
             FROM (SELECT c.*, concat('https://dir.example.org/com/p_',
                                      CAST(CASE WHEN id % 10 = 3 THEN id + 1 ELSE id END AS STRING), '/') AS lead_url
                   FROM companies c) q"""


@register(
    "e01_upsert_conflicts",
    f"""WITH inc AS ({CROSSED})
        SELECT i.external_id, i.url, a.id AS id_by_external_id, b.id AS id_by_url
        FROM inc i JOIN companies a ON a.external_id = i.external_id JOIN companies b ON b.url = i.url
        WHERE a.id <> b.id""",
)
def e01_conflicts(fx):
    cur = fx.companies.drop("hours_line")
    return M.upsert_companies(cur, fx.sql(f"SELECT * FROM ({CROSSED}) i"), F.lit(DAY).cast("date")).conflicts


@register(
    "e01_rows_without_keys",
    """SELECT address, n, n AS ids FROM (SELECT address, COUNT(*) AS n FROM companies GROUP BY address) q""",
)
def e01_loose(fx):
    """Rows without id and URL are companies of their own, equal ones too."""
    cur = fx.companies.drop("hours_line")
    none = F.lit(None).cast("string")
    inc = cur.select(none.alias("external_id"), none.alias("url"), F.lit("Same").alias("name"), "address")
    new = M.upsert_companies(cur, inc, F.lit(DAY).cast("date")).snapshot.filter("name = 'Same'")
    counts = new.groupBy("address").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    return counts


BY_NAME = """SELECT CASE WHEN review_count % 2 = 0 THEN name ELSE concat(name, ' new') END AS name, city_id,
                    concat(address, '!') AS address, website, rating, CAST(NULL AS STRING) AS phone
             FROM incoming"""


@register(
    "e02_upsert_by_name",
    f"""WITH inc AS ({BY_NAME}),
             met AS (SELECT i.*, c.id AS target FROM inc i LEFT JOIN companies c ON c.name = i.name AND c.city_id = i.city_id),
             ins AS (SELECT *, concat('k', CAST(city_id AS STRING), '/', name) AS k FROM met
                     WHERE target IS NULL AND city_id IS NOT NULL)
        SELECT c.id, c.name, c.city_id, CASE WHEN m.target IS NULL THEN c.address ELSE m.address END AS address,
               CASE WHEN m.target IS NULL THEN c.website ELSE m.website END AS website,
               CASE WHEN m.target IS NULL THEN c.phone END AS phone,
               CASE WHEN m.target IS NULL THEN c.rating ELSE m.rating END AS rating, c.source
        FROM companies c LEFT JOIN met m ON m.target = c.id
        UNION ALL SELECT {NUMBER}, name, city_id, address, website, phone, rating, 'yp.ru' FROM ins""",
)
def e02(fx):
    inc = fx.sql(f"SELECT * FROM ({BY_NAME}) i").filter("city_id is not null")
    done = M.upsert_by_name(fx.companies.drop("hours_line"), inc, F.lit(DAY).cast("date"))
    return done.snapshot.select("id", "name", "city_id", "address", "website", "phone", "rating", "source")


@register(
    "e02_rows_without_city",
    f"""SELECT address, n, n AS ids FROM (SELECT address, COUNT(*) AS n FROM ({BY_NAME}) i
                                         WHERE city_id IS NULL AND address LIKE '%!' GROUP BY address) q""",
)
def e02_loose(fx):
    """Rows without a city match nothing: each is a company of its own."""
    done = M.upsert_by_name(fx.companies.drop("hours_line"), fx.sql(f"SELECT * FROM ({BY_NAME}) i"), F.lit(DAY).cast("date"))
    return _loose(done.snapshot)


def _loose(snapshot):
    new = snapshot.filter("city_id is null and address like '%!%'")
    return new.groupBy("address").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


ABSENT = f"""SELECT * FROM ({BY_NAME}) a UNION ALL
             SELECT concat(name, ' twin'), city_id, address, website, rating, CAST(NULL AS STRING) FROM incoming
             UNION ALL SELECT concat(name, ' twin'), city_id, concat(address, ' b'), website, rating,
             CAST(NULL AS STRING) FROM incoming"""


@register(
    "e03_insert_absent",
    f"""WITH inc AS (SELECT * FROM ({ABSENT}) q WHERE city_id IS NOT NULL),
             fresh AS (SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.name = i.name
                                                             AND c.city_id = i.city_id)),
             ins AS (SELECT *, concat('k', CAST(city_id AS STRING), '/', name) AS k
                     FROM (SELECT *, row_number() OVER (PARTITION BY name, city_id ORDER BY address) AS rn FROM fresh) q
                     WHERE rn = 1)
        SELECT id, name, city_id, address, source FROM companies
        UNION ALL SELECT {NUMBER}, name, city_id, address, '2gis' FROM ins""",
)
def e03(fx):
    inc = fx.sql(f"SELECT * FROM ({ABSENT}) i").filter("city_id is not null")
    done = M.insert_absent(fx.companies.drop("hours_line"), inc, "2gis", F.col("address"))
    return done.snapshot.select("id", "name", "city_id", "address", "source")


@register(
    "e03_rows_without_city",
    f"""SELECT address, n, n AS ids FROM (SELECT address, COUNT(*) AS n FROM ({ABSENT}) i
                                         WHERE city_id IS NULL AND address LIKE '%!%' GROUP BY address) q""",
)
def e03_loose(fx):
    inc = fx.sql(f"SELECT * FROM ({ABSENT}) q")
    return _loose(M.insert_absent(fx.companies.drop("hours_line"), inc, "yp.ru").snapshot)


@register(
    "e04_new_candidates",
    """SELECT i.external_id, i.url, i.city_id FROM incoming i
       WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.external_id = i.external_id AND c.city_id = i.city_id)""",
)
def e04(fx):
    return M.new_candidates(fx.incoming, fx.companies).select("external_id", "url", "city_id")


HOST_ROWS = ", ".join(f"('{slug}', '{name}')" for slug, name in CITY_HOSTS)
NAMED_CITIES = f"""SELECT c.id, coalesce(h.name, c.name) AS name, c.slug, c.region, c.url FROM cities c
                   LEFT JOIN (SELECT * FROM (VALUES {', '.join(f"({2 * i}, '{n}')" for i, (_, n) in enumerate(CITY_HOSTS[:8]))}) v(id, name)) h
                   ON h.id = c.id"""


@register(
    "e08_city_hosts",
    f"""WITH cur AS ({NAMED_CITIES}), h AS (SELECT * FROM (VALUES {HOST_ROWS}) v(slug, name)),
             fresh AS (SELECT * FROM h WHERE name NOT IN (SELECT name FROM cur))
        SELECT c.id, c.name, c.slug, c.region, coalesce('https://' || h.slug || '.{SUBDOMAIN_HOST}', c.url) AS url
        FROM cur c LEFT JOIN h ON h.name = c.name
        UNION ALL SELECT CAST((SELECT MAX(id) FROM cur) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS BIGINT),
                         name, slug, NULL, 'https://' || slug || '.{SUBDOMAIN_HOST}' FROM fresh""",
)
def e08_hosts(fx):
    return M.add_city_hosts(fx.sql(f"SELECT * FROM ({NAMED_CITIES}) n"))


UNORDERED = """SELECT external_id, url, concat(name, ' again') AS name, phone, CAST(NULL AS INT) AS pos FROM companies WHERE id % 3 <> 2
               UNION ALL SELECT external_id, url, concat(name, ' first') AS name, phone, 1 FROM companies WHERE id % 3 = 1
               UNION ALL SELECT concat(external_id, '-n'), NULL, concat(name, ' new') AS name, phone, NULL FROM companies WHERE id % 3 = 0"""


@register(
    "e01_upsert_null_order",
    f"""WITH inc AS ({UNORDERED}),
             hit AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY pos NULLS LAST) AS rn FROM inc)
        SELECT c.external_id, coalesce(h.url, c.url) AS url, coalesce(h.name, c.name) AS name, coalesce(h.phone, c.phone) AS phone
        FROM companies c LEFT JOIN hit h ON h.external_id = c.external_id AND h.rn = 1
        UNION ALL SELECT external_id, url, name, phone FROM inc WHERE external_id LIKE '%-n'""",
)
def e01_null_order(fx):
    """Rows without an order win only where a company has no other, and never wipe it."""
    inc = fx.sql(f"SELECT * FROM ({UNORDERED}) u")
    cur = fx.companies.select("id", "external_id", "url", "name", "phone", "parsed_at")
    done = M.upsert_companies(cur, inc, F.lit("2024-01-01").cast("date"), order=F.col("pos"))
    return done.snapshot.select("external_id", "url", "name", "phone")


REVIEWS = """SELECT company_id, CASE WHEN id % 5 = 0 THEN NULL ELSE author_name END AS author_name, rating,
                    CASE WHEN id % 7 = 0 THEN NULL ELSE text END AS text, date FROM reviews
             UNION ALL SELECT company_id, author_name, rating, concat(text, '!'), date FROM reviews WHERE id % 3 = 0
             UNION ALL SELECT company_id, author_name, rating, concat(text, '!'), date FROM reviews WHERE id % 6 = 0"""
NEW_REVIEWS = f"""
    inc AS (SELECT company_id, coalesce(author_name, 'Anonymous') AS author_name, rating, coalesce(text, '') AS text, date
            FROM ({REVIEWS}) q),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, author_name, text
                                                        ORDER BY date, rating) AS rn FROM inc) q WHERE rn = 1),
    ins AS (SELECT *, concat('key/', length(CAST(company_id AS STRING)), ':', company_id, length(author_name), ':', author_name,
                              length(text), ':', text) AS k FROM one o
            WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.company_id = o.company_id
                              AND r.author_name = o.author_name AND r.text = o.text))"""


@register(
    "e05_insert_reviews",
    f"""WITH {NEW_REVIEWS}
        SELECT CAST((SELECT MAX(id) FROM reviews) + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) AS BIGINT) AS id,
               company_id, author_name, rating, text, CAST(date AS STRING) AS date FROM ins""",
)
def e05(fx):
    inserted = M.insert_reviews(fx.reviews, fx.sql(f"SELECT * FROM ({REVIEWS}) r"), F.struct("date", "rating"))[1]
    return inserted.select("id", "company_id", "author_name", "rating", "text", F.col("date").cast("string").alias("date"))


@register(
    "e05_reviews_after",
    f"""WITH {NEW_REVIEWS}
        SELECT company_id, COUNT(*) AS n FROM (SELECT company_id FROM reviews UNION ALL SELECT company_id FROM ins) q
        GROUP BY company_id""",
)
def e05_after(fx):
    after = M.insert_reviews(fx.reviews, fx.sql(f"SELECT * FROM ({REVIEWS}) r"), F.struct("date", "rating"))[0]
    return after.groupBy("company_id").agg(F.count("*").alias("n"))


SEEN_CITIES = """SELECT CASE WHEN id % 2 = 0 THEN slug ELSE concat(slug, '-', CAST(weight AS STRING)) END AS slug,
                        concat(name, ' seen') AS name FROM cities
                 UNION ALL SELECT concat('town-', CAST(id % 40 AS STRING)), name FROM companies"""


@register(
    "e06_get_or_create",
    f"""WITH fresh AS (SELECT slug, MIN(name) AS name FROM ({SEEN_CITIES}) q WHERE slug NOT IN (SELECT slug FROM cities)
                       GROUP BY slug)
        SELECT id, slug, name, region FROM cities
        UNION ALL SELECT CAST((SELECT MAX(id) FROM cities)
                         + row_number() OVER (ORDER BY substr(md5(slug), 1, 3), slug) AS BIGINT), slug, name, NULL
        FROM fresh""",
)
def e06(fx):
    inc = fx.sql(f"SELECT * FROM ({SEEN_CITIES}) s")
    return M.get_or_create(fx.cities, inc, "slug", F.col("name")).select("id", "slug", "name", "region")


@register(
    "e07_add_links",
    """SELECT company_id, tag_id FROM company_tags
       UNION SELECT user_id, company_id FROM favorites""",
)
def e07(fx):
    inc = fx.favorites.select(F.col("user_id").alias("company_id"), F.col("company_id").alias("tag_id"))
    return M.add_links(fx.company_tags, inc, ["company_id", "tag_id"])


CITY_NEWS = """SELECT CASE WHEN id % 3 = 0 THEN concat(name, ' new') ELSE name END AS name,
                      concat(slug, '-x') AS slug, concat('https://', slug, '.site.example/') AS url FROM cities"""
BLANK_CITIES = """SELECT id, name, slug, region, CASE WHEN id % 2 = 0 THEN '' WHEN id % 5 = 0 THEN NULL ELSE url END AS url
                  FROM cities"""


def _cities(fx):
    return fx.sql(f"SELECT * FROM ({BLANK_CITIES}) c"), fx.sql(f"SELECT * FROM ({CITY_NEWS}) n")


@register(
    "e08_merge_cities_set_url",
    f"""WITH cur AS ({BLANK_CITIES}), inc AS ({CITY_NEWS}), ins AS (SELECT * FROM inc WHERE name NOT IN (SELECT name FROM cur))
        SELECT c.id, c.name, c.slug, coalesce(i.url, c.url) AS url FROM cur c LEFT JOIN inc i ON i.name = c.name
        UNION ALL SELECT CAST((SELECT MAX(id) FROM cur) + row_number() OVER (ORDER BY substr(md5(name), 1, 3), name)
                         AS BIGINT), name, slug, url FROM ins""",
)
def e08(fx):
    return M.merge_cities(*_cities(fx), "set_url").select("id", "name", "slug", "url")


@register(
    "e08_merge_cities_fill_url",
    f"""WITH cur AS ({BLANK_CITIES}), inc AS ({CITY_NEWS})
        SELECT c.id, c.name, coalesce(nullif(c.url, ''), i.url, c.url) AS url
        FROM cur c LEFT JOIN inc i ON i.name = c.name""",
)
def e08_fill(fx):
    return M.merge_cities(*_cities(fx), "fill_url").select("id", "name", "url")


@register(
    "e08_merge_cities_fix_slug",
    f"""WITH cur AS ({BLANK_CITIES}), inc AS ({CITY_NEWS})
        SELECT c.id, coalesce(i.slug, c.slug) AS slug FROM cur c LEFT JOIN inc i ON i.name = c.name""",
)
def e08_slug(fx):
    return M.merge_cities(*_cities(fx), "fix_slug").select("id", "slug")


@register(
    "e09_merge_menu",
    """SELECT company_id, section, pos, name, price, 0 AS origin FROM menu_old
       UNION ALL SELECT f.company_id, f.section, f.pos, f.name, f.price, 1 FROM menu_fresh f
       WHERE NOT EXISTS (SELECT 1 FROM menu_old o WHERE o.company_id = f.company_id AND o.section = f.section
                         AND o.name = f.name)""",
)
def e09(fx):
    return U.merge_menu(fx.menu_old, fx.menu_fresh)


MENU_SIDES = """
    o AS (SELECT company_id, COUNT(*) AS n, string_agg(DISTINCT section, '|' ORDER BY section) AS cats,
                 string_agg(concat(section, ':', CAST(pos AS STRING), ':', name), '|' ORDER BY section, pos) AS items
          FROM menu_old GROUP BY company_id),
    f AS (SELECT company_id, COUNT(*) AS n, string_agg(DISTINCT section, '|' ORDER BY section) AS cats,
                 string_agg(concat(section, ':', CAST(pos AS STRING), ':', name), '|' ORDER BY section, pos) AS items
          FROM menu_fresh GROUP BY company_id),
    both_sides AS (SELECT coalesce(o.company_id, f.company_id) AS company_id, coalesce(o.n, 0) AS current_count,
                          coalesce(f.n, 0) AS fresh_count, o.cats AS ocats, f.cats AS fcats, o.items AS oitems,
                          f.items AS fitems FROM o FULL OUTER JOIN f ON f.company_id = o.company_id),
    compared AS (SELECT company_id, current_count, fresh_count,
                        CASE WHEN fresh_count > current_count
                             THEN concat('more_items (+', CAST(fresh_count - current_count AS STRING), ')')
                             WHEN fresh_count = current_count AND ocats <> fcats THEN 'different_categories'
                             WHEN fresh_count = current_count AND oitems <> fitems THEN 'items_changed'
                             ELSE 'current_has_equal_or_more' END AS reason FROM both_sides)"""


@register(
    "e10_compare_menus",
    f"""WITH {MENU_SIDES}
        SELECT company_id, current_count, fresh_count, reason <> 'current_has_equal_or_more' AS should_update, reason
        FROM compared""",
)
def e10(fx):
    return U.compare_menus(fx.menu_old, fx.menu_fresh)


# Every third company lists the sections of its fresh menu the other way round.
PLACED_OLD = "SELECT *, CAST(dense_rank() OVER (PARTITION BY company_id ORDER BY section) AS BIGINT) AS section_pos FROM menu_old"
PLACED_FRESH = """SELECT *, CAST(CASE WHEN company_id % 3 = 0 THEN dense_rank() OVER (PARTITION BY company_id ORDER BY section DESC)
                                      ELSE dense_rank() OVER (PARTITION BY company_id ORDER BY section) END AS BIGINT) AS section_pos
                  FROM menu_fresh"""
TURNED = MENU_SIDES.replace(
    "string_agg(DISTINCT section, '|' ORDER BY section) AS cats", "string_agg(DISTINCT section, '|' ORDER BY section) AS up"
)
TURNED = TURNED.replace("o AS (SELECT company_id, COUNT(*) AS n,", "o AS (SELECT *, up AS cats FROM (SELECT company_id, COUNT(*) AS n,")
TURNED = TURNED.replace("FROM menu_old GROUP BY company_id)", "FROM menu_old GROUP BY company_id) q)")
TURNED = TURNED.replace(
    "f AS (SELECT company_id, COUNT(*) AS n,",
    """f AS (SELECT *, CASE WHEN company_id % 3 = 0 THEN down ELSE up END AS cats FROM (SELECT company_id, COUNT(*) AS n,
          string_agg(DISTINCT section, '|' ORDER BY section DESC) AS down,""",
)
TURNED = TURNED.replace("FROM menu_fresh GROUP BY company_id)", "FROM menu_fresh GROUP BY company_id) q)")


@register(
    "e10_section_order",
    f"""WITH {TURNED}
        SELECT company_id, current_count, fresh_count, reason <> 'current_has_equal_or_more' AS should_update, reason
        FROM compared""",
)
def e10_order(fx):
    """Menus with the same sections in another order differ."""
    return U.compare_menus(fx.sql(PLACED_OLD), fx.sql(PLACED_FRESH))


@register(
    "e10_menu_diff",
    """WITH o AS (SELECT company_id, section, COUNT(*) AS n FROM menu_old GROUP BY company_id, section),
            f AS (SELECT company_id, section, COUNT(*) AS n FROM menu_fresh GROUP BY company_id, section)
       SELECT f.company_id, f.section, concat('+', CAST(f.n - coalesce(o.n, 0) AS STRING)) AS change
       FROM f LEFT JOIN o ON o.company_id = f.company_id AND o.section = f.section WHERE f.n > coalesce(o.n, 0)""",
)
def e10_diff(fx):
    return U.menu_diff(fx.menu_old, fx.menu_fresh)


@register(
    "e11_refresh_hours",
    """SELECT id, CASE WHEN id % 3 = 1 THEN concat(hours_line, '|Sun: 12:00-13:00') ELSE hours_line END AS hours,
              id % 3 = 1 AS hours_changed FROM companies""",
)
def e11(fx):
    extra = F.array_append("working_hours", "Sun: 12:00-13:00")
    hours = F.when(F.col("id") % 3 == 1, extra).when(F.col("id") % 3 == 2, F.col("working_hours"))
    key = F.when((F.col("id") % 5 == 0) & (F.col("id") % 3 != 1), -F.col("id")).otherwise(F.col("id"))
    fresh = fx.companies.select(
        key.alias("id"), F.coalesce(hours, F.array().cast("array<string>")).alias("working_hours")
    )
    done = M.refresh_hours(fx.companies, fresh)
    return done.select("id", F.array_join("working_hours", "|").alias("hours"), "hours_changed")


# The pages of some companies were not read: what came belongs to others.
FRESH = """SELECT CASE WHEN id % 10 = 9 THEN -id ELSE id END AS id, CASE WHEN id % 2 = 0 THEN '+7 900 000-00-00' ELSE '' END AS phone,
                  CASE WHEN id % 3 = 0 THEN NULL ELSE 'Fresh street' END AS address,
                  CASE WHEN id % 8 = 0 THEN 'http://fresh.example.net' END AS website,
                  CASE WHEN id % 6 = 0 THEN concat('About ', name, ' at www.shop', CAST(id AS STRING), '.example.ru')
                       WHEN id % 6 = 1 THEN '' END AS description
           FROM companies"""
PATCH_CUR = """SELECT id, name, phone, CASE WHEN id % 4 = 1 THEN '' ELSE address END AS address, website,
                      concat('Short ', name) AS description FROM companies"""


@register(
    "e12_patch_companies",
    f"""WITH cur AS ({PATCH_CUR}), f AS ({FRESH}),
             j AS (SELECT c.*, f.phone AS fp, f.address AS fa, f.website AS fw, coalesce(f.description, c.description) AS txt
                   FROM cur c LEFT JOIN f ON f.id = c.id),
             d AS (SELECT *, CASE WHEN txt LIKE 'About%' THEN concat('https://www.shop', CAST(id AS STRING), '.example.ru') END
                                 AS tw,
                          CASE WHEN txt = '' THEN NULL WHEN txt LIKE 'About%' THEN concat('About ', name, ' at')
                               ELSE txt END AS nd FROM j),
             p AS (SELECT id, phone, address, website, description,
                          CASE WHEN website IS NULL AND txt <> '' THEN coalesce(nullif(fw, ''), tw) END AS pw,
                          CASE WHEN nd IS DISTINCT FROM description AND nd IS NOT NULL THEN nd END AS pd,
                          CASE WHEN phone IS NULL THEN nullif(fp, '') END AS pp,
                          CASE WHEN address = '' THEN nullif(fa, '') END AS pa FROM d)
        SELECT id, coalesce(pp, phone) AS phone, coalesce(pa, address) AS address, coalesce(pw, website) AS website,
               coalesce(pd, description) AS description,
               array_to_string(list_filter([CASE WHEN pw IS NOT NULL THEN 'website' END,
                   CASE WHEN pd IS NOT NULL THEN 'description' END, CASE WHEN pp IS NOT NULL THEN 'phone' END,
                   CASE WHEN pa IS NOT NULL THEN 'address' END], lambda x: x IS NOT NULL), ',') AS changed FROM p""",
)
def e12(fx):
    done = M.patch_companies(fx.sql(f"SELECT * FROM ({PATCH_CUR}) c"), fx.sql(f"SELECT * FROM ({FRESH}) f"))
    return done.select("id", "phone", "address", "website", "description", F.array_join("changed", ",").alias("changed"))


@register(
    "e13_verify_updates",
    """SELECT id, array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'name' END,
                  CASE WHEN id % 4 <> 0 AND id % 5 = 0 THEN 'website' END], lambda x: x IS NOT NULL), ',') AS mismatched
       FROM companies""",
)
def e13(fx):
    expected = fx.companies.select("id", "name", "website")
    stored = fx.companies.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("website")).alias("website"),
    )
    done = M.verify_updates(expected, stored, ["name", "website"])
    return done.select("id", F.array_join("mismatched", ",").alias("mismatched"))


READ = """SELECT CASE WHEN id % 9 = 0 THEN -id ELSE id END AS id, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN concat(coalesce(description, ''), ' more')
                          WHEN id % 4 = 2 THEN description ELSE NULL END AS description
          FROM companies"""
OUTCOMES = f"""SELECT c.id, c.description AS old, f.description AS new,
                      CASE WHEN f.id IS NULL THEN 'error' WHEN coalesce(f.description, '') = '' THEN 'empty'
                           WHEN coalesce(c.description, '') <> f.description THEN 'updated' ELSE 'unchanged' END AS outcome
               FROM companies c LEFT JOIN ({READ}) f ON f.id = c.id"""


@register("e14_refresh_counts", f"SELECT outcome, COUNT(*) AS n FROM ({OUTCOMES}) q GROUP BY outcome")
def e14(fx):
    return M.refresh_descriptions(fx.companies, fx.sql(f"SELECT * FROM ({READ}) r"))[1]


@register(
    "e14_refresh_descriptions",
    f"SELECT id, CASE WHEN outcome = 'updated' THEN new ELSE old END AS description FROM ({OUTCOMES}) q",
)
def e14_rows(fx):
    after = M.refresh_descriptions(fx.companies, fx.sql(f"SELECT * FROM ({READ}) r"))[0]
    return after.select("id", "description")


DIRTY = """SELECT id, name, city_id, source FROM companies
           UNION ALL SELECT id + 1000000, name, city_id, source FROM companies WHERE id % 10 = 0"""


@register(
    "e15_drop_duplicates",
    f"""WITH d AS ({DIRTY})
        SELECT id, name, city_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE d.id > b.id AND d.name = b.name
                                                          AND d.city_id = b.city_id)""",
)
def e15(fx):
    return M.drop_duplicates_min_id(fx.sql(f"SELECT * FROM ({DIRTY}) d")).select("id", "name", "city_id")


@register(
    "e16_drop_uncategorised",
    "SELECT id, name FROM companies WHERE id IN (SELECT company_id FROM company_categories)",
)
def e16(fx):
    return M.drop_uncategorised(fx.companies, fx.company_categories).select("id", "name")


@register(
    "e17_touch",
    f"""SELECT id, CASE WHEN id % 4 = 0 OR (id % 7 = 0 AND phone IS NOT NULL) THEN '{DAY}'
                        ELSE CAST(parsed_at AS STRING) END AS updated_at FROM companies""",
)
def e17(fx):
    cur = fx.companies.select("id", "name", "phone", F.col("parsed_at").cast("string").alias("updated_at"))
    new = cur.withColumn("name", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("name")))
    new = new.withColumn("phone", F.when(F.col("id") % 7 != 0, F.col("phone")))
    return M.touch(cur, new, ["name", "phone"], F.lit(DAY)).select("id", "updated_at")


def _gone(fx):
    tables = {n: getattr(fx, n) for n in ("companies", "company_categories", "reviews", "company_tags")}
    return M.delete_cascade(tables, fx.favorites.select(F.col("company_id").alias("id")))


@register(
    "e18_delete_cascade",
    """WITH gone AS (SELECT DISTINCT company_id AS gid FROM favorites)
       SELECT 'companies' AS part, COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS s FROM companies WHERE id NOT IN (SELECT gid FROM gone)
       UNION ALL SELECT 'company_categories', COUNT(*), CAST(SUM(company_id) AS BIGINT) FROM company_categories
       WHERE company_id NOT IN (SELECT gid FROM gone)
       UNION ALL SELECT 'reviews', COUNT(*), CAST(SUM(company_id) AS BIGINT) FROM reviews WHERE company_id NOT IN (SELECT gid FROM gone)
       UNION ALL SELECT 'company_tags', COUNT(*), CAST(SUM(company_id) AS BIGINT) FROM company_tags
       WHERE company_id NOT IN (SELECT gid FROM gone)""",
)
def e18(fx):
    parts = []
    for name, df in _gone(fx).items():
        key = "id" if name == "companies" else "company_id"
        parts.append(df.agg(F.count("*").alias("n"), F.sum(key).alias("s")).withColumn("part", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register(
    "e18_delete_city",
    """SELECT id, CASE WHEN city_id % 6 = 0 THEN NULL ELSE city_id END AS city_id FROM companies""",
)
def e18_city(fx):
    tables = {"cities": fx.cities, "companies": fx.companies}
    return M.delete_city(tables, fx.cities.filter("id % 6 = 0").select("id"))["companies"].select("id", "city_id")
