"""Page queries B1 to B15: over the page table, and over pages that Spark builds from the catalog tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from catalog_queries import site_pages as P
from catalog_queries.merges import MENU_SIDES
from catalog_queries.texts import MARK, commas, page_text
from streetbook.functions import contacts as N
from streetbook.operators import extract as X

LISTED = """
    WITH named AS (SELECT id, id // 20 AS block, CASE WHEN id % 7 = 0 THEN concat(name, ' again') ELSE name END AS name
                   FROM companies WHERE id % 9 <> 0 OR id % 7 = 0)
    SELECT block, CAST(id AS STRING) AS external_id, CASE WHEN id % 9 = 0 THEN 'again' ELSE name END AS name,
           concat('https://dir.example.org/north/com/p_', CAST(id AS STRING), '/') AS link, CAST(pos AS INT) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) - 1 AS pos FROM named) q WHERE pos < 15"""


@register("b01_listing_links", LISTED)
def b01(fx):
    links = X.listing_links(
        P.listing_pages(fx.companies), "/north/com/", "https://dir.example.org", 15, ("block",), "companies__item-title-text"
    )
    return links


@register(
    "b02_listing_cards",
    """SELECT name, address, phone, rating,
              CASE WHEN id % 2 = 0 THEN concat('https://msk.yp.ru/firm/', CAST(id AS STRING))
                   ELSE concat('http://other.example/', CAST(id AS STRING)) END AS link
       FROM companies WHERE id % 8 <> 0""",
)
def b02(fx):
    cards = X.listing_cards(P.card_pages(fx.companies), F.lit("msk"))
    return cards.select("name", "address", "phone", "rating", "link")


@register(
    "b03_pattern_links",
    """WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS link,
                             unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS name,
                             generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS i
                      FROM pages),
            clean AS (SELECT page_id, i, replace(replace(link, '&amp;', '&'), '&quot;', '"') AS link,
                             trim(replace(replace(name, '&amp;', '&'), '&quot;', '"')) AS name FROM found),
            kept AS (SELECT page_id, name, MIN(i) AS i FROM clean WHERE contains(link, 't') AND length(name) > 2
                     GROUP BY page_id, name),
            ranked AS (SELECT k.page_id, k.name, c.link, row_number() OVER (PARTITION BY k.page_id ORDER BY k.i) - 1 AS pos
                       FROM kept k JOIN clean c ON c.page_id = k.page_id AND c.i = k.i)
       SELECT page_id, CAST(pos AS INT) AS pos, name, link FROM ranked WHERE pos < 3""",
)
def b03(fx):
    return X.pattern_links(fx.pages, "t", 3, ("page_id",))


@register(
    "b04_detail_heading",
    """SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'),
              '&quot;', '"'), '\\s+', ' ', 'g')) AS name FROM pages""",
)
def b04(fx):
    return X.detail_fields(fx.pages, "microdata", ("page_id",)).select("page_id", "name")


@register(
    "b04_detail_microdata",
    """SELECT id, name, phone, address, rating, CASE WHEN review_count > 0 THEN review_count END AS review_count, website,
              concat('box', CAST(id AS STRING), '@mail.example') AS email FROM companies""",
)
def b04_micro(fx):
    return X.detail_fields(P.detail_pages(fx.companies), "microdata", ("id",))


@register(
    "b05_detail_cards",
    """SELECT id, name, trim(description, concat(' ', chr(9), chr(10))) AS description, address,
              CASE WHEN phone IS NULL THEN '' ELSE concat(phone, '|+7 000') END AS phones, website,
              concat('box', CAST(id AS STRING), '@mail.example') AS email, hours_line AS schedule, rating, review_count
       FROM companies""",
)
def b05(fx):
    fields = X.detail_fields(P.card_site_pages(fx.companies), "cards", ("id",))
    return fields.withColumn("phones", F.array_join("phones", "|"))


@register("b06_detail_rendered", "SELECT id, phone, address, website FROM companies")
def b06(fx):
    return X.detail_fields(P.rendered_pages(fx.companies), "rendered", ("id",))


def _trees(fx, **parts):
    return X.with_tree(P.detail_pages(fx.companies, **parts))


@register(
    "b07_opening_hours",
    "SELECT id, CASE WHEN id % 3 = 2 THEN '' ELSE hours_line END AS hours FROM companies",
)
def b07(fx):
    return _trees(fx).select("id", F.array_join(X.hours_column(F.col("tree")), "|").alias("hours"))


@register(
    "b08_social_links",
    """SELECT id, 'vk' AS network, concat('https://vk.com/c', CAST(id AS STRING), '|https://t.me/vk.com', CAST(id AS STRING))
                  AS links FROM companies
       UNION ALL SELECT id, 'telegram', concat('https://t.me/vk.com', CAST(id AS STRING)) FROM companies""",
)
def b08(fx):
    rows = _trees(fx).select("id", F.explode(X.social_column(F.col("tree"))).alias("network", "urls"))
    return rows.select("id", "network", F.array_join("urls", "|").alias("links"))


@register(
    "b09_gallery",
    """SELECT id, 0 AS pos, concat('/imager/k/100x80/responses/', CAST(id AS STRING), '.jpg') AS preview, '100x80' AS size,
              concat('https://image2.yell.ru/responses/', CAST(id AS STRING), '.jpg') AS original FROM companies
       UNION ALL SELECT id, 1, concat('/imager/k/50x40/responses/b', CAST(id AS STRING), '.jpg'), '50x40',
              concat('https://image2.yell.ru/responses/b', CAST(id AS STRING), '.jpg') FROM companies""",
)
def b09(fx):
    rows = _trees(fx).select("id", F.posexplode(X.gallery_column(F.col("tree"))).alias("pos", "i"))
    return rows.select("id", "pos", "i.preview", F.col("i.preview_size").alias("size"), "i.original")


@register(
    "b10_features",
    """SELECT company_id AS id, title, CAST(COUNT(*) AS STRING) AS count, string_agg(name, '|' ORDER BY name) AS items
       FROM (SELECT DISTINCT ct.company_id, coalesce(t.category, 'Plain') AS title, t.name
             FROM company_tags ct JOIN tags t ON t.id = ct.tag_id) q GROUP BY company_id, title""",
)
def b10(fx):
    trees = _trees(fx, company_tags=fx.company_tags, tags=fx.tags)
    rows = trees.select("id", F.explode(X.feature_groups_column(F.col("tree"))).alias("title", "body"))
    return rows.select("id", "title", "body.count", F.array_join("body.items", "|").alias("items"))


@register(
    "b10_flat_features",
    """SELECT c.id, coalesce(q.features, '') AS features FROM companies c LEFT JOIN
       (SELECT company_id, string_agg(name, '|' ORDER BY coalesce(category, 'Plain'), name) AS features
        FROM company_tags ct JOIN tags t ON t.id = ct.tag_id GROUP BY company_id) q ON q.company_id = c.id""",
)
def b10_flat(fx):
    trees = _trees(fx, company_tags=fx.company_tags, tags=fx.tags)
    return trees.select(
        "id", F.array_join(X.flat_features(X.feature_groups_column(F.col("tree"))), "|").alias("features")
    )


MENU = """SELECT m.company_id AS id, m.section, s.section_pos, m.pos, m.name, m.price,
                 CASE WHEN m.pos % 2 = 0 THEN concat(CAST(m.pos * 50 AS STRING), ' г') {other} END AS portion
          FROM menu_fresh m JOIN (SELECT company_id, section, row_number() OVER (PARTITION BY company_id ORDER BY section)
                                         AS section_pos FROM (SELECT DISTINCT company_id, section FROM menu_fresh) d) s
               ON s.company_id = m.company_id AND s.section = m.section
               JOIN companies c ON c.id = m.company_id
          WHERE m.company_id % 6 {which}"""


@register("b11_menu_rows", MENU.format(which="> 1", other=""))
def b11(fx):
    trees = _trees(fx, menu=fx.menu_fresh)
    return X.menu_long(trees.select("id", X.menu_column(F.col("tree")).alias("menu")), "id")


@register(
    "b11_menu_rows_loose",
    MENU.format(which="> 1", other="").replace("m.section, s.section_pos", "concat(m.section, 'n') AS section, s.section_pos").replace(
        "m.price,", "concat(m.price, CASE WHEN m.pos % 2 = 0 THEN concat(' за ', CAST(m.pos * 50 AS STRING), ' г') ELSE '' END) AS price,"
    ).replace("CASE WHEN m.pos % 2 = 0 THEN concat(CAST(m.pos * 50 AS STRING), ' г')  END AS portion", "'' AS portion"),
)
def b11_loose(fx):
    """The refresh job's reading: the whole title, and price and portion as they stand."""
    html = F.replace(F.replace("html", F.lit("price__list-left"), F.lit("price__list-name")), F.lit("price__list-right"), F.lit("price__list-price"))
    trees = X.with_tree(P.detail_pages(fx.companies, menu=fx.menu_fresh).withColumn("html", html))
    return X.menu_long(trees.select("id", X.smart_menu_column(F.col("tree")).alias("menu")), "id")


@register(
    "b12_menu_json",
    MENU.format(which="> 1", other="") + " UNION ALL " + MENU.format(which="<= 1", other="ELSE ''").replace(
        "concat(CAST(m.pos * 50 AS STRING), ' г')", "concat('за ', CAST(m.pos * 50 AS STRING), ' г')"),
)
def b12(fx):
    """The visible menu of most pages, the embedded one of the others."""
    trees = _trees(fx, menu=fx.menu_fresh)
    return X.menu_long(trees.select("id", X.full_menu(F.col("tree"), F.col("html")).alias("menu")), "id")


@register(
    "b13_url_keys",
    r"""SELECT id, nullif(regexp_extract(url, '/([^/]+)/$', 1), '') AS key, CAST(id AS STRING) AS number,
               CASE WHEN id % 2 = 0 THEN concat('c', CAST(id AS STRING)) END AS sub FROM companies""",
)
def b13(fx):
    site = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://c"), F.col("id").cast("string"), F.lit(".yp.ru/"))).otherwise(
        F.col("url")
    )
    rows = fx.companies.withColumn("site", site)
    return rows.select(
        "id", N.url_key("url").alias("key"), N.url_number("url").alias("number"), N.url_subdomain("site").alias("sub")
    )


@register(
    "b14_block_page",
    """SELECT page_id, contains(t, 'DDoS') OR contains(t, 'Guard') AS blocked
       FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN concat(regexp_extract(html, '<title>(.*?)</title>', 1), ' DDoS-Guard')
                                  ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS t FROM pages) q""",
)
def b14(fx):
    guarded = F.when(
        F.col("page_id") % 9 == 0, F.replace("html", F.lit("</title>"), F.lit(" DDoS-Guard</title>"))
    ).otherwise(F.col("html"))
    trees = X.with_tree(fx.pages.withColumn("html", guarded))
    return trees.select("page_id", N.is_block_page(X.title_column(F.col("tree"))).alias("blocked"))


COPIED = "'Информация  скопирована с Yell.ru вчера'"
TOLD = "description || chr(10) || chr(10) || chr(10) || 'Line two. Вот так, Наши  цены. '"


@register(
    "b15_page_description",
    f"""WITH cut AS MATERIALIZED (SELECT id, string_split({page_text('t')}, '{MARK}') AS parts
                                  FROM (SELECT id, {TOLD} AS t FROM companies) q)
        SELECT id, {commas('parts')} AS description FROM cut""",
)
def b15(fx):
    """Whole descriptions, each with a line more and the footer of a directory."""
    rows = fx.companies.withColumn("description", F.expr(f"{TOLD} || {COPIED}"))
    trees = X.with_tree(P.detail_pages(rows))
    return trees.select("id", X.description_column(F.col("tree")).alias("description"))


@register(
    "b00_extract_pages",
    """SELECT c.id, c.name, c.phone, c.address, c.rating, c.website, coalesce(m.n, 0) AS menu_items,
              coalesce(t.n, 0) AS features, 2 AS images
       FROM companies c LEFT JOIN (SELECT company_id, COUNT(*) AS n FROM menu_fresh GROUP BY company_id) m ON m.company_id = c.id
            LEFT JOIN (SELECT company_id, COUNT(*) AS n FROM company_tags GROUP BY company_id) t ON t.company_id = c.id""",
)
def b00(fx):
    pages = P.detail_pages(fx.companies, fx.menu_fresh, fx.company_tags, fx.tags)
    out = X.extract_pages(pages, ("id",))
    items = F.aggregate(F.map_values("menu"), F.lit(0).cast("bigint"), lambda acc, v: acc + F.size(v))
    return out.select(
        "id", "name", "phone", "address", "rating", "website", items.alias("menu_items"),
        F.size("features").cast("bigint").alias("features"), F.size("images").alias("images"),
    )


@register(
    "flow_menu_refresh",
    f"""WITH {MENU_SIDES}
        SELECT company_id AS id, CASE WHEN company_id % 10 = 9 THEN 'fetch_failed' WHEN fresh_count = 0 THEN 'no_menu_on_page'
                                      WHEN reason = 'current_has_equal_or_more' THEN 'current_is_better' ELSE reason END AS reason
        FROM compared JOIN companies c ON c.id = company_id WHERE current_count > 0""",
)
def menu_flow(fx):
    from streetbook.plans.menu_refresh import refresh_menus

    pages = P.detail_pages(fx.companies, fx.menu_fresh).withColumn("html", F.when(F.col("id") % 10 != 9, F.col("html")))
    items = F.collect_list(F.struct("pos", "name", "price"))
    sections = fx.menu_old.groupBy("company_id", "section").agg(F.sort_array(items).alias("items"))
    menus = sections.withColumn(
        "items", F.transform("items", lambda i: F.struct(i["name"], i["price"], F.lit(None).cast("string").alias("portion")))
    ).groupBy(F.col("company_id").alias("id"))
    menus = menus.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "items")))).alias("menu"))
    companies = fx.companies.join(menus, "id")
    return refresh_menus(companies, pages.select("url", "html")).log.select("id", "reason")


# The pages of every tenth company were not fetched, those of the next are anti-bot pages; some companies have no city.
LOST = "(c.id % 10 = 9 OR c.id % 10 = 8 OR ci.id IS NULL)"
GATED = f"""
    ranked AS (SELECT c.id, c.url, c.city_id, c.source, {LOST} AS lost, ci.id IS NULL AS homeless,
                      NOT {LOST} AND coalesce(c.rating >= 4.0 AND c.review_count >= 5, FALSE) AS good,
                      CASE WHEN ci.weight >= 500000 THEN 100 WHEN ci.weight >= 100000 THEN 50
                           WHEN ci.weight >= 50000 THEN 30 ELSE 15 END AS quota,
                      row_number() OVER (PARTITION BY ci.id IS NULL, c.city_id, c.source ORDER BY c.id) AS rn
               FROM companies c LEFT JOIN cities ci ON ci.id = c.city_id),
    looked AS (SELECT * FROM ranked WHERE homeless OR rn <= 2 * quota),
    counted AS (SELECT *, coalesce(SUM(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY homeless, city_id, source ORDER BY rn
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= quota AS beyond FROM looked),
    gated AS (SELECT *, CASE WHEN homeless THEN 'failed' WHEN beyond THEN 'not_reached' WHEN good THEN 'saved'
                             WHEN lost THEN 'failed' ELSE 'skipped' END AS outcome FROM counted)"""


def _ingest(fx, category=None, company_tags=None):
    """All pages of the catalog through extraction, gate, normaliser, moderation, upsert and tags."""
    from streetbook.dicts.sites import BLOCK_WORDS
    from streetbook.plans.ingest import ingest_pages

    pages = P.detail_pages(fx.companies, fx.menu_fresh, fx.company_tags, fx.tags)
    pages = pages.join(fx.companies.select("id", (F.col("source") if category is None else category).alias("source_category")), "id")
    blocked = F.lit(f"<html><head><title>{BLOCK_WORDS[0]}</title></head></html>")
    html = F.when(F.col("id") % 10 == 8, blocked).when(F.col("id") % 10 != 9, F.col("html"))
    pages = pages.withColumn("html", html).withColumn("pos", F.col("id")).drop("id")
    cat = fx.catalog("cities", "categories", "company_categories", "tags", companies=fx.companies.drop("hours_line"))
    cat = cat.with_tables(company_tags=fx.company_tags if company_tags is None else company_tags)
    return ingest_pages(cat, pages, F.lit("2024-01-01").cast("date"))


@register(
    "flow_ingest",
    f"""WITH {GATED}
        SELECT city_id, source AS category, COUNT(CASE WHEN outcome = 'saved' THEN 1 END) AS saved,
               COUNT(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped, COUNT(CASE WHEN outcome = 'failed' THEN 1 END) AS failed
        FROM gated GROUP BY city_id, source""",
)
def ingest_flow(fx):
    counts = {x: F.count(F.when(F.col("outcome") == x, 1)).alias(x) for x in ("saved", "skipped", "failed")}
    return _ingest(fx).outcomes.groupBy("city_id", "category").agg(*counts.values())


@register("flow_ingest_outcomes", f"WITH {GATED} SELECT id AS pos, url, city_id, source AS category, outcome FROM gated")
def ingest_outcomes(fx):
    return _ingest(fx).outcomes.select("pos", "url", "city_id", "category", "outcome")


@register(
    "flow_ingest_companies",
    f"""WITH {GATED}
        SELECT c.id, c.external_id, c.url, c.name,
               CASE WHEN c.id IN (SELECT id FROM gated WHERE outcome = 'saved') THEN '2024-01-01'
                    ELSE CAST(c.parsed_at AS STRING) END AS parsed_at FROM companies c""",
)
def ingest_companies(fx):
    out = _ingest(fx).catalog.companies
    return out.select("id", "external_id", "url", "name", F.col("parsed_at").cast("string").alias("parsed_at"))


BRAND = "concat('brand-', CAST(1 + {id} % 6 AS STRING), CAST(1 + {id} % 4 AS STRING))"


@register(
    "flow_ingest_links",
    f"""WITH {GATED.replace("c.source,", BRAND.format(id="c.id") + " AS source,").replace("c.source ORDER", BRAND.format(id="c.id") + " ORDER")},
             new AS (SELECT g.id AS company_id, k.id AS category_id FROM gated g JOIN categories k ON k.slug = g.source WHERE outcome = 'saved')
        SELECT company_id, category_id FROM company_categories WHERE company_id NOT IN (SELECT company_id FROM new)
        UNION ALL SELECT company_id, category_id FROM new""",
)
def ingest_links(fx):
    return _ingest(fx, F.expr(BRAND.format(id="id"))).catalog.company_categories.select("company_id", "category_id")


@register(
    "flow_ingest_tags",
    f"""WITH {GATED}
        SELECT company_id, t.name FROM company_tags JOIN tags t ON t.id = tag_id
        WHERE company_id IN (SELECT id FROM gated WHERE outcome = 'saved')""",
)
def ingest_tags(fx):
    """The catalog starts without tags, so that all that is there came from the pages."""
    held = _ingest(fx, company_tags=fx.company_tags.limit(0))
    return held.catalog.company_tags.join(held.catalog.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("company_id", "name")
