"""Moderation and category queries D1 to D9. The words are put into names and descriptions by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from streetbook.dicts import categories as C
from streetbook.dicts import moderation as M
from streetbook.operators import classify as K

# Names and descriptions with words of the dictionaries; both engines run the same expressions.
NAME = """concat(CASE WHEN id % 6 < 3 THEN '[МОДЕРАЦИЯ] ' ELSE '' END, name, CASE id % 17
        WHEN 0 THEN ' Стриптиз-холл' WHEN 1 THEN ' Кафе Vape' WHEN 2 THEN ' Стоматология и клиника'
        WHEN 3 THEN ' Школа танцев' WHEN 4 THEN ' CASINO Бар' WHEN 5 THEN ' Ресторан, паб и бильярд'
        WHEN 6 THEN ' Hookah' WHEN 7 THEN ' Мастер: ремонт, химчистка' ELSE '' END)"""
TEXT = """concat(coalesce(description, ''), CASE id % 11
        WHEN 0 THEN ' Лечение зубов, рентген, УЗИ' WHEN 1 THEN ' Табак и сигары' WHEN 2 THEN ' Ветеринар, больница'
        WHEN 3 THEN ' Фитнес, йога, Бокс' WHEN 4 THEN ' Аренда, ипотека' WHEN 5 THEN ' Покер, лото'
        WHEN 6 THEN ' Мебельный бутик' ELSE '' END)"""
TOLD = f"SELECT id, {NAME} AS name, {TEXT} AS description, source FROM companies"


def _told(fx):
    return fx.sql(f"SELECT * FROM ({TOLD}) q")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.lower() + "'" for v in values) + "]"


FLAT = [w for ws in M.SENSITIVE.values() for w in ws]
FLAGGED = f"""src AS ({TOLD}),
    flagged AS (SELECT *, list_filter({_list(FLAT)}, lambda w: contains(lower(concat(name, ' ', description)), w))[1]
                    AS matched FROM src)"""


@register("d01_flag_sensitive", f"WITH {FLAGGED} SELECT id, matched, matched IS NOT NULL AS sensitive FROM flagged")
def d01(fx):
    return K.flag_sensitive(_told(fx)).select("id", "matched", "sensitive")


MARKED = "CASE WHEN sensitive AND NOT starts_with(name, '[МОДЕРАЦИЯ]') THEN concat('[МОДЕРАЦИЯ] ', name) ELSE name END"


@register(
    "d02_moderated_names",
    f"""WITH src AS ({TOLD}),
             hit AS (SELECT *, len(list_filter({_list(M.SENSITIVE_NAMES)}, lambda w: contains(lower(name), w))) > 0
                         AS sensitive FROM src)
        SELECT id, {MARKED} AS name, sensitive FROM hit""",
)
def d02_names(fx):
    return K.mark_names(K.flag_names(_told(fx))).select("id", "name", "sensitive")


@register(
    "d02_moderated_links",
    f"""WITH {FLAGGED}
        SELECT company_id, category_id FROM company_categories
        WHERE company_id NOT IN (SELECT id FROM flagged WHERE matched IS NOT NULL)
        UNION ALL SELECT id, (SELECT id FROM categories WHERE slug = 'brand-5') FROM flagged WHERE matched IS NOT NULL""",
)
def d02_links(fx):
    flagged = K.flag_sensitive(_told(fx))
    return K.apply_moderation(flagged, fx.company_categories, fx.categories, catch_all="brand-5")[1]


@register(
    "d02_moderate_existing",
    f"""WITH src AS ({TOLD}), cats AS (SELECT id, name, CASE WHEN slug = 'brand-5' THEN '{M.CATCH_ALL_SLUG}' ELSE slug END AS slug FROM categories),
             hit AS (SELECT *, len(list_filter({_list(M.SENSITIVE_NAMES)}, lambda w: contains(lower(name), w))) > 0
                         AS sensitive FROM src),
             marked AS (SELECT id, {MARKED} AS name, sensitive FROM hit),
             links AS (SELECT company_id, category_id FROM company_categories
                       WHERE company_id NOT IN (SELECT id FROM hit WHERE sensitive)
                             OR (SELECT COUNT(*) FROM cats WHERE slug = '{M.CATCH_ALL_SLUG}') = 0
                       UNION ALL SELECT h.id, c.id FROM hit h JOIN cats c ON c.slug = '{M.CATCH_ALL_SLUG}' WHERE h.sensitive)
        SELECT m.id, m.name, l.category_id FROM marked m LEFT JOIN links l ON l.company_id = m.id""",
)
def d02_existing(fx):
    from streetbook.plans.moderation import moderate_existing

    slug = F.when(F.col("slug") == "brand-5", M.CATCH_ALL_SLUG).otherwise(F.col("slug"))
    cat = fx.catalog("company_categories", companies=_told(fx), categories=fx.categories.withColumn("slug", slug))
    out = moderate_existing(cat)
    links = out.company_categories.withColumnRenamed("company_id", "id")
    return out.companies.join(links, "id", "left").select("id", "name", "category_id")


SLUGS = dict(zip(M.REVIEW_RULES, ["brand-1", "brand-2", "brand-3", "brand-4", "brand-6", "brand-7", "brand-8", "lost",
                                  "brand-9", "brand-10"]))
RULES = {SLUGS[k]: v for k, v in M.REVIEW_RULES.items()}
EXCLUDES = {SLUGS[k]: v for k, v in M.REVIEW_EXCLUDES.items()}


def _scores() -> str:
    parts = []
    for i, (slug, words) in enumerate(RULES.items()):
        hits = f"len(list_filter({_list(words)}, lambda w: contains(clean, w)))"
        bars = EXCLUDES.get(slug)
        if bars:
            hits = f"CASE WHEN len(list_filter({_list(bars)}, lambda w: contains(t, w))) > 0 THEN 0 ELSE {hits} END"
        parts.append(f"SELECT id, {i} AS i, '{slug}' AS slug, {hits} AS score FROM told WHERE NOT stay")
    return "\n UNION ALL ".join(parts)


REVIEWED = f"""src AS ({TOLD}),
    base AS (SELECT *, lower(concat(name, ' ', description)) AS t, replace(lower(name), '[модерация]', '') AS n,
                    concat(replace(lower(name), '[модерация]', ''), ' ', lower(description)) AS clean FROM src),
    told AS (SELECT *, coalesce(list_filter({_list(M.GUARD_ADULT)}, lambda w: contains(t, w))[1],
                                list_filter({_list(M.GUARD_TOBACCO)}, lambda w: contains(t, w))[1]) AS matched,
                    coalesce(list_filter({_list(M.GUARD_ADULT)}, lambda w: contains(t, w))[1],
                             list_filter({_list(M.GUARD_TOBACCO)}, lambda w: contains(t, w))[1]) IS NOT NULL
                    AND len(list_filter({_list(M.GUARD_SAFE)}, lambda w: contains(n, w))) = 0 AS stay FROM base),
    scores AS ({_scores()}),
    best AS (SELECT id, slug, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS rn
                                          FROM scores) q WHERE rn = 1 AND score > 0),
    reviewed AS (SELECT told.id, told.matched, coalesce(best.score, 0) AS score, c.slug AS category_slug,
                        CASE WHEN stay THEN 'stay' WHEN best.slug IS NULL THEN 'no_match'
                             WHEN c.slug IS NULL THEN 'unresolved' ELSE 'reassigned' END AS outcome,
                        CASE WHEN c.slug IS NULL THEN told.name
                             ELSE regexp_replace(told.name, '(?i)^\\[МОДЕРАЦИЯ\\]\\s*', '') END AS new_name
                 FROM told LEFT JOIN best ON best.id = told.id LEFT JOIN categories c ON c.slug = best.slug)"""


def _reviewed(fx):
    return K.review_moderated(_told(fx), fx.categories, rules=RULES, excludes=EXCLUDES)


@register(
    "d03_review_moderated",
    f"WITH {REVIEWED} SELECT id, matched, CAST(score AS INT) AS score, category_slug, outcome, new_name FROM reviewed",
)
def d03(fx):
    return _reviewed(fx).select("id", "matched", "score", "category_slug", "outcome", "new_name")


@register(
    "d04_review_summary",
    f"""WITH {REVIEWED}
        SELECT outcome, category_slug, COUNT(*) AS n FROM reviewed GROUP BY outcome, category_slug
        UNION ALL SELECT 'total', NULL, COUNT(*) FROM reviewed""",
)
def d04(fx):
    return K.review_summary(_reviewed(fx))


SOURCES = list(C.FIRST_SITE) + ["unknown-one", "unknown-two"]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


@register(
    "d05_map_category",
    f"""WITH src AS (SELECT id, {_list(SOURCES)}[1 + id % {len(SOURCES)}] AS source_category FROM companies)
        SELECT s.id, s.source_category, coalesce(m.own, s.source_category) AS slug
        FROM src s LEFT JOIN {_values(C.FIRST_SITE.items())} m(source, own) ON m.source = s.source_category""",
)
def d05(fx):
    pick = F.get(F.array(*[F.lit(s) for s in SOURCES]), (F.col("id") % len(SOURCES)).cast("int"))
    rows = fx.companies.select("id", pick.alias("source_category"))
    return K.map_category(rows, C.FIRST_SITE).select("id", "source_category", "slug")


EXPANDED = [(own, i, s) for own, sources in C.SECOND_SITE.items() for i, s in enumerate(sources)]
OWN = list(C.SECOND_SITE) + ["none"]


@register(
    "d05_expand_category",
    f"""WITH src AS (SELECT id, {_list(OWN)}[1 + id % {len(OWN)}] AS slug FROM companies)
        SELECT s.id, m.source_slug, m.pos FROM src s JOIN {_values(EXPANDED)} m(own, pos, source_slug) ON m.own = s.slug""",
)
def d05_expand(fx):
    pick = F.get(F.array(*[F.lit(s) for s in OWN]), (F.col("id") % len(OWN)).cast("int"))
    rows = fx.companies.select("id", pick.alias("slug"))
    return K.expand_category(rows, C.SECOND_SITE).select("id", "source_slug", "pos")


NAME_RULES = {"magaziny": ["vape", "0007"], "medicina": ["клиника"], "bary-i-kluby": ["casino", "стрип", "бар"]}


def _first_rule(expr: str, rules) -> str:
    whens = " ".join(
        f"WHEN len(list_filter({_list(ws)}, lambda w: contains(lower({expr}), w))) > 0 THEN '{r}'" for r, ws in rules.items()
    )
    return f"CASE {whens} END"


@register(
    "d06_detect_category",
    f"""WITH src AS ({TOLD}),
             feats AS (SELECT ct.company_id, string_agg(t.name, ' ' ORDER BY t.name) AS f FROM company_tags ct
                       JOIN tags t ON t.id = ct.tag_id GROUP BY ct.company_id)
        SELECT s.id, coalesce({_first_rule("s.name", NAME_RULES)}, {_first_rule("s.description", C.CASCADE_DESCRIPTION)},
                              CASE WHEN s.id % 3 = 0 THEN 'sport' WHEN s.id % 3 = 1 THEN 'other' END,
                              {_first_rule("f.f", {"tools": ["gear", "rod"], "art": ["blue"]})}) AS detected_slug
        FROM src s LEFT JOIN feats f ON f.company_id = s.id""",
)
def d06(fx):
    source = F.when(F.col("id") % 3 == 0, "fitnes-kluby").when(F.col("id") % 3 == 1, "other")
    names = fx.tags.select(F.col("id").alias("tag_id"), "name")
    features = fx.company_tags.join(names, "tag_id").groupBy(F.col("company_id").alias("id"))
    features = features.agg(F.sort_array(F.collect_set("name")).alias("features"))
    rows = _told(fx).withColumn("source_category", source).join(features, "id", "left")
    out = K.detect_category(rows, NAME_RULES, feature_rules={"tools": ["gear", "rod"], "art": ["blue"]})
    return out.select("id", "detected_slug")


# A keyword table of some thousand rows over the part table: rules share keywords, and some keywords are part of others.
KEYWORDS = """SELECT lower(replace(p_brand, '#', '-')) AS rule, p_size AS priority,
                     concat(CASE WHEN p_partkey % 3 = 0 THEN 'Street ' ELSE 'eet ' END, CAST(p_partkey % 300 AS STRING)) AS keyword
              FROM part"""
PLACED = "SELECT id, concat(name, ' ', address) AS name, description FROM companies"


@register(
    "d06_detect_by_name_table",
    f"""WITH src AS ({PLACED}), kw AS ({KEYWORDS}),
             hit AS (SELECT s.id, k.rule, row_number() OVER (PARTITION BY s.id ORDER BY k.priority, k.rule) AS n
                     FROM src s JOIN kw k ON contains(lower(s.name), lower(k.keyword)))
        SELECT s.id, coalesce(h.rule, {_first_rule("s.description", C.CASCADE_DESCRIPTION)}) AS detected_slug
        FROM src s LEFT JOIN hit h ON h.id = s.id AND h.n = 1""",
)
def d06_table(fx):
    """The name stage on a keyword table that is joined, not written into the plan."""
    return K.detect_category(fx.sql(PLACED), fx.sql(KEYWORDS)).select("id", "detected_slug")


TITLE = """concat(name, CASE id % 7 WHEN 0 THEN ' Кухня мира' WHEN 1 THEN ' Тип Кухни' WHEN 2 THEN ' Музыка и Услуги'
        WHEN 3 THEN ' Способы оплаты' WHEN 4 THEN ' Услуги' ELSE '' END)"""


@register(
    "d07_tag_group",
    f"""SELECT id, CASE WHEN contains(t, 'Кухня') THEN 'кухня' WHEN contains(t, 'Тип') THEN 'тип'
                  WHEN contains(t, 'Музыка') THEN 'музыка' WHEN contains(t, 'Услуги') THEN 'услуги'
                  WHEN contains(t, 'Способы оплаты') THEN 'оплата' END AS tag_group
        FROM (SELECT id, {TITLE} AS t FROM companies) q""",
)
def d07(fx):
    return fx.sql(f"SELECT id, {TITLE} AS t FROM companies").select("id", K.tag_group("t").alias("tag_group"))


# Features of a company: the names of its menu, some of them new to the tag table. Companies without a menu keep their tags.
FEATURES = """SELECT DISTINCT company_id, section AS title,
                     CASE WHEN pos % 3 = 0 THEN concat('New ', name) ELSE name END AS name
              FROM menu_fresh"""


@register(
    "d08_build_tags",
    f"""WITH f AS (SELECT *, replace(lower(name), ' ', '-') AS tag_slug FROM ({FEATURES}) q),
             fresh AS (SELECT tag_slug, MIN(name) AS name FROM f WHERE tag_slug NOT IN (SELECT slug FROM tags)
                       GROUP BY tag_slug),
             numbered AS (SELECT tag_slug, (SELECT MAX(id) FROM tags)
                              + row_number() OVER (ORDER BY substr(md5(tag_slug), 1, 3), tag_slug) AS id FROM fresh),
             every AS (SELECT id, slug FROM tags UNION ALL SELECT id, tag_slug FROM numbered)
        SELECT company_id, tag_id FROM company_tags WHERE company_id NOT IN (SELECT company_id FROM f)
        UNION ALL SELECT DISTINCT f.company_id, CAST(e.id AS BIGINT) FROM f JOIN every e ON e.slug = f.tag_slug""",
)
def d08(fx):
    return K.build_tags(fx.sql(FEATURES), fx.tags, fx.company_tags)[1]


@register(
    "d08_tags_after",
    f"""WITH f AS (SELECT *, replace(lower(name), ' ', '-') AS tag_slug FROM ({FEATURES}) q),
             fresh AS (SELECT tag_slug, MIN(name) AS name FROM f WHERE tag_slug NOT IN (SELECT slug FROM tags)
                       GROUP BY tag_slug)
        SELECT id, slug FROM tags
        UNION ALL SELECT CAST((SELECT MAX(id) FROM tags)
                         + row_number() OVER (ORDER BY substr(md5(tag_slug), 1, 3), tag_slug) AS BIGINT), tag_slug
        FROM fresh""",
)
def d08_tags(fx):
    return K.build_tags(fx.sql(FEATURES), fx.tags, fx.company_tags)[0].select("id", "slug")


NEW_SLUGS = "SELECT id AS company_id, CASE WHEN id % 3 > 0 OR id % 5 = 0 THEN 'none' ELSE 'brand-9' END AS slug FROM companies"


@register(
    "d09_assign_category",
    f"""WITH new AS ({NEW_SLUGS}), hit AS (SELECT n.company_id, c.id AS category_id FROM new n
                                           JOIN categories c ON c.slug = n.slug)
        SELECT company_id, category_id FROM company_categories WHERE company_id NOT IN (SELECT company_id FROM hit)
        UNION ALL SELECT company_id, category_id FROM hit""",
)
def d09(fx):
    return K.assign_category(fx.company_categories, fx.sql(NEW_SLUGS), fx.categories)


@register(
    "review_links_after",
    f"""WITH {REVIEWED},
             under AS (SELECT r.id AS company_id, c.id AS category_id FROM reviewed r
                       JOIN company_categories cc ON cc.company_id = r.id
                       JOIN categories m ON m.id = cc.category_id AND m.slug = 'brand-5'
                       JOIN categories c ON c.slug = r.category_slug WHERE r.outcome = 'reassigned')
        SELECT company_id, category_id FROM company_categories WHERE company_id NOT IN (SELECT company_id FROM under)
        UNION ALL SELECT company_id, category_id FROM under""",
)
def review_links(fx):
    from streetbook.operators.classify import assign_category, moderated

    rows = moderated(_told(fx), fx.company_categories, fx.categories, catch_all="brand-5")
    done = K.review_moderated(rows, fx.categories, rules=RULES, excludes=EXCLUDES).filter("outcome = 'reassigned'")
    new = done.select(F.col("id").alias("company_id"), F.col("category_slug").alias("slug"))
    return assign_category(fx.company_categories, new, fx.categories)
