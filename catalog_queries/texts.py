"""Text queries C1 to C17, over whole documents and company descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from streetbook.dicts import phrases as P
from streetbook.functions import contacts as N
from streetbook.functions import text as T
from streetbook.operators import describe as D

# Descriptions with what a directory adds to them; both engines run the same expression.
ADDED = r"""concat(coalesce(description, ''), CASE id % 9
        WHEN 0 THEN concat('. Сайт: http://www.firm', CAST(id AS STRING), '.example.net/menu?x=1). Звоните')
        WHEN 1 THEN concat(' приветsite', CAST(id AS STRING), '.ru/a,b +7 912 345-67-', CAST(10 + id % 90 AS STRING))
        WHEN 2 THEN ' пишите на box@mail.example.ru, тел. 8 (495) 123 45 67'
        WHEN 3 THEN '. Ищите НАС в соцсетях: vk.com/x, https://t.me/y'
        WHEN 4 THEN '. Информация скопирована с Yell.ru и далее'
        WHEN 5 THEN concat(chr(10), chr(10), 'Особенности: wifi, терраса', chr(10), chr(10), 'В меню представлены: суп')
        WHEN 6 THEN concat(' Факс: 123-4567 и +79', CAST(100000000 + id AS STRING), ' или 89', CAST(100000000 + id AS STRING))
        WHEN 7 THEN ' https://www.yell.ru/x/ и YANDEX.RU или vk.com'
        ELSE '' END)"""
WITH_TEXT = f"SELECT id, website, {ADDED} AS t FROM companies"


def _texts(fx):
    return fx.sql(f"SELECT * FROM ({WITH_TEXT}) q")


def _steps(expr: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    for pattern, value in steps:
        expr = f"regexp_replace({expr}, '{pattern}', {value}, '{flags}')"
    return expr


NL, NL2 = "chr(10)", "concat(chr(10), chr(10))"
BLOCKS = [
    (r"(?is)\n\nОсобенности:.*?($|\n\n|\nВ меню)", NL2),
    (r"(?is)\nОсобенности:.*?($|\n\n|\nВ меню)", NL),
] * 2 + [
    (r"(?is)\n\nВ меню представлены:.*?($|\n\n|\nОсобенности)", NL2),
    (r"(?is)\nВ меню представлены:.*?($|\n\n|\nОсобенности)", NL),
] * 2
FOOTERS = [
    (r"(?is)Ищите нас в соцсетях:.*$", "''"),
    (r"(?is)Информация скопирована с Yell\.ru.*$", "''"),
    (r"(?is)Описание скопировано с Yell\.ru.*$", "''"),
    (r"(?is)Текст скопирован с Yell\.ru.*$", "''"),
]
TAILS = [(r"(?is)Особенности:.*$", "''"), (r"(?is)В меню представлены:.*$", "''")]


def _boilerplate(expr: str) -> str:
    return _steps(expr, FOOTERS + BLOCKS + TAILS)


@register("c01_remove_boilerplate", f"WITH src AS ({WITH_TEXT}) SELECT id, {_boilerplate('t')} AS clean FROM src")
def c01(fx):
    return _texts(fx).select("id", T.remove_boilerplate("t").alias("clean"))


HOST = r"(?i)\b([a-z0-9][a-z0-9\-]*(?:\.[a-z0-9][a-z0-9\-]*)*\.[a-z]{2,})(?:/[^\s,]*)?"
STRICT_HOST = r"(?i)\b([a-z0-9][a-z0-9\-]*(?:\.[a-z0-9][a-z0-9\-]*)+\.[a-z]{2,})"
COMMON = "('yandex.ru', 'google.com', 'vk.com', 'facebook.com', 'instagram.com', 'youtube.com')"
TAIL = "'.,;:!?)''\"'"

WEBSITE = rf"""
    u AS (SELECT *, nullif(regexp_extract(t, '(?i)https?://[^\s,]+', 0), '') AS hit FROM src),
    u2 AS (SELECT *, CASE WHEN contains(lower(rtrim(hit, {TAIL})), 'yell.ru') THEN NULL ELSE rtrim(hit, {TAIL}) END
                     AS site1,
                  CASE WHEN hit IS NULL THEN t ELSE replace(t, hit, '') END AS t1 FROM u),
    h AS MATERIALIZED (SELECT *, nullif(regexp_extract(t1, '{HOST}', 1), '') AS host, regexp_extract(t1, '{HOST}', 0) AS whole
          FROM u2),
    h2 AS (SELECT *, contains(lower(host), 'yell.ru') AS own,
                  regexp_matches(t1, concat('(?i)[a-z0-9._%+-]+@', regexp_escape(host))) AS mail FROM h),
    found AS (SELECT *,
                  CASE WHEN host IS NULL OR own THEN t1
                       ELSE regexp_replace(t1, concat('\b', regexp_escape(whole)), '', 'gi') END AS rest,
                  coalesce(site1, CASE WHEN NOT own AND NOT mail AND lower(host) NOT IN {COMMON}
                                       THEN concat('https://', whole) END) AS site FROM h2)"""


@register("c02_extract_website", f"WITH src AS ({WITH_TEXT}), {WEBSITE} SELECT id, rest, site FROM found")
def c02(fx):
    found = _texts(fx).select("id", N.extract_website("t").alias("w"))
    return found.select("id", F.col("w.text").alias("rest"), F.col("w.website").alias("site"))


@register(
    "c03_extract_website_strict",
    rf"""WITH src AS ({WITH_TEXT}),
         u AS (SELECT *, nullif(regexp_extract(t, '(?i)https?://[^\s,]+', 0), '') AS hit FROM src),
         u2 AS (SELECT *, CASE WHEN contains(lower(rtrim(hit, {TAIL})), 'yell.ru') THEN NULL
                               ELSE rtrim(hit, {TAIL}) END AS site1 FROM u),
         u3 AS (SELECT *, CASE WHEN site1 IS NULL THEN t ELSE replace(t, hit, '') END AS t1 FROM u2),
         h AS (SELECT *, CASE WHEN site1 IS NULL THEN nullif(regexp_extract(t1, '{STRICT_HOST}', 1), '') END AS host
               FROM u3),
         h2 AS (SELECT *, host IS NOT NULL AND NOT contains(lower(host), 'yell.ru') AND lower(host) NOT IN {COMMON}
                       AS ok FROM h)
         SELECT id, CASE WHEN ok THEN replace(t1, host, '') ELSE t1 END AS rest,
                CASE WHEN ok THEN concat('https://', host) ELSE site1 END AS site FROM h2""",
)
def c03(fx):
    found = _texts(fx).select("id", N.extract_website("t", strict=True).alias("w"))
    return found.select("id", F.col("w.text").alias("rest"), F.col("w.website").alias("site"))


NUMBER = r"\s*\(?\d{3}\)?\s*\d{3}[-\s]?\d{2}[-\s]?\d{2}"


def _normal(d: str) -> str:
    full = f"CASE WHEN length({d}) = 11 AND {d} LIKE '8%' THEN concat('7', substr({d}, 2)) WHEN length({d}) = 10 THEN concat('7', {d}) ELSE {d} END"
    return f"CASE WHEN length({full}) = 11 AND ({full}) LIKE '7%' THEN concat('+', {full}) END"


PHONES = rf"""
    raw AS (SELECT *, list_concat(list_concat(regexp_extract_all(t, '\+7{NUMBER}'), regexp_extract_all(t, '8{NUMBER}')),
                                  regexp_extract_all(t, '(?i)(?:тел|телефон|факс)\.?\s*:?\s*(\+7|8)?{NUMBER}')) AS hits
            FROM src),
    dig AS (SELECT *, list_transform(hits, lambda p: regexp_replace(p, '\D', '', 'g')) AS ds FROM raw),
    nums AS MATERIALIZED (SELECT *, list_distinct(list_filter(list_transform(ds, lambda d: {_normal('d')}), lambda p: p IS NOT NULL))
                       AS phones FROM dig),
    cut AS (SELECT *, list_reduce(list_prepend(t, phones), lambda a, p: replace(a, p, '')) AS rest FROM nums)"""


@register(
    "c04_extract_phones",
    f"WITH src AS ({WITH_TEXT}), {PHONES} SELECT id, rest, array_to_string(list_sort(phones), '|') AS phones FROM cut",
)
def c04(fx):
    found = _texts(fx).select("id", N.extract_phones("t").alias("p"))
    return found.select("id", F.col("p.text").alias("rest"), F.array_join(F.sort_array("p.phones"), "|").alias("phones"))


@register(
    "c04_phones_of_documents",
    f"WITH src AS (SELECT doc_id AS id, text AS t FROM documents), {PHONES} "
    "SELECT id, length(rest) AS n, array_to_string(list_sort(phones), '|') AS phones FROM cut",
)
def c04_documents(fx):
    found = fx.documents.select(F.col("doc_id").alias("id"), N.extract_phones("text").alias("p"))
    return found.select(
        "id",
        F.length("p.text").cast("bigint").alias("n"),
        F.array_join(F.sort_array("p.phones"), "|").alias("phones"),
    )


@register(
    "c05_normalize_phone",
    rf"""WITH src AS (SELECT id, CASE id % 4 WHEN 0 THEN concat('(912) ', CAST(100 + id % 900 AS STRING), '-45-67')
                              WHEN 1 THEN concat(phone, '0') WHEN 2 THEN concat('+', phone) ELSE phone END AS raw
                      FROM companies),
              d AS (SELECT id, regexp_replace(raw, '\D', '', 'g') AS d FROM src)
         SELECT id, {_normal('d')} AS phone FROM d""",
)
def c05(fx):
    raw = fx.sql(
        """SELECT id, CASE id % 4 WHEN 0 THEN concat('(912) ', CAST(100 + id % 900 AS STRING), '-45-67')
                                  WHEN 1 THEN concat(phone, '0') WHEN 2 THEN concat('+', phone) ELSE phone END AS raw
           FROM companies"""
    )
    return raw.select("id", N.normalize_phone("raw").alias("phone"))


def _trim(expr: str) -> str:
    return f"trim({expr}, concat(' ', chr(9), chr(10), chr(13), chr(11)))"


SPOKEN = """concat(coalesce(description, ''), CASE id % 5 WHEN 0 THEN ' Кто мы? Команда! Вот так. Адрес нашей компании.'
            WHEN 1 THEN '.  Режим работы с 9 до 18. Телефон и Адрес ниже.' WHEN 2 THEN ' Да! Нет? Yes! No? Ой' ELSE '' END)"""


# The paragraph rules without lookahead. What has to follow a match is marked beforehand by a character that no text holds; a
# letter with its mark before it counts as one.
WHITE, BLACK = r"[\t-\r \x{85}\p{Z}]", r"[^\t-\r \x{85}\p{Z}]"
CAPITAL, SMALL = "[А-ЯA-Z]", "[а-яa-z]"
MARK = "\ue000"
LETTER = rf"(?:{MARK}?[^\n{MARK}])"
EMPTY_LINES = (r"\n{3,}", "\n\n")


def _regex(expr: str, *steps: tuple[str, str]) -> str:
    return _steps(expr, [(pattern, f"'{value}'") for pattern, value in steps])


def _sentences(expr: str, least: int, ends: str, follows: str, value: str) -> str:
    """A break after the last sentence of a line that ends at ``least`` characters or later before ``follows``."""
    return _regex(expr, (rf"({WHITE})({follows})", rf"\1{MARK}\2"), (rf"({LETTER}{{{least},}}{ends})({WHITE}+){MARK}", value), (MARK, ""))


def _long_text(expr: str) -> str:
    open_ends = _regex(
        expr, (r"[ \t]+", " "), (rf"\?({WHITE}+)({CAPITAL})", "?\n\\1\\2"), (rf"!({WHITE}+)({CAPITAL})", "!\n\n\\1\\2")
    )
    split = _sentences(open_ends, 100, r"\.", CAPITAL, "\\1\n\n\\2")
    named = _regex(split, *[(rf"({BLACK}[^\n]*?)({p})", "\\1\n\n\\2") for p in P.LONG_TEXT_PHRASES])
    return _trim(_regex(named, EMPTY_LINES, ("(?m)^ +", "")))


def page_text(expr: str) -> str:
    """Up to the commas before a capital, which are marked; ``commas`` goes on from there."""
    open_ends = _regex(
        _trim(expr), (r"(\p{L})\n+(\p{L})", r"\1\2"), (rf"([.!?])({CAPITAL})", r"\1 \2"), (r"[ \t]{2,}", " "),
        (rf"\?{WHITE}+({CAPITAL})", "?\n\\1"), (rf"!{WHITE}+({CAPITAL})", "!\n\n\\1"),
    )
    split = _sentences(open_ends, 30, r"\.", CAPITAL + SMALL, "\\1\n\n")
    named = _regex(split, *[(rf"(?i)([.!?]){WHITE}+({p})", "\\1\n\n\\2") for p in P.PAGE_PHRASES])
    return _regex(named, (rf"(,{WHITE}+)({CAPITAL}{SMALL}{{3,}}{WHITE})", rf"\1{MARK}\2"))


def commas(parts: str) -> str:
    """A break after a comma unless a line ends within the 51 characters behind it; ``parts`` are cut at the marks."""
    ahead = f"substr(array_to_string({parts}[i + 1:], ''), 1, 51)"
    cut = rf"""CASE WHEN i < len({parts}) AND NOT contains({ahead}, chr(10))
                    THEN regexp_replace({parts}[i], ',{WHITE}+$', concat(',', chr(10))) ELSE {parts}[i] END"""
    joined = f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: {cut}), '')"
    return _trim(_regex(joined, EMPTY_LINES, ("(?is)Ищите нас в соцсетях.*$", "")))


def _fresh_text(expr: str) -> str:
    split = _sentences(_regex(expr, (r"[ \t]+", " ")), 150, "[.!?]", CAPITAL, "\\1\n\n\\2")
    return _trim(_regex(split, *[(rf"([.!?]){WHITE}+({p})", "\\1\n\n\\2") for p in P.REFRESH_PHRASES], EMPTY_LINES))


@register("c06_format_text", f"SELECT id, {_long_text('t')} AS f FROM (SELECT id, {SPOKEN} AS t FROM companies) q")
def c06(fx):
    return fx.sql(f"SELECT id, {SPOKEN} AS t FROM companies").select("id", T.format_text("t").alias("f"))


@register(
    "c07_format_description",
    f"""WITH cut AS MATERIALIZED (SELECT id, string_split({page_text('t')}, '{MARK}') AS parts
                                  FROM (SELECT id, {SPOKEN} AS t FROM companies) q)
        SELECT id, {commas('parts')} AS f FROM cut""",
)
def c07(fx):
    return fx.sql(f"SELECT id, {SPOKEN} AS t FROM companies").select("id", T.format_description("t").alias("f"))


@register("c08_format_smart", f"SELECT id, {_fresh_text('t')} AS f FROM (SELECT id, {SPOKEN} AS t FROM companies) q")
def c08(fx):
    return fx.sql(f"SELECT id, {SPOKEN} AS t FROM companies").select("id", T.format_smart("t").alias("f"))


# The texts have a first line, so the paragraph step leaves them alone; those of the other query are on one line.
LINED = f"SELECT id, website, concat('About', chr(10), t) AS t FROM ({WITH_TEXT}) q"
NORMALIZED = f"""
    base AS ({LINED}), src AS (SELECT * FROM base), {WEBSITE},
    clean AS MATERIALIZED (SELECT id, website, site, {_boilerplate('rest')} AS t FROM found),
    {PHONES.replace('FROM src', 'FROM clean')},
    done AS (SELECT id, {_trim('rest')} AS description, coalesce(nullif(website, ''), site) AS website,
                    array_to_string(list_sort(phones), '|') AS phones FROM cut)"""


@register("c09_normalize_descriptions", f"WITH {NORMALIZED} SELECT id, description, website, phones FROM done")
def c09(fx):
    rows = fx.sql(f"SELECT * FROM ({LINED}) r").withColumnRenamed("t", "description")
    done = D.normalize_descriptions(rows)
    return done.select("id", "description", "website", F.array_join(F.sort_array("phones"), "|").alias("phones"))


UNBROKEN = NORMALIZED.replace(LINED, f"SELECT id, website, replace(t, chr(10), ' ') AS t FROM ({WITH_TEXT}) q").replace(
    f"{_trim('rest')} AS description",
    f"""CASE WHEN strlen(rest) > 200 AND NOT contains(rest, chr(10)) THEN {_long_text('rest')} ELSE {_trim('rest')} END AS description""",
)


@register("c09_normalize_unbroken_texts", f"WITH {UNBROKEN} SELECT id, description, website, phones FROM done")
def c09_unbroken(fx):
    """Whole texts on one line, so that the paragraph step works on every long one."""
    rows = _texts(fx).withColumn("description", F.replace("t", F.lit("\n"), F.lit(" "))).drop("t")
    done = D.normalize_descriptions(rows)
    return done.select("id", "description", "website", F.array_join(F.sort_array("phones"), "|").alias("phones"))


LETTERS = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
MULTI = [("ё", "yo"), ("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"), ("&", "and")]


def _slug(expr: str) -> str:
    out = f"translate(lower({expr}), 'абвгдезийклмнопрстуфхыэ ъь,', 'abvgdeziyklmnoprstufhye-')"
    for letter, latin in MULTI:
        out = f"replace({out}, '{letter}', '{latin}')"
    return f"regexp_replace(trim({out}, '-'), '-+', '-', 'g')"


NAMES = f"concat(' ', name, ', ', substr('{LETTERS}', CAST(1 + id % 33 AS INT), 4), '  & ', source, ' ')"


@register("c10_slugify", f"SELECT id, {_slug(NAMES)} AS slug FROM companies")
def c10(fx):
    return fx.sql(f"SELECT id, {NAMES} AS n FROM companies").select("id", T.slugify("n").alias("slug"))


ROW_TEXT = """concat(CASE WHEN pos % 3 = 0 THEN concat('1 ', price) ELSE price END,
                     CASE WHEN pos % 2 = 0 THEN concat(' за ', CAST(pos * 50 AS STRING), ' г') ELSE '' END)"""


@register(
    "c11_price_and_portion",
    rf"""WITH src AS (SELECT company_id, section, pos, {ROW_TEXT} AS t FROM menu_old)
         SELECT company_id, section, pos,
                concat(regexp_replace(regexp_extract(t, '([\d\s]+)\s*руб\.', 1), '\s', '', 'g'), ' руб.') AS price,
                nullif(trim(regexp_extract(t, '(?i)за\s*([\d\s]+(?:г|мл|шт))', 1)), '') AS portion FROM src""",
)
def c11(fx):
    rows = fx.sql(f"SELECT company_id, section, pos, {ROW_TEXT} AS t FROM menu_old")
    return rows.select("company_id", "section", "pos", T.parse_price("t").alias("price"), T.parse_portion("t").alias("portion"))


@register(
    "c12_excerpt",
    r"""WITH src AS (SELECT page_id, replace(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10), ' ') AS t FROM pages),
             cut AS (SELECT *, substr(t, 1, 150) AS head FROM src)
        SELECT page_id, CASE WHEN length(t) <= 150 THEN t
               ELSE concat(CASE WHEN contains(head, ' ') THEN substr(head, 1, 150 - instr(reverse(head), ' ')) ELSE head END,
                           '...') END AS short FROM cut""",
)
def c12(fx):
    return fx.pages.select("page_id", T.excerpt("html", 150).alias("short"))


@register(
    "c12_short_text",
    """SELECT doc_id, CASE WHEN strlen(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS short
       FROM documents""",
)
def c12_short(fx):
    return fx.documents.select("doc_id", T.short_text("text").alias("short"))


@register(
    "c13_longest_text",
    """SELECT id, name, city_id, length(description) AS len,
              length(description) - length(replace(description, chr(10), '')) AS breaks,
              (length(description) - length(replace(description, concat(chr(10), chr(10)), ''))) // 2 AS empty_lines
       FROM companies WHERE length(description) > 1000 ORDER BY length(description) DESC, id LIMIT 5""",
)
def c13(fx):
    return D.longest_text(fx.companies)


@register(
    "c14_normalization_log",
    f"""WITH {NORMALIZED}
        SELECT b.id AS company_id, length(b.t) AS original_length, length(d.description) AS normalized_length,
               '2024-01-01' AS normalized_at FROM base b JOIN done d ON d.id = b.id""",
)
def c14(fx):
    rows = fx.sql(f"SELECT * FROM ({LINED}) r").withColumnRenamed("t", "description")
    log = D.normalization_log(rows, D.normalize_descriptions(rows), F.lit("2024-01-01"))
    return log.withColumns({c: F.col(c).cast("bigint") for c in ("original_length", "normalized_length")})


@register(
    "c15_append_info",
    """SELECT c.id, concat(coalesce(c.description, ''),
                CASE WHEN f.all_names IS NULL THEN '' ELSE concat(chr(10), chr(10), 'Особенности: ', f.all_names) END,
                CASE WHEN m.sections IS NULL THEN '' ELSE concat(chr(10), chr(10), 'В меню представлены: ', m.sections)
                END) AS description
       FROM companies c
       LEFT JOIN (SELECT company_id, string_agg(name, ', ' ORDER BY name) AS all_names
                  FROM (SELECT ct.company_id, t.name, row_number() OVER (PARTITION BY ct.company_id ORDER BY t.name) AS rn
                        FROM company_tags ct JOIN tags t ON t.id = ct.tag_id) q WHERE rn <= 5 GROUP BY company_id) f
              ON f.company_id = c.id
       LEFT JOIN (SELECT company_id, string_agg(section, ', ' ORDER BY section) AS sections
                  FROM (SELECT company_id, section, row_number() OVER (PARTITION BY company_id ORDER BY section) AS rn
                        FROM (SELECT DISTINCT company_id, section FROM menu_old) s) q WHERE rn <= 3
                  GROUP BY company_id) m ON m.company_id = c.id""",
)
def c15(fx):
    features = fx.company_tags.join(fx.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    features = features.groupBy(F.col("company_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("features"))
    menus = fx.menu_old.select(F.col("company_id").alias("id"), "section").distinct().groupBy("id")
    menus = menus.agg(F.sort_array(F.collect_list(F.struct("section", F.lit(1).alias("n")))).alias("menu"))
    menus = menus.withColumn("menu", F.map_from_entries("menu"))
    rows = fx.companies.select("id", "description").join(features, "id", "left").join(menus, "id", "left")
    return D.add_structured_info(rows).select("id", "description")


@register(
    "c16_paragraphs",
    rf"""WITH parts AS (
            SELECT id, unnest(string_split(regexp_replace(description, '\.\s+([А-ЯA-Z])',
                       concat('.', chr(10), chr(10), '\1'), 'g'), concat(chr(10), chr(10)))) AS p,
                   generate_subscripts(string_split(regexp_replace(description, '\.\s+([А-ЯA-Z])',
                       concat('.', chr(10), chr(10), '\1'), 'g'), concat(chr(10), chr(10))), 1) AS i
            FROM companies WHERE description IS NOT NULL),
         t AS (SELECT id, i, {_trim('p')} AS paragraph FROM parts)
         SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) AS pos, paragraph FROM t
         WHERE strlen(paragraph) > 5""",
)
def c16(fx):
    return D.paragraphs(fx.companies.select("id", "description"))


@register(
    "c17_contact_forms",
    r"""SELECT id, regexp_replace(phone, '[^\d+]', '', 'g') AS tel, regexp_replace(website, '^https?://', '') AS site
        FROM companies""",
)
def c17(fx):
    return fx.companies.select("id", N.tel_href("phone").alias("tel"), N.bare_url("website").alias("site"))
