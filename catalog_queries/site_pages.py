"""Directory pages built by Spark from the catalog tables, so that extraction can be checked against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITY = "north"
PER_PAGE = 20


def esc(value: Column | str) -> Column:
    """Escape text for markup."""
    out = F.col(value) if isinstance(value, str) else value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def cat(*parts: Column | str) -> Column:
    """Join markup (str) and columns; a null column leaves nothing."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*cols)


def tag(head: str, value: Column, tail: str) -> Column:
    """Markup around a value, nothing when the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(head), esc(value.cast("string")), F.lit(tail))).otherwise("")


def page(*body: Column | str) -> Column:
    return cat("<!DOCTYPE html><html><head><title>Page</title></head><body>", *body, "</body></html>")


def _grouped(rows: DataFrame) -> DataFrame:
    """Pages of ``PER_PAGE`` items, from ``id`` and ``item`` markup."""
    block = F.floor(F.col("id") / PER_PAGE)
    pages = rows.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    return pages.select(
        F.concat(F.lit("https://dir.example.org/list/"), F.col("block").cast("string")).alias("url"),
        "block",
        page(body, "<footer>end</footer>").alias("html"),
    )


def listing_pages(companies: DataFrame) -> DataFrame:
    """Listing anchors; every ninth name is empty and every seventh company comes twice, renamed."""
    link = F.format_string(f'<a class="companies__item-title-text" href="/{CITY}/com/p_%s/">', F.col("id").cast("string"))
    name = F.when(F.col("id") % 9 == 0, " ").otherwise(esc("name"))
    again = F.when(F.col("id") % 7 == 0, cat(link, name, " again</a>")).otherwise("")
    foreign = cat('<a class="companies__item-title-text" href="/south/com/p_', F.col("id"), '/">x</a>')
    return _grouped(companies.withColumn("item", cat(foreign, link, name, "</a>", again)))


def card_pages(companies: DataFrame) -> DataFrame:
    """Listing cards: even ids name the company in a heading, odd ones in an anchor; every eighth has no name."""
    href = cat("/firm/", F.col("id"))
    heading = cat('<h2 class="company-name big"><a href="', href, '"> ', esc("name"), " </a></h2>")
    anchor = cat('<a class="x company-title" href="http://other.example/', F.col("id"), '">', esc("name"), "</a>")
    title = F.when(F.col("id") % 8 == 0, "").when(F.col("id") % 2 == 0, heading).otherwise(anchor)
    item = cat(
        '<div class="company-card">',
        title,
        tag('<div class="card__address">', F.col("address"), "</div>"),
        tag('<div class="phone"> ', F.col("phone"), " </div>"),
        tag('<span class="rating">', F.col("rating"), "</span>"),
        "</div>",
    )
    return _grouped(companies.withColumn("item", item))


def _menu_sections(menu: DataFrame) -> DataFrame:
    """The sections of each company's menu with their rows. Markup is made of them where the page is, as it takes far more room."""
    sections = menu.groupBy("company_id", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "price"))).alias("rows"))
    return sections.groupBy(F.col("company_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("section", "rows"))).alias("menu_sections")
    )


def _menu_markup(sections: Column) -> Column:
    """A menu as markup or, for ids 0 and 1 of every six, as embedded data."""

    def extra(r: Column) -> Column:
        return F.when(r["pos"] % 2 == 0, F.concat(F.lit(" за "), (r["pos"] * 50).cast("string"), F.lit(" г"))).otherwise("")

    def row(r: Column) -> Column:
        return cat(
            '<div class="price__list-row"><span class="price__list-left">', esc(r["name"]),
            '</span><b class="price__list-right">', r["price"], extra(r), "</b></div>",
        )

    def data(r: Column) -> Column:
        price = F.regexp_extract(r["price"], r"(\d+)", 1)
        return cat('{"title":"', r["name"], '","price":', price, ',"weight":"', F.trim(extra(r)), '"}')

    def joined(form, between: str) -> Column:
        return F.array_join(F.transform(sections, form), between)

    def group(s: Column) -> Column:
        return cat(
            '<div class="price__list-group"><div class="price__list-title"><span>', s["section"], "</span>n</div>",
            F.array_join(F.transform(s["rows"], row), ""), "</div>",
        )

    def embedded(s: Column) -> Column:
        return cat('"', s["section"], '":[', F.array_join(F.transform(s["rows"], data), ","), "]")

    def listed(s: Column) -> Column:
        return cat('{"category":"', s["section"], '","items":[', F.array_join(F.transform(s["rows"], data), ","), "]}")

    by_section = cat('<script>var d={"menu": {', joined(embedded, ","), '}, "v":1}</script>')
    as_list = cat('<script>var d={"priceList": [', joined(listed, ","), "]}</script>")
    form = F.when(F.col("id") % 6 == 0, by_section).when(F.col("id") % 6 == 1, as_list).otherwise(joined(group, ""))
    return F.when(sections.isNotNull(), form)


def _feature_markup(company_tags: DataFrame, tags: DataFrame) -> DataFrame:
    names = tags.select(F.col("id").alias("tag_id"), "name", F.coalesce("category", F.lit("Plain")).alias("title"))
    items = company_tags.join(names, "tag_id").groupBy(F.col("company_id").alias("id"), "title")
    items = items.agg(F.sort_array(F.collect_set("name")).alias("names"))
    body = F.array_join(F.transform("names", lambda n: F.concat(F.lit('<li class="company__service__item">'), n)), "")
    section = cat(
        '<div class="company__service__section"><b class="company__service__title">', F.col("title"),
        '</b><i class="company__service__count">', F.size("names"), "</i><ul>", body, "</ul></div>",
    )
    grouped = items.select("id", "title", section.alias("x")).groupBy("id")
    grouped = grouped.agg(F.sort_array(F.collect_list(F.struct("title", "x"))).alias("s"))
    return grouped.select("id", F.array_join(F.transform("s", lambda v: v["x"]), "").alias("features_html"))


def detail_pages(
    companies: DataFrame, menu: DataFrame | None = None, company_tags: DataFrame | None = None, tags: DataFrame | None = None
) -> DataFrame:
    """Detail pages with item properties. Menus are visible for most, embedded for ids 0 and 1 of every six."""
    rows = companies
    parts: list[Column | str] = []
    if menu is not None:
        rows = rows.join(_menu_sections(menu), "id", "left")
        parts.append(_menu_markup(F.col("menu_sections")))
    if company_tags is not None:
        rows = rows.join(_feature_markup(company_tags, tags), "id", "left")
        parts.append(F.col("features_html"))
    day, time = F.split_part("hours_line", F.lit(": "), F.lit(1)), F.split_part("hours_line", F.lit(": "), F.lit(2))
    hours = F.when(F.col("id") % 3 == 0, cat('<meta itemprop="openingHours" content="', F.col("hours_line"), '">')).when(
        F.col("id") % 3 == 1,
        cat('<div class="company__worktime-item"><span class="company__worktime-day">', day,
            '</span> <span class="company__worktime-time"> ', time, "</span></div>"),
    ).otherwise("")
    site = F.when(
        F.col("website").isNotNull(),
        cat('<p class="company__contacts-item"><a href="', F.col("website"), '">site</a><a href="https://www.yell.ru/c">dir</a></p>'),
    ).otherwise("")
    social = cat(
        '<a href="https://vk.com/yellru">own</a><a href="https://vk.com/c', F.col("id"), '">a</a><a href="https://t.me/vk.com',
        F.col("id"), '">b</a><a href="https://vk.com/c', F.col("id"), '">again</a>',
    )
    gallery = cat(
        '<div class="company__gallery"><img src="/imager/k/100x80/responses/', F.col("id"),
        '.jpg"><span><img data-src="/imager/k/900x800/responses/', F.col("id"), '.jpg"></span></div>',
        '<img itemprop="image" src="/imager/k/50x40/responses/b', F.col("id"), '.jpg"><img src="/imager/k/1x1/responses/no.jpg">',
    )
    body = [
        "<h1>first</h1><h1>\n ", esc("name"), "</h1>",
        tag('<span itemprop="telephone">', F.col("phone"), "</span>"),
        tag('<span itemprop="streetAddress"> ', F.col("address"), "</span>"),
        tag('<b itemprop="ratingValue">', F.col("rating"), '</b><b itemprop="ratingValue">none</b>'),
        cat('<meta itemprop="reviewCount" content="', F.col("review_count"), '">'),
        hours, site, social, gallery,
        tag('<div class="company__description"><p>', F.col("description"), "</p></div>"),
        cat('<a href="mailto:box', F.col("id"), '@mail.example">mail</a>'),
        *parts,
    ]
    return rows.select("id", "url", "city_id", page(*body).alias("html"))


def card_site_pages(companies: DataFrame) -> DataFrame:
    """Detail pages of the card directory."""
    body = [
        "<h1>", esc("name"), "</h1><h1>second</h1>",
        tag('<div class="main-description">', F.col("description"), "</div>"),
        tag('<div class="address">', F.col("address"), '</div><div class="address">other</div>'),
        tag('<div class="phone">', F.col("phone"), '</div><div class="phone-2">+7 000</div>'),
        tag('<a class="website" href="', F.col("website"), '">site</a>'),
        cat('<a href="mailto:box', F.col("id"), '@mail.example">mail</a>'),
        cat('<div class="schedule">', F.col("hours_line"), "</div>"),
        tag('<span class="rating">', F.col("rating"), "</span>"),
        cat('<span class="reviews-count">', F.col("review_count"), " reviews</span>"),
    ]
    return companies.select("id", "url", page(*body).alias("html"))


def rendered_pages(companies: DataFrame) -> DataFrame:
    """Detail pages of the rendered directory. They need narrow columns only, which Spark may read in one task: dealt by id."""
    body = [
        '<a href="https://2gis.ru/x">own</a>',
        tag('<a href="tel:', F.col("phone"), '">call</a><a href="tel:0">other</a>'),
        tag('<span data-testid="address">', F.col("address"), "</span>"),
        tag('<a href="', F.col("website"), '">site</a>'),
    ]
    return companies.repartition("id").select("id", "url", page(*body).alias("html"))
