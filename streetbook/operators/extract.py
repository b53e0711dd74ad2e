"""Page extraction: from page snapshots to listings, company details, menus and links.

Input is ``pages(url, html, ...)``; ``with_tree`` parses each page once and every operator below reads the tree
inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetbook.dicts import phrases as P
from streetbook.dicts import sites as S
from streetbook.functions import html as H
from streetbook.functions.contacts import is_block_page, url_number
from streetbook.functions.expr import blank_to_null, let, replace_all, trim_all
from streetbook.functions.text import format_description, parse_portion, parse_price

MENU_TYPE = "map<string,array<struct<name:string,price:string,portion:string>>>"
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def with_tree(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the page tree; pages that were not fetched are dropped."""
    if "tree" in pages.columns:
        return pages
    return pages.filter(F.col(html).isNotNull()).withColumn("tree", H.page_tree(html))


def _nodes(tree: Column, test) -> Column:
    return H.find(tree["nodes"], test)


def _starts(node: Column, attr: str, prefix: str) -> Column:
    return F.coalesce(node[attr].startswith(prefix), F.lit(False))


def _names_any(value: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(value, F.lit(part))
    return out


def _long(df: DataFrame, items: Column, keep: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Items to rows. The outer form keeps Spark from adding a filter that would compute the items twice more."""
    out = df.select(*keep, F.posexplode_outer(items).alias("pos", "item")).filter("pos is not null")
    return out.select(*keep, "pos", *[F.col(f"item.{f}").alias(f) for f in fields])


def listing_links(
    pages: DataFrame, prefix: str, base: str, n: int, keep: Sequence[str] = ("url",), anchor_class: str | None = None
) -> DataFrame:
    """Listing anchors whose link starts with ``prefix``: one row per external id, the first ``n`` of each page."""
    tree = F.col("tree")

    def wanted(x: Column) -> Column:
        ok = (x["tag"] == "a") & _starts(x, "href", prefix)
        return ok & H.has_class(x, anchor_class) if anchor_class else ok

    links = F.transform(
        _nodes(tree, wanted),
        lambda x: F.struct(
            url_number(x["href"]).alias("external_id"),
            H.text(tree, x).alias("name"),
            F.concat(F.lit(base), x["href"]).alias("link"),
        ),
    )
    named = F.filter(links, lambda x: (x["name"] != "") & (x["name"] != "0") & x["external_id"].isNotNull())
    top = F.slice(H.keyed(named, lambda x: x["external_id"]), 1, n)
    return _long(with_tree(pages), top, keep, ["external_id", "name", "link"])


def listing_cards(
    pages: DataFrame, subdomain: Column, host: str = S.SUBDOMAIN_HOST, keep: Sequence[str] = ("url",)
) -> DataFrame:
    """Listing cards: name, absolute link, address, phone, rating. Cards without a name are dropped."""
    tree, home = F.col("tree"), F.concat(F.lit("https://"), F.col("_sub"), F.lit(f".{host}"))

    def part(nodes: Column, tag: str, cls: str) -> Column:
        return H.first(H.find(nodes, lambda x: (x["tag"] == tag) & H.class_like(x, cls)))

    def card(c: Column) -> Column:
        def build(nodes: Column) -> Column:
            title, anchor = part(nodes, "h2", "company-name"), part(nodes, "a", "company-title")
            in_title = H.first(H.find(H.inside(tree, title), lambda x: x["tag"] == "a"))
            path = F.when(title.isNotNull(), in_title["href"]).otherwise(anchor["href"])
            rating = H.trimmed_text(tree, part(nodes, "span", "rating"))
            number = F.regexp_extract(rating, r"^[+-]?\d*\.?\d*", 0).try_cast("double")
            return F.struct(
                H.trimmed_text(tree, F.coalesce(title, anchor)).alias("name"),
                H.trimmed_text(tree, part(nodes, "div", "address")).alias("address"),
                H.trimmed_text(tree, part(nodes, "div", "phone")).alias("phone"),
                F.when(rating.isNotNull(), F.coalesce(number, F.lit(0.0))).alias("rating"),
                F.when(path.startswith("http"), path).when(path != "", F.concat(home, path)).alias("link"),
            )

        return let(H.inside(tree, c), build)

    cards = F.transform(_nodes(tree, lambda x: (x["tag"] == "div") & H.class_like(x, "company-card")), card)
    df = with_tree(pages).withColumn("_sub", subdomain)
    return _long(
        df, F.filter(cards, lambda x: x["name"].isNotNull()), keep, ["name", "address", "phone", "rating", "link"]
    )


def pattern_links(pages: DataFrame, pattern: str, n: int, keep: Sequence[str] = ("url",)) -> DataFrame:
    """Links that contain ``pattern``, name longer than two characters, one per name, the first ``n`` of each page."""
    tree = F.col("tree")
    links = F.transform(
        _nodes(tree, lambda x: (x["tag"] == "a") & F.coalesce(F.contains(x["href"], F.lit(pattern)), F.lit(False))),
        lambda x: F.struct(H.trimmed_text(tree, x).alias("name"), x["href"].alias("link")),
    )
    named = F.filter(links, lambda x: F.length(x["name"]) > 2)
    return _long(with_tree(pages), F.slice(H.keep_first(named, lambda x: x["name"]), 1, n), keep, ["name", "link"])


# --- detail fields: columns over a tree ----------------------------------------------------------------------------


def _last_text(tree: Column, test) -> Column:
    return H.text(tree, H.last(_nodes(tree, test)))


def _prop(name: str):
    return lambda x: F.coalesce(x["prop"] == name, F.lit(False))


def microdata_fields(tree: Column, own_links: Sequence[str] = S.OWN_HOSTS) -> dict[str, Column]:
    """Fields of a page with item properties. Where a field comes twice the last one wins."""
    numbers = F.filter(
        F.transform(_nodes(tree, _prop("ratingValue")), lambda x: H.text(tree, x)), lambda t: t.rlike(NUMERIC)
    )
    counts = F.filter(
        F.transform(_nodes(tree, _prop("reviewCount")), lambda x: x["content"]),
        lambda t: t.rlike(NUMERIC) & (t != "0"),
    )

    def contacts(item: Column) -> Column:
        return H.find(
            H.inside(tree, item),
            lambda x: (x["tag"] == "a") & _starts(x, "href", "http") & ~_names_any(x["href"], own_links),
        )

    sites = F.flatten(F.transform(_nodes(tree, lambda x: H.has_class(x, "company__contacts-item")), contacts))
    mails = _nodes(tree, lambda x: (x["tag"] == "a") & _starts(x, "href", "mailto:"))
    return {
        "name": _last_text(tree, lambda x: x["tag"] == "h1"),
        "phone": _last_text(tree, _prop("telephone")),
        "address": _last_text(tree, _prop("streetAddress")),
        "rating": F.trim(H.last(numbers)).try_cast("double"),
        "review_count": F.trim(H.last(counts)).try_cast("double").cast("int"),
        "website": H.last(sites)["href"],
        "email": F.replace(H.last(mails)["href"], F.lit("mailto:"), F.lit("")),
    }


def card_site_fields(tree: Column) -> dict[str, Column]:
    """Fields of a page of the card directory. The first match wins; phones are a list."""

    def part(tag: str, cls: str) -> Column:
        return H.first(_nodes(tree, lambda x: (x["tag"] == tag) & H.class_like(x, cls)))

    phones = F.transform(
        _nodes(tree, lambda x: (x["tag"] == "div") & H.class_like(x, "phone")), lambda x: H.trimmed_text(tree, x)
    )
    mail = H.first(
        _nodes(tree, lambda x: (x["tag"] == "a") & F.coalesce(F.contains(x["href"], F.lit("mailto:")), F.lit(False)))
    )
    rating = H.trimmed_text(tree, part("span", "rating"))
    number = F.regexp_extract(rating, r"^[+-]?\d*\.?\d*", 0).try_cast("double")
    reviews = F.regexp_replace(H.raw_text(tree, part("span", "reviews-count")), r"\D", "")
    return {
        "name": H.trimmed_text(tree, H.first(_nodes(tree, lambda x: x["tag"] == "h1"))),
        "description": H.trimmed_text(tree, part("div", "description")),
        "address": H.trimmed_text(tree, part("div", "address")),
        "phones": F.filter(phones, lambda p: (p != "") & (p != "0")),
        "website": part("a", "website")["href"],
        "email": F.replace(mail["href"], F.lit("mailto:"), F.lit("")),
        "schedule": H.trimmed_text(tree, part("div", "schedule")),
        "rating": F.when(rating.isNotNull(), F.coalesce(number, F.lit(0.0))),
        "review_count": F.coalesce(reviews.try_cast("int"), F.lit(0)),
    }


def rendered_fields(tree: Column, own_hosts: Sequence[str] = S.RENDERED_HOSTS) -> dict[str, Column]:
    """Fields of a page of the rendered directory."""
    phone = H.first(_nodes(tree, lambda x: (x["tag"] == "a") & _starts(x, "href", "tel:")))
    address = H.first(
        _nodes(tree, lambda x: (x["tag"] == "span") & F.coalesce(x["testid"] == "address", F.lit(False)))
    )
    site = H.first(
        _nodes(tree, lambda x: (x["tag"] == "a") & _starts(x, "href", "http") & ~_names_any(x["href"], own_hosts))
    )
    return {
        "phone": F.replace(phone["href"], F.lit("tel:"), F.lit("")),
        "address": H.trimmed_text(tree, address),
        "website": site["href"],
    }


PROFILES = {"microdata": microdata_fields, "cards": card_site_fields, "rendered": rendered_fields}


def detail_fields(pages: DataFrame, profile: str, keep: Sequence[str] = ("url",)) -> DataFrame:
    """One row per page with the fields of the profile: ``microdata``, ``cards`` or ``rendered``."""
    fields = PROFILES[profile](F.col("tree"))
    return with_tree(pages).select(*keep, *[c.alias(n) for n, c in fields.items()])


def hours_column(tree: Column) -> Column:
    """Opening hours as lines: item properties first, else day and time pairs (one per day, last wins)."""
    lines = F.filter(
        F.transform(_nodes(tree, _prop("openingHours")), lambda x: x["content"]),
        lambda c: c.isNotNull() & (c != "") & (c != "0"),
    )

    def pair(item: Column) -> Column:
        def build(nodes: Column) -> Column:
            day = H.first(H.find(nodes, lambda x: H.has_class(x, "company__worktime-day")))
            time = H.first(H.find(nodes, lambda x: H.has_class(x, "company__worktime-time")))
            return F.struct(H.text(tree, day).alias("day"), H.text(tree, time).alias("time"))

        return let(H.inside(tree, item), build)

    pairs = F.transform(_nodes(tree, lambda x: H.has_class(x, "company__worktime-item")), pair)
    named = H.keyed(F.filter(pairs, lambda p: (p["day"] != "") & (p["time"] != "")), lambda p: p["day"])
    return F.when(F.size(lines) > 0, lines).otherwise(
        F.transform(named, lambda p: F.concat(p["day"], F.lit(": "), p["time"]))
    )


def social_column(
    tree: Column, patterns: Sequence[tuple[str, str]] = S.SOCIAL_PATTERNS, own_links: Sequence[str] = S.OWN_LINKS
) -> Column:
    """Map network -> distinct links in page order; a link may fall in two networks; own links are skipped."""
    links = F.transform(
        _nodes(tree, lambda x: (x["tag"] == "a") & _starts(x, "href", "http") & ~_names_any(x["href"], own_links)),
        lambda x: x["href"],
    )

    def build(hrefs: Column) -> Column:
        def matching(pattern: str) -> Column:
            return F.array_distinct(F.filter(hrefs, lambda h: h.rlike(pattern)))

        found = F.array(*[matching(pattern) for _, pattern in patterns])
        by_network = F.map_from_arrays(F.array(*[F.lit(name) for name, _ in patterns]), found)
        return F.map_filter(by_network, lambda _, v: F.size(v) > 0)

    return let(links, build)


def gallery_column(tree: Column, base: str = S.IMAGE_BASE) -> Column:
    """Gallery images ``struct<preview, preview_size, original>``, one per original."""
    pattern = r"/imager/[^/]+/(\d+x\d+)/responses/(.+)$"
    frames = _nodes(tree, lambda x: H.has_class(x, "company__gallery"))

    def in_gallery(x: Column) -> Column:
        framed = F.exists(frames, lambda g: (x["id"] > g["id"]) & (x["id"] <= g["last"]))
        return (x["tag"] == "img") & (framed | F.coalesce(x["prop"] == "image", F.lit(False)))

    images = F.transform(
        F.filter(_nodes(tree, in_gallery), lambda x: F.coalesce(x["src"].rlike(pattern), F.lit(False))),
        lambda x: F.struct(
            x["src"].alias("preview"),
            F.regexp_extract(x["src"], pattern, 1).alias("preview_size"),
            F.concat(F.lit(base), F.regexp_extract(x["src"], pattern, 2)).alias("original"),
        ),
    )
    return H.keep_first(images, lambda i: i["original"])


def feature_groups_column(tree: Column) -> Column:
    """Map section title -> ``struct<count, items>``, in page order."""

    def section(s: Column) -> Column:
        def build(nodes: Column) -> Column:
            title = H.first(H.find(nodes, lambda x: H.has_class(x, "company__service__title")))
            count = H.first(H.find(nodes, lambda x: H.has_class(x, "company__service__count")))
            items = F.transform(
                H.find(nodes, lambda x: H.has_class(x, "company__service__item")), lambda x: H.text(tree, x)
            )
            return F.struct(
                F.coalesce(H.text(tree, title), F.lit("")).alias("title"),
                F.struct(
                    F.coalesce(H.text(tree, count), F.lit("")).alias("count"),
                    F.filter(items, lambda t: (t != "") & (t != "0")).alias("items"),
                ).alias("body"),
            )

        return let(H.inside(tree, s), build)

    sections = F.filter(
        F.transform(_nodes(tree, lambda x: H.has_class(x, "company__service__section")), section),
        lambda s: (s["title"] != "") & (s["title"] != "0") & (F.size(s["body"]["items"]) > 0),
    )
    return F.map_from_entries(H.keyed(sections, lambda s: s["title"]))


def flat_features(groups: Column) -> Column:
    """Distinct features of all groups, in order."""
    return F.array_distinct(F.flatten(F.transform(F.map_values(groups), lambda g: g["items"])))


def menu_column(tree: Column) -> Column:
    """Visible menu: map section -> items; a row needs a name and a price text."""

    def row(r: Column) -> Column:
        def build(nodes: Column) -> Column:
            name = H.first(
                H.find(nodes, lambda x: H.has_class(x, "price__list-left") | H.has_class(x, "price__val"))
            )
            price = H.text(tree, H.first(H.find(nodes, lambda x: H.has_class(x, "price__list-right"))))
            return let(
                price,
                lambda p: F.struct(
                    H.text(tree, name).alias("name"),
                    parse_price(p).alias("price"),
                    parse_portion(p).alias("portion"),
                    p.alias("price_text"),
                ),
            )

        return let(H.inside(tree, r), build)

    def group(g: Column) -> Column:
        def build(nodes: Column) -> Column:
            title = H.first(H.find(nodes, lambda x: H.has_class(x, "price__list-title")))
            span = H.first(H.find(H.inside(tree, title), lambda x: x["tag"] == "span"))
            rows = F.filter(
                F.transform(H.find(nodes, lambda x: H.has_class(x, "price__list-row")), row),
                lambda r: (r["name"] != "") & (r["price_text"] != ""),
            )
            return F.struct(
                F.coalesce(blank_to_null(H.text(tree, span)), H.text(tree, title), F.lit("")).alias("section"),
                F.transform(
                    rows,
                    lambda r: F.struct(r["name"].alias("name"), r["price"].alias("price"), r["portion"].alias("portion")),
                ).alias("items"),
            )

        return let(H.inside(tree, g), build)

    groups = F.filter(
        F.transform(_nodes(tree, lambda x: H.has_class(x, "price__list-group")), group),
        lambda g: (g["section"] != "") & (F.size(g["items"]) > 0),
    )
    return F.map_from_entries(H.keyed(groups, lambda g: g["section"]))


def smart_menu_column(tree: Column) -> Column:
    """Looser visible menu of the refresh job: a row needs a name only; price and portion are plain texts."""

    def row(r: Column) -> Column:
        def build(nodes: Column) -> Column:
            def part(cls: str) -> Column:
                return F.coalesce(H.text(tree, H.first(H.find(nodes, lambda x: H.has_class(x, cls)))), F.lit(""))

            return F.struct(
                part("price__list-name").alias("name"),
                part("price__list-price").alias("price"),
                part("price__list-portion").alias("portion"),
            )

        return let(H.inside(tree, r), build)

    def group(g: Column) -> Column:
        def build(nodes: Column) -> Column:
            title = H.first(H.find(nodes, lambda x: H.has_class(x, "price__list-title")))
            rows = F.transform(H.find(nodes, lambda x: H.has_class(x, "price__list-row")), row)
            return F.struct(
                F.coalesce(H.text(tree, title), F.lit("")).alias("section"),
                F.filter(rows, lambda r: r["name"] != "").alias("items"),
            )

        return let(H.inside(tree, g), build)

    groups = F.filter(
        F.transform(_nodes(tree, lambda x: H.has_class(x, "price__list-group")), group),
        lambda g: (g["section"] != "") & (F.size(g["items"]) > 0),
    )
    return F.map_from_entries(H.keyed(groups, lambda g: g["section"]))


def menu_json_column(tree: Column, html: Column) -> Column:
    """Menu from data embedded in the page: ``"menu"`` by section, then ``"priceList"``, which wins on one section.

    A section that ``"menu"`` holds twice has its last items.
    """
    item = "array<struct<name:string,title:string,price:string,portion:string,weight:string>>"

    def clean(items: Column) -> Column:
        return F.transform(
            items,
            lambda i: F.struct(
                F.coalesce(i["name"], i["title"], F.lit("")).alias("name"),
                F.concat(i["price"], F.lit(P.CURRENCY)).alias("price"),
                F.coalesce(i["portion"], i["weight"]).alias("portion"),
            ),
        )

    parsed = F.transform(tree["menu"], lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], item).alias("items")))
    known = F.filter(parsed, lambda e: e["items"].isNotNull())
    menu = F.map_from_entries(F.transform(known, lambda e: F.struct(e["key"], clean(e["items"]))))
    lists = F.from_json(
        F.regexp_extract(html, r'"priceList":\s*(\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])', 1),
        f"array<struct<category:string,title:string,items:{item},dishes:{item}>>",
    )
    entries = F.transform(
        lists,
        lambda x: F.struct(
            F.coalesce(x["category"], x["title"], F.lit("")).alias("section"),
            clean(F.coalesce(x["items"], x["dishes"])).alias("items"),
        ),
    )
    named = F.filter(entries, lambda e: (e["section"] != "") & (F.size(e["items"]) > 0))
    prices = F.map_from_entries(H.keyed(named, lambda e: e["section"]))
    empty = F.create_map().cast(MENU_TYPE)

    def merge(p: Column) -> Column:
        rest = F.map_filter(F.coalesce(menu, empty), lambda k, _: ~F.map_contains_key(p, k))
        return F.map_concat(rest, p)

    return let(F.coalesce(prices, empty), merge)


def full_menu(tree: Column, html: Column) -> Column:
    """Visible menu, else the embedded one."""
    return let(menu_column(tree), lambda m: F.when(F.size(m) > 0, m).otherwise(menu_json_column(tree, html)))


def menu_long(df: DataFrame, key: str, menu: str = "menu") -> DataFrame:
    """Menu map to rows ``key, section, section_pos, pos, name, price, portion``; positions start at 1."""
    sections = df.select(key, F.posexplode_outer(F.map_entries(menu)).alias("section_pos", "s"))
    sections = sections.filter("section_pos is not null")
    rows = sections.select(key, "section_pos", F.col("s.key").alias("section"), F.posexplode("s.value").alias("pos", "i"))
    return rows.select(
        key,
        "section",
        (F.col("section_pos") + 1).cast("bigint").alias("section_pos"),
        (F.col("pos") + 1).cast("bigint").alias("pos"),
        "i.name",
        "i.price",
        "i.portion",
    )


def description_column(tree: Column, page_footer: str = P.PAGE_FOOTER) -> Column:
    """Description block: text without tags, footer cut, in paragraphs."""
    body = H.raw_text(tree, H.last(_nodes(tree, lambda x: H.has_class(x, "company__description"))))
    return format_description(trim_all(replace_all(body, [(page_footer, "")])))


def title_column(tree: Column) -> Column:
    return H.text(tree, H.first(_nodes(tree, lambda x: x["tag"] == "title")))


def extract_pages(pages: DataFrame, keep: Sequence[str] = ("url",), failed: bool = False) -> DataFrame:
    """Everything of a microdata detail page in one pass, one row per page, no shuffle.

    Pages that were not fetched and anti-bot pages are left out. With ``failed`` they stay, marked in a column ``failed``.
    """
    tree = F.col("tree")
    if failed:
        parsed = pages.withColumn("tree", H.page_tree("html"))
        lost = F.coalesce(F.col("html") == "", F.lit(True)) | is_block_page(title_column(tree))
        parsed = parsed.withColumn("failed", lost)
        keep = (*keep, "failed")
    else:
        parsed = with_tree(pages).filter(~is_block_page(title_column(tree)))
    fields = {n: c for n, c in microdata_fields(tree).items()}
    fields["description"] = description_column(tree)
    fields["working_hours"] = hours_column(tree)
    fields["social_links"] = social_column(tree)
    fields["images"] = gallery_column(tree)
    fields["feature_groups"] = feature_groups_column(tree)
    fields["menu"] = full_menu(tree, F.col("html"))
    out = parsed.select(*keep, *[c.alias(n) for n, c in fields.items()])
    return out.withColumn("features", flat_features(F.col("feature_groups")))
