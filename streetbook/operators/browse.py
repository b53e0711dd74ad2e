"""Catalog queries: search, listings, facets, details. Each is one lazy plan that filters before it limits.

Dimension joins carry no broadcast hint: Spark broadcasts a side when its size allows it and shuffles otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetbook.dicts.categories import OTHER_TAGS
from streetbook.dicts.sites import SUBDOMAIN_HOST
from streetbook.functions.contacts import url_subdomain
from streetbook.functions.hours import is_open, next_opening, open_status, seconds_of_day, week_spans
from streetbook.functions.text import short_text, text_grams
from streetbook.operators.common import join_known
from streetbook.sources.catalog import Catalog


TEXTS = ("name", "description", "address")
GRAM = 3


def text_filter(q: str, columns: Sequence[str] = TEXTS) -> Column:
    """Case-insensitive match anywhere; ``%`` and ``_`` in the query are wildcards."""
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).ilike(f"%{q}%"), F.lit(False))
    return out


def text_index(companies: DataFrame, columns: Sequence[str] = TEXTS) -> DataFrame:
    """``gram, id``: each run of three characters of a company's texts, once for each company.

    The texts are dealt by id first: cutting them is the work here, and companies often come in a few tasks only. The outer form
    keeps Spark from adding a filter that would compute the grams again.
    """
    every = F.array_distinct(F.concat(*[F.coalesce(text_grams(c, GRAM), F.array().cast("array<string>")) for c in columns]))
    dealt = companies.select("id", *columns).repartition("id")
    return dealt.select(F.explode_outer(every).alias("gram"), "id").filter("gram is not null")


def query_grams(q: str) -> list[str]:
    """Grams that any text matching ``q`` holds: wildcards and escapes part the query."""
    parts = re.split(r"[%_\\]", q)
    return sorted({part[i : i + GRAM] for part in parts for i in range(len(part) - GRAM + 1)})


def text_matches(companies: DataFrame, q: str, texts: DataFrame | None = None) -> DataFrame:
    """Companies that ``text_filter`` keeps. With ``texts``, from ``text_index``, only those that hold all grams of the query
    are looked at; a query without a gram looks at all."""
    grams = query_grams(q)
    if texts is None or not grams:
        return companies.filter(text_filter(q))
    # lowered by Spark, as the texts were
    wanted = texts.filter(F.col("gram").isin([F.lower(F.lit(g)) for g in grams]))
    found = wanted.groupBy("id").agg(F.count("*").alias("_grams"))
    held = F.size(F.array_distinct(F.array(*[F.lower(F.lit(g)) for g in grams])))
    # the check names a column of the index, so that it comes after the join and not before
    check = F.when(F.col("_grams") == held, text_filter(q))
    return companies.join(found, "id").filter(check).select(*companies.columns)


def with_city(companies: DataFrame, cities: DataFrame, slug: bool = False) -> DataFrame:
    names = [F.col("name").alias("city_name")] + ([F.col("slug").alias("city_slug")] if slug else [])
    return join_known(companies, cities.select(F.col("id").alias("city_id"), *names), ["city_id"])


def having_all_tags(company_tags: DataFrame, tag_ids: Sequence[int]) -> DataFrame:
    """Ids of the companies that have every one of the tags: one flag per tag, combined before the shuffle."""
    wanted = sorted(set(tag_ids))
    flags = company_tags.filter(F.col("tag_id").isin(wanted)).groupBy(F.col("company_id").alias("id")).agg(
        *[F.bool_or(F.col("tag_id") == t).alias(f"t{i}") for i, t in enumerate(wanted)]
    )
    return flags.filter(" and ".join(f"t{i}" for i in range(len(wanted)))).select("id")


BY_RATING = (F.desc_nulls_last, "rating"), (F.desc, "review_count"), (F.asc, "id")


def _by_rating() -> list[Column]:
    return [make(name) for make, name in BY_RATING]


def search(
    cat: Catalog,
    q: str = "",
    city_id: int | None = None,
    tag_ids: Sequence[int] = (),
    n: int = 20,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Text search over name, description and address, in a city, with all of the tags; best rated first.

    ``texts``, from ``text_index``, spares looking at the texts of companies that cannot match.
    """
    hits = text_matches(cat.companies, q, texts)
    if city_id is not None:
        hits = hits.filter(F.col("city_id") == city_id)
    if tag_ids:
        hits = hits.join(having_all_tags(cat.company_tags, tag_ids), "id", "left_semi")
    return with_city(hits.orderBy(*_by_rating()).limit(n), cat.cities).orderBy(*_by_rating())


def by_tag(cat: Catalog, slug: str, city_id: int | None = None, n: int = 20) -> DataFrame:
    """Companies that have a tag, by its slug."""
    tag = cat.tags.filter(F.col("slug") == slug).select(F.col("id").alias("tag_id"))
    ids = cat.company_tags.join(tag, "tag_id", "left_semi").select(F.col("company_id").alias("id"))
    hits = cat.companies.join(ids, "id", "left_semi")
    if city_id is not None:
        hits = hits.filter(F.col("city_id") == city_id)
    return with_city(hits.orderBy(*_by_rating()).limit(n), cat.cities).orderBy(*_by_rating())


def in_category(cat: Catalog, slug: str) -> DataFrame:
    """Ids of the companies of a category."""
    wanted = cat.categories.filter(F.col("slug") == slug).select(F.col("id").alias("category_id"))
    return cat.company_categories.join(wanted, "category_id", "left_semi").select(F.col("company_id").alias("id"))


def catalog_rows(
    cat: Catalog,
    city_id: int | None = None,
    category: str | None = None,
    q: str = "",
    texts: DataFrame | None = None,
) -> DataFrame:
    """The filter behind the catalog page, one row per company; ``texts`` as in ``search``."""
    hits = cat.companies
    if city_id is not None:
        hits = hits.filter(F.col("city_id") == city_id)
    if q:
        hits = text_matches(hits, q, texts)
    if category is not None:
        hits = hits.join(in_category(cat, category), "id", "left_semi")
    return hits


SORT_COLUMNS = {"name": "name", "date": "created_at", "rating": "rating", "reviews": "review_count"}


def sort_order(sort: str = "rating", order: str = "desc") -> list[Column]:
    """Order of the catalog page: nulls last, ids break ties; an unknown sort means rating."""
    name = SORT_COLUMNS.get(sort, "rating")
    return [F.asc_nulls_last(name) if order == "asc" else F.desc_nulls_last(name), F.asc("id")]


def sort_catalog(df: DataFrame, sort: str = "rating", order: str = "desc") -> DataFrame:
    return df.orderBy(*sort_order(sort, order))


def catalog(
    cat: Catalog,
    city_id: int | None = None,
    category: str | None = None,
    q: str = "",
    sort: str = "rating",
    order: str = "desc",
    n: int = 50,
    open_now: datetime | None = None,
    hours: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Catalog page: filter, open-now filter, sort, limit, then the city name of the rows kept.

    ``hours``, from ``hours_index``, answers the open-now filter without reading the hours of the companies;
    ``texts`` as in ``search``.
    """
    hits = catalog_rows(cat, city_id, category, q, texts)
    if open_now is not None:
        hits = open_at(hits, open_now) if hours is None else open_in(hits, hours, open_now)
    top = sort_catalog(hits, sort, order).limit(n)
    return sort_catalog(with_city(top, cat.cities), sort, order)


def catalog_count(
    cat: Catalog, city_id: int | None = None, category: str | None = None, q: str = ""
) -> DataFrame:
    """Number of companies that the same filter meets. Ids are unique after the semi join, so a plain count does."""
    return catalog_rows(cat, city_id, category, q).agg(F.count("*").alias("total"))


def open_at(df: DataFrame, as_of: datetime, **options) -> DataFrame:
    """Companies open at a moment; options as in ``functions.hours.is_open``."""
    return df.filter(F.coalesce(is_open("working_hours", as_of, **options), F.lit(False)))


def hours_index(companies: DataFrame, **options) -> DataFrame:
    """``id, day, begin, end``: the stretches of the week in which a company is open; options as in ``open_at``.

    A stretch stays inside its day, so that of an index stored by day (``sources.catalog.save_hours``) a question reads
    one seventh, and of that only the parts whose times fit.
    """
    spans = F.explode(week_spans("working_hours", **options))
    return companies.select("id", spans.alias("s")).select("id", "s.day", "s.begin", "s.end")


def open_in(df: DataFrame, index: DataFrame, as_of: datetime) -> DataFrame:
    """Companies that the index has as open at a moment: the rows of ``open_at`` with the options of the index."""
    now = seconds_of_day(as_of)
    fits = (F.col("day") == as_of.weekday()) & (F.col("begin") <= now) & (F.col("end") >= now)
    return df.join(index.filter(fits).select("id"), "id", "left_semi")


def with_open_status(df: DataFrame, as_of: datetime) -> DataFrame:
    return df.withColumn("status_label", open_status("working_hours", as_of))


def with_next_opening(df: DataFrame, as_of: datetime) -> DataFrame:
    out = df.withColumn("_next", next_opening("working_hours", as_of))
    out = out.withColumn("is_open", F.col("_next.is_open")).withColumn("next_day", F.col("_next.day"))
    return out.withColumn("next_time", F.col("_next.time")).drop("_next")


CITY_SORTS = {
    "name_asc": [F.asc, "name"],
    "name_desc": [F.desc, "name"],
    "count_asc": [F.asc, "count", F.asc, "name"],
    "count_desc": [F.desc, "count", F.asc, "name"],
    "weight_asc": [F.asc_nulls_last, "weight", F.asc, "name"],
    "weight_desc": [F.desc_nulls_first, "weight", F.asc, "name"],
}


def city_list(cat: Catalog, only: str = "all", sort: str = "name_asc", null_aware: bool = False) -> DataFrame:
    """Cities with their number of companies, all of them or only those ``with`` or ``without`` companies.

    Companies are counted per city before the join. ``null_aware`` asks ``without`` as SQL ``NOT IN`` does: a single
    company without a city empties the list.
    """
    counts = cat.companies.groupBy("city_id").agg(F.count("*").alias("_n"))
    out = cat.cities.join(counts.filter("city_id is not null").withColumnRenamed("city_id", "id"), "id", "left")
    out = out.withColumn("count", F.coalesce("_n", F.lit(0))).drop("_n")
    if only == "with":
        out = out.filter("count > 0")
    elif only == "without":
        out = out.filter("count = 0")
        if null_aware:
            homeless = counts.agg(F.coalesce(F.max(F.col("city_id").isNull()), F.lit(False)).alias("b")).scalar()
            out = out.filter(~homeless)
    spec = CITY_SORTS.get(sort, CITY_SORTS["name_asc"])
    return out.orderBy(*[make(name) for make, name in zip(spec[::2], spec[1::2])], F.asc("id"))


def category_facet(cat: Catalog, city_id: int) -> DataFrame:
    """Categories of the companies of a city, with counts."""
    here = cat.companies.filter(F.col("city_id") == city_id).select(F.col("id").alias("company_id"))
    counts = cat.company_categories.join(here, "company_id", "left_semi").groupBy("category_id")
    counts = counts.agg(F.count("*").alias("count"))
    names = cat.categories.select(F.col("id").alias("category_id"), "name")
    return counts.join(names, "category_id").select(F.col("category_id").alias("id"), "name", "count").orderBy(
        "name", "id"
    )


def with_linked(rows: DataFrame, links: DataFrame, *aggregates: Column) -> DataFrame:
    """``rows`` (one for each ``id``) with aggregates over their ``links`` (by ``company_id``), in one pass over both."""
    joined = rows.join(links.withColumnRenamed("company_id", "id"), "id", "left")
    grouped = joined.groupBy("id").agg(F.any_value(F.struct(*rows.columns)).alias("_row"), *aggregates)
    return grouped.select("_row.*", *[c for c in grouped.columns if c not in ("id", "_row")])


def companies_with_categories(
    cat: Catalog,
    city_id: int,
    category_id: int | None = None,
    q: str = "",
    sort: str = "rating",
    n: int = 100,
) -> DataFrame:
    """Companies of a city with the names and ids of their categories.

    The rows are limited first and the links of those rows joined after, so only ``n`` companies are grouped. With a
    category the arrays hold that category only. ``q`` matches name and address and is applied before the limit.
    """
    hits = cat.companies.filter(F.col("city_id") == city_id)
    if q:
        low = F.lit(q.lower())
        name, address = F.lower("name"), F.lower(F.coalesce("address", F.lit("")))
        hits = hits.filter(F.contains(name, low) | F.contains(address, low))
    links = cat.company_categories
    if category_id is not None:
        links = links.filter(F.col("category_id") == category_id)
        hits = hits.join(links.select(F.col("company_id").alias("id")), "id", "left_semi")
    order = {
        "name": [F.asc("name")],
        "reviews": [F.desc_nulls_last("review_count")],
    }.get(sort, [F.desc_nulls_last("rating"), F.asc("name")]) + [F.asc("id")]
    top = hits.orderBy(*order).limit(n)
    names = cat.categories.select(F.col("id").alias("category_id"), F.col("name").alias("_category"))
    named = links.join(names, "category_id").select("company_id", "category_id", "_category")
    sets = {"categories": "_category", "category_ids": "category_id"}
    out = with_linked(top, named, *[F.sort_array(F.collect_set(c)).alias(n) for n, c in sets.items()])
    return out.orderBy(*order)


def city_top(cat: Catalog, city_id: int, n: int = 100) -> DataFrame:
    hits = cat.companies.filter(F.col("city_id") == city_id)
    return hits.orderBy(F.desc_nulls_last("rating"), F.asc("name"), F.asc("id")).limit(n)


def company_detail(cat: Catalog, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Detail records of a set of companies: the row, its city, category names and tags.

    Link tables are cut to these companies and grouped before they meet the rows, so no row is repeated for each of its links.
    """
    def of(df: DataFrame, key: str) -> DataFrame:
        if isinstance(ids, DataFrame):
            return df.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")
        return df.filter(F.col(key).isin(list(ids)))

    def names(links: DataFrame, targets: DataFrame, key: str, out: str) -> DataFrame:
        named = of(links, "company_id").join(targets.select(F.col("id").alias(key), F.col("name").alias("_n")), key)
        return named.groupBy(F.col("company_id").alias("id")).agg(F.sort_array(F.collect_set("_n")).alias(out))

    rows = with_city(of(cat.companies, "id"), cat.cities, slug=True)
    rows = rows.groupBy("id").agg(F.any_value(F.struct(*rows.columns)).alias("_row")).select("_row.*")
    columns = [F.col(c) for c in rows.columns]
    for links, targets, key, out in (
        (cat.company_categories, cat.categories, "category_id", "category_names"),
        (cat.company_tags, cat.tags, "tag_id", "tag_names"),
    ):
        rows = rows.join(names(links, targets, key, out), "id", "left")
        columns.append(F.coalesce(out, F.array().cast("array<string>")).alias(out))
    return rows.select(*columns)


def company_tags(cat: Catalog) -> DataFrame:
    """Tags per company: ``company_id, tag_id, name, slug, category, heading, pos``; ``pos`` by (category, name).

    ``heading`` is the group that a page shows, with a word for tags without one. Null categories come last.
    """
    tags = cat.tags.select(F.col("id").alias("tag_id"), "name", "slug", "category")
    rows = cat.company_tags.join(tags, "tag_id")
    order = Window.partitionBy("company_id").orderBy(F.asc_nulls_last("category"), "name", "tag_id")
    return rows.select(
        "company_id",
        "tag_id",
        "name",
        "slug",
        "category",
        F.coalesce("category", F.lit(OTHER_TAGS)).alias("heading"),
        F.row_number().over(order).cast("bigint").alias("pos"),
    )


def tags_by_category(cat: Catalog) -> DataFrame:
    """Tags under their category, one row each with its place ``pos`` by id; tags without a category are left out."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("id")).cast("bigint")
    return cat.tags.filter("category is not null").select("category", place.alias("pos"), "id", "name", "slug")


def city_category(cat: Catalog, city: str | Column, category: str | Column) -> DataFrame:
    """Companies of a city in a category, both by slug (also a scalar subquery), best rated first."""
    town = cat.cities.filter(F.col("slug") == city).select(F.col("id").alias("city_id"))
    hits = cat.companies.join(town, "city_id", "left_semi")
    wanted = cat.categories.filter(F.col("slug") == category).select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    links = cat.company_categories.join(wanted, "category_id").select(
        F.col("company_id").alias("id"), "category_name"
    )
    return hits.join(links, "id").orderBy(F.desc_nulls_last("rating"), F.asc("id"))


def by_phone(cat: Catalog, fragment: str) -> DataFrame:
    hits = cat.companies.filter(F.contains("phone", F.lit(fragment)))
    cities = cat.cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"))
    return hits.join(cities, "city_id").select("id", "name", "phone", "city")


def with_favorites(df: DataFrame, favorites: DataFrame, user_id: int) -> DataFrame:
    """Add ``is_favorite`` for one user."""
    mine = favorites.filter(F.col("user_id") == user_id).select(F.col("company_id").alias("id")).distinct()
    out = df.join(mine.withColumn("_fav", F.lit(True)), "id", "left")
    return out.withColumn("is_favorite", F.col("_fav").isNotNull()).drop("_fav")


def primary_category(cat: Catalog) -> DataFrame:
    """One category per company, the one with the lowest id: a single job for all cards."""
    best = cat.company_categories.groupBy("company_id").agg(F.min("category_id").alias("category_id"))
    names = cat.categories.select(F.col("id").alias("category_id"), "slug", "name")
    return best.join(names, "category_id").select("company_id", "category_id", "slug", "name")


def card_view(df: DataFrame, k: int = 3) -> DataFrame:
    """Card columns: first image, photo count, the first ``k`` features and a short text."""
    photos = F.greatest(F.size("images"), F.lit(0))
    return df.withColumn("image", F.get("images", F.lit(0))["preview"]).withColumn("photo_count", photos).withColumn(
        "card_tags", F.slice("features", 1, k)
    ).withColumn("short_text", short_text("description"))


def resolve_city(cities: DataFrame, slugs: DataFrame, host: str = SUBDOMAIN_HOST) -> DataFrame:
    """City of each ``slugs(slug)``: by the subdomain of the city's URL, else by its slug; the lowest id if several.

    ``site_slug`` is the subdomain of the city found, else the slug itself.
    """
    sub = url_subdomain("url", host)
    by_host = cities.groupBy(sub.alias("slug")).agg(F.min("id").alias("_host_id"))
    by_slug = cities.groupBy("slug").agg(F.min("id").alias("_slug_id"))
    met = slugs.join(by_host, "slug", "left").join(by_slug, "slug", "left")
    met = met.withColumn("city_id", F.coalesce("_host_id", "_slug_id")).drop("_host_id", "_slug_id")
    known = cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"), sub.alias("_sub"))
    out = join_known(met, known, ["city_id"])
    return out.withColumn("site_slug", F.coalesce("_sub", "slug")).drop("_sub")


def dimension_list(dim: DataFrame, order: str = "name", n: int | None = None) -> DataFrame:
    """Filter lists: a whole dimension by name, or its first rows by id."""
    out = dim.orderBy(order, "id") if order != "id" else dim.orderBy("id")
    return out.limit(n) if n is not None else out
