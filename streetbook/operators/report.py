"""Counts, ingest reports and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetbook.operators.common import small_table, spread_key
from streetbook.sources.catalog import Catalog


def stats(cat: Catalog) -> DataFrame:
    """Row counts: ``table, rows``."""
    names = ("companies", "reviews", "categories", "cities", "tags")
    frames = [
        getattr(cat, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
        for n in names
        if getattr(cat, n) is not None
    ]
    return reduce(DataFrame.unionByName, frames)


def by_source(cat: Catalog) -> DataFrame:
    return cat.companies.groupBy("source").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source")


def _per_city(cat: Catalog) -> DataFrame:
    """Companies per city id: counted before any join, so a big city is one row."""
    counts = cat.companies.groupBy("city_id").agg(F.count("*").alias("companies"))
    return counts.filter("city_id is not null").withColumnRenamed("city_id", "id")


def top_cities(cat: Catalog, n: int = 20) -> DataFrame:
    """Cities with the most companies, those without any included."""
    joined = cat.cities.select("id", "name").join(_per_city(cat), "id", "left")
    out = joined.select("id", "name", F.coalesce("companies", F.lit(0)).alias("companies"))
    return out.orderBy(F.desc("companies"), "name", "id").limit(n)


def by_category(cat: Catalog) -> DataFrame:
    """Links per category, categories without any included."""
    counts = cat.company_categories.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("count"))
    joined = cat.categories.select("id", "name").join(counts, "id", "left")
    return joined.select("id", "name", F.coalesce("count", F.lit(0)).alias("count")).orderBy(F.desc("count"), "name")


def city_stats(cat: Catalog, category: str) -> DataFrame:
    """Companies per city, and how many of them are in a category. Ids are unique, so both are plain counts."""
    wanted = cat.categories.filter(F.col("slug") == category).select(F.col("id").alias("category_id"))
    inside = cat.company_categories.join(wanted, "category_id", "left_semi").select(F.col("company_id").alias("id"))
    flagged = cat.companies.select("id", "city_id").join(
        inside.distinct().withColumn("_in", F.lit(1)), "id", "left"
    )
    counts = flagged.groupBy("city_id").agg(F.count("*").alias("_total"), F.count("_in").alias("_in"))
    joined = cat.cities.select(F.col("id").alias("city_id"), "name").join(
        counts.filter("city_id is not null"), "city_id", "left"
    )
    return joined.select(
        "city_id",
        "name",
        F.coalesce("_total", F.lit(0)).alias("total_companies"),
        F.coalesce("_in", F.lit(0)).alias("in_category"),
    ).orderBy(F.desc("total_companies"), "name")


def progress_status(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count("*").alias("count"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Names that come more than once in a city; rows without a city group together here."""
    return df.groupBy("name", "city_id").agg(F.count("*").alias("count")).filter("count > 1")


def orphan_links(links: DataFrame, companies: DataFrame) -> DataFrame:
    ids = companies.select(F.col("id").alias("company_id"))
    return links.join(ids, "company_id", "left_anti").agg(F.count("*").alias("orphans"))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """One row over ``outcome (saved, skipped, failed), rating, review_count``."""
    def n(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == kind, 1)), F.lit(0)).cast("bigint")

    saved = F.col("outcome") == "saved"
    rating = F.avg(F.when(saved, F.coalesce("rating", F.lit(0.0))))
    reviews = F.sum(F.when(saved, F.coalesce("review_count", F.lit(0))))
    return outcomes.agg(
        n("saved").alias("saved"),
        n("skipped").alias("skipped"),
        n("failed").alias("failed"),
        F.coalesce(F.round(rating, 2), F.lit(0.0)).alias("avg_rating"),
        F.coalesce(reviews, F.lit(0)).cast("bigint").alias("total_reviews"),
    )


def ingest_rollup(outcomes: DataFrame) -> DataFrame:
    """Found, saved, skipped and failed per city and category, per city, and in total.

    ``level``: 0 city and category, 1 city, 3 total.
    """
    def n(kind: str) -> Column:
        return F.sum((F.col("outcome") == kind).cast("int")).cast("bigint").alias(kind)

    return outcomes.rollup("city", "category").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("found"),
        n("saved"),
        n("skipped"),
        n("failed"),
    )


UNIQUE = {
    "cities": ("slug",),
    "categories": ("slug",),
    "companies": ("external_id", "url"),
    "company_phones": ("company_id,phone",),
    "company_categories": ("company_id,category_id",),
}
NOT_NULL = {
    "cities": ("name", "slug"),
    "categories": ("name", "slug"),
    "companies": ("name",),
    "company_phones": ("phone",),
    "parse_logs": ("task_type", "status"),
}
MAX_LENGTH = {"companies": {"external_id": 100, "name": 500, "phone": 50, "email": 255}}
REFERENCES = (
    ("company_categories", "company_id", "companies"),
    ("company_categories", "category_id", "categories"),
    ("reviews", "company_id", "companies"),
    ("companies", "city_id", "cities"),
)


def audit(cat: Catalog) -> DataFrame:
    """Constraint audit: ``check, violations``. Covers unique keys, nulls, lengths, ratings and references.

    Each table is read once. A row gives a pair of check and key for each of its unique keys, for each reference it holds and
    for each that may point to it, and one for each condition on single rows that it breaks. All pairs share one
    aggregate by check and key: a unique key is broken by its rows beyond the first, a reference by the rows of a key that no
    parent has. Parents count once, and a hot key is one row per task before the shuffle. Null keys are never equal and
    refer to nothing.
    """
    tables = cat.tables()
    checks: list[str] = []
    kinds: list[str] = []
    pairs: dict[str, list[Column]] = {table: [] for table in tables}

    def add(check: str, kind: str) -> int:
        checks.append(check)
        kinds.append(kind)
        return len(checks) - 1

    def pair(number: int, when: Column, key: Column, parent: bool = False) -> Column:
        return F.when(when, F.struct(F.lit(number).alias("number"), key.alias("key"), F.lit(parent).alias("parent")))

    def broken(table: str, check: str, when: Column) -> None:
        pairs[table].append(pair(add(check, "row"), F.coalesce(when, F.lit(False)), F.lit(None).cast("string")))

    for table, keys in UNIQUE.items():
        for key in keys if table in tables else ():
            parts = [F.col(k) for k in key.split(",")]
            known = reduce(Column.__and__, [p.isNotNull() for p in parts])
            pairs[table].append(pair(add(f"unique {table}({key})", "unique"), known, spread_key(parts, F.lit(""))))
    for table, df in tables.items():
        for name in NOT_NULL.get(table, ()):
            if name in df.columns:
                broken(table, f"not null {table}({name})", F.col(name).isNull())
        for name, size in MAX_LENGTH.get(table, {}).items():
            if name in df.columns:
                broken(table, f"length {table}({name})", F.length(name) > size)
        if table == "reviews":
            broken(table, "rating reviews", ~F.col("rating").between(1, 5))
    for table, key, parent in REFERENCES:
        if table in tables and parent in tables:
            number = add(f"reference {table}({key})", "reference")
            pairs[table].append(pair(number, F.col(key).isNotNull(), F.col(key).cast("string")))
            pairs[parent].append(pair(number, F.col("id").isNotNull(), F.col("id").cast("string"), parent=True))

    rows = [tables[t].select(F.inline(F.array_compact(F.array(*columns)))) for t, columns in pairs.items() if columns]
    by_key = reduce(DataFrame.unionByName, rows).groupBy("number", "key").agg(
        F.count_if(~F.col("parent")).alias("n"), F.max("parent").alias("has_parent")
    )
    names = small_table(next(iter(tables.values())).sparkSession, list(zip(range(len(checks)), checks, kinds)), "number int, check string, kind string")
    extra = (
        F.when(F.col("kind") == "unique", F.col("n") - 1)
        .when(F.col("kind") == "reference", F.when(~F.col("has_parent"), F.col("n")).otherwise(0))
        .otherwise(F.col("n"))
    )
    found = by_key.join(names, "number").groupBy("number").agg(F.sum(extra).alias("violations"))
    counts = names.join(found, "number", "left")
    return counts.select("check", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
