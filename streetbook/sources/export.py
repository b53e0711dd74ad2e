"""Exports of the catalog: CSV, JSON lines and parquet, each written in parallel by the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetbook.operators.browse import in_category
from streetbook.sources.catalog import Catalog

FLAT_COLUMNS = ("id", "name", "address", "phone", "website", "rating", "review_count")


def _with_categories(cat: Catalog, source: str | None) -> DataFrame:
    """Companies in a city, with the sorted names of their categories. The names are grouped by company id alone."""
    rows = cat.companies
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if "source_url" not in rows.columns:
        rows = rows.withColumn("source_url", F.lit(None).cast("string"))
    cities = cat.cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"))
    names = cat.categories.select(F.col("id").alias("category_id"), F.col("name").alias("_n"))
    listed = cat.company_categories.join(names, "category_id").groupBy(F.col("company_id").alias("id"))
    listed = listed.agg(F.sort_array(F.collect_list("_n")).alias("_categories"))
    return rows.join(cities, "city_id").join(listed, "id", "left")


def csv_frame(cat: Catalog, source: str | None = None) -> DataFrame:
    """One row per company, categories joined by comma; null when there are none."""
    return _with_categories(cat, source).select(
        *FLAT_COLUMNS, "city", F.array_join("_categories", ", ").alias("categories"), "source", "source_url"
    )


def json_frame(cat: Catalog, source: str | None = None) -> DataFrame:
    """One object per company, with a nested category list."""
    rows = _with_categories(cat, source)
    stamp = ["created_at"] if "created_at" in rows.columns else []
    return rows.select(
        *FLAT_COLUMNS, "description", "city", F.col("_categories").alias("categories"), "source", "source_url", *stamp
    )


def export_csv(cat: Catalog, path: str, source: str | None = None) -> None:
    """CSV with a header, ordered by city and name: the sort ranges over files, so their order is the order."""
    rows = csv_frame(cat, source).orderBy("city", "name", "id")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("errorifexists").csv(path)


def export_json(cat: Catalog, path: str, source: str | None = None) -> None:
    json_frame(cat, source).write.mode("errorifexists").json(path)


def export_tables(
    cat: Catalog,
    path: str,
    names: Sequence[str] = ("companies", "company_categories", "cities", "categories"),
) -> None:
    tables = cat.tables()
    for name in names:
        tables[name].write.mode("errorifexists").parquet(f"{path}/{name}")


def export_filter(
    cat: Catalog,
    has_phone: bool = False,
    min_rating: float | None = None,
    category: str | None = None,
    city: str | None = None,
) -> DataFrame:
    """Companies to export: with a phone, from a rating up, of a category, of a city (both by slug)."""
    rows = cat.companies
    if has_phone:
        rows = rows.filter(F.col("phone").isNotNull() & (F.col("phone") != ""))
    if min_rating is not None:
        rows = rows.filter(F.col("rating") >= min_rating)
    if city is not None:
        town = cat.cities.filter(F.col("slug") == city).select(F.col("id").alias("city_id"))
        rows = rows.join(town, "city_id", "left_semi").select(*cat.companies.columns)
    if category is not None:
        rows = rows.join(in_category(cat, category), "id", "left_semi")
    return rows
