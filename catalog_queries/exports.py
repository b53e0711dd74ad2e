"""Source and export queries A1 to A6."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from catalog_queries import register
from streetbook.sources import export as E
from streetbook.sources.catalog import decode_json
from streetbook.sources.pages import load_pages


def _folder(fx) -> str:
    """A new folder under the shared checkpoint folder, or a temporary one on a local master."""
    base = fx.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not fx.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="streetbook-")
    return os.path.join(base, f"export-{uuid.uuid4().hex}")


@register(
    "a01_load_catalog",
    """SELECT c.id, c.hours_line AS hours, concat('f', CAST(c.id % 3 AS STRING), '|wifi') AS features,
              coalesce(m.sections, -1) AS sections, coalesce(m.items, 0) AS items
       FROM companies c LEFT JOIN (SELECT company_id, CAST(COUNT(DISTINCT section) AS INT) AS sections, COUNT(*) AS items
                                   FROM menu_old GROUP BY company_id) m ON m.company_id = c.id""",
)
def a01(fx):
    day, time = F.split_part("hours_line", F.lit(": "), F.lit(1)), F.split_part("hours_line", F.lit(": "), F.lit(2))
    hours = F.when(F.col("id") % 2 == 0, F.to_json(F.array("hours_line"))).otherwise(F.to_json(F.create_map(day, time)))
    sections = fx.menu_old.groupBy("company_id", "section").agg(F.collect_list(F.struct("name", "price")).alias("items"))
    menus = sections.groupBy(F.col("company_id").alias("id")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "items")))).alias("menu")
    )
    features = F.to_json(F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")), F.lit("wifi")))
    rows = fx.companies.drop("working_hours").withColumns({"working_hours": hours, "features": features}).join(menus, "id", "left")
    out = decode_json(rows)
    items = F.aggregate(F.map_values("menu"), F.lit(0).cast("bigint"), lambda acc, v: acc + F.size(v))
    return out.select(
        "id",
        F.array_join("working_hours", "|").alias("hours"),
        F.array_join("features", "|").alias("features"),
        F.coalesce(F.size("menu"), F.lit(-1)).alias("sections"),
        F.coalesce(items, F.lit(0)).alias("items"),
    )


@register("a02_load_pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE html IS NOT NULL AND html <> ''")
def a02(fx):
    pages = load_pages(fx.spark, f"{fx.folder}/pages.parquet", ("page_id", "url", "html"))
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n"))


TABLES = ("companies", "cities", "categories", "company_categories")
EXPORTED = """SELECT c.id, c.name, c.address, c.phone, c.website, c.rating, c.review_count, city.name AS city,
                     string_agg(cat.name, ', ' ORDER BY cat.name) AS categories, c.source
              FROM companies c JOIN cities city ON city.id = c.city_id
                   LEFT JOIN company_categories cc ON cc.company_id = c.id LEFT JOIN categories cat ON cat.id = cc.category_id
              WHERE c.source = 'BUILDING'
              GROUP BY c.id, c.name, c.address, c.phone, c.website, c.rating, c.review_count, city.name, c.source"""


@register("a03_export_csv", EXPORTED)
def a03(fx):
    """Written as CSV and read back."""
    path = _folder(fx)
    E.export_csv(fx.catalog(*TABLES), path, "BUILDING")
    schema = (
        "id bigint, name string, address string, phone string, website string, rating double, review_count int, "
        "city string, categories string, source string, source_url string"
    )
    back = fx.spark.read.schema(schema).csv(path, header=True, escape='"')
    return back.drop("source_url")


@register("a04_export_json", EXPORTED.replace("c.id, c.name,", "c.id, c.description, c.name,"))
def a04(fx):
    """Written as JSON lines and read back."""
    path = _folder(fx)
    E.export_json(fx.catalog(*TABLES), path, "BUILDING")
    schema = (
        "id bigint, name string, address string, phone string, website string, rating double, review_count int, "
        "description string, city string, categories array<string>, source string"
    )
    back = fx.spark.read.schema(schema).json(path)
    return back.withColumn("categories", F.array_join("categories", ", "))


@register(
    "a05_export_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS part, COUNT(*) AS n FROM {t}" for t in TABLES),
)
def a05(fx):
    path = _folder(fx)
    E.export_tables(fx.catalog(*TABLES), path)
    out = None
    for name in TABLES:
        part = fx.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "a06_export_filter",
    """SELECT c.id FROM companies c JOIN cities city ON city.id = c.city_id
       WHERE c.phone IS NOT NULL AND c.phone <> '' AND c.rating >= 3.0 AND city.slug = 'nation-4'
         AND EXISTS (SELECT 1 FROM company_categories cc JOIN categories cat ON cat.id = cc.category_id
                     WHERE cc.company_id = c.id AND cat.slug IN ('brand-3'))""",
)
def a06(fx):
    return E.export_filter(fx.catalog(*TABLES), True, 3.0, "brand-3", "nation-4").select("id")
