"""The catalog page: the rows, their cards, and the lists of its filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetbook.operators.browse import catalog, sort_order, with_linked, with_open_status
from streetbook.sources.catalog import Catalog


def catalog_page(
    cat: Catalog,
    as_of: datetime,
    city_id: int | None = None,
    category: str | None = None,
    q: str = "",
    sort: str = "rating",
    order: str = "desc",
    n: int = 50,
    open_now: bool = False,
) -> DataFrame:
    """Rows of one page with city name, status label and primary category: one job, not one query per card."""
    rows = catalog(cat, city_id, category, q, sort, order, n, as_of if open_now else None)
    # the links join the rows that are kept, so companies are read and cut once
    cards = with_linked(rows, cat.company_categories, F.min("category_id").alias("category_id"))
    names = cat.categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("slug").alias("category_slug")
    )
    cards = cards.join(names, "category_id", "left").drop("category_id")
    return with_open_status(cards, as_of).orderBy(*sort_order(sort, order))
