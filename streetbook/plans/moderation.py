"""Review of the companies under moderation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetbook.operators.classify import apply_moderation, assign_category, flag_names, moderated
from streetbook.operators.classify import review_moderated, review_summary
from streetbook.sources.catalog import Catalog


@dataclass(frozen=True)
class Review:
    catalog: Catalog
    reviewed: DataFrame

    def summary(self) -> DataFrame:
        return review_summary(self.reviewed)


def moderate_existing(cat: Catalog) -> Catalog:
    """Put companies whose name holds a sensitive word under moderation."""
    flagged = flag_names(cat.companies)
    companies, links = apply_moderation(flagged, cat.company_categories, cat.categories)
    return cat.with_tables(companies=companies.drop("sensitive"), company_categories=links)


def review(cat: Catalog, **dictionaries) -> Review:
    """Score the moderated companies, rename and relink those that are cleared."""
    rows = moderated(cat.companies, cat.company_categories, cat.categories)
    reviewed = review_moderated(rows, cat.categories, **dictionaries)
    cleared = reviewed.filter("outcome = 'reassigned'")
    names = cleared.select("id", F.col("new_name").alias("_name"))
    companies = cat.companies.join(names, "id", "left")
    companies = companies.withColumn("name", F.coalesce("_name", "name")).select(*cat.companies.columns)
    links = assign_category(
        cat.company_categories,
        cleared.select(F.col("id").alias("company_id"), F.col("category_slug").alias("slug")),
        cat.categories,
    )
    return Review(cat.with_tables(companies=companies, company_categories=links), reviewed)
