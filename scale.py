"""Time five operators on the companies of a folder, copied 1 and 10 times, with a third of the incoming rows on one key.

``python scale.py [folder] [copies ...]``. Inputs are written to a new temporary folder first, so only the operator is timed.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import functions as F

from catalog_queries import site_pages as P
from streetbook.fixtures import Fixture
from streetbook.operators import browse, classify, describe, extract, merge
from streetbook.session import session


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = [int(n) for n in sys.argv[2:]] or [1, 10]
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "32", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    fx = Fixture(spark, folder)
    base = tempfile.mkdtemp(prefix="streetbook-scale-")
    for n in copies:
        def store(df, name):
            path = f"{base}/{name}-{n}"
            df.write.parquet(path)
            return spark.read.parquet(path)

        size = fx.companies.count()
        shifted = F.col("id") + F.col("_copy") * size
        rows = fx.companies.drop("hours_line").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = rows.withColumn("id", shifted).drop("_copy").repartition(32)
        rows = rows.withColumn("external_id", F.concat(F.lit("x"), "id")).withColumn("url", F.concat(F.lit("https://d/p_"), "id", F.lit("/")))
        companies = store(rows, "companies")
        hot = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("external_id"))
        incoming = store(companies.withColumn("external_id", hot).withColumn("name", F.concat("name", F.lit("!"))), "incoming")
        pages = companies.withColumn("hours_line", F.array_join("working_hours", ""))
        pages = store(P.detail_pages(pages), "pages")
        cat = fx.catalog("cities", "categories", companies=companies)
        jobs = {
            "search": lambda: browse.search(cat, "the", n=50),
            "normalise": lambda: describe.normalize_descriptions(companies),
            "review": lambda: classify.review_moderated(companies, cat.categories),
            "upsert": lambda: merge.upsert_companies(companies, incoming, F.lit("2024-01-01").cast("date"), order=F.col("id")).snapshot,
            "extract": lambda: extract.extract_pages(pages),
        }
        for name, job in jobs.items():
            start = time.time()
            job().write.format("noop").mode("overwrite").save()
            print(f"| {name} | x{n} | {size * n} | {time.time() - start:.1f} |", flush=True)


if __name__ == "__main__":
    main()
