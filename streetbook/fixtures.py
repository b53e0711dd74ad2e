"""Catalog views over the driver tables, as SQL text that Spark and DuckDB both run.

``Fixture(spark, folder)`` gives each base table and view as a DataFrame attribute; ``with_views`` puts the views that
a statement names in front of it, for the SQL twin of a query.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from streetbook.sources.catalog import Catalog

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "cities": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(replace(n_name, '_', '-')) AS slug,
               r_name AS region, concat('https://', lower(replace(n_name, '_', '')), '.example.org/') AS url,
               CAST(((n_nationkey * 7919) % 13) * 50000 AS INT) AS weight
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "reviews": """
        SELECT o_orderkey AS id, o_custkey AS company_id,
               concat('author', CAST(o_orderkey % 97 AS STRING)) AS author_name,
               6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating,
               concat(o_orderpriority, ' ', o_orderstatus) AS text, CAST(o_orderdate AS DATE) AS date
        FROM orders""",
    "review_agg": """
        SELECT company_id, COUNT(*) AS n,
               floor(CAST(SUM(rating) * 10 AS DOUBLE) / COUNT(*)) / 10 AS avg_rating, MAX(date) AS last_date
        FROM reviews GROUP BY company_id""",
    "companies": """
        SELECT c_custkey AS id, concat('x', CAST(c_custkey AS STRING)) AS external_id,
               concat('https://dir.example.org/com/p_', CAST(c_custkey AS STRING), '/') AS url, c_name AS name,
               d.text AS description, concat('Street ', CAST(c_custkey % 300 AS STRING)) AS address,
               CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS city_id,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE concat('8 (912) ', CAST(100 + c_custkey % 900 AS STRING), '-',
                                CAST(10 + c_custkey % 90 AS STRING), '-', CAST(10 + c_custkey % 7 AS STRING))
               END AS phone,
               CASE WHEN c_custkey % 4 = 0 THEN NULL
                    ELSE concat('http://site', CAST(c_custkey AS STRING), '.example.net') END AS website,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(a.avg_rating AS DOUBLE) END AS rating,
               CAST(coalesce(a.n, 0) AS INT) AS review_count, c_mktsegment AS source,
               CASE c_custkey % 4 WHEN 0 THEN 'Mon,Tue,Wed: 09:00-18:00' WHEN 1 THEN 'Daily: 10:00-22:00'
                    WHEN 2 THEN 'Mo,Sa: 08:30-12:00' ELSE 'Fri,Sat: 20:00-03:00' END AS hours_line,
               c_custkey % 3 = 0 AS is_normalized,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE a.last_date END AS parsed_at
        FROM customer LEFT JOIN review_agg a ON a.company_id = c_custkey
                      LEFT JOIN documents d ON d.doc_id = c_custkey""",
    "categories": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name,
               lower(replace(p_brand, '#', '-')) AS slug
        FROM part""",
    "company_categories": """
        SELECT DISTINCT CASE WHEN o_custkey % 13 = 5 THEN o_custkey - 1 ELSE o_custkey END AS company_id,
               CAST(substr(p_brand, 7) AS BIGINT) AS category_id
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "tags": """
        SELECT MIN(p_partkey) AS id, p_name AS name, replace(p_name, ' ', '-') AS slug,
               CASE WHEN p_name LIKE 'red%' THEN NULL ELSE substr(p_name, instr(p_name, ' ') + 1) END AS category
        FROM part GROUP BY p_name""",
    "company_tags": """
        SELECT DISTINCT o_custkey AS company_id, t.id AS tag_id
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
                    JOIN tags t ON t.name = p_name""",
    "menu_old": """
        SELECT o_custkey AS company_id, p_type AS section,
               CAST(row_number() OVER (PARTITION BY o_custkey, p_type ORDER BY o_orderkey, l_linenumber, l_partkey)
                    AS BIGINT) AS pos,
               p_name AS name, concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), ' руб.') AS price
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
    "menu_fresh": """
        SELECT company_id, section,
               CAST(row_number() OVER (PARTITION BY company_id, section ORDER BY o_orderkey, l_linenumber, l_partkey)
                    AS BIGINT) AS pos, name, price
        FROM (SELECT o_orderkey, l_linenumber, l_partkey,
                     CASE WHEN o_custkey % 29 = 5 OR (o_custkey % 5 = 3 AND o_orderkey % 4 = 1) THEN o_custkey - 1
                          ELSE o_custkey END AS company_id,
                     CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 4 = 1 THEN concat(p_type, ' NEW') ELSE p_type END AS section,
                     CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 4 = 1 THEN concat(p_name, ' new') ELSE p_name END AS name,
                     concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), ' руб.') AS price
              FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey) q""",
    "incoming": """
        SELECT CASE WHEN id % 2 = 0 THEN external_id ELSE NULL END AS external_id,
               CASE WHEN id % 3 = 0 THEN url ELSE concat(url, 'new/') END AS url, name, address, city_id, website,
               rating, review_count
        FROM companies""",
    "favorites": """
        SELECT DISTINCT user_id, event_id % (SELECT COUNT(*) FROM customer) AS company_id
        FROM events WHERE event_type = 'purchase'""",
    "run_log": """
        SELECT event_id AS id, event_type AS task_type,
               CASE WHEN event_id % 3 = 0 THEN 'started' ELSE 'completed' END AS status,
               CAST(floor(value) AS INT) AS items, ts AS started_at
        FROM events""",
    "progress": """
        SELECT user_id % 25 AS city_id, COUNT(*) AS total, MAX(ts) AS last_attempt,
               CASE WHEN user_id % 25 < 5 THEN 'failed' WHEN user_id % 25 < 15 THEN 'completed' ELSE 'parsing' END
                   AS status
        FROM events GROUP BY user_id % 25""",
}


def _named(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def _needed(sql: str) -> list[str]:
    """Views that a statement needs, in the order of definition."""
    need = _named(sql) & VIEWS.keys()
    for name in reversed(VIEWS):
        if name in need:
            need |= (_named(VIEWS[name]) & VIEWS.keys()) - {name}
    return [name for name in VIEWS if name in need]


def with_views(sql: str) -> str:
    """Prepend the views that a statement names; the statement may start with its own ``WITH``."""
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql))
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


class Fixture:
    """Base tables and views of one folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def sql(self, statement: str) -> DataFrame:
        text = with_views(statement)
        bases = [t for t in BASE_TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
        heads = ", ".join(f"{t} AS (SELECT * FROM parquet.`{self.folder}/{t}.parquet`)" for t in bases)
        if not heads:
            return self.spark.sql(text)
        rest = text[5:] if text.upper().startswith("WITH ") else None
        return self.spark.sql(f"WITH {heads}, {rest}" if rest else f"WITH {heads} {text}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    @cached_property
    def companies(self) -> DataFrame:
        """Companies with their hours as a list."""
        return self.sql("SELECT * FROM companies").withColumn("working_hours", F.array("hours_line"))

    @cached_property
    def menu_old(self) -> DataFrame:
        """The view's rows, numbered by their own names, so that what groups a section finds its rows in one place already."""
        rows = self.sql("""SELECT o_custkey AS company_id, p_type AS section, o_orderkey, l_linenumber, l_partkey, p_name AS name,
                                  concat(CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), ' руб.') AS price
                           FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""")
        order = Window.partitionBy("company_id", "section").orderBy("o_orderkey", "l_linenumber", "l_partkey")
        rows = rows.withColumn("pos", F.row_number().over(order).cast("bigint"))
        return rows.select("company_id", "section", "pos", "name", "price")

    def catalog(self, *names: str, **tables: DataFrame) -> Catalog:
        return Catalog(**{n: getattr(self, n) for n in names if n not in tables}, **tables)
