"""The catalog: its tables as DataFrames, loaded with typed nested columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetbook.functions.hours import fold_hours_map
from streetbook.schema import FLAGS, JSON_COLUMNS, TABLES, struct_type


@dataclass(frozen=True)
class Catalog:
    companies: DataFrame | None = None
    cities: DataFrame | None = None
    categories: DataFrame | None = None
    company_categories: DataFrame | None = None
    reviews: DataFrame | None = None
    company_phones: DataFrame | None = None
    tags: DataFrame | None = None
    company_tags: DataFrame | None = None
    favorites: DataFrame | None = None
    parse_logs: DataFrame | None = None
    progress: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are present."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


def decode_hours(text: Column) -> Column:
    """Hours JSON, a list of lines or a map day -> time, as a list of lines."""
    listed = F.from_json(text, "array<string>")
    mapped = F.from_json(text, "map<string,string>")
    is_map = F.ltrim(text).startswith("{")
    return F.when(is_map, fold_hours_map(mapped)).otherwise(listed)


def decode_json(df: DataFrame) -> DataFrame:
    """Turn JSON text columns into typed ones; columns that are typed already stay."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    out = {}
    for name, kind in JSON_COLUMNS.items():
        if name in text:
            out[name] = decode_hours(F.col(name)) if name == "working_hours" else F.from_json(name, kind)
    return df.withColumns(out) if out else df


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One catalog table from parquet, with the fixed schema."""
    df = spark.read.schema(struct_type(name)).parquet(f"{folder}/{name}")
    if name != "companies":
        return df
    return decode_json(df).withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in FLAGS})


def load_catalog(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> Catalog:
    return Catalog(**{name: load_table(spark, folder, name) for name in names})


def save_catalog(cat: Catalog, folder: str, names: tuple[str, ...] | None = None) -> None:
    """Write tables to a new folder, nested columns as JSON text. A snapshot is never written over its own source."""
    for name, df in cat.tables().items():
        if names is not None and name not in names:
            continue
        encoded = {c: F.to_json(c) for c, kind in df.dtypes if c in JSON_COLUMNS and kind != "string"}
        out = df.withColumns(encoded) if encoded else df
        known = [
            (F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_type(name).fields
        ]
        out.select(*known).write.mode("errorifexists").parquet(f"{folder}/{name}")


def save_hours(index: DataFrame, folder: str) -> None:
    """Write an index of opening hours to a new folder, a part for each day, sorted by opening time."""
    rows = index.repartitionByRange("day", "begin", "id").sortWithinPartitions("day", "begin", "end")
    rows.write.mode("errorifexists").partitionBy("day").parquet(folder)


def load_hours(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id bigint, begin int, end int, day int").parquet(folder)


def save_texts(index: DataFrame, folder: str) -> None:
    """Write an index of texts to a new folder, in ranges of grams: a question reads the parts that hold its grams."""
    rows = index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    rows.write.mode("errorifexists").parquet(folder)


def load_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram string, id bigint").parquet(folder)
