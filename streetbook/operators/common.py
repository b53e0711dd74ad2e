"""Join, key and id helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

MAX_BROADCAST_ROWS = 10_000
ID_BUCKET_DIGITS = 3


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed table of known size, marked for broadcast."""
    if len(rows) > MAX_BROADCAST_ROWS:
        raise ValueError(f"a fixed table may hold up to {MAX_BROADCAST_ROWS} rows, got {len(rows)}")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def spread_key(keys: Sequence[Column], salt: Column) -> Column:
    """One join key from several columns; the salt takes its place where one of them is null."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | key.isNull()
    parts = [F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")) for k in keys]
    return F.when(missing, F.concat(F.lit("null/"), salt.cast("string"))).otherwise(F.concat(F.lit("key/"), *parts))


def join_known(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on equally named keys that may be null on the left; the right side's keys are dropped.

    ``how`` is ``left``, ``left_anti`` or ``left_semi``. Rows of the left side with a null key match nothing, as in SQL.
    They would all hash to one task, so a salt of their partition, their other keys and their id spreads them, equal rows
    too; a task that runs again gives the same salts, and no further column is read for it.
    """
    salt = F.xxhash64(F.spark_partition_id(), *keys, *(["id"] if "id" in left.columns else []))
    probe = left.withColumn("_probe", spread_key([F.col(k) for k in keys], salt))
    known = right.filter(" and ".join(f"`{k}` is not null" for k in keys))
    known = known.withColumn("_probe", spread_key([F.col(k) for k in keys], F.lit(""))).drop(*keys)
    return probe.join(known, "_probe", how).drop("_probe")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Column, newest: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``. An aggregate, so each map task sends one row per key and a
    hot key costs no more than any other.

    A row without an order is taken only where its key has no other. Ties go by a hash of the row, the same on every run.
    """
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    plain = [c for c, kind in df.dtypes if c in rest and "map<" not in kind and "variant" not in kind]
    tie = F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")
    rank = F.struct((order.isNotNull() if newest else order.isNull()).alias("known"), order.alias("order"), tie.alias("tie"))
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def allocate_ids(df: DataFrame, start: DataFrame, key: Column, name: str = "id") -> DataFrame:
    """Consecutive ids above ``start`` (one row, column ``max_id``) for rows with a distinct ``key``.

    Rows are numbered within buckets of the key's MD5 and each bucket is shifted by the sizes of those before it, so
    no task sees more than one bucket. Ids follow (bucket, key) and come out the same on every run.
    """
    rows = df.withColumn("_key", key).withColumn("_bucket", F.substring(F.md5("_key"), 1, ID_BUCKET_DIGITS))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    # at most 16 ** ID_BUCKET_DIGITS rows
    numbered = rows.withColumn("_rank", F.row_number().over(W.Window.partitionBy("_bucket").orderBy("_key")))
    top = start.select(F.coalesce(F.col("max_id"), F.lit(0)).cast("bigint")).scalar()
    out = numbered.join(F.broadcast(shifts), "_bucket")
    value = (top + F.col("_shift") + F.col("_rank")).cast("bigint")
    return out.withColumn(name, value).drop("_key", "_bucket", "_rank", "_shift")


def key_copies(df: DataFrame, name: str = "_key", chunk: int = 100_000) -> DataFrame:
    """Give every row of ``df`` a distinct key made of its content and a copy number.

    Equal rows are counted, not grouped row by row, and laid out again in chunks over the tasks.
    """
    content = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    body = F.struct(*df.columns)
    counted = df.groupBy(F.sha2(content, 256).alias("_hash")).agg(
        F.min_by(body, content).alias("_row"), F.count("*").alias("_n")
    )
    flat = counted.select("_row.*", "_hash", "_n")
    spans = flat.withColumn("_span", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))))
    spans = spans.repartition("_hash", "_span")
    begin = F.col("_span") * chunk
    copies = F.sequence(begin, F.least(begin + chunk, F.col("_n")) - 1)
    out = spans.withColumn("_copy", F.explode(copies)).drop("_n", "_span")
    key = F.concat(F.lit("r"), "_hash", F.lit("/"), F.col("_copy").cast("string"))
    return out.withColumn(name, key).drop("_hash", "_copy")


def max_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.agg(F.max(column).alias("max_id"))


def union_aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union with the left side's columns and types; columns that the right side lacks are null."""
    cols = [
        (F.col(f.name) if f.name in right.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name)
        for f in left.schema.fields
    ]
    return left.unionByName(right.select(*cols))


def column_or_null(df: DataFrame, name: str, dtype: T.DataType | str, alias: str | None = None) -> Column:
    c = F.col(alias or name) if name in df.columns else F.lit(None)
    return c.cast(dtype)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of ``spark.checkpoint.dir``, so that a lost executor does not recompute it.

    On a local master without that setting a temporary folder is used; on a cluster the setting is required.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="streetbook-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
