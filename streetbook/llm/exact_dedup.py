"""Exact duplicates by a tree of merged digest runs.

Each text becomes a digest of 32 bytes with its length and a second hash of other make; all three together are the key,
so a digest is believed only where the others agree. The rows start as runs, one row for each key of a run. In every round
``fan_in`` runs are partners, as in a binomial tree: run numbers that differ in one digit. Each keeps its part of the keys, by
one digit of the key's hash, and sends the others theirs; what a run has got stands sorted by digest, length, second hash
and identifier, and is merged: of equal digests, verified by length and second hash, the first row has the smallest
identifier, and the merged row keeps it with the largest one and the row count. After the last round each run holds all of one part of the
keys. Only DataFrame functions are used; a hot key is one row in each run, so a merge sees it ``fan_in`` times at most.

Null texts count as empty. A null identifier loses against any other; where a key has only such rows, ``keep_id`` is null
and these rows stay; their rows count in ``group_size``. Very long texts are digested whole, and only digests are shuffled. Rows that repeat both identifier and text share one decision. Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import join_counted, lower_ascii, sets_aside, stored, tasks


def digest_key(text: Column) -> Column:
    """A key that equal texts share: SHA-256, length in bytes and XXH64."""
    return F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n"), F.xxhash64(text).alias("x"))


def merge_runs(rows: DataFrame, runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """``(_key, first_id, last_id, group_size)`` of rows ``(_key, _id)``, merged in rounds.

    There are ``fan_in`` to the power of the rounds many runs: at least ``runs``, or as many as shuffle partitions.
    """
    places = tasks(rows.sparkSession)
    rounds = 0
    while fan_in**rounds < (runs or places):
        rounds += 1
    runs = fan_in**rounds

    def digit(number: Column, place: int) -> Column:
        return F.floor(number / fan_in**place) % fan_in

    run = F.pmod(F.xxhash64("_id", "_key.x"), F.lit(runs))
    level = rows.select(run.alias("_run"), "_key", "_id").groupBy("_run", "_key")
    level = level.agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"), F.count("*").alias("group_size"))
    part = F.pmod(F.xxhash64("_key.sha", F.lit(1)), F.lit(runs))
    key = [F.col(f"_key.{name}") for name in ("sha", "n", "x")]
    sorted_run = W.Window.partitionBy("_run", *key).orderBy(F.col("first_id").asc_nulls_last())
    equal = sorted_run.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    for k in range(rounds):
        moved = F.col("_run") + (digit(part, k) - digit(F.col("_run"), k)) * fan_in**k
        level = level.withColumn("_run", moved).repartition(places, "_run")
        level = level.select(
            "_run",
            "_key",
            "first_id",
            F.max("last_id").over(equal).alias("last_id"),
            F.sum("group_size").over(equal).alias("group_size"),
            F.row_number().over(sorted_run).alias("_place"),
        )
        level = level.filter("_place = 1").drop("_place")
    return level.select("_key", "first_id", "last_id", "group_size")


@sets_aside("_key", "_hot", "_hot_keep_id", "_hot_group_size")
def exact_groups(docs: DataFrame, text: Column, doc_id: str = "doc_id", keep: str = "last", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept``; ``keep`` says whether the first or last identifier stays.

    ``text`` is what is compared, in the form to compare (see ``normalised``). New columns replace old ones of their name.
    """
    keyed = docs.drop("keep_id", "group_size", "kept").withColumn("_key", digest_key(F.coalesce(text, F.lit(""))))
    groups = stored(merge_runs(keyed.select("_key", F.col(doc_id).alias("_id")), runs, fan_in))
    repeated = groups.filter("group_size > 1").select("_key", F.col(f"{keep}_id").alias("keep_id"), "group_size")
    out = join_counted(keyed, repeated, "_key", "group_size")
    # a key of one row needs no join: it keeps itself
    alone = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col(doc_id)).otherwise(F.col("keep_id")))
    out = out.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))
