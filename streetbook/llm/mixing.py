"""Mixing of sources to target weights along a curriculum that changes over the training time.

A source's weight is a function of the training time t in 0..1, linear between knots. Its integral is the source's share of
all words. A share may not exceed ``max_repeats`` times the source's words: what is above goes to the others by weight,
until none is above. The documents of a source, in an order fixed by a digest of their identifiers, follow one another as
often as the target needs them. The word that stands at offset c of the target T is needed when the source's integrated
weight has reached the part c / T, so the position of a copy is the inverse of that integral. Documents are then sorted by
position, which deals them to tasks by range. Only DataFrame functions are used.

Prefix sums over a source run in two levels, ``buckets`` of the digest first, so no task sees a whole source. Null texts
have size 0, null sources are a source of their own (last in order). Equal digests are ordered by identifier and size;
rows equal in all of these may swap their shares. Documents without words take nothing and stand at position 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import WORD, sets_aside

#: Columns that ``mix`` makes for itself; ``_start`` and ``_class`` stay, for ``position``.
OWN = ("_order", "_bucket", "_b", "_source", "_size", "_ahead", "_start", "_class", "_full", "_rest")

Knots = Sequence[tuple[float, float]]
#: Weight over time of the first, second and third source, repeating: the integrals are 5, 2 and 1.
SCHEDULES: tuple[Knots, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def inverse(knots: Knots, part: Column) -> Column:
    """The time at which the integral of the weight has reached ``part`` (0..1) of its whole."""
    whole, before, out = integral(knots), 0.0, None
    area = part * F.lit(whole)
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        slope, here = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        rest = F.greatest(area - F.lit(before), F.lit(0.0))
        # w0 x + slope x^2 / 2 = rest, solved in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.least(F.lit(t0) + F.when(root + F.lit(w0) > 0, 2 * rest / (root + F.lit(w0))).otherwise(0.0), F.lit(t1))
        out = time if out is None else F.when(area >= F.lit(before), time).otherwise(out)
        before += here
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """Targets of ``sizes`` (one row per source: ``source``, ``source_size``): adds ``_class`` and ``target``.

    A source is capped when its cap per unit of weight is below the level to which the others fill up. Sorted by that
    ratio the capped ones come first, so running sums give the level without a loop: of the levels that leave their own
    source below its cap the highest is right, as each source held capped without need lowers those after it.
    """
    weights = F.array(*[F.lit(float(integral(k))) for k in schedules])
    by_name = W.Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_class", (F.row_number().over(by_name) - 1) % len(schedules))
    ranked = ranked.withColumn("_weight", F.get(weights, "_class")).withColumn("_cap", F.col("source_size") * max_repeats)
    by_ratio = W.Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source")
    before, onward = by_ratio.rowsBetween(W.Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.Window.unboundedFollowing)
    everything = W.Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(onward)
    filled = ranked.withColumn("_level", level)
    free = F.col("_level") * F.col("_weight") <= F.col("_cap")
    filled = filled.withColumn("_level", F.max(F.when(free, F.col("_level"))).over(everything))
    target = F.least(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double"))
    return filled.select("source", "source_size", "_class", F.coalesce(target, F.lit(0.0)).alias("target"))


@sets_aside(*OWN)
def mix(
    docs: DataFrame,
    schedules: Sequence[Knots] = SCHEDULES,
    max_repeats: int = 3,
    whole: bool = False,
    buckets: int = 1024,
    doc_id: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies`` and ``position``.

    The last copy that a source needs is cut at the word where its target ends. With ``whole`` it is taken as a whole when
    at least half of it is wanted, and else not at all. New columns replace old ones of their name.
    """
    made = ("size", "source_size", "target", "taken", "copies", "position")
    order = F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit(""))
    rows = docs.drop(*made).withColumn("size", word_count(F.col("text"))).withColumn("_order", order)
    rows = rows.withColumn("_bucket", F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("_bucket", F.coalesce("_bucket", F.lit(0)))
    light = docs.select("source", doc_id, word_count(F.col("text")).alias("size"))
    light = light.withColumn("_order", order).withColumn(
        "_bucket", F.coalesce(F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"), F.lit(0))
    )
    parts = light.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    ahead = W.Window.partitionBy("source").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    sizes = parts.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, schedules, max_repeats)
    known = parts.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_size")
    known = known.withColumnRenamed("source", "_source").withColumnRenamed("_bucket", "_b")
    out = rows.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))).drop("_source", "_b")
    inside = W.Window.partitionBy("source", "_bucket").orderBy("_order", doc_id, "size")
    inside = inside.rowsBetween(W.Window.unboundedPreceding, -1)
    out = out.withColumn("_start", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("_full", full).withColumn("_rest", goal - F.col("_full") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    if whole:
        part = F.when((part > 0) & (part * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("_full") + part)
    out = out.withColumn("copies", (F.col("_full") + (part > 0).cast("long")).cast("int"))
    out = out.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("copies")))
    return out.withColumn("position", position(F.lit(0), schedules)).drop("_order", "_bucket", "_ahead", "_rest", "_full")


def position(copy: Column, schedules: Sequence[Knots] = SCHEDULES) -> Column:
    """Training time of a copy (0 for the first) of a row with ``_start``, ``source_size``, ``target`` and ``_class``."""
    part = F.least(F.lit(1.0), (F.col("_start") + copy * F.col("source_size")) / F.col("target"))
    out = F.lit(0.0)
    for n, knots in enumerate(schedules):
        out = F.when((F.col("_class") == n) & (F.col("target") > 0), inverse(knots, part)).otherwise(out)
    return out


@sets_aside(*OWN, "copy")
def curriculum(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, max_repeats: int = 3, doc_id: str = "doc_id", **mixing) -> DataFrame:
    """One row for each copy of a document that the mix takes (``copy`` from 0), sorted by training ``position``."""
    rows = mix(docs, schedules, max_repeats, doc_id=doc_id, **mixing).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("position", position(F.col("copy"), schedules))
    return rows.drop("_start", "_class").orderBy("position", "source", doc_id, "copy")
