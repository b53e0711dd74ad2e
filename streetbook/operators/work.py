"""What to crawl next: stale records, queues, quotas, the quality gate, progress and the run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetbook.dicts import sites as S
from streetbook.dicts.categories import CRAWL_GRID
from streetbook.operators.common import best_per_key
from streetbook.operators.merge import add_links

MAX_GRID = 1_000


def stale(df: DataFrame, as_of: Column, days: int = 7, n: int | None = 100) -> DataFrame:
    """Records never parsed or parsed more than ``days`` before ``as_of``, by id."""
    old = F.col("parsed_at").isNull() | (F.col("parsed_at") < as_of - F.make_interval(days=F.lit(days)))
    out = df.filter(old)
    return out.orderBy("id").limit(n) if n is not None else out


def _not_normalized() -> Column:
    return ~F.coalesce("is_normalized", F.lit(False))


def unnormalized(df: DataFrame, n: int | None = 1) -> DataFrame:
    """Queue of records that were not normalised, by id."""
    out = df.filter(_not_normalized())
    return out.orderBy("id").limit(n) if n is not None else out


def unnormalized_count(df: DataFrame) -> DataFrame:
    return df.filter(_not_normalized()).agg(F.count("*").alias("count"))


def mark_normalized(cur: DataFrame, done: DataFrame) -> DataFrame:
    """Write the description and website of ``done(id, description, website)`` and mark its rows as normalised."""
    new = done.select(
        "id", F.lit(True).alias("_done"), F.col("description").alias("_text"), F.col("website").alias("_site")
    )
    joined = cur.join(new, "id", "left")
    hit = F.col("_done").isNotNull()
    values = {
        "description": F.when(hit, F.col("_text")).otherwise(F.col("description")),
        "website": F.when(hit, F.col("_site")).otherwise(F.col("website")),
        "is_normalized": F.when(hit, True).otherwise(F.col("is_normalized")),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in cur.columns])


def add_phones(phones: DataFrame, done: DataFrame) -> DataFrame:
    """Add the phones found in descriptions: ``done(id, phones)``."""
    found = done.select(F.col("id").alias("company_id"), F.explode("phones").alias("phone"))
    return add_links(phones, found, ["company_id", "phone"])


def next_cities(
    cities: DataFrame, progress: DataFrame, n: int = 1, exclude: Sequence[str] = S.BIG_CITIES
) -> DataFrame:
    """Cities that are not excluded and not completed, by id."""
    done = progress.filter("status = 'completed'").select(F.col("city_id").alias("id"))
    open_ = cities.filter(~F.col("slug").isin(list(exclude))).join(done, "id", "left_anti")
    return open_.orderBy("id").limit(n)


def merge_progress(progress: DataFrame, run: DataFrame, as_of: Column, max_errors: int = 3) -> DataFrame:
    """Progress after a run: ``run(city_id, category, saved, error)``.

    Parsed categories are a set, totals add up, and a city with ``max_errors`` categories that failed is failed. A
    category with an error is not parsed. A city holds as many categories as the crawl grid has.
    """
    parsed = ~F.coalesce("error", F.lit(False))
    per_city = run.groupBy("city_id").agg(
        F.sort_array(F.collect_set(F.when(parsed, F.col("category")))).alias("_new"),
        F.sum(F.when(parsed, F.coalesce("saved", F.lit(0))).otherwise(0)).cast("bigint").alias("_saved"),
        F.sum(F.when(parsed, 0).otherwise(1)).alias("_errors"),
    )
    joined = progress.join(per_city, "city_id", "full_outer")
    empty = F.array().cast("array<string>")
    ran = F.col("_errors").isNotNull()
    old, new = F.coalesce("categories_parsed", empty), F.coalesce("_new", empty)
    status = F.when(F.col("_errors") >= max_errors, "failed").otherwise("completed")
    return joined.select(
        "city_id",
        F.array_union(old, new).alias("categories_parsed"),
        (F.coalesce("total", F.lit(0)) + F.coalesce("_saved", F.lit(0))).cast("bigint").alias("total"),
        F.when(ran, as_of).otherwise(F.col("last_attempt")).alias("last_attempt"),
        F.when(ran, status).otherwise(F.col("status")).alias("status"),
    )


def quota(weight: Column | str, tiers: Sequence[tuple[int | None, int]] = tuple(S.QUOTA_TIERS["list"])) -> Column:
    """Records per category for a city of this weight: the first tier that it reaches. No weight is weight 0."""
    w = F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0))
    out = F.lit(None).cast("int")
    for least, value in reversed(list(tiers)):
        out = F.lit(value) if least is None else F.when(w >= least, value).otherwise(out)
    return out.cast("int")


def fixed_quota(slug: Column | str, table: Mapping[str, int] = S.BIG_CITY_QUOTA) -> Column:
    """Records per category for the big cities, by slug; null for any other city."""
    c = F.col(slug) if isinstance(slug, str) else slug
    out = F.lit(None).cast("int")
    for city, value in table.items():
        out = F.when(c == city, F.lit(value)).otherwise(out)
    return out


def select_quality(
    cand: DataFrame,
    min_rating: float = S.MIN_RATING,
    min_reviews: int = S.MIN_REVIEWS,
    span: int = 1024,
) -> DataFrame:
    """Apply quota and quality gate to ``cand(city_id, category, pos, quota, rating, review_count[, failed])``.

    Of each city and category the first ``2 * quota`` candidates in list order are looked at and the first ``quota``
    that pass are saved. Adds ``outcome``: ``saved``, ``skipped``, ``failed`` or ``not_reached``. A candidate without a
    city or category has no list to stand in and is ``failed``; so is one without a quota, for its city is not known.
    A list has one quota, the largest of its rows. Candidates without a position come first.

    Ranks have two levels: lists are cut into parts of ``span`` positions, an aggregate counts each part's candidates and
    those that pass, and running sums over parts say how many come before. Parts beyond the quota are left out, and only rows
    of one part are sorted together, however long a list and however large its quota.
    """
    group = ["city_id", "category"]
    homeless = F.col("city_id").isNull() | F.col("category").isNull() | F.col("quota").isNull()
    lost = cand.filter(homeless).withColumn("outcome", F.lit("failed"))
    failed = F.coalesce("failed", F.lit(False)) if "failed" in cand.columns else F.lit(False)
    good = (F.coalesce("rating", F.lit(0)) >= min_rating) & (F.coalesce("review_count", F.lit(0)) >= min_reviews)
    rows = cand.filter(~homeless).withColumn("_good", (good & ~failed).cast("int"))
    rows = rows.withColumn("_part", F.coalesce(F.floor(F.col("pos") / span).cast("long"), F.lit(-(1 << 62))))

    parts = rows.groupBy(*group, "_part").agg(
        F.count("*").alias("_n"), F.sum("_good").alias("_passed"), F.max("quota").alias("_most")
    )
    listed = Window.partitionBy(*group)
    before = listed.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *group,
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        F.coalesce(F.sum("_passed").over(before), F.lit(0)).alias("_passed"),
        F.max("_most").over(listed).alias("_quota"),
    )
    parts = parts.filter(F.col("_skip") < 2 * F.col("_quota"))
    here = Window.partitionBy(*group, "_part").orderBy("pos")
    earlier = F.coalesce(F.sum("_good").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(parts, [*group, "_part"]).select(
        *cand.columns,
        "_good",
        "_quota",
        (F.col("_skip") + F.row_number().over(here)).alias("_rank"),
        (F.col("_passed") + earlier).alias("_saved"),
    )
    outcome = (
        F.when(F.col("_saved") >= F.col("_quota"), "not_reached")
        .when(F.col("_good") == 1, "saved")
        .when(failed, "failed")
        .otherwise("skipped")
    )
    looked = ranked.filter(F.col("_rank") <= 2 * F.col("_quota"))
    return looked.select(*cand.columns, outcome.alias("outcome")).unionByName(lost)


def work_grid(
    cities: DataFrame,
    progress: DataFrame,
    grid: Sequence[tuple[str, str]] = tuple(CRAWL_GRID),
    least_weight: int = 0,
) -> DataFrame:
    """Cities with a weight above ``least_weight`` times the crawl grid, without what is done.

    The grid is a short fixed list, so each city row is spread over it in place. ``priority`` numbers are left to the
    reader's sort: ``orderBy(weight desc, city_id, pos)``.
    """
    if len(grid) > MAX_GRID:
        raise ValueError(f"a crawl grid may hold up to {MAX_GRID} categories")
    steps = F.array(*[F.struct(F.lit(s).alias("source_slug"), F.lit(o).alias("slug")) for s, o in grid])
    rows = cities.filter(F.col("weight") > least_weight).select(
        F.col("id").alias("city_id"), F.col("slug").alias("city"), "weight", F.posexplode(steps).alias("pos", "_g")
    )
    rows = rows.select("city_id", "city", "weight", "pos", "_g.source_slug", F.col("_g.slug").alias("slug"))
    done = progress.select("city_id", F.explode("categories_parsed").alias("slug")).distinct()
    return rows.join(done, ["city_id", "slug"], "left_anti")


def open_run(log: DataFrame, run: DataFrame) -> DataFrame:
    """Add started runs to the log."""
    return log.unionByName(run.withColumn("status", F.lit("started")), allowMissingColumns=True)


def close_runs(log: DataFrame, results: DataFrame) -> DataFrame:
    """Close the latest open row of each task: ``results(task_type, status, items, completed_at)``.

    The latest row per task is an aggregate, so a task with many rows sends one per map task.
    """
    started = log.filter("status = 'started'").select("task_type", "id", "started_at")
    latest = best_per_key(started, ["task_type"], F.struct("started_at", "id"), newest=True)
    result = best_per_key(
        results.select("task_type", "status", "items", "completed_at"), ["task_type"], F.col("completed_at"), newest=True
    )
    closing = latest.join(result, "task_type").select(
        "id",
        F.lit(True).alias("_close"),
        F.col("status").alias("_status"),
        F.col("items").alias("_items"),
        F.col("completed_at").alias("_at"),
    )
    joined = log.join(closing, "id", "left")
    hit = F.col("_close").isNotNull()
    at = F.col("completed_at") if "completed_at" in log.columns else F.lit(None).cast(dict(results.dtypes)["completed_at"])
    values = {
        "status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
        "items": F.when(hit, F.col("_items")).otherwise(F.col("items")),
        "completed_at": F.when(hit, F.col("_at")).otherwise(at),
    }
    names = [*log.columns, *(["completed_at"] if "completed_at" not in log.columns else [])]
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in names])
