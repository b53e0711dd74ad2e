"""Work selection queries H1 to H8."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries import register
from streetbook.dicts.sites import QUOTA_TIERS
from streetbook.operators import work as H


@register(
    "h01_stale",
    """SELECT id, CAST(parsed_at AS STRING) AS parsed_at FROM companies
       WHERE parsed_at IS NULL OR parsed_at < DATE '2001-08-01' - INTERVAL 7 DAY ORDER BY id LIMIT 500""",
)
def h01(fx):
    rows = H.stale(fx.companies, F.lit("2001-08-01").cast("date"), n=500)
    return rows.select("id", F.col("parsed_at").cast("string").alias("parsed_at"))


FLAGS = "SELECT id, name, description, website, CASE WHEN id % 7 = 0 THEN NULL ELSE is_normalized END AS is_normalized FROM companies"


@register(
    "h02_unnormalized",
    f"SELECT id, is_normalized FROM ({FLAGS}) q WHERE NOT coalesce(is_normalized, FALSE) ORDER BY id LIMIT 200",
)
def h02(fx):
    return H.unnormalized(fx.sql(f"SELECT * FROM ({FLAGS}) f"), 200).select("id", "is_normalized")


@register("h02_unnormalized_count", f"SELECT COUNT(*) AS count FROM ({FLAGS}) q WHERE NOT coalesce(is_normalized, FALSE)")
def h02_count(fx):
    return H.unnormalized_count(fx.sql(f"SELECT * FROM ({FLAGS}) f"))


@register(
    "h02_mark_normalized",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN concat('clean ', name) ELSE description END AS description,
               CASE WHEN id % 4 = 0 THEN NULL ELSE website END AS website,
               CASE WHEN id % 4 = 0 THEN TRUE ELSE is_normalized END AS is_normalized FROM ({FLAGS}) q""",
)
def h02_mark(fx):
    cur = fx.sql(f"SELECT * FROM ({FLAGS}) f")
    done = cur.filter("id % 4 = 0").select(
        "id", F.concat(F.lit("clean "), "name").alias("description"), F.lit(None).cast("string").alias("website")
    )
    return H.mark_normalized(cur, done).select("id", "description", "website", "is_normalized")


@register(
    "h02_add_phones",
    """SELECT id AS company_id, phone FROM companies WHERE phone IS NOT NULL
       UNION SELECT id, '+79120000000' FROM companies WHERE id % 3 = 0
       UNION SELECT id, phone FROM companies WHERE id % 3 = 0 AND phone IS NOT NULL""",
)
def h02_phones(fx):
    phones = fx.companies.filter("phone is not null").select(F.col("id").alias("company_id"), "phone")
    found = F.array_compact(F.array(F.lit("+79120000000"), F.col("phone"), F.lit("+79120000000")))
    done = fx.companies.filter("id % 3 = 0").select("id", found.alias("phones"))
    return H.add_phones(phones, done)


@register(
    "h03_next_cities",
    """SELECT c.id, c.slug FROM cities c WHERE c.slug NOT IN ('nation-16', 'nation-17')
         AND NOT EXISTS (SELECT 1 FROM progress p WHERE p.city_id = c.id AND p.status = 'completed')
       ORDER BY c.id LIMIT 8""",
)
def h03(fx):
    return H.next_cities(fx.cities, fx.progress, 8, ("nation-16", "nation-17")).select("id", "slug")


RUN = """SELECT user_id % 30 AS city_id, event_type AS category, CAST(SUM(floor(value)) AS BIGINT) AS saved,
                MIN(event_id) % 3 = 0 AS error
         FROM events GROUP BY user_id % 30, event_type"""
PARSED = """SELECT p.city_id, p.total, p.last_attempt, p.status, CASE WHEN p.city_id % 2 = 0 THEN 'view' ELSE 'old' END AS one
            FROM progress p"""


def _progress(fx):
    rows = fx.sql(f"SELECT * FROM ({PARSED}) q")
    return rows.withColumn("categories_parsed", F.array("one")).drop("one")


@register(
    "h04_merge_progress",
    f"""WITH run AS ({RUN}), p AS ({PARSED}),
             r AS (SELECT city_id, SUM(CASE WHEN error THEN 0 ELSE saved END) AS saved,
                          SUM(CASE WHEN error THEN 1 ELSE 0 END) AS errors FROM run GROUP BY city_id),
             cats AS (SELECT city_id, string_agg(category, '|' ORDER BY category) AS cats
                      FROM (SELECT city_id, category FROM run WHERE NOT error UNION SELECT city_id, one FROM p) q
                      GROUP BY city_id)
        SELECT coalesce(p.city_id, r.city_id) AS city_id, coalesce(c.cats, '') AS cats,
               CAST(coalesce(p.total, 0) + coalesce(r.saved, 0) AS BIGINT) AS total,
               CASE WHEN r.city_id IS NULL THEN p.status WHEN r.errors >= 3 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN r.city_id IS NOT NULL THEN '2024-02-01 00:00:00' ELSE CAST(p.last_attempt AS STRING) END
                   AS last_attempt
        FROM p FULL OUTER JOIN r ON r.city_id = p.city_id
               LEFT JOIN cats c ON c.city_id = coalesce(p.city_id, r.city_id)""",
)
def h04(fx):
    run = fx.sql(f"SELECT * FROM ({RUN}) r")
    done = H.merge_progress(_progress(fx), run, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return done.select(
        "city_id",
        F.array_join(F.sort_array("categories_parsed"), "|").alias("cats"),
        "total",
        "status",
        F.col("last_attempt").cast("string").alias("last_attempt"),
    )


def _tiers(tiers, expr="coalesce(weight, 0)") -> str:
    whens = " ".join(f"WHEN {expr} >= {least} THEN {n}" for least, n in tiers if least is not None)
    return f"CASE {whens} ELSE {tiers[-1][1]} END"


@register(
    "h05_quota",
    f"""SELECT c.id, {_tiers(QUOTA_TIERS['list'])} AS by_list, {_tiers(QUOTA_TIERS['per_category'])} AS by_category
        FROM (SELECT co.id, CASE WHEN co.id % 9 = 0 THEN NULL ELSE ci.weight END AS weight
              FROM companies co JOIN cities ci ON ci.id = co.city_id) c""",
)
def h05(fx):
    weights = fx.cities.select(F.col("id").alias("city_id"), "weight")
    rows = fx.companies.join(weights, "city_id").withColumn("weight", F.when(F.col("id") % 9 != 0, F.col("weight")))
    return rows.select(
        "id", H.quota("weight").alias("by_list"), H.quota("weight", QUOTA_TIERS["per_category"]).alias("by_category")
    )


BIG = "SELECT id, CASE id % 3 WHEN 0 THEN 'moscow' WHEN 1 THEN 'spb' ELSE slug END AS slug FROM cities"


@register(
    "h05_quota_fixed",
    f"SELECT id, CASE slug WHEN 'moscow' THEN 30 WHEN 'spb' THEN 20 END AS quota FROM ({BIG}) q",
)
def h05_fixed(fx):
    return fx.sql(f"SELECT * FROM ({BIG}) b").select("id", H.fixed_quota("slug").alias("quota"))


CANDIDATES = """SELECT c.id AS pos, c.city_id, c.source AS category, c.rating + 1.2 AS rating, c.review_count,
                       1 + ci.weight // 150000 AS quota, c.id % 19 = 0 AS failed
                FROM companies c JOIN cities ci ON ci.id = c.city_id"""


@register(
    "h06_select_quality",
    f"""WITH cand AS ({CANDIDATES}),
             r AS (SELECT *, row_number() OVER (PARTITION BY city_id, category ORDER BY pos) AS rn FROM cand),
             g AS (SELECT *, coalesce(rating, 0) >= 4.0 AND coalesce(review_count, 0) >= 5 AND NOT failed AS good FROM r
                   WHERE rn <= 2 * quota),
             s AS (SELECT *, coalesce(SUM(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY city_id, category
                       ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
        SELECT pos, city_id, category, CASE WHEN before >= quota THEN 'not_reached' WHEN good THEN 'saved'
               WHEN failed THEN 'failed' ELSE 'skipped' END AS outcome FROM s""",
)
def h06(fx):
    cand = fx.sql(f"SELECT * FROM ({CANDIDATES.replace('//', 'DIV')}) c")
    return H.select_quality(cand).select("pos", "city_id", "category", "outcome")


HIGH_QUOTA = CANDIDATES.replace("1 + ci.weight // 150000", "200 + ci.id")


@register(
    "h06_quota_unbounded",
    f"""WITH cand AS ({HIGH_QUOTA}),
             r AS (SELECT *, row_number() OVER (PARTITION BY city_id, category ORDER BY pos) AS rn FROM cand)
        SELECT pos, CASE WHEN coalesce(rating, 0) >= 4.0 AND coalesce(review_count, 0) >= 5 AND NOT failed THEN 'saved'
                         WHEN failed THEN 'failed' ELSE 'skipped' END AS outcome FROM r WHERE rn <= 2 * quota""",
)
def h06_unbounded(fx):
    """Quotas that no list reaches: every good candidate is saved."""
    return H.select_quality(fx.sql(f"SELECT * FROM ({HIGH_QUOTA}) c")).select("pos", "outcome")


GRID = [("v", "view"), ("c", "click"), ("p", "purchase"), ("s", "signup"), ("e", "error"), ("o", "other")]
# Two thirds of the cities have seen views alone.
DONE = """SELECT DISTINCT user_id % 25 AS city_id, CASE WHEN user_id % 25 % 3 = 0 THEN event_type ELSE 'view' END AS slug
          FROM events"""


@register(
    "h07_work_grid",
    f"""WITH grid AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{o}', {i})" for i, (s, o) in enumerate(GRID))})
                      g(source_slug, slug, pos)),
             done AS ({DONE})
        SELECT c.id AS city_id, c.slug AS city, g.source_slug, g.slug, g.pos FROM cities c, grid g
        WHERE c.weight > 0 AND NOT EXISTS (SELECT 1 FROM done d WHERE d.city_id = c.id AND d.slug = g.slug)""",
)
def h07(fx):
    done = fx.sql(f"SELECT * FROM ({DONE}) d").groupBy("city_id").agg(F.collect_set("slug").alias("categories_parsed"))
    return H.work_grid(fx.cities, done, GRID).select("city_id", "city", "source_slug", "slug", "pos")


UNFINISHED = """SELECT event_type AS task_type, 'stopped' AS status, CAST(COUNT(*) AS INT) AS items,
                       CAST(NULL AS TIMESTAMP) AS completed_at FROM events GROUP BY event_type"""


@register(
    "h08_close_unfinished",
    f"""WITH res AS ({UNFINISHED}),
             o AS (SELECT id, row_number() OVER (PARTITION BY task_type ORDER BY started_at DESC, id DESC) AS rn
                   FROM run_log WHERE status = 'started')
        SELECT l.id, l.task_type, coalesce(res.status, l.status) AS status, coalesce(res.items, l.items) AS items
        FROM run_log l LEFT JOIN o ON o.id = l.id AND o.rn = 1 LEFT JOIN res ON res.task_type = l.task_type AND o.id IS NOT NULL""",
)
def h08_unfinished(fx):
    """Results without an end still close the run they belong to."""
    return H.close_runs(fx.run_log, fx.sql(f"SELECT * FROM ({UNFINISHED}) r")).select("id", "task_type", "status", "items")


RESULTS = """SELECT event_type AS task_type, 'done' AS status, CAST(COUNT(*) AS INT) AS items,
                    MAX(ts) AS completed_at FROM events WHERE event_type <> 'error' GROUP BY event_type"""


@register(
    "h08_close_runs",
    f"""WITH res AS ({RESULTS}),
             last_open AS (SELECT id, task_type FROM (SELECT *, row_number() OVER (PARTITION BY task_type
                               ORDER BY started_at DESC, id DESC) AS rn FROM run_log WHERE status = 'started') q
                           WHERE rn = 1)
        SELECT l.id, coalesce(r.status, l.status) AS status, coalesce(r.items, l.items) AS items,
               CAST(r.completed_at AS STRING) AS completed_at
        FROM run_log l LEFT JOIN last_open o ON o.id = l.id LEFT JOIN res r ON r.task_type = o.task_type""",
)
def h08(fx):
    done = H.close_runs(fx.run_log, fx.sql(f"SELECT * FROM ({RESULTS}) r"))
    return done.select("id", "status", "items", F.col("completed_at").cast("string").alias("completed_at"))


@register(
    "h08_open_run",
    """SELECT id, task_type, status FROM run_log
       UNION ALL SELECT id + 1000000, concat(event_type, ' again'), 'started' FROM
       (SELECT event_id AS id, event_type FROM events) e""",
)
def h08_open(fx):
    new = fx.events.select((F.col("event_id") + 1_000_000).alias("id"), F.concat("event_type", F.lit(" again")).alias("task_type"))
    return H.open_run(fx.run_log, new).select("id", "task_type", "status")
