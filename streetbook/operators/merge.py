"""Merges: a snapshot and incoming rows in, a new snapshot out. Nothing is updated in place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetbook.dicts import sites as S
from streetbook.functions.contacts import extract_website
from streetbook.functions.expr import blank_to_null
from streetbook.functions.text import FOOTERS, Cut, format_smart, remove_footers
from streetbook.operators.common import (
    allocate_ids,
    best_per_key,
    column_or_null,
    cut_lineage,
    join_known,
    key_copies,
    max_id,
    small_table,
    spread_key,
    union_aligned,
)

UPSERT_FIELDS = (
    "name", "description", "address", "city_id", "phone", "email", "website", "rating", "review_count", "url",
    "latitude", "longitude", "working_hours", "metro_station", "metro_distance", "features", "feature_groups",
    "menu", "social_links", "images", "raw_data", "source_category",
)
NAME_UPSERT_FIELDS = ("address", "phone", "website", "description", "rating")

#: Stores a frame that several others read.
Settle = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Upsert:
    """Result of an upsert: the new snapshot, ``incoming key -> id`` and the rows that met two companies.

    ``matched`` holds every incoming row with the ``id`` of its company, also those that another row overruled.
    """

    snapshot: DataFrame
    assigned: DataFrame
    conflicts: DataFrame
    matched: DataFrame | None = None


def _row_order(inc: DataFrame, order: Column | None) -> Column:
    """The caller's order, else one that is arbitrary but the same on every run."""
    if order is not None:
        return order
    plain = [f.name for f in inc.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*plain)


def upsert_companies(
    cur: DataFrame,
    inc: DataFrame,
    as_of: Column,
    mode: str = "overwrite",
    order: Column | None = None,
    settle: Settle = cut_lineage,
) -> Upsert:
    """Upsert by external id, then by URL.

    An incoming row belongs to the company with its external id, else to the one with its URL (the lowest id if there
    are several); null keys match nothing. When several rows meet one company the last in ``order`` wins. ``overwrite``
    writes every field, null included; ``fill_empty`` writes only where the company has none. New companies are known
    by external id; a new row without one joins the new company that carries its URL, else its URL names it, and a row
    without both is a company of its own.

    Two equi joins replace the one ``OR`` join, which would compare every pair of rows. Their result is stored once, and so
    are the new companies with their ids: snapshot, matches, conflicts and outcomes all read these two. ``settle`` stores
    them. The incoming rows are read once; of the companies, keys twice, ids once and whole rows once.
    """
    if mode not in ("overwrite", "fill_empty"):
        raise ValueError(mode)
    columns = [c for c in inc.columns if c != "id"]
    inc = inc.withColumn("_order", _row_order(inc, order))
    by_ext = cur.groupBy("external_id").agg(F.min("id").alias("_by_ext"))
    by_url = cur.groupBy("url").agg(F.min("id").alias("_by_url"))
    met = join_known(inc, by_ext, ["external_id"])
    met = settle(join_known(met, by_url, ["url"]).withColumn("_target", F.coalesce("_by_ext", "_by_url")))
    conflicts = met.filter(F.col("_by_ext") != F.col("_by_url")).select(
        "external_id", "url", F.col("_by_ext").alias("id_by_external_id"), F.col("_by_url").alias("id_by_url")
    )

    hits = best_per_key(met.filter("_target is not null"), ["_target"], F.col("_order"), newest=True)
    fresh = met.filter("_target is null").drop("_by_ext", "_by_url", "_target")
    owner = fresh.filter("external_id is not null").groupBy("url").agg(F.min("external_id").alias("_owner"))
    fresh = join_known(fresh, owner, ["url"])
    own_key = (
        F.when(F.col("external_id").isNotNull(), F.concat(F.lit("x"), "external_id"))
        .when(F.col("_owner").isNotNull(), F.concat(F.lit("x"), "_owner"))
        .when(F.col("url").isNotNull(), F.concat(F.lit("u"), "url"))
    )
    given = fresh.withColumn("_key", own_key)
    fresh = given.withColumn("external_id", F.coalesce("external_id", "_owner"))
    fresh = fresh.drop("_owner")
    keyed = best_per_key(fresh.filter("_key is not null"), ["_key"], F.col("_order"), newest=True)
    loose = key_copies(fresh.filter("_key is null").drop("_key")).select(*keyed.columns)
    rows = keyed.unionByName(loose).withColumn("_of", F.col("_key"))
    created = settle(allocate_ids(rows, max_id(cur), F.col("_key")))
    matched = met.filter("_target is not null").select(*columns, F.col("_target").alias("id"))
    numbers = created.select(F.col("_of").alias("_key"), "id")
    matched = matched.unionByName(given.filter("_key is not null").join(numbers, "_key").select(*columns, "id"))
    matched = matched.unionByName(created.filter("_of like 'r%'").select(*columns, "id"))

    incoming = hits.select(F.col("_target").alias("id"), F.struct(*inc.columns).alias("_in"))
    joined = cur.join(incoming, "id", "left")
    hit = F.col("_in").isNotNull()
    out: list[Column] = []
    for field in cur.schema.fields:
        new = _incoming_value(field.name, inc).cast(field.dataType.simpleString())  # by name: elements may be null
        old = F.col(field.name)
        if field.name == "parsed_at":
            out.append(F.when(hit, as_of.cast(field.dataType.simpleString())).otherwise(old).alias(field.name))
        elif field.name not in UPSERT_FIELDS:
            out.append(old)
        elif mode == "overwrite":
            out.append(F.when(hit, new).otherwise(old).alias(field.name))
        else:
            kept = blank_to_null(old) if field.dataType.typeName() == "string" else old
            out.append(F.when(hit, F.coalesce(kept, new)).otherwise(old).alias(field.name))
    inserts = created.withColumn("parsed_at", as_of)
    if "review_count" in inserts.columns:
        inserts = inserts.withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    snapshot = union_aligned(joined.select(*out), inserts)
    assigned = hits.select("external_id", "url", F.col("_target").alias("id"), F.lit("updated").alias("action"))
    assigned = assigned.unionByName(created.select("external_id", "url", "id", F.lit("inserted").alias("action")))
    return Upsert(snapshot, assigned, conflicts, matched)


def _incoming_value(name: str, inc: DataFrame) -> Column:
    value = F.col(f"_in.{name}") if name in inc.columns else F.lit(None)
    return F.coalesce(value, F.lit(0)) if name == "review_count" else value


def upsert_by_name(
    cur: DataFrame,
    inc: DataFrame,
    as_of: Column,
    source: str = S.SUBDOMAIN_HOST,
    order: Column | None = None,
    settle: Settle = cut_lineage,
) -> Upsert:
    """Upsert by name and city: five fields of a known company are written, others are inserted with their source.

    Matches and new companies are stored once each (``settle``). Incoming rows without name or city match nothing.
    """
    keys = ["name", "city_id"]
    inc = inc.withColumn("_order", _row_order(inc, order))
    known = cur.groupBy(*keys).agg(F.min("id").alias("_target"))
    met = settle(join_known(inc, known, keys))
    hits = best_per_key(met.filter("_target is not null"), ["_target"], F.col("_order"), newest=True)
    fresh = met.filter("_target is null").drop("_target")
    null_key = F.col("name").isNull() | F.col("city_id").isNull()
    keyed = best_per_key(fresh.filter(~null_key), keys, F.col("_order"), newest=True).withColumn(
        "_key", F.concat(F.lit("k"), "city_id", F.lit("/"), "name")
    )
    loose = key_copies(fresh.filter(null_key))
    created = settle(allocate_ids(keyed.unionByName(loose), max_id(cur), F.col("_key")))

    fields = [f for f in NAME_UPSERT_FIELDS if f in cur.columns]
    types = dict(cur.dtypes)
    incoming = hits.select(
        F.col("_target").alias("id"),
        F.lit(True).alias("_hit"),
        *[column_or_null(hits, f, types[f]).alias(f"_{f}") for f in fields],
    )
    joined = cur.join(incoming, "id", "left")
    hit = F.col("_hit").isNotNull()
    out = []
    for name in cur.columns:
        if name in fields:
            out.append(F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            out.append(F.when(hit, as_of).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    stamped = created.withColumn("source", F.lit(source))
    for name in ("created_at", "updated_at"):
        stamped = stamped.withColumn(name, as_of)
    if "link" in stamped.columns:
        stamped = stamped.withColumn("source_url", F.col("link"))
    snapshot = union_aligned(joined.select(*out), stamped)
    assigned = hits.select("name", "city_id", F.col("_target").alias("id"), F.lit("updated").alias("action"))
    assigned = assigned.unionByName(created.select("name", "city_id", "id", F.lit("inserted").alias("action")))
    return Upsert(snapshot, assigned, hits.limit(0).select("name", "city_id"))


def insert_absent(
    cur: DataFrame, inc: DataFrame, source: str, order: Column | None = None, settle: Settle = cut_lineage
) -> Upsert:
    """Insert companies whose name and city are not known; the first of equal incoming rows is taken.

    The unknown rows and the new companies are stored once each (``settle``).
    """
    keys = ["name", "city_id"]
    inc = inc.withColumn("_order", _row_order(inc, order))
    fresh = settle(join_known(inc, cur.select(*keys).distinct(), keys, "left_anti"))
    null_key = F.col("name").isNull() | F.col("city_id").isNull()
    keyed = best_per_key(fresh.filter(~null_key), keys, F.col("_order")).withColumn(
        "_key", F.concat(F.lit("k"), "city_id", F.lit("/"), "name")
    )
    loose = key_copies(fresh.filter(null_key))
    created = settle(allocate_ids(keyed.unionByName(loose), max_id(cur), F.col("_key")))
    snapshot = union_aligned(cur, created.withColumn("source", F.lit(source)))
    assigned = created.select("name", "city_id", "id", F.lit("inserted").alias("action"))
    return Upsert(snapshot, assigned, created.limit(0).select("name", "city_id"))


def new_candidates(cand: DataFrame, cur: DataFrame) -> DataFrame:
    """Candidates not yet known by external id and city."""
    keys = ["external_id", "city_id"]
    return join_known(cand, cur.select(*keys).distinct(), keys, "left_anti")


def insert_reviews(cur: DataFrame, inc: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """New review snapshot and the inserted rows. A review is known by company, author and text."""
    keys = ["company_id", "author_name", "text"]
    named = inc.withColumn("author_name", F.coalesce("author_name", F.lit("Anonymous"))).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    named = named.withColumn("_order", _row_order(named, order))
    first = best_per_key(named.drop("id"), keys, F.col("_order")).drop("_order")
    fresh = join_known(first, cur.select(*keys).distinct(), keys, "left_anti")
    # a review without a company is one of its own content, like any other key
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    inserted = allocate_ids(fresh, max_id(cur), spread_key(parts, F.lit("")))
    return union_aligned(cur, inserted), inserted


def get_or_create(dim: DataFrame, inc: DataFrame, key: str = "slug", order: Column | None = None) -> DataFrame:
    """Dimension rows by key: known ones stay, each new key gets one row and an id."""
    inc = inc.filter(F.col(key).isNotNull())
    inc = inc.withColumn("_order", _row_order(inc, order))
    fresh = best_per_key(inc, [key], F.col("_order")).drop("_order").join(dim.select(key), key, "left_anti")
    return union_aligned(dim, allocate_ids(fresh, max_id(dim), F.col(key)))


def add_links(links: DataFrame, inc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert links, ignoring those already there."""
    return links.select(*keys).unionByName(inc.select(*keys)).distinct()


def merge_cities(cur: DataFrame, inc: DataFrame, mode: str) -> DataFrame:
    """Enrich cities by name.

    ``set_url`` writes the URL of known cities and inserts the others; ``fill_url`` writes it only where it is blank;
    ``fix_slug`` writes the slug. Only ``set_url`` inserts.
    """
    field = "slug" if mode == "fix_slug" else "url"
    value = F.col(field)
    new = inc.groupBy("name").agg(F.max(field).alias("_new"))
    joined = join_known(cur, new, ["name"])
    if mode == "fill_url":
        merged = F.coalesce(blank_to_null(value), "_new", value)
    elif mode in ("set_url", "fix_slug"):
        merged = F.coalesce("_new", value)
    else:
        raise ValueError(mode)
    out = joined.withColumn(field, merged).select(*cur.columns)
    if mode != "set_url":
        return out
    fresh = best_per_key(inc, ["name"], _row_order(inc, None)).join(cur.select("name"), "name", "left_anti")
    return union_aligned(out, allocate_ids(fresh, max_id(cur), F.col("name")))


def add_city_hosts(
    cities: DataFrame, hosts: Sequence[tuple[str, str]] = tuple(S.CITY_HOSTS), host: str = S.SUBDOMAIN_HOST
) -> DataFrame:
    """Write the second source's URL of each of its cities, and insert the cities that are not known by name."""
    rows = [(slug, name, f"https://{slug}.{host}") for slug, name in hosts]
    return merge_cities(cities, small_table(cities.sparkSession, rows, "slug string, name string, url string"), "set_url")


def fix_city_slugs(cities: DataFrame, fixes: Sequence[tuple[str, str]] = S.CITY_SLUG_FIXES) -> DataFrame:
    return merge_cities(cities, small_table(cities.sparkSession, fixes, "name string, slug string"), "fix_slug")


def refresh_hours(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Take fresh hours when there are any and they differ."""
    new = fresh.select("id", F.col("working_hours").alias("_fresh"))
    take = (F.size("_fresh") > 0) & ~F.col("_fresh").eqNullSafe(F.col("working_hours"))
    joined = old.join(new, "id", "left")
    changed = F.coalesce(take, F.lit(False))
    return (
        joined.withColumn("hours_changed", changed)
        .withColumn("working_hours", F.when(F.col("hours_changed"), F.col("_fresh")).otherwise(F.col("working_hours")))
        .drop("_fresh")
    )


def patch_companies(
    cur: DataFrame,
    fresh: DataFrame,
    footers: Sequence[Cut] = FOOTERS,
    own_hosts: Sequence[str] = S.OWN_HOSTS,
) -> DataFrame:
    """Fill empty phone, address and website from a fresh page, refresh the description, and list what changed.

    The website found in the description gives way to the one of the page. A company without a fresh page and without
    a description keeps its row.
    """
    fields = ("phone", "address", "website", "description")
    types = dict(cur.dtypes)
    new = fresh.select("id", *[column_or_null(fresh, f, types[f]).alias(f"_{f}") for f in fields])
    joined = cur.join(new, "id", "left")
    text = F.coalesce("_description", "description")
    has_text = F.coalesce(text, F.lit("")) != ""
    found = joined.withColumn("_found", extract_website(text, strict=True, own_hosts=own_hosts))
    cut = remove_footers(F.col("_found.text"), footers)
    found = found.withColumn("_text", F.when(has_text, format_smart(cut)))

    def empty(name: str) -> Column:
        return blank_to_null(F.col(name)).isNull()

    def given(value: Column) -> Column:
        return blank_to_null(value)

    site = F.when(has_text, F.coalesce(given(F.col("_website")), F.col("_found.website")))
    patches = {
        "website": F.when(empty("website"), site),
        "description": F.when(has_text & ~F.col("_text").eqNullSafe(F.col("description")), F.col("_text")),
        "phone": F.when(empty("phone"), given(F.col("_phone"))),
        "address": F.when(empty("address"), given(F.col("_address"))),
    }
    patched = found.select(*cur.columns, *[c.alias(f"_p_{n}") for n, c in patches.items()])
    changed = F.array_compact(F.array(*[F.when(F.col(f"_p_{n}").isNotNull(), F.lit(n)) for n in patches]))
    out = [F.coalesce(f"_p_{n}", n).alias(n) if n in patches else F.col(n) for n in cur.columns]
    return patched.select(*out, changed.alias("changed"))


def verify_updates(expected: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per expected row, the fields whose stored value is not the expected one. A null expectation is not checked."""
    got = stored.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    bad = [
        F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields
    ]
    return expected.join(got, "id", "left").select("id", F.array_compact(F.array(*bad)).alias("mismatched"))


def refresh_descriptions(cur: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshot and outcome counts. ``fresh(id, description)`` has a row for every page that could be read."""
    new = fresh.select("id", F.lit(True).alias("_read"), F.col("description").alias("_new"))
    joined = cur.join(new, "id", "left")
    outcome = (
        F.when(F.col("_read").isNull(), "error")
        .when(F.coalesce("_new", F.lit("")) == "", "empty")
        .when(F.coalesce("description", F.lit("")) != F.col("_new"), "updated")
        .otherwise("unchanged")
    )
    marked = joined.withColumn("_outcome", outcome)
    text = F.when(F.col("_outcome") == "updated", F.col("_new")).otherwise(F.col("description"))
    snapshot = marked.withColumn("description", text).select(*cur.columns)
    counts = marked.groupBy(F.col("_outcome").alias("outcome")).agg(F.count("*").alias("n"))
    return snapshot, counts


def drop_duplicates_min_id(df: DataFrame) -> DataFrame:
    """Keep the lowest id of each name and city; rows with a null name or city are never duplicates.

    The key carries the id of such rows, so they form groups of one and spread over the tasks.
    """
    loner = F.when(F.col("name").isNull() | F.col("city_id").isNull(), F.col("id"))
    keyed = df.withColumn("_loner", loner)
    return best_per_key(keyed, ["name", "city_id", "_loner"], F.col("id")).drop("_loner").select(*df.columns)


def drop_uncategorised(df: DataFrame, links: DataFrame) -> DataFrame:
    return df.join(links.select(F.col("company_id").alias("id")), "id", "left_semi")


def touch(cur: DataFrame, new: DataFrame, cols: Sequence[str], as_of: Column) -> DataFrame:
    """Set ``updated_at`` of the rows of ``new`` that differ from ``cur`` in any of ``cols``."""
    old = cur.select("id", F.lit(True).alias("_known"), F.struct(*cols).alias("_old"), F.col("updated_at").alias("_at"))
    joined = new.drop("updated_at").join(old, "id", "left")
    same = F.col("_known").isNotNull() & F.struct(*cols).eqNullSafe(F.col("_old"))
    return joined.withColumn("updated_at", F.when(same, F.col("_at")).otherwise(as_of)).drop("_known", "_old", "_at")


def delete_cascade(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete companies with everything that hangs on them. ``ids`` has one column ``id``."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    out["companies"] = tables["companies"].join(gone, "id", "left_anti")
    child = gone.select(F.col("id").alias("company_id"))
    for name in ("company_categories", "reviews", "company_phones", "company_tags", "favorites"):
        if name in tables:
            out[name] = tables[name].join(child, "company_id", "left_anti")
    return out


def delete_city(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete cities; their companies stay, without a city."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    out["cities"] = tables["cities"].join(gone, "id", "left_anti")
    companies = tables["companies"]
    lost = gone.select(F.col("id").alias("city_id"), F.lit(True).alias("_lost"))
    joined = join_known(companies, lost, ["city_id"])
    city = F.when(F.col("_lost").isNull(), F.col("city_id")).alias("city_id")
    out["companies"] = joined.select(*[city if c == "city_id" else F.col(c) for c in companies.columns])
    return out
