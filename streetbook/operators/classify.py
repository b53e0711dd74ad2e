"""Moderation, category mapping and tags. Keyword work stays inside one projection; only relinking shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetbook.dicts import categories as C
from streetbook.dicts import moderation as M
from streetbook.functions.expr import let, words
from streetbook.functions.keywords import any_hit, first_hit, first_rule, hit_count
from streetbook.functions.text import slugify
from streetbook.operators.common import small_table
from streetbook.operators.merge import add_links, get_or_create

Rules = Mapping[str, Sequence[str]]


def _full_text() -> Column:
    name, text = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    return F.lower(F.concat(name, F.lit(" "), text))


def flag_sensitive(df: DataFrame, dictionary: Rules = M.SENSITIVE) -> DataFrame:
    """Add ``sensitive`` and the first ``matched`` word of name and description."""
    flat = [w for ws in dictionary.values() for w in ws]
    hit = df.withColumn("matched", first_hit(_full_text(), flat))
    return hit.withColumn("sensitive", F.col("matched").isNotNull())


def flag_names(df: DataFrame, dictionary: Sequence[str] = tuple(M.SENSITIVE_NAMES)) -> DataFrame:
    """The bulk check: names only."""
    return df.withColumn("sensitive", F.coalesce(any_hit(F.lower("name"), dictionary), F.lit(False)))


def mark_names(flagged: DataFrame, prefix: str = M.MODERATION_PREFIX) -> DataFrame:
    """Put the moderation prefix before the name of flagged companies, once."""
    add = F.col("sensitive") & ~F.col("name").startswith(prefix)
    return flagged.withColumn("name", F.when(add, F.concat(F.lit(f"{prefix} "), "name")).otherwise(F.col("name")))


def slug_ids(categories: DataFrame, slug: str) -> DataFrame:
    return categories.filter(F.col("slug") == slug).select(F.col("id").alias("category_id"))


def apply_moderation(
    flagged: DataFrame,
    links: DataFrame,
    categories: DataFrame,
    prefix: str = M.MODERATION_PREFIX,
    catch_all: str = M.CATCH_ALL_SLUG,
) -> tuple[DataFrame, DataFrame]:
    """Companies with marked names, and links in which flagged companies have the catch-all category only.

    When the catch-all category does not exist the links stay as they are.
    """
    new = flagged.filter("sensitive").select(F.col("id").alias("company_id"), F.lit(catch_all).alias("slug"))
    return mark_names(flagged, prefix), assign_category(links, new, categories)


def assign_category(links: DataFrame, new: DataFrame, categories: DataFrame) -> DataFrame:
    """Single category per company: ``new(company_id, slug)`` replaces a company's links if its slug resolves."""
    resolved = (
        new.join(categories.select("slug", F.col("id").alias("category_id")), "slug")
        .select("company_id", "category_id")
        .distinct()
    )
    kept = links.join(resolved.select("company_id").distinct(), "company_id", "left_anti")
    return kept.select("company_id", "category_id").unionByName(resolved)


def moderated(
    companies: DataFrame, links: DataFrame, categories: DataFrame, catch_all: str = M.CATCH_ALL_SLUG
) -> DataFrame:
    """Companies under moderation with their source category and current category."""
    current = categories.filter(F.col("slug") == catch_all).select(
        F.col("id").alias("current_category_id"), F.col("name").alias("current_category")
    )
    at = links.join(current, F.col("category_id") == F.col("current_category_id")).drop("category_id")
    return companies.join(at, F.col("id") == F.col("company_id")).drop("company_id")


def review_moderated(
    df: DataFrame,
    categories: DataFrame,
    rules: Rules = M.REVIEW_RULES,
    excludes: Rules = M.REVIEW_EXCLUDES,
    adult: Sequence[str] = tuple(M.GUARD_ADULT),
    safe: Sequence[str] = tuple(M.GUARD_SAFE),
    tobacco: Sequence[str] = tuple(M.GUARD_TOBACCO),
    prefix: str = M.MODERATION_PREFIX,
    aliases: Mapping[str, str] = C.SLUG_ALIASES,
) -> DataFrame:
    """Review companies under moderation.

    Adds ``outcome`` (``stay``, ``reassigned``, ``unresolved``, ``no_match``), ``matched``, ``category_slug``,
    ``score`` and ``new_name``. An adult or tobacco word keeps a company under moderation unless its name holds a safe
    word. Else the rule with the most words in the text wins, the first one on a tie; an exclusion sets a score to 0.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    text = F.lower(F.coalesce("description", F.lit("")))
    table = F.array(
        *[
            F.struct(
                F.lit(slug).alias("slug"),
                F.lit(i).alias("priority"),
                words([w.lower() for w in kws]).alias("words"),
                words([w.lower() for w in excludes.get(slug, [])]).alias("excludes"),
            )
            for i, (slug, kws) in enumerate(rules.items())
        ]
    )

    def judge(low: Column) -> Column:
        """Verdict over the lower-cased ``struct<name, clean_name, text>``."""
        full = F.concat(low["name"], F.lit(" "), low["text"])
        clean = F.concat(low["clean_name"], F.lit(" "), low["text"])

        def score(both: Column):
            def one(rule: Column) -> Column:
                barred = F.exists(rule["excludes"], lambda w: F.contains(both["full"], w))
                points = F.when(barred, F.lit(0)).otherwise(hit_count(both["clean"], rule["words"]))
                return F.struct(points.alias("score"), (-rule["priority"]).alias("order"), rule["slug"].alias("slug"))

            return one

        def decide(both: Column) -> Column:
            matched = F.coalesce(first_hit(both["full"], adult), first_hit(both["full"], tobacco))

            def finish(hit: Column) -> Column:
                stay = hit.isNotNull() & ~any_hit(low["clean_name"], safe)
                # rules are only scored for rows that may leave moderation
                best = F.when(~stay, F.array_max(F.transform(table, score(both))))
                return F.struct(hit.alias("matched"), stay.alias("stay"), best.alias("best"))

            return let(matched, finish)

        return let(F.struct(full.alias("full"), clean.alias("clean")), decide)

    low = F.struct(
        name.alias("name"), F.replace(name, F.lit(prefix.lower()), F.lit("")).alias("clean_name"), text.alias("text")
    )
    judged = df.withColumn("_verdict", let(low, judge))
    scored = judged.select(
        *df.columns,
        F.col("_verdict.matched").alias("matched"),
        F.col("_verdict.stay").alias("_stay"),
        F.col("_verdict.best").alias("_best"),
    )
    scored = scored.withColumn("_rule", F.when(F.col("_best.score") > 0, F.col("_best.slug")))

    known = categories.select(F.col("slug").alias("_slug"))
    pairs = [(a, b) for a, b in aliases.items()] + [(b, a) for a, b in aliases.items()]
    alias = small_table(df.sparkSession, pairs, "_alias string, _own string")
    spellings = known.withColumn("_spelling", F.col("_slug")).withColumn("_rank", F.lit(0)).unionByName(
        known.join(alias, F.col("_slug") == F.col("_own")).select(
            "_slug", F.col("_alias").alias("_spelling"), F.lit(1).alias("_rank")
        )
    )
    # one row for each rule at most, so companies stay where they are
    wanted = spellings.filter(F.col("_spelling").isin(list(rules)))
    resolve = F.broadcast(wanted.groupBy("_spelling").agg(F.min_by("_slug", "_rank").alias("category_slug")))
    out = scored.join(resolve, F.col("_rule") == F.col("_spelling"), "left")
    outcome = (
        F.when(F.col("_stay"), "stay")
        .when(F.col("_rule").isNull(), "no_match")
        .when(F.col("category_slug").isNull(), "unresolved")
        .otherwise("reassigned")
    )
    pattern = rf"(?iu)^\Q{prefix}\E\s*"
    renamed = F.when(F.col("category_slug").isNotNull(), F.regexp_replace("name", pattern, "")).otherwise(F.col("name"))
    out = out.withColumn("outcome", outcome).withColumn("score", F.coalesce(F.col("_best.score"), F.lit(0)))
    return out.withColumn("new_name", renamed).drop("_stay", "_best", "_rule", "_spelling")


def review_summary(reviewed: DataFrame) -> DataFrame:
    """Counts by outcome and category, with a total row (``outcome`` = ``total``)."""
    counts = reviewed.rollup("outcome", "category_slug").agg(F.count("*").alias("n"), F.grouping_id().alias("_level"))
    outcome = F.when(F.col("_level") == 3, "total").otherwise(F.col("outcome")).alias("outcome")
    return counts.filter("_level in (0, 3)").select(outcome, "category_slug", "n")


def map_category(df: DataFrame, mapping: Mapping[str, str], column: str = "source_category") -> DataFrame:
    """Add ``slug``: the own slug of a source slug, or the source slug itself when it is not mapped."""
    table = small_table(df.sparkSession, list(mapping.items()), "_source string, _own string")
    joined = df.join(table, F.col(column) == F.col("_source"), "left")
    return joined.withColumn("slug", F.coalesce("_own", column)).drop("_source", "_own")


def expand_category(df: DataFrame, table: Mapping[str, Sequence[str]], column: str = "slug") -> DataFrame:
    """One row per source slug of an own slug, in table order; unknown slugs give no rows."""
    rows = [(own, i, source) for own, sources in table.items() for i, source in enumerate(sources)]
    known = small_table(df.sparkSession, rows, "_own string, pos int, source_slug string")
    return df.join(known, F.col(column) == F.col("_own")).drop("_own")


#: Characters of a keyword by which it is looked up, and of a text that are cut into such runs at once.
ANCHOR, PIECE = 3, 256


def match_rules(df: DataFrame, rules: DataFrame, column: str = "name", out: str = "rule") -> DataFrame:
    """Add ``out``: the first rule, by priority, one of whose keywords the lower-cased text contains.

    ``rules(rule, keyword, priority)`` is a table of any size: each distinct text is cut into its runs of up to ``ANCHOR``
    characters, these are joined with the lengths of the keywords that begin so, and the parts of these lengths are joined
    with the keywords themselves. So a text meets only keywords that it holds, however many begin alike. Equal priorities go
    by rule. Blank keywords match nothing, null texts have no rule. Rows that share a text or a keyword are looked up once.
    Long texts are cut in pieces that overlap by the longest keyword. The outer forms keep Spark from computing the arrays again
    in a filter; the joins drop what is null.
    """
    words = rules.select(F.lower("keyword").alias("_word"), F.struct(F.col("priority").alias("_priority"), F.col("rule").alias("_rule")).alias("_first"))
    words = words.filter("_word <> ''").groupBy("_word").agg(F.min("_first").alias("_first"))
    begun = words.select(F.substring("_word", 1, ANCHOR).alias("_anchor"), F.length("_word").alias("_n")).distinct()
    begun = begun.groupBy("_anchor").agg(F.collect_set("_n").alias("_lengths"))
    longest = F.broadcast(words.agg(F.coalesce(F.max(F.length("_word")), F.lit(0)).alias("_longest")))
    texts = df.select(F.lower(column).alias("_text")).filter("_text <> ''").distinct()

    def runs(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.least(F.length(piece), F.lit(PIECE)))
        return F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(piece, i, F.lit(n)) for n in range(1, ANCHOR + 1)])))

    places = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / PIECE))
    size = F.lit(PIECE + ANCHOR - 1) + F.col("_longest")
    pieces = F.transform(places, lambda k: F.substring("_text", (k * PIECE + 1).cast("int"), size))
    cut = texts.crossJoin(longest).select("_text", F.explode_outer(pieces).alias("_piece"))
    found = cut.select("_text", "_piece", F.explode_outer(F.array_distinct(runs(F.col("_piece")))).alias("_anchor")).join(begun, "_anchor")
    starts = F.sequence(F.lit(1), F.least(F.length("_piece"), F.lit(PIECE)))
    here = F.filter(starts, lambda i: F.substring("_piece", i, F.length("_anchor")) == F.col("_anchor"))
    parts = F.flatten(F.transform("_lengths", lambda n: F.transform(here, lambda i: F.substring("_piece", i, n))))
    held = found.select("_text", F.explode_outer(F.array_distinct(parts)).alias("_word")).join(words, "_word")
    first = held.groupBy("_text").agg(F.min("_first").alias("_first"))
    joined = df.join(first, F.lower(column) == F.col("_text"), "left")
    return joined.withColumn(out, F.col("_first._rule")).drop("_text", "_first")


def detect_category(
    df: DataFrame,
    name_rules: Rules | DataFrame | None = None,
    description_rules: Rules = C.CASCADE_DESCRIPTION,
    source_map: Mapping[str, str] | None = None,
    group_rules: Rules = C.CASCADE_GROUP,
    feature_rules: Rules = C.CASCADE_FEATURE,
) -> DataFrame:
    """Add ``detected_slug`` by the cascade name, description, source category, group titles, features.

    The long word list of the name stage is an input: a table ``rule, keyword, priority`` of any size (see ``match_rules``), or
    a mapping, which becomes part of the plan. The others default to the fixed tables. Columns that the frame lacks skip
    their stage.
    """
    source_map = C.CASCADE_SOURCE if source_map is None else source_map
    stages: list[Column] = []
    if isinstance(name_rules, DataFrame):
        df = match_rules(df, name_rules, "name", "_named")
        stages.append(F.col("_named"))
    elif name_rules:
        stages.append(first_rule("name", name_rules))
    if "description" in df.columns:
        stages.append(first_rule("description", description_rules))
    if "source_category" in df.columns:
        df = map_category(df, source_map).withColumnRenamed("slug", "_mapped")
        stages.append(F.when(F.col("_mapped") != "", F.col("_mapped")))
    if "feature_groups" in df.columns:
        stages.append(first_rule(F.array_join(F.map_keys("feature_groups"), " "), group_rules))
    if "features" in df.columns:
        stages.append(first_rule(F.array_join("features", " "), feature_rules))
    return df.withColumn("detected_slug", F.coalesce(*stages)).drop("_mapped", "_named")


def tag_group(title: Column | str, groups: Sequence[tuple[str, str]] = C.TAG_GROUPS) -> Column:
    """Tag group of a section title: the first part that it contains."""
    t = F.col(title) if isinstance(title, str) else title

    def pick(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for part, group in reversed(groups):
            out = F.when(F.contains(v, F.lit(part)), F.lit(group)).otherwise(out)
        return out

    return let(t, pick)


def feature_rows(df: DataFrame, key: str = "company_id") -> DataFrame:
    """Feature groups to rows ``key, title, name``."""
    sections = df.select(F.col(key), F.explode("feature_groups").alias("title", "body"))
    return sections.select(key, "title", F.explode("body.items").alias("name"))


def build_tags(
    features: DataFrame, tags: DataFrame, links: DataFrame, groups: Sequence[tuple[str, str]] = C.TAG_GROUPS
) -> tuple[DataFrame, DataFrame]:
    """Tags and links from ``features(company_id, title, name)``.

    A tag is known by the slug of its name; new ones get ids. The links of every company named here are replaced.
    """
    named = features.select(
        "company_id", "name", slugify("name").alias("slug"), tag_group("title", groups).alias("category")
    )
    all_tags = get_or_create(tags, named.select("name", "slug", "category"), "slug")
    fresh = named.select("company_id", "slug").distinct().join(
        all_tags.select("slug", F.col("id").alias("tag_id")), "slug"
    )
    kept = links.join(named.select("company_id").distinct(), "company_id", "left_anti")
    return all_tags, add_links(kept, fresh.select("company_id", "tag_id"), ["company_id", "tag_id"])
