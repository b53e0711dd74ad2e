"""The prefix trie of conversations: each distinct sequence of first turns is a node, subtree totals by parallel tree contraction.

A turn becomes a digest of its role and text and the number of its code points before any join or trie work. Conversations are
streamed turn by turn, and a running SHA-256 over turn digests names the node of each prefix, so equal prefixes of all
conversations meet in one aggregate, whose hot keys are reduced to one row per task first.

Totals over subtrees come from tree contraction. Each round rakes and compresses: all leaves hand their totals to their parents in
one aggregate and leave the tree; then every node with one child left is spliced out, whole chains at once, by pointer doubling
in join rounds, in which each node of a chain jumps twice as far as before and adds up what it passes. Both keep only leaves
and forks, so each round at least halves the leaves, and the rounds grow with the logarithm of the tree, not with its depth. At
the end the rounds are undone from the last to the first: a spliced node's total is what it has passed plus the total of
the node at its chain's end. All joins are on keys that are unique on both sides, but for that last one and the parents'
identifiers, where hot keys are broadcast and all others bounded (``join_counted``). Each round is stored.

The conversations that end at a node are written as one list. Its digest has to be taken in order: ranges of ``SPAN``
identifiers are sorted and joined to text in tasks of their own, and one task streams these pieces into the digest.

Rows go by turn, null turns first; equal turns by role and text. Null roles and texts are empty. Rows without conversation
take no part. Rows that repeat a turn are turns of their own. Very long texts are read once and very long conversations are streamed, one
turn at a time. An empty table gives an empty result (there is no conversation at the root); further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import join_counted, stored, tasks

#: Identifiers of one range of a list of conversations.
SPAN = 50_000
ROOT = hashlib.sha256().digest()
PREFIXES = "conv_id long, depth long, node binary, parent binary, chars long, ends boolean"


def turn_digest(role: Column, text: Column) -> Column:
    """A digest of 32 bytes that tells role from text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, chars)``: turns in order, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = W.Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = F.row_number().over(order).cast("long").alias("place")
    return turns.select("conv_id", place, turn_digest(F.col("role"), F.col("text")).alias("digest"), F.char_length("text").cast("long").alias("chars"))


def with_shared_start(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations ``(conv_id, place, digest, chars, length)`` that begin like the first of their group.

    Conversation c takes the first h turns of c - c % group (all if fewer) and then its own after its first h, with h =
    crc32(c) % most. One without turns has one row whose ``place`` is null. No identifier has more than 2 * group others in
    its group, so the join has no hot key.
    """
    turns = stored(turns)  # read three times below, without the texts
    held = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    convs = held.select("conv_id", base, h, "own")
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most))
    shared = heads.select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    sizes = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("first"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("first", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    begin = convs.join(shared, "base").filter("place <= h").select("conv_id", "place", "digest", "chars", "length")
    rest = turns.join(convs, "conv_id").filter("place > h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "digest", "chars", "length")
    bare = convs.filter("length = 0").select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in rest.dtypes if c in ("place", "digest", "chars")], "length")
    return begin.unionByName(rest).unionByName(bare.select(*rest.columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """``PREFIXES``: for each conversation the node of each of its prefixes, that of no turns included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, node = None, hashlib.sha256(), ROOT
        names = [p.split()[0] for p in PREFIXES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        for batch in batches:
            out = []
            for c, place, digest, chars, length in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "digest", "chars", "length"))):
                if c != conv:
                    conv, running, node = c, hashlib.sha256(), ROOT
                    out.append((c, 0, ROOT, None, 0, length == 0))
                if place is not None:
                    running.update(digest)
                    parent, node = node, running.digest()
                    out.append((c, place, node, parent, chars, place == length))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    rows = turns.select("conv_id", "place", "digest", "chars", "length")
    # by a hash of its own: Spark leaves out a repartition by a key that all parts of a union are dealt by already, and adaptive
    # execution then merges the partitions of each part in its own way, which tears conversations apart
    rows = rows.repartition(tasks(turns.sparkSession), F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(work, PREFIXES)


def double(chain: DataFrame) -> DataFrame:
    """Pointer doubling over ``(node, to, leaves, saved)``, one row for each node that is spliced out.

    Each round a node whose pointer is still on a chain takes over the pointer of the node it points to, and adds what that one
    has passed. At the end every pointer shows to the node below the chain.
    """
    while True:
        ahead = chain.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
        step = chain.join(ahead, "to", "left")
        moved = F.col("_to").isNotNull()
        chain = stored(
            step.select(
                "node",
                F.coalesce("_to", "to").alias("to"),
                (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
                moved.alias("moved"),
            )
        )
        if chain.filter("moved").isEmpty():
            return chain.drop("moved")
        chain = chain.drop("moved")


def subtree_totals(nodes: DataFrame, watch: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """``(node, leaves, saved)`` summed over each node's subtree; ``nodes(node, parent, leaves, saved)`` has what each adds itself.

    ``watch`` is told the number of each round, of its nodes and of its spliced nodes.
    """
    # over_*: what was spliced out between a node and its parent
    zero = F.lit(0).cast("long")
    tree = stored(nodes.select("node", "parent", "leaves", "saved", zero.alias("over_leaves"), zero.alias("over_saved")))
    done: list[DataFrame] = []
    spliced: list[DataFrame] = []
    left = tree.count()
    while left:
        kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
        tree = stored(tree.join(kids, "node", "left"))
        # rake
        leaves = tree.filter("kids is null")
        done.append(leaves.select("node", "leaves", "saved"))
        raked = leaves.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.sum(F.col("leaves") + F.col("over_leaves")).alias("_leaves"), F.sum(F.col("saved") + F.col("over_saved")).alias("_saved"),
            F.count("*").alias("_gone"),
        )
        rest = tree.filter("kids is not null").join(raked, "node", "left")
        rest = stored(
            rest.select(
                "node", "parent", "over_leaves", "over_saved",
                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
                (F.col("kids") - F.coalesce("_gone", F.lit(0))).alias("kids"),
            )
        )
        before, left = left, rest.count()
        if not left:
            break
        # compress: the only child of each node that has one, with what lies between
        only = rest.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("_n"), F.min("node").alias("to"), F.min("over_leaves").alias("_leaves"), F.min("over_saved").alias("_saved")
        )
        unary = rest.filter("kids = 1 and parent is not null").join(only.filter("_n = 1"), "node")
        unary = unary.select("node", "parent", "over_leaves", "over_saved", "to", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("leaves", "saved")])
        unary = stored(unary)
        gone = unary.count()
        if watch:
            watch(len(done), before, gone)
        if not gone:
            tree = rest.drop("kids")
            continue
        chain = double(unary.select("node", "to", "leaves", "saved"))
        spliced.append(chain)
        tops = unary.join(unary.select(F.col("to").alias("node")), "node", "left_anti").select("node", "parent", "over_leaves", "over_saved")
        ends = tops.join(chain, "node").select(
            F.col("to").alias("node"), F.col("parent").alias("_parent"),
            (F.col("leaves") + F.col("over_leaves")).alias("_leaves"), (F.col("saved") + F.col("over_saved")).alias("_saved"),
        )
        kept = rest.join(unary.select("node"), "node", "left_anti").join(ends, "node", "left")
        tree = stored(
            kept.select(
                "node", F.coalesce("_parent", "parent").alias("parent"), "leaves", "saved",
                *[F.coalesce(f"_{c}", f"over_{c}").alias(f"over_{c}") for c in ("leaves", "saved")],
            )
        )
        left = tree.count()
    totals = nodes.select("node", "leaves", "saved").limit(0)
    for some in done:
        totals = totals.unionByName(some)
    for chain in reversed(spliced):
        hang = chain.groupBy("to").agg(F.count("*").alias("_n"))
        below = totals.select(F.col("node").alias("to"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
        known = stored(below.join(hang, "to"))
        back = join_counted(chain, known, "to", "_n", "inner")
        back = back.select("node", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("leaves", "saved")])
        totals = totals.unionByName(stored(back))
    return totals


def end_lists(ends: DataFrame, span: int = SPAN) -> DataFrame:
    """``(node, ends_sha256)`` of ``(node, conv_id)``: the digest of each node's identifiers, rising, in decimal, with commas."""
    part = F.floor(F.col("conv_id") / span).alias("part")
    texts = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("node", part).agg(F.concat_ws(",", texts).alias("piece"))
    pieces = pieces.repartition(tasks(ends.sparkSession), F.xxhash64("node")).sortWithinPartitions("node", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, hashlib.sha256()
        for batch in batches:
            out = []
            for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if n == node:
                    running.update(b",")
                else:
                    if node is not None:
                        out.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256()
                running.update(piece.encode())
            yield lists(out)
        if node is not None:
            yield lists([(node, running.hexdigest())])

    def lists(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    return pieces.select("node", "piece").mapInArrow(work, "node binary, ends_sha256 string")


def trie(turns: DataFrame, watch: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """One row for each node of ``turns(conv_id, place, digest, chars, length)``, places from 1 to the length.

    ``node`` (its digest), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    rows = stored(prefixes(turns))
    nodes = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.first("chars").alias("chars"),
    )
    nodes = stored(nodes)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = nodes.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    totals = subtree_totals(own, watch)
    parents = stored(nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    named = nodes.drop("chars")
    below = join_counted(named.filter("parent is not null"), parents.withColumnRenamed("n_children", "_n"), "parent", "_n", "inner").drop("_n")
    top = named.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    named = below.unionByName(top.select(*below.columns))
    out = named.join(totals, "node").join(end_lists(rows.filter("ends").select("node", "conv_id")), "node", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
