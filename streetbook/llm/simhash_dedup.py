"""Near-duplicates by SimHash fingerprints, found with a pigeonring filter.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and into runs of ``shingle`` words joined by a space,
repeats included; with fewer words the whole sequence is one run, and without a word the fingerprint is zero. A bit of the
fingerprint is 1 if more than half of the runs' XXH64 hashes (seed 42) have it.

Fingerprints of at most ``max_bits`` differing bits are linked. With m = ``max_bits`` + 1 segments in a ring, the pigeonring
principle says: of such a pair, some segment begins a chain in which, for each length l, the first l segments together
differ in at most l * max_bits / m bits. For l = 1 that is a segment without a difference, for l = 2 its successor has at
most one, so one of the successor's halves is equal too. Segment and half together are the key that brings candidates
together; the whole chain is checked before the full Hamming distance.

Equal fingerprints are one row from the start, however many documents have them. Candidates with one key are compared inside
the task that holds the key, in blocks, and leave as a spanning forest: never as all pairs. A key with more than ``DENSE``
fingerprints is split by the bits that the key leaves open, as often as needed. Every document counts, none is capped.

Null texts count as empty; all texts without words share the fingerprint zero. A null identifier is never the smallest; if
a group has only such, its ``component_id`` is null. Repeated rows stay repeated. New columns replace old ones of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetbook.llm.shared import Forest, components, join_counted, sets_aside, stored, tasks, whole_keys

SEED = 42
BITS = 64
#: Fingerprints under one key up to which all of them are compared in blocks.
DENSE = 2048
#: Hashes that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white space characters alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    count = len(words) - shingle + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, CHUNK):
        part = words[start : start + CHUNK + shingle - 1]
        runs = zip(*[part[k:] for k in range(shingle)])
        hashes = np.array([digest(b" ".join(run), SEED) for run in runs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, text: str = "text", name: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType(kept + [T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64)
            columns = [batch.column(f.name) for f in kept] + [pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(add, schema)


def ring(max_bits: int) -> list[np.uint64]:
    """The masks of the segments, in ring order."""
    cuts = [BITS * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def halves(mask: np.uint64) -> list[np.uint64]:
    bits = [i for i in range(BITS) if int(mask) >> i & 1]
    middle = len(bits) // 2
    return [np.uint64(sum(1 << i for i in part)) for part in (bits[:middle], bits[middle:])]


def key_masks(max_bits: int) -> list[tuple[int, np.uint64]]:
    """For each kind of key the segment that begins the chain and the bits that must be equal."""
    segments = ring(max_bits)
    if max_bits == 0:
        return [(0, segments[0])]
    return [(i, m | h) for i, m in enumerate(segments) for h in halves(segments[(i + 1) % len(segments)])]


def in_chain(diff: np.ndarray, first: int, max_bits: int) -> np.ndarray:
    """Whether every part of the chain that begins with segment ``first`` stays within its share of the distance."""
    segments = ring(max_bits)
    m, total = len(segments), np.zeros(diff.shape, dtype=np.int64)
    good = np.ones(diff.shape, dtype=bool)
    for length in range(1, m + 1):
        total += np.bitwise_count(diff & segments[(first + length - 1) % m])
        good &= total * m <= length * max_bits
    return good


def links(found: np.ndarray, first: int, fixed: np.uint64, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that agree in the bits ``fixed``."""
    if len(found) > DENSE and (open_bits := [i for i in range(BITS) if not int(fixed) >> i & 1]) and len(open_bits) > max_bits:
        # pigeonhole on the open bits: a linked pair agrees in one of max_bits + 1 parts
        out = []
        for part in np.array_split(np.array(open_bits), max_bits + 1):
            mask = np.uint64(sum(1 << int(i) for i in part))
            order = np.argsort(found & mask, kind="stable")
            cuts = np.flatnonzero(np.diff((found & mask)[order])) + 1
            for group in np.split(found[order], cuts):
                if len(group) > 1:
                    out += links(group, first, fixed | mask, max_bits)
        return out
    forest, out = Forest(len(found)), []
    for start in range(0, len(found), 256):
        diff = found[start : start + 256, None] ^ found[None, :]
        good = in_chain(diff, first, max_bits)
        good &= np.bitwise_count(diff) <= max_bits
        left, right = np.nonzero(good)
        for i, j in zip((left + start).tolist(), right.tolist()):
            if i < j and forest.join(i, j):
                out.append((int(found[i]), int(found[j])))
    return out


def linked(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints (column ``_fp``) that link, directly or by others."""
    masks = key_masks(max_bits)
    keys = [F.struct(F.lit(k).alias("kind"), F.col("_fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("key")) for k, (_, m) in enumerate(masks)]
    rows = distinct.select("_fp", F.explode(F.array(*keys)).alias("_k")).select("_k.kind", "_k.key", "_fp")
    rows = rows.repartition(tasks(distinct.sparkSession), "kind", "key").sortWithinPartitions("kind", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _, value), begins, ends in whole_keys(batches, 2):
            pairs: list[tuple[int, int]] = []
            for a, b in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
                first, mask = masks[int(kind[a])]
                pairs += links(value[a:b].view(np.uint64), first, mask, max_bits)
            out = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The identifiers of ``docs``, each with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest of its linked group.

    Other columns are not carried along.
    """
    marked = fingerprints(docs.select(doc_id, text), shingle, text).select(doc_id, "_fp")
    marked = stored(marked)
    distinct = stored(marked.groupBy("_fp").agg(F.min(doc_id).alias("_low"), F.count("*").alias("_n")))
    groups = components(linked(distinct.select("_fp"), max_bits))
    labels = distinct.join(groups.withColumnRenamed("node", "_fp"), "_fp", "left")
    labels = labels.withColumn("label", F.coalesce("label", "_fp"))
    lows = labels.groupBy("label").agg(F.min("_low").alias("component_id"), F.count("*").alias("_m"))
    named = stored(join_counted(labels, stored(lows), "label", "_m", "inner").select("_fp", "component_id", "_n"))
    out = join_counted(marked, named, "_fp", "_n", "inner").drop("_n")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp")


@sets_aside("_later")
def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its group. Rows without an identifier stay."""
    found = near_groups(docs, shingle, max_bits, doc_id=doc_id)
    later = found.filter(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias("_later"))
    first = found.filter(F.col("component_id") == F.col(doc_id)).select(F.col(doc_id).alias("_later"))
    return docs.join(later.join(first, "_later", "left_anti"), F.col(doc_id) == F.col("_later"), "left_anti")
