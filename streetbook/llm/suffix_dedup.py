"""Repeated passages, found with longest-previous-factor arrays over sorted suffixes.

Texts are UTF-8 bytes. A byte is removed if a string of ``WINDOW`` bytes covers it that also starts in a document with a
smaller identifier; so of all copies of a passage the first document's stays. Strings are judged on the input, overlapping
ones all count, and none crosses documents.

No machine could sort the suffixes of all texts, so they are dealt out by content. Every window of 50 bytes has an anchor: the
one of its 12-byte strings with the smallest hash, the leftmost of equals. Equal windows have equal anchors. Neighbouring
windows with one anchor are a run, and the run's text goes where its anchor's hash says; there all windows meet that could be
equal. ``later_copies`` takes runs of one place: it sorts the suffixes of their texts (to a depth of one window), finds for
each the previous and the next one in that order that belongs to a smaller document, and the longer of the two common
prefixes is the longest previous factor. Where that reaches a whole window, the window is a later copy.

The same is done first inside each task, over the texts it has at hand. Runs of which every window is a later copy there go no
further, for their windows live on in the first copy's run: a passage that a third of all documents share, or a text with
thousands of copies, is sent once for each piece of about ``CHUNK`` bytes. Runs whose bytes around the anchor no other document
shares are left out of the sort. Equal runs of many documents enter the sort as two, the
first and one for all others. Long texts are cut into slices that overlap by a window less one byte.

Null texts are empty. Rows without identifier neither take nor give: nothing is smaller than null. Rows of one identifier with
different texts are told apart by a hash of the text and do not affect each other. New columns replace old ones of their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from streetbook.llm.shared import ODD, PACKED, deal_rows, mixed, opened, packed, sets_aside, tasks

WINDOW, GRAM = 50, 12
#: A window holds this many bytes before its anchor or after it, or more.
SIDE = (WINDOW - GRAM) // 2
#: Bytes of text that are cut into runs at once, run bytes that meet in one place, windows that are sorted at once, and
#: windows whose anchors are found at once.
CHUNK, PLACE, SORTED, BLOCK = 1 << 22, 1 << 25, 1 << 19, 1 << 19
#: Low bits of an anchor's key that hold its position, so that the smallest key is also the leftmost.
_AT = np.uint64((1 << 20) - 1)


def words(data: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The 8 (or as ``kind`` says) bytes at every position, as numbers that sort like the bytes."""
    size = np.dtype(kind).itemsize
    return np.ndarray((max(0, len(data) - size + 1),), dtype=kind, buffer=data, strides=(1,)) if len(data) >= size else np.zeros(0, kind)


def gram_hashes(data: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A hash of the 12 bytes at every position, or at those given."""
    eight, four = words(data, "<u8"), words(data, "<u4")
    first, second = (eight[at], four[at + 8]) if isinstance(at, np.ndarray) else (eight[: len(four) - 8], four[8:])
    return mixed(mixed(first * ODD[0]) + second.astype(np.uint64) * ODD[1])


class Runs:
    """Runs of neighbouring windows: place in ``data``, length, anchor, and the document and offset they come from."""

    def __init__(self, data: np.ndarray, begin, length, anchor, doc, row, offset):
        self.data, self.begin, self.length, self.anchor = data, begin, length, anchor  # anchor: relative to begin
        self.doc, self.row, self.offset = doc, row, offset  # offset: of the run in its document

    def __len__(self) -> int:
        return len(self.begin)

    def take(self, which: np.ndarray) -> Runs:
        return Runs(self.data, *(x[which] for x in (self.begin, self.length, self.anchor, self.doc, self.row, self.offset)))

    def keys(self) -> np.ndarray:
        """A hash of each anchor's 16 bytes."""
        return gram_hashes(self.data, self.begin + self.anchor)

    def digests(self, begin: np.ndarray | None = None, length: np.ndarray | None = None) -> np.ndarray:
        """A hash of each run's whole text, or of the bytes given, of other make than ``keys``."""
        begin, length = (self.begin, self.length) if begin is None else (begin, length)
        longest = int(length.max(initial=0)) + 7
        eight = words(np.concatenate([self.data, np.zeros(longest + 8, dtype=np.uint8)]), "<u8")
        out = mixed(length.astype(np.uint64) * ODD[3])
        for k in range(0, longest - 7, 8):
            left = np.clip(length - k, 0, 8).astype(np.uint64)
            mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left % np.uint64(8) * np.uint64(8))) - np.uint64(1))
            out = mixed(out * ODD[1] + (eight[begin + k] & mask)) ^ (out << np.uint64(7))
        return out

    def shared(self) -> np.ndarray:
        """Which runs may hold a window of another document.

        A common window reaches ``SIDE`` bytes to the left of its anchor or to the right, so those bytes are common too.
        """
        out = np.zeros(len(self), dtype=bool)
        at = self.begin + self.anchor
        for side in (-SIDE, 0):
            room = self.anchor >= SIDE if side else self.length - self.anchor >= GRAM + SIDE
            some = np.flatnonzero(room)
            keys = self.digests(at[some] + side, np.full(len(some), GRAM + SIDE))
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], self.doc[some[order]]
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            if len(bounds):
                sizes = np.diff(np.concatenate([bounds, [len(keys)]]))
                several = np.minimum.reduceat(doc, bounds) != np.maximum.reduceat(doc, bounds)
                out[some[order[np.repeat(several, sizes)]]] = True
        return out

    def texts(self) -> np.ndarray:
        return self.data[spread(self.begin, self.length)]


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def cut(pieces: list[tuple[int, int, int, bytes]]) -> Runs:
    """The runs of pieces of text ``(doc, row, offset, bytes)``."""
    pieces = [p for p in pieces if len(p[3]) >= WINDOW]
    data = np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[3]) for p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    if not len(pieces):
        none = np.zeros(0, dtype=np.int64)
        return Runs(data, none, none, none, none, none, none)
    n = len(data) - WINDOW + 1
    at = np.empty(n, dtype=np.int32)  # for each window of data the place of its anchor
    for start in range(0, n, BLOCK):
        hashes = gram_hashes(data[start : start + BLOCK + WINDOW - 1])
        low = (hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64)
        width, have = WINDOW - GRAM + 1, 1
        while 2 * have <= width:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low
        at[start : start + len(low)] = (low & _AT).astype(np.int32) + start
    inside = np.ones(n + 1, dtype=bool)  # windows that lie in one piece
    for start, size in zip(starts.tolist(), sizes.tolist()):
        inside[start + size - WINDOW + 1 : start + size] = False
    inside[n] = False
    new = np.concatenate([[True], at[1:] != at[:-1]])
    new[starts] = True
    begin = np.flatnonzero(new & inside[:-1])
    last = np.flatnonzero(inside[:-1] & np.concatenate([new[1:] | ~inside[1:n], [True]]))
    of = np.searchsorted(starts, begin, side="right") - 1
    doc, row, offset = (np.array([p[k] for p in pieces], dtype=np.int64) for k in range(3))
    anchor = at[begin].astype(np.int64) - begin
    return Runs(data, begin, last - begin + WINDOW, anchor, doc[of], row[of], offset[of] + begin - starts[of])


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    found = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero((found >= 0) & (values[found] >= values))
    while len(todo):
        # all between a place and its pointer are at least as large, so the pointer's pointer is next
        found[todo] = found[found[todo]]
        todo = todo[(found[todo] >= 0) & (values[found[todo]] >= values[todo])]
    return found


def common_prefix(parts: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, up to a window; 0 where ``b`` is -1.

    Only pairs that are equal so far meet the next part, and bytes are counted only in the part where a pair parts.
    """
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.flatnonzero(b >= 0)
    a, b, done = a[open_], b[open_], 0
    for part in parts:
        diff = part[a] ^ part[b]
        ends = np.flatnonzero(diff)
        if len(ends):
            bits = diff[ends].astype(np.uint64)
            high, low = (np.frexp(x.astype(np.float64))[1] for x in (bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)))
            out[open_[ends]] = done + (8 * part.dtype.itemsize - np.where(high > 0, high + 32, low)) // 8
            same = np.flatnonzero(diff == 0)
            open_, a, b = open_[same], a[same], b[same]
        done += part.dtype.itemsize
    out[open_] = done
    return out


def previous_factors(data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes that begin ``at`` the longest factor, up to a window, that also begins in a smaller document.

    Equal suffixes stay in the order given, which changes no factor; those of small documents are best given first.
    """
    eight, two = words(data), words(data, ">u2")
    # the numbers of the first 8 bytes bring nearly all in order at little cost; the rest is for a sort that uses that
    order = np.argsort(eight[at].astype(np.uint64), kind="stable")
    order = order[np.argsort(words(data, f"S{WINDOW}")[at[order]], kind="stable")]
    at = at[order]
    parts = [eight[at + k].astype(np.uint64) for k in range(0, WINDOW - 7, 8)] + [two[at + k].astype(np.uint16) for k in range(WINDOW // 8 * 8, WINDOW, 2)]
    sorted_doc = doc[order]
    before = nearest_smaller(sorted_doc)
    after = len(order) - 1 - nearest_smaller(sorted_doc[::-1])[::-1]
    after = np.where(after >= len(order), -1, after)
    places = np.arange(len(order))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum(common_prefix(parts, places, before), common_prefix(parts, places, after))
    return out


def later_copies(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of ``runs`` also start in a smaller document: run, first and last + 1 window, as maximal spans."""
    none = np.zeros(0, dtype=np.int64)
    if not len(runs):
        return none, none, none
    some = np.flatnonzero(runs.shared())
    if not len(some):
        return none, none, none
    found = runs.take(some)
    keys, digests = found.keys(), found.digests()
    order = np.lexsort([found.doc, digests, keys])
    keys, digests, doc, order = keys[order], digests[order], found.doc[order], some[order]
    group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
    # equal runs: those of the first document, and those of all others; each kind is sorted once
    same = np.concatenate([[True], (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])])
    text = np.cumsum(same) - 1
    later = doc != doc[np.flatnonzero(same)][text]
    kind = 2 * text + later
    kinds, lead, which = np.unique(kind, return_index=True, return_inverse=True)
    by_doc = np.lexsort([doc[lead], group[lead]])  # within an anchor the small documents first
    lead = lead[by_doc]
    sorted_runs = runs.take(order[lead])
    counts = sorted_runs.length - WINDOW + 1
    anchor_of = group[lead]
    marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    totals = np.cumsum(counts)
    while start < len(lead):
        # whole anchors up to about SORTED windows
        base = totals[start - 1] if start else 0
        stop = int(np.searchsorted(totals, base + SORTED, side="right"))
        stop = max(stop, start + 1)
        stop = int(np.searchsorted(anchor_of, anchor_of[stop - 1], side="right"))
        part = sorted_runs.take(np.arange(start, stop))
        n = counts[start:stop]
        factors = previous_factors(runs.data, spread(part.begin, n), np.repeat(part.doc, n))
        hit = np.concatenate([[False], factors >= WINDOW, [False]])
        # spans of hits, cut where a run ends
        edge = np.concatenate([[True], np.zeros(n.sum() - 1, dtype=bool), [True]])
        edge[np.cumsum(n)[:-1]] = True
        begins = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
        ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:])) + 1
        run = np.repeat(np.arange(len(n)), n)[begins]
        ahead = np.cumsum(n) - n
        marks.append((run + start, begins - ahead[run], ends - ahead[run]))
        start = stop
    run, first, last = (np.concatenate(x) for x in zip(*marks))
    # each mark of a kind holds for all runs of that kind
    run = by_doc[run]
    members = np.argsort(which, kind="stable")
    sizes = np.bincount(which, minlength=len(kinds))
    offsets = np.cumsum(sizes) - sizes
    every = spread(offsets[run], sizes[run])
    return order[members[every]], np.repeat(first, sizes[run]), np.repeat(last, sizes[run])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans that cover the same places; spans that touch become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


SPANS = "doc long, row long, begins array<long>, ends array<long>"


def span_batch(runs: Runs, run: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[str, pa.Array]:
    """The bytes that marked windows cover, one row for each document."""
    begin, end = runs.offset[run] + first, runs.offset[run] + last - 1 + WINDOW
    doc, row = runs.doc[run], runs.row[run]
    order = np.lexsort([begin, row, doc])
    doc, row, begin, end = doc[order], row[order], begin[order], end[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) if len(doc) else np.zeros(0, int)
    spans = [merged(b, e) for b, e in zip(np.split(begin, cuts[1:]), np.split(end, cuts[1:]))] if len(doc) else []
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) for b, _ in spans])]).astype(np.int32))
    listed = [np.concatenate([s[k] for s in spans] or [np.zeros(0, np.int64)]) for k in (0, 1)]
    return {"doc": pa.array(doc[cuts]), "row": pa.array(row[cuts])} | {
        name: pa.ListArray.from_arrays(offsets, pa.array(x)) for name, x in zip(("begins", "ends"), listed)
    }


def planes(values: np.ndarray) -> bytes:
    """Whole numbers with their first bytes together, then their second bytes and so on: most planes are all zero."""
    return np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def pack(runs: Runs) -> bytes:
    """Runs as bytes: a few arrays and their texts, compressed."""
    numbers = [planes(np.diff(x, prepend=np.int64(0))) for x in (runs.doc, runs.row)] + [planes(runs.offset)]
    body = b"".join([*numbers, runs.length.astype(np.uint8).tobytes(), runs.anchor.astype(np.uint8).tobytes(), runs.texts().tobytes()])
    return zstandard.ZstdCompressor(level=6, write_content_size=True).compress(len(runs).to_bytes(8, "little") + body)


def unpack(blobs: list[bytes]) -> Runs:
    fields: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        body, at = zstandard.ZstdDecompressor().decompress(blob), 8
        n = int.from_bytes(body[:8], "little")
        for k in range(3):
            numbers = np.frombuffer(body, "u1", 8 * n, at).reshape(8, n).T.copy().view("<i8")[:, 0]
            fields[k].append(numbers if k == 2 else np.cumsum(numbers))
            at += 8 * n
        for k in (3, 4):
            fields[k].append(np.frombuffer(body, "u1", n, at))
            at += n
        fields[5].append(np.frombuffer(body, "u1", offset=at))
    doc, row, offset, length, anchor, data = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in fields)
    length = length.astype(np.int64)
    return Runs(data.astype(np.uint8), np.cumsum(length) - length, length, anchor.astype(np.int64), doc, row, offset)


def slices(doc: int, row: int, text: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    for start in range(0, max(1, len(text) - WINDOW + 1), CHUNK):
        yield doc, row, start, text[start : start + CHUNK + WINDOW - 1]


def told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``_row``: a hash of the text where the identifier is null or occurs more than once, else 0."""
    twice = docs.groupBy(F.col(doc_id).alias("_twice")).count().filter("count > 1 and _twice is not null").select("_twice")
    if twice.isEmpty():
        return docs.withColumn("_row", F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(0).cast("long"))
    marked = docs.join(twice, F.col(doc_id) == F.col("_twice"), "left")
    return marked.withColumn("_row", F.when(F.col("_twice").isNotNull() | F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(0).cast("long")).drop("_twice")


def place_count(docs: DataFrame, text: str) -> int:
    """Places for the runs of all texts; as runs overlap they are up to four times the text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return max(tasks(docs.sparkSession), 4 * size // PLACE)


def removed_spans(docs: DataFrame, places: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes to remove from ``docs`` (with ``_row``), ``PACKED`` in ``places`` buckets: rows of ``SPANS``.

    A document may have several rows, whose spans overlap.
    """
    texts = docs.filter(F.col(doc_id).isNotNull() & (F.octet_length(text) >= WINDOW))
    names = ["place", "runs", "doc", "row", "begins", "ends"]
    schema = f"place int, runs binary, {SPANS}"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(pieces):
            runs = cut(pieces)
            run, first, last = later_copies(runs)
            spans = span_batch(runs, run, first, last)
            copied = np.bincount(run, last - first, len(runs)) if len(run) else np.zeros(len(runs))
            left = runs.take(np.flatnonzero(copied < runs.length - WINDOW + 1))
            keys = (left.keys() >> np.uint64(20)) % np.uint64(places) if len(left) else np.zeros(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0])) if len(left) else np.zeros(0, int)
            groups = np.split(order, bounds[1:]) if len(left) else []
            nothing = pa.array([[]] * len(groups), pa.list_(pa.int64()))
            zero = pa.array([None] * len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(keys[g[0]]) for g in groups], pa.int32()), pa.array([pack(left.take(g)) for g in groups], pa.binary()), zero, zero, nothing, nothing],
                names=names,
            )
            # spans go along to any place
            n = len(spans["doc"])
            where = pa.array((spans["doc"].to_numpy(zero_copy_only=False) % places).astype(np.int32))
            yield pa.RecordBatch.from_arrays([where, pa.array([None] * n, pa.binary()), *spans.values()], names=names)

        held, size = [], 0
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for piece in slices(doc, row, text):
                    held.append(piece)
                    size += len(piece[3])
                    if size >= CHUNK:
                        yield from work(held)
                        held, size = [], 0
        if held:
            yield from work(held)

    def second_pass(table: pa.Table) -> pa.Table:
        runs = unpack([b for b in table.column("runs").to_pylist() if b is not None])
        found = pa.table(span_batch(runs, *later_copies(runs)))
        kept = table.filter(pc.is_valid(table.column("doc"))).select(["doc", "row", "begins", "ends"])
        spans = pa.concat_tables([kept.cast(found.schema), found]).combine_chunks()
        doc, row = (spans.column(n).to_numpy() for n in ("doc", "row"))
        return pa.Table.from_batches([packed(spans, doc, row, places, True)])

    rows = texts.select(F.col(doc_id).cast("long"), "_row", F.col(text).cast("binary")).mapInArrow(first_pass, schema)
    return rows.groupBy("place").applyInArrow(second_pass, PACKED)


@sets_aside("_row", "_twice")
def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and the remaining bytes' ``kept`` (binary) and ``kept_sha256``."""
    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_sha256": "string"}
    rows = told_apart(docs.drop(*made), doc_id, text)
    places = place_count(rows, text)
    spans = removed_spans(rows, places, doc_id, text)
    kept = [f for f in rows.schema.fields if f.name != "_row"]
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in made.items()])

    def remove(group: pa.Table) -> pa.Table:
        of: dict[tuple[int, int], list] = {}
        is_span = group.column("spans").to_pylist()
        blocks = group.column("rows").to_pylist()
        for table in opened([b for b, s in zip(blocks, is_span) if s]):
            lists = [x for c in ("begins", "ends") for x in [table.column(c).combine_chunks()]]
            for i, key in enumerate(zip(table.column("doc").to_pylist(), table.column("row").to_pylist())):
                of.setdefault(key, []).append([x[i].values.to_numpy() for x in lists])
        tables = opened([b for b, s in zip(blocks, is_span) if not s])
        out: dict[str, list] = {n: [] for n in made}
        for table in tables:
            keys = zip(table.column(doc_id).to_pylist(), table.column("_row").to_pylist())
            for key, content in zip(keys, table.column(text).cast(pa.binary())):
                content = content.as_py() or b""
                begins, ends = (np.concatenate([x[k] for x in of[key]]) if key in of else np.zeros(0, np.int64) for k in (0, 1))
                begins, ends = merged(begins, ends)
                edges = [0, *np.column_stack([begins, ends]).ravel().tolist(), len(content)]
                rest = b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (len(content), len(content) - len(rest), len(begins), rest, hashlib.sha256(rest).hexdigest())
                for name, value in zip(made, row):
                    out[name].append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = [pa.chunked_array([c for t in tables for c in t.column(f.name).chunks], arrow.field(f.name).type) for f in kept]
        return pa.table(columns + [pa.array(out[n], t) for n, t in zip(made, types)], names=[f.name for f in schema.fields])

    arrow = to_arrow_schema(T.StructType(kept))
    dealt = deal_rows(rows, doc_id, "_row", places, False)
    return dealt.unionByName(spans).groupBy("bucket").applyInArrow(remove, schema)
