"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

Rows are shuffled by their full text and grouped, so a text that a third of all rows share is one row with a multiplicity
before it is tokenised. A text is encoded as space+text by A and, as B adds that space itself, as text by B. Where the bytes of
both are those of space+text, byte offsets at which tokens of A and of B both end cut them into groups, and all pairs of an
A token and a B token of one group are links. The corpus count of an id pair is the number of rows whose text links it: each
distinct text counts with its multiplicity.

Texts go on in chunks of at least ``CHUNK`` distinct (text, pair) entries. A chunk asks once for each of its distinct pairs, so
what is shuffled for counts grows with chunks and not with texts, and the answers come back to the chunk, where the texts'
measures are summed. Nothing is broadcast but the answers of the hottest texts (see ``join_counted``).

Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and an empty digest. Rows that repeat
identifier or text are rows of their own, also in counts. Null identifiers are kept. Very long texts are encoded whole, one at
a time; those with long unbroken runs by a tokenizer that needs no quadratic time. An empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import join_counted, stored

#: (text, pair) entries from which a chunk is closed, and bytes of text that are aligned at once.
CHUNK, AT_ONCE = 500_000, 1 << 20
#: Links of one group from which equal ids are counted first, and the pairs that are made at once then.
WIDE = 4096
#: Characters of an unbroken run from which the encoder without quadratic time is taken.
RUN = 400

CHUNKS = "chunk long, pairs binary, weights binary, body binary"
ASKED = "chunk long, place int, a int, b int, weight long"
MEASURES = "sha binary, rows long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = pa.schema(
    [("sha", pa.binary()), ("rows", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("entries", pa.int64())]
)


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary (a ``tokenizer.json``). Its special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        ids = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        every = special | ids
        self.tokens = [every.get(i, b"") for i in range(max(every) + 1)]
        self.fast = self._ranked(spec, {b: i for i, b in ids.items() if i not in special})

    @staticmethod
    def _ranked(spec: dict, ranks: dict[bytes, int]):
        """A faster encoder with the same ids, for a vocabulary of the common form whose ids are in the order of the merges."""
        before, merges, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["merges"], spec["model"]["vocab"]
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        common = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not common or spec.get("normalizer") or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(parts)):
            return None
        import tiktoken

        # fixed value: the pattern of byte-level pre-tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _long(text: str) -> bool:
        """Whether there may be an unbroken run of ``RUN`` characters, of white space or of others."""
        words = text.split()
        return max(map(len, words), default=0) >= RUN or len(text) - sum(map(len, words)) - len(words) >= RUN

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        # the faster one takes quadratic time for a single long run
        slow = (self.library.encode(t, add_special_tokens=False).ids if self._long(t) else None for t in texts)
        return [self.fast(t) if ids is None else ids for t, ids in zip(texts, slow)]


class Pieces:
    """A sentencepiece model with byte fallback; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.tokens.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.tokens.append(b"")
            else:
                self.tokens.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass(frozen=True)
class Loaded:
    """Both tokenizers with what the alignment looks up: token lengths and their numbers as text with what may follow."""

    a: ByteLevel
    b: Pieces
    a_bytes: np.ndarray
    b_bytes: np.ndarray
    written: list[bytes]


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Loaded:
    """Once in each worker. ``written`` has the ids of A before ``,`` and ``|``, then those of B before ``,`` and ``;``."""
    a, b = ByteLevel(a_path), Pieces(b_path)
    written = [b"%d%s" % (i, end) for t, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for end in ends for i in range(len(t.tokens))]
    return Loaded(a, b, np.array([len(x) for x in a.tokens]), np.array([len(x) for x in b.tokens]), written)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` with ``count[i]`` numbers, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - first, count)


@dataclass
class Aligned:
    """Measures of texts, and their entries: text number, pair ``a << 32 | b`` and how often, sorted by both."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by text and pair, equal ones added up."""
    if not len(text):
        return text, pair, times
    wide = int((pair & 0xFFFFFFFF).max()) + 1
    high = ((pair >> 32).max() + 1) * wide
    if high * (int(text.max()) + 1) < 1 << 62 and int(times.max()) == 1:  # the usual case: one number for each entry
        keys, times = np.unique(text * high + (pair >> 32) * wide + (pair & 0xFFFFFFFF), return_counts=True)
        text, pair = keys // high, keys % high
        return text, (pair // wide << 32) | pair % wide, times
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(pair) != 0)]))
    return text[new], pair[new], np.add.reduceat(times, new)


def wide_links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of one large group and how often each is linked, some at a time."""
    (a, n), (b, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    step = max(1, CHUNK // len(b))
    for i in range(0, len(a), step):
        yield ((a[i : i + step, None] << 32) | b).ravel(), (n[i : i + step, None] * m).ravel()


def align(a: list[list[int]], b: list[list[int]], known: Loaded) -> Aligned:
    """Aligns texts whose tokens have the same bytes, all in one pass over their concatenation."""
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
    ends_a, ends_b = np.cumsum(known.a_bytes[ids_a]), np.cumsum(known.b_bytes[ids_b])  # a token of kept bytes has some
    last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    text_a = np.repeat(np.arange(len(a)), n_a)
    text_of = text_a[first_a]
    links = size_a * size_b
    n_links = np.zeros(len(a), dtype=np.int64)
    np.add.at(n_links, text_of, links)

    # groups of usual size: every A token beside every B token of its group
    narrow = (links <= WIDE)[group_a]
    left, many = ids_a[narrow], size_b[group_a[narrow]]
    right = ids_b[spread(first_b[group_a[narrow]], many)]
    entries = [(np.repeat(text_a[narrow], many), (np.repeat(left, many) << 32) | right, np.ones(len(right), dtype=np.int64))]
    for g in np.flatnonzero(links > WIDE):
        for pair, times in wide_links(ids_a[first_a[g] : first_a[g] + size_a[g]], ids_b[first_b[g] : first_b[g] + size_b[g]]):
            entries.append((np.full(len(pair), text_of[g]), pair, times))
    text, pair, times = summed(*(np.concatenate(x) for x in zip(*entries)))

    # group by group the ids of A and then those of B, each with the sign behind it
    line = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    line[np.arange(len(ids_a)) + first_b[group_a]] = ids_a + last_a * len(known.a_bytes)
    line[np.arange(len(ids_b)) + (first_a + size_a)[group_b]] = ids_b + last_b * len(known.b_bytes) + 2 * len(known.a_bytes)
    bounds = np.cumsum(n_a + n_b)
    digests = []
    for end, n in zip(bounds, n_a + n_b):
        body = b"".join(map(known.written.__getitem__, line[end - n : end].tolist()))
        digests.append(hashlib.sha256(body[:-1]).hexdigest())
    return Aligned(n_a, n_b, np.bincount(text_of, minlength=len(a)), n_links, digests, text, pair, times)


def encoded(texts: list[str], known: Loaded) -> tuple[list[list[int]], list[list[int]], list[bool]]:
    """Tokens of both for the texts whose bytes they keep, and which these are."""
    a, b = known.a.encode([" " + t for t in texts]), known.b.encode(texts)
    good = []
    for t, x, y in zip(texts, a, b):
        want = b" " + t.encode()
        good.append(all(b"".join(map(k.tokens.__getitem__, ids)) == want for k, ids in ((known.a, x), (known.b, y))))
    return [x for x, g in zip(a, good) if g], [y for y, g in zip(b, good) if g], good


def small(x: np.ndarray) -> np.ndarray:
    """The numbers in the smallest unsigned type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def ipc(batches: list[pa.RecordBatch | pa.Table]) -> bytes:
    """Arrow tables one after the other, compressed."""
    sink = pa.BufferOutputStream()
    for table in batches:
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write(table)
    return sink.getvalue().to_pybytes()


class Chunk:
    """Texts that wait until they have entries enough."""

    def __init__(self):
        self.texts, self.text, self.pair, self.times, self.size, self.count = [], [], [], [], 0, 0

    def add(self, keys: list[tuple[bytes, int]], found: Aligned) -> None:
        entries = np.bincount(found.text, minlength=len(keys))
        columns = [found.n_a, found.n_b, found.n_groups, found.n_links, found.digests, entries]
        rows = [[k[0] for k in keys], [k[1] for k in keys], *columns]
        self.texts.append(pa.table([pa.array(c, t) for c, t in zip(rows, TEXTS.types)], schema=TEXTS))
        self.text.append(found.text + self.count)
        self.pair.append(found.pair)
        self.times.append(found.times)
        self.size += len(found.pair)
        self.count += len(keys)

    def row(self, number: int) -> tuple[int, bytes, bytes, bytes]:
        """Its distinct pairs, in how many rows each is linked, and texts with the places of their pairs."""
        place, pairs = pd.factorize(np.concatenate(self.pair))
        texts = pa.concat_tables(self.texts).combine_chunks()
        rows = texts.column("rows").to_numpy()[np.concatenate(self.text)]
        weights = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(weights, place, rows)
        entries = pa.table({"place": small(place), "times": small(np.concatenate(self.times))})
        return number, pairs.tobytes(), weights.tobytes(), ipc([texts, entries])


def chunked(texts: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """``CHUNKS`` of ``(text, sha, rows)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_chunk = load(a_path, b_path), Chunk()
        number = TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            row = open_chunk.row(number)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["chunk", "pairs", "weights", "body"],
            )

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                held, end = 0, start
                words, keys = [], []
                while end < batch.num_rows and (held < AT_ONCE or end == start):
                    words.append(batch.column("text")[end].as_py())
                    keys.append((batch.column("sha")[end].as_py(), batch.column("rows")[end].as_py()))
                    held += len(words[-1])
                    end += 1
                a, b, good = encoded(words, known)
                if a:
                    open_chunk.add([k for k, g in zip(keys, good) if g], align(a, b, known))
                if open_chunk.size >= chunk:
                    yield closed()
                    number, open_chunk = number + 1, Chunk()
                start = end
        if open_chunk.count:
            yield closed()

    return texts.mapInArrow(work, CHUNKS)


def asked(chunks: DataFrame) -> DataFrame:
    """``ASKED``: a row for each distinct pair of each chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, weight = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["weights"], np.int64)
                for i in range(0, len(pair), 100_000):
                    part = pair[i : i + 100_000]
                    columns = [np.full(len(part), row["chunk"]), np.arange(i, i + len(part), dtype=np.int32)]
                    columns += [(part >> 32).astype(np.int32), part.astype(np.int32), weight[i : i + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "place", "a", "b", "weight"])

    return chunks.select("chunk", "pairs", "weights").mapInArrow(work, ASKED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: rows that link the pair, and whether no other pair of ``a`` has more. ``pairs`` has weights."""
    counts = pairs.groupBy("a", "b").agg(F.sum("weight").alias("count"))
    most = F.max("count").over(W.Window.partitionBy("a"))  # an id of A has no more rows here than B has ids
    return counts.withColumn("best", F.col("count") == most)


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """``MEASURES`` of the texts of each chunk, from ``answers(chunk, place, count, best)``."""
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(False)
        out = []
        for row in left.to_pylist():
            source = pa.py_buffer(row["body"])
            reader = pa.BufferReader(source)
            texts, entries = pa.ipc.open_stream(reader).read_all(), pa.ipc.open_stream(reader).read_all()
            at, times = entries.column("place").to_numpy(), entries.column("times").to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(texts.column("entries").to_numpy())])
            totals = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, count)]
            n_best, count_sum = (t[bounds[1:]] - t[bounds[:-1]] for t in totals)
            columns = texts.drop_columns(["entries"]).columns + [pa.chunked_array([n_best]), pa.chunked_array([count_sum])]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out)

    body = chunks.select("chunk", "body")
    return body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, MEASURES)


def measure(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, *COLUMNS)`` of each row, and the corpus table ``(a, b, count, best)`` of linked id pairs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    full = rows.filter(F.octet_length("text") > 0)
    texts = full.groupBy("text").agg(F.count("*").alias("rows"))
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    chunks = stored(chunked(texts, a_path, b_path, chunk))
    pairs = asked(chunks)
    counts = stored(pair_counts(pairs))
    answers = pairs.join(counts, ["a", "b"]).select("chunk", "place", "count", "best")
    measures = stored(answered(chunks, answers))
    keyed = rows.select("doc_id", F.unhex(F.sha2(F.when(F.octet_length("text") > 0, F.col("text")), 256)).alias("sha"))
    out = join_counted(keyed.filter("sha is not null"), measures, "sha", "rows")
    filled = [F.coalesce(c, F.lit("") if c == "groups_sha256" else F.lit(0).cast("long")).alias(c) for c in COLUMNS]
    none = [(F.lit("") if c == "groups_sha256" else F.lit(0).cast("long")).alias(c) for c in COLUMNS]
    return out.select("doc_id", *filled).unionByName(keyed.filter("sha is null").select("doc_id", *none)), counts
