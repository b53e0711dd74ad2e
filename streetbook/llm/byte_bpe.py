"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. First tier: a minimal perfect hash over the vocabulary gives the
one slot where a pre-token can stand; if its bytes stand there, its id is the answer. Second tier, for all others: the bytes
form a linked list, a heap holds the adjacent pairs that are tokens by rank and place, and the lowest pair is joined until
none is left. Long pre-tokens take n log n steps.

Results are kept per worker, for pieces between a letter and a single space, where the pattern always cuts; that memory is
bounded by twice ``MEMO`` pieces and as many pre-tokens of up to ``MEMO_CHARS`` characters and changes no result. The vocabulary is a file of fixed size
(some 50,000 tokens) that the driver reads and hands to the tasks.

Null texts are empty: no ids, no bytes. Lone surrogates cannot occur in Spark strings. Further columns are carried along,
new ones replace old ones of their name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MEMO = 200_000
MEMO_CHARS = 64
#: Rows taken at once in a task.
PIECE_ROWS = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids (0, 1, 2, ...)."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash by hash and displace: ``n`` keys in ``n`` slots, and one displacement for each bucket.

    A key's 64-bit hash names its bucket, a place a and a step b; it stands in slot (a + d * b) mod n, with the bucket's d.
    Buckets with many keys are placed first; a bucket of one key takes any slot that is left, as -1 - slot in place of d.
    """

    LOAD = 2

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // self.LOAD)
        for seed in range(100):
            if self._place(keys, seed):
                return
        raise ValueError("no perfect hash found; are there equal keys?")

    def _place(self, keys: list[bytes], seed: int) -> bool:
        self.seed = seed
        hashes = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) < self.n:
            return False
        n = np.uint64(max(self.n, 1))
        bucket = hashes % np.uint64(self.buckets)
        a, b = (hashes >> np.uint64(20)) % n, (hashes >> np.uint64(40)) % np.uint64(max(self.n - 1, 1)) + np.uint64(1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slots = np.full(self.n, -1, dtype=np.int32)
        a, b = a.astype(np.int64), b.astype(np.int64)
        tries = np.arange(32, dtype=np.int64)[:, None]
        for k in np.argsort(cuts[:-1] - cuts[1:], kind="stable"):
            members = order[cuts[k] : cuts[k + 1]]
            if len(members) < 2:
                break
            for start in range(0, 8 * self.n + 32, 32):
                places = (a[members] + (tries + start) * b[members]) % self.n
                free = (self.slots[places] < 0).all(axis=1)
                free &= (np.diff(np.sort(places, axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    found = int(free.argmax())
                    self.shift[k], self.slots[places[found]] = start + found, members
                    break
            else:
                return False
        single = np.flatnonzero(np.diff(cuts) == 1)
        left = np.flatnonzero(self.slots < 0)
        self.shift[single], self.slots[left] = -1 - left, order[cuts[single]]
        self.shift, self.slots = self.shift.tolist(), self.slots.tolist()
        return True

    def slot(self, key: bytes) -> int:
        """The index of the only key that may equal ``key``; -1 if there are no keys."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        return self.slots[-1 - d if d < 0 else ((h >> 20) % self.n + d * ((h >> 40) % max(self.n - 1, 1) + 1)) % self.n]


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, whole: PerfectHash):
        self.tokens, self.find, self.hash = tokens, regex.compile(pattern).findall, whole
        ranks = {token: rank for rank, token in enumerate(tokens)}
        self.odd_space = regex.compile(r" \s|\s ").search
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        #: Rank of two bytes, and of two tokens by their ids, where they make a token.
        self.first = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.pairs = {
            ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
            for rank, token in enumerate(tokens)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older_parts: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: bytes) -> int:
        """The id of ``piece`` as one token, or -1."""
        slot = self.hash.slot(piece)
        return slot if slot >= 0 and self.tokens[slot] == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids after all merges, lowest rank first and leftmost among equals."""
        n, first, rank_of, byte_ids = len(piece), self.first, self.pairs.get, self.byte_ids
        ids = [byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joins = [first[a << 8 | b] for a, b in zip(piece, piece[1:])] + [-1]  # the rank of each part with the next
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [rank << bits | i for i, rank in enumerate(joins) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & place, top >> bits
            if joins[i] != rank:
                continue  # one of the two has been joined otherwise meanwhile
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], joins[i], joins[j] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                if (more := rank_of(rank << 32 | ids[k], -1)) >= 0:
                    joins[i] = more
                    heapq.heappush(heap, more << bits | i)
            if (k := before[i]) >= 0:
                joins[k] = more = rank_of(ids[k] << 32 | rank, -1)
                if more >= 0:
                    heapq.heappush(heap, more << bits | k)
        return [x for x in ids if x >= 0]

    def pretoken(self, piece: str) -> tuple[int, ...]:
        """The ids of a pre-token; those of merged ones are kept, as other pieces hold them too ("word," and "word.")."""
        ids = self.parts.get(piece)
        if ids is None:
            ids = self.older_parts.get(piece)
            if ids is None:
                raw = piece.encode()
                token = self.whole(raw)
                ids = (token,) if token >= 0 else tuple(self.merged(raw))
            if len(piece) <= MEMO_CHARS:
                if len(self.parts) >= MEMO:
                    self.parts, self.older_parts = {}, self.parts
                self.parts[piece] = ids
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that is not in ``memo``; when that is full it becomes ``older``, which is then forgotten."""
        ids = self.older.get(piece)
        if ids is None:
            found = self.find(piece)
            ids = self.pretoken(piece) if len(found) == 1 else tuple(chain.from_iterable(map(self.pretoken, found)))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.odd_space(text):  # white space next to a space: cut by the pattern alone
            pieces = self.find(text)
        else:
            # a space between two other characters always begins a pre-token
            pieces = text.split(" ")
            pieces[1:] = [" " + p for p in pieces[1:]]
        return list(chain.from_iterable([self.memo.get(p) or self.piece(p) for p in pieces]))

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


CODECS: dict[str, Codec] = {}


class Vocabulary:
    """A vocabulary as tasks receive it, with its perfect hash; each worker builds its codec once."""

    def __init__(self, path: str, pattern: str):
        self.tokens, self.pattern = read_ranks(path), pattern
        self.hash = PerfectHash(self.tokens)
        self.name = xxhash.xxh3_128_hexdigest(pattern.encode() + b"\0" + b"\0".join(self.tokens))

    def codec(self) -> Codec:
        if self.name not in CODECS:
            CODECS[self.name] = Codec(self.tokens, self.pattern, self.hash)
        return CODECS[self.name]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def map_texts(df: DataFrame, column: str, added: dict[str, str], rows) -> DataFrame:
    """``df`` with the columns ``added`` (name: type), which ``rows(values)`` gives as one list for each column."""
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()])
    names = [f.name for f in kept]

    out = to_arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(start, PIECE_ROWS)
                made = rows(part.column(column).to_pylist())
                columns = [part.column(n) for n in names] + [pa.array(made[n], out.field(n).type) for n in added]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(batches, schema)


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array."""

    def rows(values):
        codec = vocab.codec()
        return {ids: [codec.encode(v or "") for v in values]}

    return map_texts(df, text, {ids: "array<int>"}, rows)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the tokens ``ids``; null ids give no bytes."""

    def rows(values):
        codec = vocab.codec()
        return {decoded: [codec.decode(v or ()) for v in values]}

    return map_texts(df, ids, {decoded: "binary"}, rows)


def round_trip(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` and SHA-256 digests of the decimal ids and of the bytes decoded from them, in one pass.

    With ``ids`` the token ids come along in a column of that name.
    """
    names = [str(i) for i in range(len(vocab.tokens))]
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({ids: "array<int>"} if ids else {})

    def rows(values):
        codec = vocab.codec()
        out = {name: [] for name in added}
        for value in values:
            found = codec.encode(value or "")
            out["n_tokens"].append(len(found))
            out["ids_sha256"].append(sha256(" ".join([names[i] for i in found]).encode()).hexdigest())
            out["decoded_sha256"].append(sha256(codec.decode(found)).hexdigest())
            if ids:
                out[ids].append(np.array(found, dtype=np.int32))
        return out

    return map_texts(df, text, added, rows)
