"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn by a generator seeded with its code point; so has the gap between
words. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by its place in the n-gram. A text's vector
bundles (adds) the vectors of all its n-grams; a language's prototype bundles those of its labelled texts. A text gets the
language whose prototype has the largest cosine with its vector, and that cosine, cut to 0..1, as score.

Text is lower-cased, each run of other characters than letters is one gap, and gaps stand at both ends. Null texts and texts
without a letter get ``und`` and score 0, and so does every text when there is nothing to learn from. Equal cosines go to
the language that comes first. Whole texts count; each task holds the n-grams of a few texts at a time, and very long ones
are taken in pieces. The model is one vector for each language (at most ``max_languages``, or it is an error), whatever the
number of documents: tasks add up their own texts by language and send one row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
DIM = 1024
GRAM = 3
#: Characters whose n-grams are gathered at once in a task, and rows of n-gram vectors made at once.
CHUNK = 1 << 20
ROWS = 1 << 13
GAP = 0x20


def symbols(text: str) -> Iterator[np.ndarray]:
    """Code points in lower case with one gap for each run of other characters than letters and at both ends.

    They come in pieces; each begins with the last n - 1 of the piece before, so that every n-gram lies in one piece.
    """
    text, held = text.lower(), np.array([GAP], dtype=np.uint32)
    for start in range(0, len(text) + 1, CHUNK):
        points = np.frombuffer(text[start : start + CHUNK].encode("utf-32-le"), dtype=np.uint32)
        ends = [GAP] if start + CHUNK > len(text) else []
        points = np.concatenate([held, np.where(_letters()[points], points, GAP), ends]).astype(np.uint32)
        points = points[np.concatenate([[True], (points[1:] != GAP) | (points[:-1] != GAP)])]
        yield points
        held = points[1 - GRAM :]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(points: np.ndarray) -> np.ndarray:
    """One number for each n-gram: its code points in base 2**21."""
    n = len(points) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    for k in range(GRAM):
        out = (out << 21) | points[k : k + n].astype(np.int64)
    return out


@lru_cache(maxsize=4096)
def letter(point: int, dim: int) -> np.ndarray:
    return np.random.default_rng(point).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """The bound vector of each n-gram, one row each."""
    out = np.ones((len(codes), dim), dtype=np.float32)
    for k in range(GRAM):
        points, which = np.unique((codes >> (21 * (GRAM - 1 - k))) & 0x1FFFFF, return_inverse=True)
        table = np.stack([np.roll(letter(int(p), dim), GRAM - 1 - k) for p in points]).astype(np.float32)
        out *= table[which]
    return out


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, sorted, and how often each occurs."""
    codes, n, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def merge():
        found, more = np.unique(np.concatenate(held), return_counts=True)
        both, which = np.unique(np.concatenate([codes, found]), return_inverse=True)
        return both, np.bincount(which, np.concatenate([n, more]), len(both)).astype(np.int64)

    for text in texts:
        for points in symbols(text):
            held.append(grams(points))
            if sum(map(len, held)) >= CHUNK:
                codes, n = merge()
                held = []
    if held and not len(codes):  # the usual case, without a second sort
        return np.unique(np.concatenate(held), return_counts=True)
    return merge() if held else (codes, n)


def bundles(texts: list[str], dim: int) -> np.ndarray:
    """One bundled vector for each text."""
    out, start = np.zeros((len(texts), dim), dtype=np.float32), 0
    while start < len(texts):
        held, end, size = [], start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            held.append(counted([texts[end]]))
            size += len(texts[end])
            end += 1
        codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        bounds = np.cumsum([0] + [len(c) for c, _ in held])
        for low in range(0, len(codes), ROWS):
            table = vectors(codes[low : low + ROWS], dim)
            for i, (_, n) in enumerate(held):
                mine = which[bounds[i] : bounds[i + 1]]  # rising, as codes are sorted
                a, b = np.searchsorted(mine, [low, low + ROWS])
                if b > a:
                    out[start + i] += n[a:b].astype(np.float32) @ table[mine[a:b] - low]
        start = end
    return out


@dataclass
class Profiles:
    """Prototypes, one row for each language; the languages are sorted."""

    languages: list[str]
    prototypes: np.ndarray
    dim: int = DIM

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            found = bundles([texts[i] for i in known], self.dim).astype(np.float64)
            unit = self.prototypes / np.maximum(np.linalg.norm(self.prototypes, axis=1, keepdims=True), 1e-12)
            cosine = found @ unit.T / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            for i, best, row in zip(known, cosine.argmax(axis=1), cosine):
                names[i], scores[i] = self.languages[best], float(min(1.0, max(0.0, row[best])))
        return names, scores


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, max_languages: int = 4096) -> Profiles:
    """Prototypes from rows with a text and a language; rows that lack either teach nothing."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(t)
            if len(sums.keys() | by_lang.keys()) > max_languages:
                raise ValueError(f"more than {max_languages} languages")
            for name, texts in by_lang.items():
                total = sums.setdefault(name, np.zeros(dim))
                for part in pieces(texts):
                    codes, n = counted(part)
                    for low in range(0, len(codes), ROWS):
                        total += n[low : low + ROWS].astype(np.float32) @ vectors(codes[low : low + ROWS], dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "bundle"],
        )

    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    parts = rows.mapInArrow(add, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("at", "x"))
    # sums of whole numbers, the same in any order
    summed = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    found = sorted((r["lang"], r["v"]) for r in whole.limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return Profiles([name for name, _ in found], np.array([v for _, v in found], dtype=np.float64).reshape(len(found), dim), dim)


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about ``CHUNK`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; new columns replace old ones of their name."""
    kept = [f for f in docs.schema.fields if f.name not in (lang, score)]
    schema = T.StructType(kept + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = profiles.predict(part.column(text).to_pylist())
                columns = [part.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: its CRC-32 modulo 4 is 2. A null identifier is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))
