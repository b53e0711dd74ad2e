"""Token counts of flat, unindexed token files by a scan for separators.

A token file is nothing but identifiers of two bytes (little-endian), one document after the other, each closed by the
end-of-document identifier. ``write_tokens`` lets Spark write such files; ``count_tokens`` reads any. A file is cut into
blocks; in each block one vectorised comparison finds the separators. What lies between two separators of a block is a whole
document. What stands before the first and after the last is a piece: a prefix scan over the blocks of a file gives every
piece the number of its document and adds the pieces up, so documents may run over any number of blocks.

Documents may carry a header, some leading identifiers that name them: ``write_tokens`` writes the document's id in base
32,768 as five digits, a sixth before them telling null, positive and negative ids apart. The header is no token of the text.

Tokens after the last separator of a file are a document without end; it counts, with ``closed`` false. An empty file has no
documents. Null and empty texts are documents of 0 tokens. A file of odd length is an error. Repeated ids stay repeated.
Spark hands a file to a task as one value, so a file may have up to 2 GB; ``write_tokens`` writes one per input split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from streetbook.llm.byte_bpe import read_ranks
from streetbook.llm.shared import shared_folder

#: Identifiers in a block.
BLOCK = 1 << 20
BASE, DIGITS = 32_768, 5
HEADER = DIGITS + 1


def header(doc_id: int | None) -> list[int]:
    """The id as leading identifiers, all below any end-of-document identifier that is at least ``BASE``."""
    if doc_id is None:
        return [0] * HEADER
    rest, digits = abs(doc_id), []
    for _ in range(DIGITS):
        rest, digit = divmod(rest, BASE)
        digits.append(digit)
    return [2 if doc_id < 0 else 1, *digits[::-1]]


def header_id(head: Column) -> Column:
    """The id that a header (an array) tells. Added up from signed digits, so that no id overflows."""
    sign = F.when(F.get(head, F.lit(0)) == 2, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    value = F.lit(0).cast("long")
    for k in range(1, HEADER):
        value = value * BASE + sign * F.get(head, F.lit(k))
    return F.when(F.get(head, F.lit(0)) > 0, value)


def write_tokens(docs: DataFrame, ranks_path: str, pattern: str, eod: int, doc_id: str = "doc_id", text: str = "text") -> str:
    """Tokenise ``text`` and write flat files to the shared folder; returns their folder.

    Spark's text writer puts the bytes of each row and then the separator, which here are the two bytes of ``eod``.
    """
    if not BASE <= eod < 65_536:
        raise ValueError(f"the end-of-document identifier must be {BASE} to 65535")
    tokens = read_ranks(ranks_path)
    if len(tokens) > eod:
        raise ValueError("the end-of-document identifier is a token")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(ids), 256):
                some = zip(ids[start : start + 256], texts.slice(start, 256).to_pylist())
                rows = [np.array(header(i) + made.encode_ordinary(t or ""), dtype="<u2").tobytes() for i, t in some]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    rows = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(encode, "value binary")
    path = f"{shared_folder(docs.sparkSession)}/llm-tokens-{uuid.uuid4().hex}"
    separator = eod.to_bytes(2, "little").decode("latin-1")
    # the cast keeps the bytes as they are
    rows.select(F.col("value").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)
    return path


def scan_blocks(spark: SparkSession, path: str, eod: int, head: int = 0, block: int = BLOCK) -> DataFrame:
    """Pieces of documents in each block: ``(file, block, piece, start, n, ends, head)``.

    ``piece`` numbers the pieces of a block from 0, ``start`` counts identifiers from the begin of the file, ``ends`` tells
    whether the separator follows, ``head`` holds those of the document's first ``head`` identifiers that may lie in the
    piece (the first of a block may go on in the middle of a header).
    """
    schema = "file string, block long, piece long, start long, n long, ends boolean, head array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = content.as_buffer()
                if view.size % 2:
                    raise ValueError(f"{name} ends within an identifier")
                ids = np.frombuffer(view, dtype="<u2")
                for number, low in enumerate(range(0, len(ids), block)):
                    part = ids[low : low + block]
                    at = np.flatnonzero(part == eod)
                    begins = np.concatenate([[0], at + 1])
                    stops = np.concatenate([at, [len(part)]])
                    if begins[-1] == len(part):  # nothing after the last separator
                        begins, stops = begins[:-1], stops[:-1]
                    take = np.minimum(stops - begins, head)
                    offsets = np.concatenate([[0], np.cumsum(take)])
                    places = np.repeat(begins - offsets[:-1], take) + np.arange(offsets[-1])
                    heads = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(part[places], pa.int32()))
                    n = len(begins)
                    columns = [pa.array([name] * n, pa.string()), pa.array(np.full(n, number), pa.int64()), pa.array(np.arange(n), pa.int64())]
                    columns += [pa.array(begins + low, pa.int64()), pa.array(stops - begins, pa.int64()), pa.array(np.arange(n) < len(at)), heads]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "piece", "start", "n", "ends", "head"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, schema)


def count_tokens(spark: SparkSession, path: str, eod: int, head: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each document of the token files: ``(file, number, start, n_tokens, closed, head)``.

    ``number`` counts the documents of a file from 0, ``n_tokens`` leaves out the ``head`` leading identifiers.
    """
    pieces = scan_blocks(spark, path, eod, head, block)
    # a block in one row: separators, and whether the document before goes on in it
    inside = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("_ends"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_ends").over(inside), F.lit(0))).drop("_ends")
    numbered = pieces.join(before, ["file", "block"]).withColumn("number", F.col("_before") + F.col("piece"))
    # only the first and last piece of a block can belong to a document of several pieces
    whole = numbered.groupBy("file", "number").agg(
        F.min("start").alias("start"),
        F.sum("n").alias("_n"),
        F.max("ends").alias("closed"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "head"))), lambda p: p["head"])).alias("head"),
    )
    whole = whole.withColumn("head", F.slice("head", 1, head) if head else F.array().cast("array<int>"))
    return whole.select("file", "number", "start", (F.col("_n") - F.size("head")).alias("n_tokens"), "closed", "head")
