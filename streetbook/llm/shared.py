"""Helpers that the text operators share: stored tables, hot keys, connected groups."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has more than this part of all rows, so there are at most ``HOT_PARTS`` hot keys.
HOT_PARTS = 1000
#: Characters that separate words, as in the pattern ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"

ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master gets one of its own where the session names none.

    On a cluster each executor would write to its own disk there, so a missing folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="streetbook-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: later steps neither repeat it nor depend on executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sets_aside(*names: str) -> Callable:
    """For an operator whose first argument is a table and that uses ``names`` for columns of its own.

    Columns of the table with such a name are renamed meanwhile, and stand in the result as they were.
    """

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            taken, aside = {c.lower() for c in docs.columns} | set(names), {}
            for name in docs.columns:
                if name.lower() in names:
                    aside[name] = f"{name}_"
                    while aside[name].lower() in taken:
                        aside[name] += "_"
                    taken.add(aside[name].lower())
            if not aside:
                return operator(docs, *args, **kwargs)
            args = [aside.get(a, a) if isinstance(a, str) else a for a in args]
            kwargs = {k: aside.get(a, a) if isinstance(a, str) else a for k, a in kwargs.items()}
            out = operator(docs.withColumnsRenamed(aside), *args, **kwargs)
            back = {new: old for old, new in aside.items() if new in out.columns}
            return out.drop(*back.values()).withColumnsRenamed(back)

        return run

    return wrap


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z alone. Spark's ``lower`` does just that where a text has no other character than ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(plain, F.lower(text)).otherwise(mapped)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """Equi join of ``left`` with ``right``, which has one row per key and in ``count`` the key's rows on the left.

    Keys with more than 1/``HOT_PARTS`` of all counted rows are at most ``HOT_PARTS`` rows of the right side: these are
    broadcast, and their left rows stay where they are. All other keys are joined by a shuffle in which no key has more
    than that part. ``right`` should be stored, as it is read several times; ``how`` is ``left`` or ``inner``.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(right.filter(F.col(count) > max(total / HOT_PARTS, 1000)))
    values = [c for c in right.columns if c != key]
    if hot.isEmpty():
        return left.join(right, key, how)
    names = {c: f"_hot_{c}" for c in values}
    marked = left.join(hot.select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    cold = marked.filter("_hot is null").drop("_hot", *names.values()).join(right, key, how)
    warm = marked.filter("_hot").select(*left.columns, *[F.col(n).alias(c) for c, n in names.items()])
    return cold.select(*warm.columns).unionByName(warm)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (columns ``a``, ``b``): the label is the smallest node of its group.

    Large and small stars in turn until nothing changes: each round sends every edge to the smallest neighbour, and the
    number of rounds grows with the logarithm of the longest path. Each round is stored; hubs are joined as hot keys.
    """
    kind = edges.schema["a"].dataType
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sums["n"] == 0 or (sums["n"], sums["s"]) == mark:
            break
        mark = (sums["n"], sums["s"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        low = low.withColumn("m", F.least("a", "m"))
        large = join_counted(both, low, "a", "n", "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_counted(large, low, "a", "n", "inner")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(moved.filter("a <> b").distinct())
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    hubs = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.unionByName(hubs).select(F.col("node").cast(kind), F.col("label").cast(kind))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart until now."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Sorted batches of numbers as columns in which no key (the first ``keys`` columns) is cut in two.

    With them come the begin and end of each key's rows.
    """
    held: list[np.ndarray] = []

    def grouped(rows):
        change = np.flatnonzero(np.any([np.diff(k) != 0 for k in rows[:keys]], axis=0)) + 1
        return rows, np.concatenate([[0], change]), np.concatenate([change, [len(rows[0])]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
        # the last key may go on in the next batch
        other = np.flatnonzero(np.any([k != k[-1] for k in rows[:keys]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield grouped([r[:cut] for r in rows])
    if held:
        yield grouped(held)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[2]
    return x ^ (x >> np.uint64(29))


PACKED = "bucket int, spans boolean, rows binary"


def packed(rows: pa.RecordBatch | pa.Table, doc: np.ndarray, row: np.ndarray, buckets: int, spans: bool) -> pa.RecordBatch:
    """Rows dealt to buckets by their document: one compressed block of Arrow data for each bucket."""
    where = (mixed(mixed(doc.view(np.uint64)) + row.view(np.uint64)) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) > 0])) if len(order) else np.zeros(0, np.int64)
    groups = np.split(order, bounds[1:]) if len(order) else []
    blocks = []
    for group in groups:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write(rows.take(pa.array(group)))
        blocks.append(sink.getvalue().to_pybytes())
    columns = [pa.array([int(where[g[0]]) for g in groups], pa.int32()), pa.array([spans] * len(groups), pa.bool_())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.binary())], names=["bucket", "spans", "rows"])


def opened(blocks: list[bytes]) -> list[pa.Table]:
    return [pa.ipc.open_stream(b).read_all() for b in blocks]


def deal_rows(rows: DataFrame, doc: str, row: str, buckets: int, spans: bool) -> DataFrame:
    """``rows`` ``PACKED``: those of one document (``doc``, and ``row`` where one identifier has several texts) share a bucket.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column(doc).cast(pa.int64()), 0).to_numpy()
            yield packed(batch, ids, batch.column(row).to_numpy(False).astype(np.int64), buckets, spans)

    return rows.mapInArrow(deal, PACKED)
