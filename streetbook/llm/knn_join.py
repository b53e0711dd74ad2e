"""Exact top-k search by inner product of integer vectors: a Voronoi join of queries and data.

Components become ``floor(scale * x)``. Up to ``PIVOTS`` data vectors of each length are pivots, drawn by a hash, and every
vector belongs to the cell of its nearest pivot. What a cell is like is summarised by its row count, its largest distance r to the
pivot p and its largest norm. As q.x = q.p + q.(x - p), no row of a cell scores above q.p + |q| r, nor above |q| |x|.

Pivots are data rows, so a query's exact scores with all of them give a score that its ``top`` rows reach at least. Queries of
neighbouring cells form blocks of about ``BLOCK``. For each block and cell the bounds turn into a least distance to the pivot:
nearer rows cannot be among the answers of any of its queries. Only rows beyond it, and with the norm that the block needs, are
copied to the block. Its rows are laid out in slices of about ``SLICE`` by the counts of the summaries, so large cells and
data that cannot be pruned spread over all tasks. A task streams one slice past the queries of its block and keeps their
best; answers of slices are merged by rank. Scores are exact: double precision while all sums stay below 2^53, integers beyond.

Equal vectors are one row with their smallest ``top + 1`` identifiers, more cannot be among an answer; equal queries are asked
once and the answer is joined to their identifiers, common ones as hot keys. So a vector that fills a third of the table is one row.

Pivots, cell summaries and block bounds pass the driver: at most ``PIVOTS`` vectors, as many summary rows for each length, and
one bound for each cell and block, of which there are ``MAX_BLOCKS`` at most (blocks grow beyond that).

Null or empty vectors, those with null or non-finite components and rows without identifier take no part, neither do vectors
whose squared integer norm reaches 2^62, as their scores do not fit a long. Zero vectors do take part. Vectors of different length never meet. Rows that
repeat identifier and vector count once; an identifier with several vectors is several rows, and none of them is a candidate for
itself. Equal scores go to the smaller identifier. A query with fewer candidates gets all of them. Empty tables give empty
results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import join_counted, mixed, stored, tasks

PIVOTS, BLOCK, MAX_BLOCKS, SLICE = 128, 1024, 4096, 8192
#: Rows that are copied or multiplied at once.
STEP = 2048
LIMIT = 2.0**62

CELLED = "dim int, v binary, ids array<long>, cell int, radius double, norm double"
PARTS = "block int, slice int, kind int, n int, ids binary, sizes binary, v binary"
FOUND = "v binary, dim int, score long, vec_id long"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def integers(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """Distinct ``(id, dim, v)`` of the rows that take part; ``v`` holds 64-bit integers."""
    v = F.col(vector).cast("array<double>")
    good = rows.filter(F.col(vec_id).isNotNull() & usable(v)).select(F.col(vec_id).cast("long").alias("id"), v.alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            bounds = column.offsets.to_numpy()
            flat = np.floor(column.values.to_numpy() * scale)
            norms = np.add.reduceat(flat * flat, bounds[:-1]) if batch.num_rows else np.zeros(0)
            kept = np.flatnonzero(norms < LIMIT)
            whole = np.where(np.abs(flat) < 2.0**62, flat, 0).astype(np.int64)
            out = [whole[bounds[i] : bounds[i + 1]].tobytes() for i in kept]
            columns = [batch.column("id").take(pa.array(kept)), pa.array(np.diff(bounds)[kept].astype(np.int32)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "v"])

    return good.mapInArrow(work, "id long, dim int, v binary").distinct()


def matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(len(column), dim)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows and pivots. A relative error of the squares is added, so that a bound made of them stays one."""
    a, b = (x * x).sum(axis=1)[:, None], (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(a + b - 2 * (x @ pivots.T), 0) + 1e-12 * (a + b))


class Cells:
    """The pivots of all lengths; a cell has the number of its pivot."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["dim"], r["v"]))
        self.dims = [r["dim"] for r in rows]
        self.first = {d: self.dims.index(d) for d in dict.fromkeys(self.dims)}
        self.pivots = {d: matrix([r["v"] for r in rows if r["dim"] == d], d).astype(np.float64) for d in self.first}
        self.shared = {d: [len(r["ids"]) for r in rows if r["dim"] == d] for d in self.first}

    def order(self) -> list[int]:
        """All cells so that near ones follow each other: from each on to the nearest that is left."""
        out = []
        for dim, pivots in self.pivots.items():
            apart, left, at = distances(pivots, pivots), set(range(len(pivots))), 0
            while left:
                out.append(self.first[dim] + at)
                left.discard(at)
                at = min(left, key=lambda j: (apart[at, j], j)) if left else 0
        return out

    def place(self, rows: DataFrame) -> DataFrame:
        """``CELLED`` of ``(dim, v, ids)``."""
        first, pivots = self.first, self.pivots

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
                radius, norm = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    x = matrix(batch.column("v").take(pa.array(at)).to_pylist(), int(dim)).astype(np.float64)
                    norm[at] = np.sqrt((x * x).sum(axis=1))
                    apart = distances(x, pivots[int(dim)])
                    cell[at] = apart.argmin(axis=1) + first[int(dim)]
                    radius[at] = apart.min(axis=1)
                columns = [*batch.columns, pa.array(cell), pa.array(radius), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "v", "ids", "cell", "radius", "norm"])

        return rows.select("dim", "v", "ids").mapInArrow(work, CELLED)


class Blocks:
    """Queries by block: cells in their order are packed until a block is full, and large cells take several blocks."""

    def __init__(self, counts: dict[int, int], cells: Cells, block: int, most: int):
        block = max(block, -(-2 * sum(counts.values()) // most))
        self.of: dict[int, tuple[int, int]] = {}
        self.dim: list[int] = []
        held = block
        for cell in cells.order():
            n, dim = counts.get(cell, 0), cells.dims[cell]
            if not n:
                continue
            if held + n > block or self.dim[-1] != dim:
                parts = -(-n // block)
                self.of[cell] = (len(self.dim), parts)
                self.dim += [dim] * parts
                held = n if parts == 1 else block
            else:
                self.of[cell] = (len(self.dim) - 1, 1)
                held += n

    def deal(self, cell: np.ndarray, v: list[bytes]) -> np.ndarray:
        """The block of each query; queries of a large cell are dealt by their content."""
        first, parts = (np.array([self.of[c][k] for c in cell.tolist()], dtype=np.int64) for k in (0, 1))
        some = np.array([np.frombuffer(x, dtype=np.uint64).sum(dtype=np.uint64) if p > 1 else 0 for x, p in zip(v, parts)], dtype=np.uint64)
        return first + (mixed(mixed(some)) >> np.uint64(8)).astype(np.int64) % np.maximum(parts, 1)


def bounds(queries: np.ndarray, pivots: np.ndarray, shared: list[int], top: int) -> tuple[np.ndarray, float]:
    """For each cell the least distance to its pivot, and the least norm, that a row needs to be of use to one of ``queries``."""
    scores, length = queries @ pivots.T, np.sqrt((queries * queries).sum(axis=1))
    # the score that top + 1 rows reach, of which one may be the query itself
    order = np.argsort(-scores, axis=1, kind="stable")
    reached = np.cumsum(np.array(shared)[order], axis=1) >= top + 1
    at = np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1)
    least = np.where(reached.any(axis=1), np.take_along_axis(scores, at, axis=1)[:, 0], -np.inf)
    least = least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) - 1  # beyond all rounding
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.where(length[:, None] > 0, (least[:, None] - scores) / length[:, None], -np.inf)
        norm = np.where(length > 0, least / length, -np.inf)
    return near.min(axis=0), float(norm.min())


def part(block: int, slice_: int, kind: int, ids: list[list[int]], v: list[bytes]) -> tuple:
    sizes = np.array([len(i) for i in ids], dtype=np.int32)
    flat = np.array([x for i in ids for x in i], dtype=np.int64)
    return block, slice_, kind, len(v), flat.tobytes(), sizes.tobytes(), narrow(b"".join(v))


def narrow(v: bytes) -> bytes:
    """64-bit integers in the smallest type that holds them all; the first byte tells which."""
    x = np.frombuffer(v, dtype=np.int64)
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def widened(v: bytes) -> np.ndarray:
    return np.frombuffer(v, dtype=f"<i{v[0]}", offset=1).astype(np.int64)


def parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 4 + [pa.binary()] * 3
    names = [p.split()[0] for p in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class Best:
    """The best rows so far of each query of a block."""

    def __init__(self, queries: np.ndarray, top: int):
        self.queries, self.top = queries, top
        self.length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
        self.double = queries.astype(np.float64)
        self.score = np.full((len(queries), 0), 0, dtype=np.int64)
        self.first = np.full((len(queries), 0), 0, dtype=np.int64)
        self.place = np.full((len(queries), 0), 0, dtype=np.int64)
        self.ids: list[list[int]] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        double = x.astype(np.float64)
        if self.length * np.sqrt((double * double).sum(axis=1)).max(initial=0) < 2.0**52:
            return (self.double @ double.T).astype(np.int64)
        out = np.empty((len(self.queries), len(x)), dtype=np.int64)
        for i, q in enumerate(self.queries):
            out[i] = x @ q
        return out

    def add(self, x: np.ndarray, ids: list[list[int]]) -> None:
        """Rows with their identifiers, each row's smallest first. Equal scores go to the smaller identifier."""
        order = np.argsort([i[0] for i in ids], kind="stable")
        x, ids = x[order], [ids[i] for i in order]
        first = np.array([i[0] for i in ids], dtype=np.int64)
        scores = self.scores(x)
        if scores.shape[1] > self.top:
            # all above the score at rank top, and of those equal to it the first ones
            edge = np.partition(scores, scores.shape[1] - self.top, axis=1)[:, scores.shape[1] - self.top, None]
            above, level = scores > edge, scores == edge
            room = self.top - above.sum(axis=1)[:, None]
            taken = above | (level & (np.cumsum(level, axis=1) <= room))
            place = np.nonzero(taken)[1].reshape(len(scores), self.top)
        else:
            place = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        new = np.take_along_axis(scores, place, axis=1)
        score = np.concatenate([self.score, new], axis=1)
        one = np.concatenate([self.first, first[place]], axis=1)
        at = np.concatenate([self.place, place + len(self.ids)], axis=1)
        self.ids += ids
        rank = np.lexsort((one, -score), axis=1)[:, : self.top]
        self.score, self.first, self.place = (np.take_along_axis(m, rank, axis=1) for m in (score, one, at))
        used, self.place = np.unique(self.place, return_inverse=True)
        self.place = self.place.reshape(self.score.shape)
        self.ids = [self.ids[i] for i in used]

    def rows(self, dim: int, v: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(i) for i in self.ids], dtype=np.int64)
        flat = np.array([x for i in self.ids for x in i], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        many = sizes[self.place.ravel()] if len(sizes) else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.repeat(np.arange(len(v)), self.score.shape[1]), many)
        ends = np.cumsum(many)
        at = np.repeat(starts[self.place.ravel()] if len(sizes) else many, many) + np.arange(len(of)) - np.repeat(ends - many, many)
        columns = [pa.array(v, pa.binary()).take(pa.array(of)), pa.array(np.full(len(of), dim, dtype=np.int32))]
        columns += [pa.array(np.repeat(self.score.ravel(), many)), pa.array(flat[at])]
        return pa.RecordBatch.from_arrays(columns, names=["v", "dim", "score", "vec_id"])


def nearest(
    rows: DataFrame, queries: DataFrame, top: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    pivots: int = PIVOTS, block: int = BLOCK, slice_rows: int = SLICE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` rows with the largest inner product for each query but the query's own."""
    spark = rows.sparkSession
    keep = top + 1
    ranked = F.row_number().over(W.Window.partitionBy("dim", "v").orderBy("id"))
    few = integers(rows, vec_id, vector, scale).withColumn("_rank", ranked).filter(F.col("_rank") <= keep)
    data = stored(few.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    drawn = F.row_number().over(W.Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v"))
    cells = Cells(data.withColumn("_drawn", drawn).filter(F.col("_drawn") <= pivots).select("dim", "v", "ids").collect())
    data = stored(cells.place(data))
    asked = stored(integers(queries, vec_id, vector, scale))
    # a query that is no data row has no cell where no row has its length; it has no candidate either
    distinct = asked.filter(F.col("dim").isin(list(cells.first))).groupBy("dim", "v").agg(F.count("*").alias("ids"))
    distinct = stored(cells.place(distinct.withColumn("ids", F.array("ids"))))
    counts = {r["cell"]: r["n"] for r in distinct.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = Blocks(counts, cells, block, MAX_BLOCKS)

    def limits(key: tuple, group: pa.Table) -> pa.Table:
        dim = blocks.dim[key[0].as_py()]
        near, norm = None, None
        q = matrix(group.column("v").to_pylist(), dim).astype(np.float64)
        for i in range(0, len(q), STEP):
            some = bounds(q[i : i + STEP], cells.pivots[dim], cells.shared[dim], top)
            near, norm = some if near is None else (np.minimum(near, some[0]), min(norm, some[1]))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "near": pa.array([near.tolist()]), "norm": pa.array([norm])})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").to_pylist()
            where = blocks.deal(batch.column("cell").to_numpy(), v)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), batch.column("v")], names=["block", "v"])

    in_blocks = distinct.select("cell", "v").mapInArrow(dealt, "block int, v binary")
    found = in_blocks.groupBy("block").applyInArrow(limits, "block int, near array<double>, norm double").collect()
    near = {r["block"]: np.array(r["near"]) for r in found}
    norm = {r["block"]: r["norm"] for r in found}
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    slices = dict.fromkeys(near, 0)
    for r in summary:
        for b in near:
            if blocks.dim[b] == cells.dims[r["cell"]] and r["radius"] >= near[b][r["cell"] - cells.first[blocks.dim[b]]] and r["norm"] >= norm[b]:
                slices[b] += r["n"]
    slices = {b: -(-n // slice_rows) for b, n in slices.items() if n}

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to the blocks that need them."""
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                dims, cell, radius, norms = (batch.column(c).to_numpy() for c in ("dim", "cell", "radius", "norm"))
                v, ids = batch.column("v").to_pylist(), batch.column("ids").to_pylist()
                for b, n in slices.items():
                    dim = blocks.dim[b]
                    mine = np.flatnonzero(dims == dim)
                    far = radius[mine] >= near[b][cell[mine] - cells.first[dim]]
                    mine = mine[far & (norms[mine] >= norm[b])]
                    if len(mine):
                        to = int(mixed(np.array([ids[mine[0]][0]], dtype=np.int64).view(np.uint64))[0] >> np.uint64(9)) % n
                        yield parts_batch([part(b, to, 1, [ids[i] for i in mine], [v[i] for i in mine])])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every slice of their block."""
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                v = batch.column("v").to_pylist()
                where = batch.column("block").to_numpy()
                for b in np.unique(where).tolist():
                    one = part(b, 0, 0, [], [v[i] for i in np.flatnonzero(where == b)])
                    for s in range(slices.get(b, 0)):
                        yield parts_batch([(b, s, *one[2:])])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One slice after the other: its queries come first, then its rows stream past them."""
        at, asking, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                dim = blocks.dim[row["block"]]
                if at != (row["block"], row["slice"]):
                    if best is not None:
                        yield best.rows(*held)
                    at, asking, best = (row["block"], row["slice"]), [], None
                x = widened(row["v"]).reshape(row["n"], dim)
                if row["kind"] == 0:
                    asking.append(x)
                    continue
                if best is None:
                    best = Best(np.concatenate(asking), keep)
                    held = dim, [q.tobytes() for q in best.queries]
                ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.int32))
                flat = np.frombuffer(row["ids"], dtype=np.int64).tolist()
                best.add(x, [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
        if best is not None:
            yield best.rows(*held)

    work = data.mapInArrow(copies, PARTS).unionByName(in_blocks.mapInArrow(asks, PARTS))
    wide = max(tasks(spark), min(sum(slices.values()), 100_000))
    work = work.repartition(wide, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    ordered = W.Window.partitionBy("dim", "v").orderBy(F.desc("score"), "vec_id")
    best = work.mapInArrow(solve, FOUND).withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") <= keep)
    answer = F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("r"), "vec_id", "score"))).alias("answer")
    best = best.groupBy("dim", "v").agg(answer).withColumnRenamed("dim", "_dim")
    best = best.join(distinct.select("v", F.col("dim").alias("_dim"), F.col("ids")[0].alias("n")), ["_dim", "v"])
    pairs = join_counted(asked.select("id", key().alias("k")), stored(best.select(key("_dim").alias("k"), "answer", "n")), "k", "n", "inner")
    others = F.filter("answer", lambda a: a["vec_id"] != F.col("id"))
    flat = pairs.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, top)).alias("rank", "a"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))


def key(dim: str = "dim") -> Column:
    """One key from length and vector."""
    return F.struct(F.col(dim).alias("dim"), F.col("v").alias("v"))
