"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by their length, of which each class spans a factor of ``SPAN``, and by a hash of their content,
about ``SHARD`` to each, so a shard's build and memory stay the same at any size. In a shard every vector draws its highest level; level by level and from the top, a beam search from the entry
point finds the candidates of a new vector, a diversity rule picks its links, and the links are set both ways with the
weakest cut. New vectors come in batches that double: a batch searches the graph of those before it, and compares its own
members directly. At the end, nodes without a way from the entry point get one. The graph is one row: vectors, and per level a flat array of neighbour numbers of fixed width.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the shard's largest norm; a query has 0
there. So the nearest by distance are those with the largest product, for vectors of any length. As M is close to all norms of
its shard and points are scaled by the shard's largest component, single precision tells them apart whatever their length.

Equal vectors are one node with their smallest ``top + 1`` identifiers: no more of them can be among a query's ``top``, so
nothing is lost and a vector that fills a third of the table is one node. Queries go to the shards of their length: a shard is
read once for every ``PART`` of them, answers with each query's ``top`` rows scored exactly in double precision, and these are merged.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part, neither do rows without
identifier. Vectors of different length never meet. Rows that repeat identifier and vector count once as candidates and
queries. Ties go to the smaller identifier. With no candidates a query has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from streetbook.llm.shared import stored, tasks

#: Vectors of a shard, queries that meet one copy of a shard, queries searched at once.
SHARD, PART, BLOCK = 8192, 16384, 256
#: With at most so many shards the table of their numbers, one short row for each length, is broadcast.
FEW = 1_000_000
#: Links of a node on upper levels (twice as many on the lowest), beams of building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 128
BATCH = 256
#: The norms of a shard differ at most by this factor; norms of about one are inside a class, not at its end.
SPAN = 4
INDEX = "dim int, shard int, n int, ids array<array<long>>, vectors binary, levels array<binary>, entry int"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def norm_class(vector: Column) -> Column:
    """The class of a vector's norm, from components over the largest, so that no square is too large or too small."""
    largest = F.array_max(F.transform(vector, F.abs))
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.floor((F.log(largest) + F.log(square) / 2) / float(np.log(SPAN)) + 0.5).cast("int")


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Points of the vectors, scaled, with the further component that turns products into distances."""
    scaled = vectors / np.abs(vectors).max()
    squares = (scaled * scaled).sum(axis=1)
    return np.column_stack([scaled, np.sqrt(squares.max() - squares)]).astype(np.float32)


def once(pool: np.ndarray) -> np.ndarray:
    """The rows with -1 in place of what stands further left already."""
    order = np.argsort(pool, axis=1, kind="stable")
    in_order = np.take_along_axis(pool, order, axis=1)
    twice = np.zeros_like(pool, dtype=bool)
    np.put_along_axis(twice, order[:, 1:], in_order[:, 1:] == in_order[:, :-1], axis=1)
    return np.where(twice, -1, pool)


class Graph:
    """A navigable graph over the rows of ``points``, which are searched by squared distance."""

    def __init__(self, points: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.points, self.links, self.beam = points.astype(np.float32), links, beam
        self.norms = (self.points * self.points).sum(axis=1)
        n = len(points)
        # levels from a generator with a fixed seed: the same rows give the same graph
        draw = np.random.default_rng(n).random(n)
        height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 8)
        self.height, self.entry = height, 0 if n else -1
        self.neighbours: list[np.ndarray] = [
            np.full((n, 2 * links if level == 0 else links), -1, dtype=np.int32) for level in range(int(height.max(initial=0)) + 1)
        ]
        if n:
            self._build()
            self._connect()

    def _connect(self) -> None:
        """Give every node a way from the entry point on the lowest level, by a further link of its nearest reached node.

        Clusters that lie far apart, and nodes that others cut from their links, would else not be found.
        """
        table = np.pad(self.neighbours[0], ((0, 0), (0, 1)), constant_values=-1)
        reached = np.zeros(len(table) + 1, dtype=bool)
        reached[-1] = True  # stands for -1
        start = self.entry
        while True:
            front = np.array([start])
            while len(front):
                reached[front] = True
                front = np.unique(table[front])
                front = front[~reached[front]]
            if reached.all():
                break
            start = int(reached.argmin())
            near = self.norms - 2 * self.points @ self.points[start]
            holder = int(np.where(reached[:-1], near, np.inf).argmin())
            if (table[holder] >= 0).all():
                table = np.pad(table, ((0, 0), (0, 1)), constant_values=-1)
            table[holder, int((table[holder] < 0).argmax())] = start
        self.neighbours[0] = np.ascontiguousarray(table)

    def _build(self) -> None:
        n, done = len(self.points), 1
        top = int(self.height[0])
        while done < n:
            batch = np.arange(done, min(n, done + min(BATCH, done)))
            start = np.full((len(batch), 1), self.entry)
            for level in range(max(top, int(self.height[batch].max())), -1, -1):
                here = self.height[batch] >= level
                if level > top:
                    found = np.full((len(batch), 1), -1)
                else:
                    found, _ = self.search(self.points[batch], level, self.beam if here.any() else 1, start)
                    start = found[:, : self.beam]
                if here.any():
                    self._link(batch[here], found[here], level)
            if int(self.height[batch].max()) > top:
                best = batch[int(self.height[batch].argmax())]
                top, self.entry = int(self.height[best]), int(best)
            done += len(batch)

    def _link(self, batch: np.ndarray, found: np.ndarray, level: int) -> None:
        """Links of new nodes to those found and to each other, both ways."""
        table = self.neighbours[level]
        width = self.links
        inner = self.norms[batch][:, None] + self.norms[batch][None, :] - 2 * self.points[batch] @ self.points[batch].T
        np.fill_diagonal(inner, np.inf)
        near = np.argsort(inner, axis=1, kind="stable")[:, : min(len(batch) - 1, 2 * width)]
        pool = np.concatenate([found, batch[near]], axis=1)
        chosen = self._diverse(batch, pool, width)
        table[batch, :width] = chosen
        # the other way: all nodes that got a new link choose again among old and new ones
        back = np.repeat(batch, width)[(chosen >= 0).ravel()]
        to = chosen[chosen >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        more = np.full((len(nodes), int(counts.max(initial=0))), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(nodes)), counts), place] = back
        pool = once(np.concatenate([table[nodes], more], axis=1))
        full = (pool >= 0).sum(axis=1) > table.shape[1]
        packed = np.argsort(pool < 0, axis=1, kind="stable")
        pool = np.take_along_axis(pool, packed, axis=1)
        table[nodes[~full]] = pool[~full, : table.shape[1]]
        if full.any():
            table[nodes[full]] = self._diverse(nodes[full], pool[full], table.shape[1])

    def _diverse(self, nodes: np.ndarray, pool: np.ndarray, width: int) -> np.ndarray:
        """For each node up to ``width`` of its pool, nearest first, leaving out what is nearer to one already chosen.

        Places that stay free are filled with the nearest left out.
        """
        pool = np.where(pool == nodes[:, None], -1, pool)
        pool = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), axis=1)
        sizes = (pool >= 0).sum(axis=1)
        out, order, start = np.full((len(nodes), width), -1, dtype=np.int64), np.argsort(-sizes, kind="stable"), 0
        while start < len(order):  # few at a time where pools are long
            wide = max(1, int(sizes[order[start]]))
            part = order[start : start + max(1, 4_000_000 // wide**2)]
            out[part] = self._choose(nodes[part], pool[part, :wide], width)
            start += len(part)
        return out

    def _choose(self, nodes: np.ndarray, pool: np.ndarray, width: int) -> np.ndarray:
        pool = once(pool)
        distance = self._distances(self.points[nodes], self.norms[nodes], pool)
        order = np.argsort(distance, axis=1, kind="stable")
        pool, distance = np.take_along_axis(pool, order, axis=1), np.take_along_axis(distance, order, axis=1)
        live = int((pool >= 0).sum(axis=1).max(initial=0))
        pool, distance = pool[:, :live], distance[:, :live]
        vectors = self.points[np.maximum(pool, 0)]
        squares = self.norms[np.maximum(pool, 0)]
        between = squares[:, :, None] + squares[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(pool.shape, dtype=bool)
        for i in range(pool.shape[1]):
            nearer = (taken & (between[:, i, :] < distance[:, i, None])).any(axis=1)
            taken[:, i] = (pool[:, i] >= 0) & ~nearer & (taken.sum(axis=1) < width)
        rank = np.argsort(np.where(taken, 0, np.where(pool >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.full((len(nodes), width), -1, dtype=np.int64)
        out[:, : rank.shape[1]] = np.take_along_axis(pool, rank, axis=1)
        return out

    def _distances(self, queries: np.ndarray, squares: np.ndarray, pool: np.ndarray) -> np.ndarray:
        some = np.maximum(pool, 0)
        out = squares[:, None] + self.norms[some] - 2 * np.einsum("qd,qkd->qk", queries, self.points[some])
        return np.where(pool < 0, np.inf, out)

    def search(self, queries: np.ndarray, level: int, beam: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beam search on one level for all queries at once: nodes and distances, nearest first, -1 where there are fewer."""
        table, n, rows = self.neighbours[level], len(queries), np.arange(len(queries))
        squares = (queries * queries).sum(axis=1)
        seen = np.zeros((n, len(self.points) + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        nodes = np.full((n, beam), -1, dtype=np.int64)
        nodes[:, : min(beam, start.shape[1])] = start[:, :beam]
        seen[rows[:, None], nodes] = True
        distance = self._distances(queries, squares, nodes)
        opened = nodes < 0
        active = rows
        while len(active):
            waiting = np.where(opened[active], np.inf, distance[active])
            best = waiting.argmin(axis=1)
            going = np.isfinite(waiting[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            opened[active, best] = True
            fresh = table[nodes[active, best]].astype(np.int64)
            fresh = np.where(seen[active[:, None], fresh], -1, fresh)
            seen[active[:, None], fresh] = True
            far = self._distances(queries[active], squares[active], fresh)
            every = np.concatenate([distance[active], far], axis=1)
            keep = np.argsort(every, axis=1, kind="stable")[:, :beam]
            nodes[active] = np.take_along_axis(np.concatenate([nodes[active], fresh], axis=1), keep, axis=1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], fresh < 0], axis=1), keep, axis=1)
            distance[active] = np.take_along_axis(every, keep, axis=1)
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(distance, order, axis=1)

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Down from the entry point, with the whole beam on the lowest level."""
        start = np.full((len(queries), 1), self.entry)
        for level in range(len(self.neighbours) - 1, 0, -1):
            start = self.search(queries, level, 4, start)[0]
        return self.search(queries, 0, beam, start)[0]


def build_index(rows: DataFrame, top: int, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row for each shard (``INDEX``), stored."""
    v = F.col(vector).cast("array<double>")
    good = rows.filter(F.col(vec_id).isNotNull() & usable(v)).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    # as many identifiers of equal vectors as can be asked for: ranks are cut in each task before the shuffle
    first = W.Window.partitionBy("v").orderBy("id")
    few = good.distinct().withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= top + 1)
    distinct = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = stored(distinct.withColumn("dim", F.size("v")).withColumn("_norm", norm_class(F.col("v"))))
    sizes = distinct.groupBy("dim", "_norm").agg(F.ceil(F.count("*") / shard).alias("_shards"))
    before = W.Window.partitionBy("dim").orderBy("_norm").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_shards").over(before), F.lit(0)))
    number = F.col("_before") + F.pmod(F.xxhash64("v"), F.col("_shards"))
    dealt = distinct.join(F.broadcast(sizes), ["dim", "_norm"]).withColumn("shard", number.cast("int"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda c: c.map(lambda i: i[0]))
        vectors = np.stack(group["v"].to_numpy()).astype(np.float64)
        graph = Graph(lifted(vectors))
        row = (int(key[0]), int(key[1]), len(group), list(group["ids"]), vectors.tobytes(), [t.tobytes() for t in graph.neighbours], graph.entry)
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return stored(dealt.select("dim", "shard", "ids", "v").groupBy("dim", "shard").applyInPandas(build, INDEX))


def search_index(
    index: DataFrame, queries: DataFrame, top: int, vec_id: str = "vec_id", vector: str = "embedding", beam: int = SEARCH_BEAM
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``top`` rows of the index for each query but the query's own."""
    v = F.col(vector).cast("array<double>")
    asked = queries.filter(F.col(vec_id).isNotNull() & usable(v)).select(F.col(vec_id).cast("long").alias("query_id"), v.alias("v")).distinct()
    asked = asked.withColumn("dim", F.size("v"))
    parts, shards = max(1, -(-asked.count() // PART)), index.count()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.lit(parts)).cast("int"))
    # queries go to the shards, each of which is copied for every PART of them alone
    last = index.groupBy("dim").agg(F.max("shard").alias("last"))
    last = F.broadcast(last) if shards <= FEW else last
    visits = asked.join(last, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "part", "query_id", "v")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    place = (max(tasks(index.sparkSession), parts * max(1, shards)), "dim", "shard", "part")

    def find(shard: pa.Table, some: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if shard.num_rows and some.num_rows:
            n, dim, ids = (shard[c][0].as_py() for c in ("n", "dim", "ids"))
            vectors = np.frombuffer(shard["vectors"][0].as_py(), dtype=np.float64).reshape(n, dim)
            graph = Graph.__new__(Graph)
            graph.points = lifted(vectors)
            graph.norms = (graph.points * graph.points).sum(axis=1)
            graph.neighbours = [np.frombuffer(t, dtype=np.int32).reshape(n, -1) for t in shard["levels"][0].as_py()]
            graph.entry = shard["entry"][0].as_py()
            numbers = some["query_id"].to_pylist()
            asked = np.concatenate([c.flatten().to_numpy() for c in some["v"].chunks]).reshape(-1, dim)
            for begin in range(0, len(asked), BLOCK):
                q = asked[begin : begin + BLOCK]
                unit = q / np.abs(q).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                found = graph.nearest(np.column_stack([unit, np.zeros(len(q))]).astype(np.float32), max(beam, top + 1))
                for own, vector, nodes in zip(numbers[begin : begin + BLOCK], q, found):
                    nodes = nodes[nodes >= 0]
                    scores = (vectors[nodes] * vector).sum(axis=1)
                    rows = [(-float(x), other) for x, node in zip(scores, nodes) for other in ids[node] if other != own]
                    out += [(own, other, -x) for x, other in sorted(rows)[:top]]
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    keys = ("dim", "shard", "part")
    met = copies.repartition(*place).groupBy(*keys).cogroup(visits.repartition(*place).groupBy(*keys))
    found = met.applyInArrow(find, "query_id long, vec_id long, score double")
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding", **search) -> DataFrame:
    """The ``top`` rows with the largest inner product for each query, by an index over all rows."""
    return search_index(build_index(rows, top, vec_id, vector), queries, top, vec_id, vector, **search)
