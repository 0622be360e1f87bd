"""Exact top-k search by inner product: best-first search of an M-tree of paged metric nodes.

Integer vectors get one more component, ``sqrt(M^2 - |x|^2)`` with the greatest norm M, so that a larger inner product
is a smaller distance and the triangle inequality applies. The tree has three levels of nodes, none larger than a page:

- *pivots*: at most ``MAX_PIVOTS`` rows with the least hash of their id, known to all tasks. They only shape the tree.
- *subtrees*: runs of pages with one pivot and the range of their entries' distances to it.
- *pages*: at most ``PAGE`` entries with a routing object, its covering radius, and each entry's distance to it.

Vectors are dealt by range over (pivot, distance, id), so that thousands of equal vectors fill many pages. The queries
go in blocks to those subtrees whose bound can reach their k-th best score, there visit pages from the best bound
on, and compute only products that the stored distances cannot rule out. Scores come from integer arithmetic.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different length never meet.
A repeated id is a row of its own, of
which one asks; a query skips all rows of its own id. A null id is never a query, and never returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import Shared, arrow_schema, cut_lineage, map_batches

PAGE = 512
SUBTREE = 32  # pages
BLOCK = 256  # queries
GROUP = 16  # blocks that visit a subtree together
MAX_PIVOTS = 1024
ROWS_PER_PIVOT = 256

PLACED = "dim int, pivot int, dist double, vec_id long, v array<long>"
PAGES = "subtree long, dim int, pivot int, low double, high double, ids binary, matrix binary, extra binary, routing int, radius double, parents binary"
BLOCKS = "subtree long, grp long, dim int, ids binary, matrix binary, least binary"
FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in doubles where every sum fits, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def extra(matrix: np.ndarray, most: float) -> np.ndarray:
    """The added component of each row."""
    return np.sqrt(np.maximum(most - (matrix.astype(float) ** 2).sum(axis=1), 0.0))


def distances(a: np.ndarray, a_extra: np.ndarray, b: np.ndarray, b_extra: np.ndarray) -> np.ndarray:
    """Distances of rows with their added components."""
    x, y = a.astype(float), b.astype(float)
    square = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T) + (a_extra[:, None] - b_extra) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def reach(norms: np.ndarray, most: float, least: np.ndarray) -> np.ndarray:
    """The greatest product that a query of this squared norm can have at a distance of at least ``least``."""
    bound = (norms + most - np.maximum(least, 0.0) ** 2) / 2
    return bound + 1e-9 * (norms + most) + 0.5


def _by_dim(batches: Iterator[pa.RecordBatch], key: str = "dim") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches with one number of components, in order."""
    for batch in batches:
        dims = batch.column(key).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1], [True]])) if len(dims) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(dims[a]), batch.slice(a, b - a)


def _place(shared: Shared):
    schema = arrow_schema(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most = shared.value()
        for dim, part in _by_dim(batches):
            near, far = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
            if dim in pivots:
                m = _matrix(part.column("v"), dim)
                p = pivots[dim][1]
                for a in range(0, len(m), 1024):
                    x = m[a : a + 1024]
                    d = distances(x, extra(x, most), p, extra(p, most))
                    near[a : a + 1024], far[a : a + 1024] = d.argmin(axis=1), d.min(axis=1)
            columns = [pa.array(np.full(part.num_rows, dim, np.int32)), pa.array(near), pa.array(far), part.column("vec_id"), part.column("v").cast(schema.field("v").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _runs(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of at most ``most_rows`` rows with one dim and pivot: (dim, pivot, dist, ids, matrix); batches' ends end runs."""
    for dim, part in _by_dim(batches):
        pivots = part.column("pivot").to_numpy()
        dist, ids, m = part.column("dist").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("v"), dim)
        edges = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c in range(a, b, most_rows):
                e = min(c + most_rows, b)
                yield dim, int(pivots[a]), dist[c:e], ids[c:e], m[c:e]


def _build(most: float):
    schema = arrow_schema(PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, last, filled = TaskContext.get().partitionId(), -1, None, 0
        for dim, pivot, dist, ids, m in _runs(batches, PAGE):
            if last != (dim, pivot) or filled == SUBTREE:
                number, last, filled = number + 1, (dim, pivot), 0
            filled += 1
            more = extra(m, most)
            routing = len(m) // 2
            parents = distances(m, more, m[routing : routing + 1], more[routing : routing + 1])[:, 0]
            row = ((part << 32) + number, dim, pivot, float(dist.min()), float(dist.max()), ids.tobytes(), np.ascontiguousarray(m).tobytes(),
                   more.tobytes(), routing, float(parents.max()), parents.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _send(shared: Shared, k: int):
    """Blocks of queries for every subtree that may hold one of their k best, with the least score that still counts."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pivots, most, subtrees = shared.value()
        part, number = TaskContext.get().partitionId(), 0
        for dim, _, _, ids, m in _runs(batches, BLOCK):
            ids, m = ids.copy(), np.ascontiguousarray(m)
            pivot_ids, p = pivots[dim]
            scores = dots(m, p)
            scores[ids[:, None] == pivot_ids[None, :]] = np.iinfo(np.int64).min
            least = np.sort(scores, axis=1)[:, -k] if len(p) >= k else np.full(len(m), np.iinfo(np.int64).min)
            d = distances(m, np.zeros(len(m)), p, extra(p, most))
            norms = (m.astype(float) ** 2).sum(1)
            for subtree, of, low, high in subtrees.get(dim, ()):
                gap = np.maximum(d[:, of] - high, low - d[:, of])
                if (reach(norms, most, gap - 1e-6 * (1 + d[:, of])) >= least).any():
                    row = (subtree, (part << 32) + number // GROUP, dim, ids.tobytes(), m.tobytes(), least.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
            number += 1

    return run


class Best:
    """The k best (score, smaller id) of each query of a block."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.k, self.least = ids, k, least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.least[q]) & (ids != self.ids[q])
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores[q], scores[good]]), np.concatenate([self.found[q], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])


def _visit(most: float, k: int):
    schema = arrow_schema(FOUND)

    def run(pages: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        nodes = []
        for r in pages.to_pylist():
            m = np.frombuffer(r["matrix"], np.int64).reshape(-1, r["dim"])
            nodes.append((np.frombuffer(r["ids"], np.int64), m, np.frombuffer(r["extra"]), r["routing"], r["radius"], np.frombuffer(r["parents"])))
        for b in blocks.to_pylist() if nodes else ():
            ids, m = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["matrix"], np.int64).reshape(-1, b["dim"])
            best, norms, none = Best(ids, np.frombuffer(b["least"], np.int64), k), (m.astype(float) ** 2).sum(1), np.zeros(len(m))
            to_routing = [distances(m, none, n[1][n[3] : n[3] + 1], n[2][n[3] : n[3] + 1])[:, 0] for n in nodes]
            bounds = [reach(norms, most, d - n[4] - 1e-6 * (1 + d)) for d, n in zip(to_routing, nodes, strict=True)]
            for i in sorted(range(len(nodes)), key=lambda i: -float((bounds[i] - best.least.astype(float)).max())):
                open_ = np.flatnonzero(bounds[i] >= best.least)
                if not len(open_):
                    continue
                page_ids, page, _, _, _, parents = nodes[i]
                gap = np.abs(to_routing[i][open_][:, None] - parents)
                maybe = reach(norms[open_][:, None], most, gap - 1e-6 * (1 + parents)) >= best.least[open_][:, None]
                columns = np.flatnonzero(maybe.any(axis=0))
                scores = dots(m[open_], page[columns])
                for row, q in enumerate(open_):
                    best.add(q, scores[row], page_ids[columns])
            for q in range(len(ids)):
                out.append((np.full(len(best.found[q]), ids[q]), best.found[q], best.scores[q]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], schema=schema)

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): components as ``floor(1024 * x)``; only vectors that take part."""
    x: Column = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(whole & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda c: F.floor(c * 1024).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k rows of highest product."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    summary = rows.agg(F.count("*"), F.max(square)).first()
    most = summary[1] or 0.0
    pivot_count = min(MAX_PIVOTS, max(1, summary[0] // ROWS_PER_PIVOT))
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, in rows.select("dim").distinct().collect():
        chosen = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_count).collect()
        pivots[dim] = (np.array([r["vec_id"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], np.int64))
    order = ["dim", "pivot", "dist", "vec_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(map_batches(rows.select("vec_id", "dim", "v"), _place(Shared(spark, (pivots, most))), PLACED))
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pages = cut_lineage(map_batches(dealt, _build(most), PAGES))
    subtrees: dict[int, list[tuple[int, int, float, float]]] = {}
    nodes = pages.groupBy("dim", "subtree").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"))
    for r in nodes.toLocalIterator():  # one row of 40 bytes for 16,384 vectors
        subtrees.setdefault(r["dim"], []).append((r["subtree"], r["pivot"], r["low"], r["high"]))
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "pivot", "dist", "v")).alias("row"))
    asked = asked.select("row.dim", "row.pivot", "row.dist", "vec_id", "row.v")
    asked = asked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = cut_lineage(map_batches(asked, _send(Shared(spark, (pivots, most, subtrees)), k), BLOCKS))
    groups = blocks.select("subtree", (F.col("grp") + 0).alias("part")).distinct()
    found = pages.join(groups, "subtree").groupBy("subtree", "part").cogroup(blocks.groupBy("subtree", "grp")).applyInArrow(_visit(most, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
