"""A regression forest grown from histograms, by the library's rules and into the library's model.

The library keeps a hundred bootstrap counts a row as objects, walks all trees for a row at a time and fills the figures of all open
nodes at random. Here a row is one byte a feature and a label, trees take their turn over a chunk of rows, and counts come again
from a seed of chunk and tree. As in the library: candidate borders lie between distinct values, or at quantiles of a sample, a
tree's bootstrap is Poisson(1), every split looks at all features, the largest drop of variance wins, the first among equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, factorial, prod
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.session import shared_folder, ship_package

CHUNK_ROWS = 1 << 18
GROUP_BYTES = 128 << 20  # figures that a task keeps for the trees of one pass
BLOCK_BINS = 256  # features of few bins are counted together, up to as many combinations
CHUNKS = "chunk bigint, bins binary, labels binary"
PARTIAL = "tree int, feature int, part int, figures binary"
BEST = "tree int, feature int, gains binary, borders binary, lefts binary"
SAVED = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def borders_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Candidate borders of a feature: between all its values, or nearest to equal shares if there are more than bins."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < max_bins:
        return middles
    stride, chosen, reached = len(values) / max_bins, [], np.cumsum(counts).astype(float)
    target = stride
    for i in range(1, len(distinct)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            chosen.append(i - 1)
            target += stride
    return middles[chosen]


@dataclass
class Tree:
    """Nodes in the order they were opened. No bin is above a leaf's border, and its child is itself, so that a row stays there."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    border: np.ndarray = field(default_factory=lambda: np.full(1, 255, np.uint8))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    first: int = 0  # of the last level
    totals: list[np.ndarray] = field(default_factory=list)  # a level: weight, sum, sum of squares of its nodes

    @property
    def levels(self) -> int:
        return len(self.totals)

    def split(self, gains: np.ndarray, features: np.ndarray, borders: np.ndarray) -> None:
        """Opens a level below the nodes of the last one that gain something."""
        n = len(self.child)
        where = np.flatnonzero(gains > 0)
        at = self.first + where
        self.feature[at], self.border[at], self.gain[at] = features[where], borders[where], gains[where]
        self.child[at] = n + 2 * np.arange(len(at))
        new = np.arange(n, n + 2 * len(at))
        self.feature, self.border = np.append(self.feature, np.zeros_like(new)), np.append(self.border, np.full_like(new, 255, np.uint8))
        self.child, self.gain = np.append(self.child, new), np.append(self.gain, np.zeros(len(new)))
        self.first = n


def _counts_table(bootstrap: bool) -> np.ndarray:
    """How often a row is drawn, by 16 random bits: Poisson(1) to one part in 65,536."""
    if not bootstrap:
        return np.ones(1 << 16)
    shares = np.cumsum([exp(-1) / factorial(k) for k in range(12)])
    return np.searchsorted(shares, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(float)


def _chunks(borders: list[np.ndarray], mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, n, number = TaskContext.get().partitionId(), [], 0, 0

        def made() -> pa.RecordBatch:
            bins, labels = np.concatenate([b for b, _ in kept]), np.concatenate([y for _, y in kept])
            return pa.RecordBatch.from_pydict({"chunk": [part << 32 | number], "bins": [bins.tobytes()], "labels": [labels.tobytes()]})

        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(borders)], axis=1).astype(np.uint8)
            kept.append((bins, batch.column("label").to_numpy(zero_copy_only=False) - mean))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield made()
                kept, n, number = [], 0, number + 1
        if n:
            yield made()

    return run


def blocks_of(sizes: list[int]) -> list[list[int]]:
    """Features that can split, in blocks of at most ``BLOCK_BINS`` combinations of their bins where there is more than one."""
    blocks: list[list[int]] = []
    for f in sorted((f for f, size in enumerate(sizes) if size > 1), key=lambda f: -sizes[f]):
        fitting = next((b for b in blocks if prod(sizes[g] for g in b) * sizes[f] <= BLOCK_BINS), None)
        if fitting is None:
            blocks.append([f])
        else:
            fitting.append(f)
    return blocks


def _figures(trees: dict[int, Tree], sizes: list[int], seed: int, bootstrap: bool, moments: int):
    """Weights and sums by node and bin, of the last level of some trees, and squares if all three ``moments`` are asked; also each
    node's own totals, as feature -1."""
    blocks = blocks_of(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, found, part = _counts_table(bootstrap), {}, TaskContext.get().partitionId()
        for batch in batches:
            for chunk, bins, labels in zip(batch.column("chunk").to_pylist(), batch.column("bins"), batch.column("labels")):
                label = np.frombuffer(labels.as_buffer(), np.float64)
                flat = np.frombuffer(bins.as_buffer(), np.uint8)
                columns = [np.ravel_multi_index([flat[f :: len(sizes)] for f in block], [sizes[f] for f in block]).astype(np.uint8) for block in blocks]
                for number, tree in trees.items():
                    random = np.random.Generator(np.random.SFC64([seed, number, chunk >> 32, chunk & 0xFFFFFFFF]))
                    weight = drawn[np.frombuffer(random.bytes(2 * len(label)), np.uint16)]
                    rows = np.flatnonzero(weight)
                    at, start = np.zeros(len(rows), np.intp), rows * len(sizes)
                    for _ in range(tree.levels):
                        asked = tree.feature.take(at)
                        asked += start
                        right = flat.take(asked) > tree.border.take(at)
                        at = tree.child.take(at)
                        at += right
                    at -= tree.first
                    if tree.first:
                        inside = at >= 0
                        rows, at = rows[inside], at[inside]
                    n, w = len(tree.child) - tree.first, weight[rows]
                    y = label[rows]
                    wy = w * y
                    powers = (w, wy, wy * y)
                    new = {-1: np.concatenate([np.bincount(at, v, n) for v in powers])}
                    for block, column in zip(blocks, columns, strict=True):
                        shape = [sizes[f] for f in block]
                        cell = at * np.intp(prod(shape)) + column[rows]
                        both = np.concatenate([np.bincount(cell, v, n * prod(shape)) for v in powers[:moments]]).reshape(moments, n, *shape)
                        for i, f in enumerate(block):
                            new[f] = both.sum(axis=tuple(2 + j for j in range(len(block)) if j != i)).ravel() if len(block) > 1 else both.ravel()
                    for f, figures in new.items():
                        if (number, f) in found:
                            found[number, f] += figures
                        else:
                            found[number, f] = figures
        for (number, f), figures in found.items():
            yield pa.RecordBatch.from_pydict(
                {"tree": pa.array([number], pa.int32()), "feature": pa.array([f], pa.int32()), "part": pa.array([part], pa.int32()), "figures": [figures.tobytes()]}
            )

    return run


def _best(sizes: list[int], moments: int):
    """The best border of each node for one feature, with the totals to its left; or the nodes' own totals."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        feature = key[1].as_py()
        figures = sum(np.frombuffer(b.as_buffer(), np.float64) for b in table.column("figures").combine_chunks())
        gains, borders, left = np.zeros(0), np.zeros(0, np.int32), figures
        if feature >= 0:
            left = np.cumsum(figures.reshape(moments, -1, sizes[feature]), axis=2)
            (n, s), (left_n, left_s) = left[:2, :, -1:], left[:2, :, :-1]
            right_n, right_s = n - left_n, s - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                each = (left_s**2 / left_n + right_s**2 / right_n - s**2 / n) / n
            each = np.where((left_n >= 1) & (right_n >= 1), each, -1.0)
            borders = each.argmax(axis=1).astype(np.int32)
            gains = np.take_along_axis(each, borders[:, None], axis=1)[:, 0]
            left = np.take_along_axis(left, borders[None, :, None], axis=2)
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.int32()), "feature": pa.array([feature], pa.int32()), "gains": [gains.tobytes()], "borders": [borders.tobytes()], "lefts": [left.tobytes()],
        })

    return run


def _groups(trees: list[Tree | None], sizes: list[int], moments: int) -> Iterator[dict[int, Tree]]:
    group, size = {}, 0
    for i, tree in enumerate(trees):
        if tree is None:
            continue
        need = 8 * moments * sum(sizes) * (len(tree.child) - tree.first)
        if group and size + need > GROUP_BYTES:
            yield group
            group, size = {}, 0
        group[i] = tree
        size += need
    if group:
        yield group


def _grow_level(chunks: DataFrame, trees: list[Tree], sizes: list[int], seed: int, bootstrap: bool, last: bool) -> None:
    moments = 3 if last else 2
    for group in _groups([t if len(t.child) > t.first else None for t in trees], sizes, moments):
        partial = chunks.mapInArrow(_figures(group, sizes, seed, bootstrap, moments), PARTIAL)
        found = partial.groupBy("tree", "feature").applyInArrow(_best(sizes, moments), BEST).toArrow().sort_by([("tree", "ascending"), ("feature", "ascending")])
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for number, f, *figures in zip(*(found.column(c).to_pylist() for c in ("tree", "feature", "gains", "borders", "lefts")), strict=True):
            gains, borders, lefts = (np.frombuffer(b, kind) for b, kind in zip(figures, (np.float64, np.int32, np.float64), strict=True))
            if f < 0:  # comes before the features
                totals = lefts.reshape(3, -1)
                group[number].totals.append(totals)
                n = totals.shape[1]
                best[number] = np.zeros(n), np.zeros(n, np.intp), np.zeros(n, np.uint8), np.zeros((moments, n))
                continue
            top, features, at, left = best[number]
            better = gains > top
            top[better], features[better], at[better] = gains[better], f, borders[better]
            left[:, better] = lefts.reshape(moments, -1)[:, better]
        for number, (gains, features, at, left) in best.items():
            tree = group[number]
            tree.split(gains, features, at)
            if last:
                split = gains > 0
                tree.totals.append(np.stack([left[:, split], tree.totals[-1][:, split] - left[:, split]], axis=2).reshape(3, -1))


def _saved_rows(number: int, tree: Tree, borders: list[np.ndarray], mean: float) -> list[tuple]:
    """Nodes as the library keeps them; leaves side by side that say the same become one."""
    weight, total, squares = np.concatenate(tree.totals, axis=1)
    impurity = np.maximum(squares / weight - (total / weight) ** 2, 0)
    prediction = total / weight + mean
    leaf = tree.child == np.arange(len(tree.child))
    for i in np.flatnonzero(~leaf)[::-1]:
        a = tree.child[i]
        leaf[i] = leaf[a] and leaf[a + 1] and prediction[a] == prediction[a + 1]
    kept, places = [0], {0: 0}
    for i in kept:
        if not leaf[i]:
            for j in (int(tree.child[i]), int(tree.child[i]) + 1):
                places[j] = len(kept)
                kept.append(j)
    rows = []
    for i in kept:
        stats = [float(weight[i]), float(total[i] + mean * weight[i]), float(squares[i] + 2 * mean * total[i] + mean**2 * weight[i])]
        a, f = int(tree.child[i]), int(tree.feature[i])
        below = (-1.0, -1, -1, (-1, [], -1)) if leaf[i] else (float(tree.gain[i]), places[a], places[a + 1], (f, [float(borders[f][tree.border[i]])], -1))
        rows.append((number, (places[i], float(prediction[i]), float(impurity[i]), stats, int(weight[i]), *below)))
    return rows


def grow(rows: DataFrame, forest: RandomForestRegressor, bootstrap: bool = True) -> RandomForestRegressionModel:
    """The model that ``forest`` describes, fitted to rows with its features and its label. Trees and depth, bins and seed are its own.

    A pass over the rows for each level, or more where the figures of all trees need more than ``GROUP_BYTES``. Every partition is a task.
    """
    spark = rows.sparkSession
    ship_package(spark)
    depth, max_bins, seed, trees = forest.getMaxDepth(), forest.getMaxBins(), forest.getSeed(), [Tree() for _ in range(forest.getNumTrees())]
    if max_bins > 256 or depth < 1:
        raise ValueError("a bin is a byte, 256 of them at most, and a tree has a level of branches at least")
    given = rows.select(vector_to_array(forest.getFeaturesCol()).alias("features"), F.col(forest.getLabelCol()).cast("double").alias("label"))
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(F.col(forest.getLabelCol()).cast("double"))).first()
    # The borders' sample is the library's, in size too.
    wanted = max(max_bins**2, 10_000)
    sample = np.array([r[0] for r in (given if n <= wanted else given.sample(False, wanted / n, seed)).select("features").collect()])
    borders = [borders_of(column, max_bins) for column in sample.T]
    sizes = [len(b) + 1 for b in borders]
    chunks = given.mapInArrow(_chunks(borders, mean), CHUNKS).persist()
    for level in range(depth):
        _grow_level(chunks, trees, sizes, seed & 0xFFFFFFFFFFFFFFFF, bootstrap, level == depth - 1)
    chunks.unpersist()
    # The library's own files, of a forest fitted to two rows, with these nodes.
    path = f"{shared_folder(spark)}/forest-{uuid4().hex}"
    zeros = [(Vectors.dense([0.0] * len(sizes)), mean)] * 2
    two = spark.createDataFrame(zeros, [forest.getFeaturesCol(), forest.getLabelCol()]).coalesce(1)
    RandomForestRegressor._fit(forest, two).write().save(path)
    nodes = [row for number, tree in enumerate(trees) for row in _saved_rows(number, tree, borders, mean)]
    spark.createDataFrame(nodes, SAVED, verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


class GrownForestRegressor(RandomForestRegressor):
    """The library's estimator by name and settings, for tables of more rows than one task should pass over."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        return grow(dataset, self)
