"""Leaf-wise boosted trees (M6): logistic loss, L1/L2 penalties, feature fraction per tree.

* Features are quantised once to at most ``max_bins`` bins; the table that every pass reads has
  one byte a feature, the label and the margin.
* A pass adds up gradients, hessians and counts for each (new leaf, feature, bin): numpy sums in
  each task, one vector a (leaf, feature) to the shuffle, best split of each on the executors.
  The driver receives one row a (leaf, feature) and holds trees only.
* Trees grow best leaf first, up to ``num_leaves``. A leaf's best split depends on its own
  rows alone, so one pass prepares the children of all leaves that may still be split; the queue
  then takes splits in order of gain. A tree costs about as many passes as it is deep.
* Gradients are rounded to multiples of ``2**-24`` and summed as integers: sums are exact and
  trees the same on any partitioning, also after lost executors.
* Margins are a column; every ``CHECKPOINT_TREES`` trees they are brought up to date and
  checkpointed. Between checkpoints a task adds the few trees since then itself.

Empty tables and tables of one class give a model without trees (a constant). Rows with a null
label or null vector are an error, as everywhere in ``pyspark.ml``; NaN counts as the smallest value.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.session import ship_package

UNIT = float(1 << 24)
CHECKPOINT_TREES = 25
PART_ROWS = 50_000       # least rows of a part of the state, on average
MAX_BINS = 255
STATE = "y double, margin double, bins binary"
SPLITS = "node int, feature int, gain double, bin int, g long, h long, n long"


@dataclass(frozen=True)
class Settings:
    """Penalties and bounds of a tree; the last two are the usual defaults of leaf-wise growth."""

    learning_rate: float = 0.05
    rounds: int = 2000
    num_leaves: int = 50
    lambda_l1: float = 1.0
    lambda_l2: float = 1.0
    feature_fraction: float = 0.85
    max_bins: int = MAX_BINS
    min_rows: int = 20
    min_hessian: float = 1e-3
    seed: int = 47


@dataclass
class Tree:
    """Arrays over nodes, root first; a leaf has feature -1. Rows whose bin is at most ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of the bin matrix."""
        at = np.zeros(len(bins), np.int64)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            low = bins[open_, self.feature[node]] <= self.bin[node]
            at[open_] = np.where(low, self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at


def shrunk(g, l1: float):
    """Soft threshold of a gradient sum."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_gain(g, h, s: Settings):
    return shrunk(g, s.lambda_l1) ** 2 / (h + s.lambda_l2)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-shrunk(g, s.lambda_l1) / (h + s.lambda_l2)) * s.learning_rate


def best_splits(sums: np.ndarray, s: Settings) -> list[tuple]:
    """For (g, h, n) by bin (whole numbers, one matrix a leaf and feature): the gain, bin and the sums
    of the best split, and the sums of all rows; gain 0 without a split."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left
    gain = (leaf_gain(left[:, 0] / UNIT, left[:, 1] / UNIT, s) + leaf_gain(right[:, 0] / UNIT, right[:, 1] / UNIT, s)
            - leaf_gain(whole[:, 0] / UNIT, whole[:, 1] / UNIT, s))
    allowed = ((np.minimum(left[:, 2], right[:, 2]) >= s.min_rows)
               & (np.minimum(left[:, 1], right[:, 1]) >= s.min_hessian * UNIT))
    gain = np.where(allowed, gain, 0.0)
    at = np.argmax(gain, axis=1)
    best = gain[np.arange(len(at)), at]
    return [(float(top), int(k), *(int(x) for x in total[:, 0])) if top > 0 else (0.0, -1, *(int(x) for x in total[:, 0]))
            for top, k, total in zip(best, at, whole)]


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradients and hessians of the logistic loss."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * UNIT), np.rint(p * (1.0 - p) * UNIT)


def sampled_features(n_features: int, tree: int, s: Settings) -> list[int]:
    """The features of one tree: a seeded sample of ``feature_fraction`` of them."""
    k = max(1, round(n_features * s.feature_fraction))
    return sorted(random.Random(f"{s.seed}/{tree}").sample(range(n_features), k))


@dataclass
class Growing:
    """A tree while it grows: every node with its sums, best split and, once prepared, its children."""

    settings: Settings
    path: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    sums: list[tuple[int, int, int] | None] = field(default_factory=lambda: [None])
    split: list[tuple | None] = field(default_factory=lambda: [None])
    children: list[tuple[int, int] | None] = field(default_factory=lambda: [None])

    def take(self, node: int, found: list) -> None:
        """The best of a node's splits: largest gain, then smallest feature."""
        self.sums[node] = (found[0].g, found[0].h, found[0].n)
        best = max(found, key=lambda r: (r.gain, -r.feature))
        self.split[node] = (best.gain, best.feature, best.bin) if best.gain > 0 else None

    def prepare(self, node: int) -> list[int]:
        new = len(self.path)
        self.children[node] = (new, new + 1)
        for side in (0, 1):
            self.path.append(self.path[node] + (side,))
            self.sums.append(None)
            self.split.append(None)
            self.children.append(None)
        return [new, new + 1]

    def queue(self) -> tuple[list[int], list[int]]:
        """Best-first growth as far as it is known: the nodes split, and the leaves in the queue (best first)
        if the next split still lacks its children's sums."""
        taken, leaves = [], 1
        heap = [(-self.split[0][0], (), 0)] if self.split[0] else []
        while heap and leaves < self.settings.num_leaves:
            node = heap[0][2]
            pair = self.children[node]
            if pair is None:
                return taken, [n for _, _, n in sorted(heap)][:self.settings.num_leaves - leaves]
            heapq.heappop(heap)
            taken.append(node)
            leaves += 1
            for child in pair:
                if self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], self.path[child], child))
        return taken, []

    def numbering(self, inner: set[int]) -> dict[int, int]:
        """Number of each node of the tree in which ``inner`` are split, from the root on."""
        order, at = [0], 0
        while at < len(order):
            if order[at] in inner:
                order.extend(self.children[order[at]])
            at += 1
        return {node: k for k, node in enumerate(order)}

    def tree(self, splits: list[int]) -> Tree:
        """The tree of these splits."""
        inner = set(splits)
        number = self.numbering(inner)
        n = len(number)
        out = Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64),
                   np.zeros(n), np.zeros(n))
        for node, k in number.items():
            if node in inner:
                out.gain[k], out.feature[k], out.bin[k] = self.split[node]
                out.left[k], out.right[k] = (number[c] for c in self.children[node])
            elif self.sums[node] is not None:
                g, h, _ = self.sums[node]
                out.value[k] = leaf_value(g / UNIT, h / UNIT, self.settings)
        return out


def _columns(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, margin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    raw = b"".join(x.as_py() for x in batch.column(2))
    return y, margin, np.frombuffer(raw, np.uint8).reshape(len(y), n_features)


def _brought_up(margin: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.leaves(bins)]
    return margin


def _find_splits(state: DataFrame, n_features: int, features: list[int], recent: list[Tree], partial: Tree,
                 wanted: list[int], s: Settings) -> DataFrame:
    """Best split of every (wanted node, feature): one pass over the state and one shuffle."""
    width = s.max_bins

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.full(len(partial.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        total = np.zeros((3, len(wanted) * len(features) * width), np.int64)
        seen = False
        for batch in batches:
            y, margin, bins = _columns(batch, n_features)
            g, h = gradients(y, _brought_up(margin, bins, recent))
            at = slot[partial.leaves(bins)]
            own = np.flatnonzero(at >= 0)
            if not len(own):
                continue
            seen = True
            cell = ((at[own, None] * len(features) + np.arange(len(features))) * width + bins[own][:, features]).ravel()
            for k, weights in enumerate((g[own], h[own], np.ones(len(own)))):
                part = np.bincount(cell, np.repeat(weights, len(features)), total.shape[1])
                total[k] += part.astype(np.int64)
        if seen:
            cube = total.reshape(3, len(wanted), len(features), width)
            for k, node in enumerate(wanted):
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([node] * len(features), pa.int32()), "feature": pa.array(features, pa.int32()),
                    "sums": pa.array([np.ascontiguousarray(cube[:, k, f]).tobytes() for f in range(len(features))], pa.binary())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for node, feature, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2)):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                if (node, feature) in added:
                    added[node, feature] += own
                else:
                    added[node, feature] = own.copy()
        if added:
            cells = np.stack(list(added.values())).reshape(len(added), 3, width)
            found = [(*key, *best) for key, best in zip(added, best_splits(cells, s))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in
                 zip(zip(*found), (pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.int64()] * 3))],
                names=["node", "feature", "gain", "bin", "g", "h", "n"])

    # a task holds the vectors of its share of the (leaf, feature) pairs, however many rows there are
    return state.mapInArrow(sums, "node int, feature int, sums binary").repartition("node", "feature").mapInArrow(choose, SPLITS)


def grow(state: DataFrame, n_features: int, features: list[int], recent: list[Tree], s: Settings) -> Tree | None:
    """One tree on the state's margins and ``recent`` trees; None if no split gains."""
    growing = Growing(s)
    wanted, taken = [0], []
    while wanted:
        prepared = [n for n, pair in enumerate(growing.children) if pair]
        number, partial = growing.numbering(set(prepared)), growing.tree(prepared)
        rows = _find_splits(state, n_features, features, recent, partial, [number[n] for n in wanted], s).collect()
        by_node: dict[int, list] = {}
        for row in rows:
            by_node.setdefault(row.node, []).append(row)
        for node in wanted:
            if number[node] in by_node:
                growing.take(node, by_node[number[node]])
        taken, next_leaves = growing.queue()
        wanted = [child for leaf in next_leaves if growing.children[leaf] is None for child in growing.prepare(leaf)]
    return growing.tree(taken) if taken else None


def bin_edges(rows: DataFrame, features: str, n_features: int, max_bins: int) -> list[list[float]]:
    """Upper edges of every feature's bins but the last: its values if they are few, else quantiles
    (one aggregate over all features; exact up to 10,000 rows, else to 1/10,000 of the ranks)."""
    value = vector_to_array(features)
    shares = [k / max_bins for k in range(1, max_bins)]
    at = F.array(*[F.lit(x) for x in shares])
    out = rows.select(value.alias("v")).agg(*[F.percentile_approx(F.col("v")[k], at, 10_000).alias(f"q{k}")
                                              for k in range(n_features)]).first()
    return [sorted(set(out[k] or [])) for k in range(n_features)]


def _binned(edges: list[list[float]], values: np.ndarray) -> np.ndarray:
    """Bin matrix of a value matrix: a value's bin is the number of edges below it (NaN: 0)."""
    out = np.zeros(values.shape, np.uint8)
    for k, own in enumerate(edges):
        column = values[:, k]
        out[:, k] = np.where(np.isnan(column), 0, np.searchsorted(own, column, side="left"))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def quantised(rows: DataFrame, features: str, label: str, edges: list[list[float]], start: float) -> DataFrame:
    """``y, margin, bins`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(edges, _matrix(batch.column(1), len(edges)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(bins), start)),
                                              pa.array([row.tobytes() for row in bins], pa.binary())],
                                             names=["y", "margin", "bins"])

    return rows.select(F.col(label).cast("double"), vector_to_array(features)).mapInArrow(run, STATE)


@dataclass
class BoostedTrees:
    """A fitted model: bin edges, trees and the constant that all margins start from."""

    edges: list[list[float]]
    trees: list[Tree]
    start: float
    features: str = "features"

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that pyspark.ml's tree models use
        """Share of the total gain that each feature's splits brought."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return DenseVector(total / total.sum() if total.sum() else total)

    def margins(self, values: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(values), self.start)
        return _brought_up(np.full(len(values), self.start), _binned(self.edges, values), self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (vector of both classes) and ``prediction``; one narrow pass."""
        ship_package(df.sparkSession)
        sent = df.sparkSession.sparkContext.broadcast(self)  # trees: bounded by rounds and leaves

        @F.arrow_udf("double")
        def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = sent.value
            for column in batches:
                margin = model.margins(_matrix(column, len(column.flatten()) // max(len(column), 1)))
                yield pa.array(1.0 / (1.0 + np.exp(-margin)))

        p = probability(vector_to_array(self.features))
        return (df.withColumn("probability", p)
                .withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1.0 - F.col("probability"), F.col("probability")))))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, threshold, left, right, value, gain`` of every node (model state)."""
        rows = []
        for t, tree in enumerate(self.trees):
            for k in range(len(tree.feature)):
                f = int(tree.feature[k])
                threshold = self.edges[f][int(tree.bin[k])] if f >= 0 else None
                rows.append((t, k, f, threshold, int(tree.left[k]), int(tree.right[k]), float(tree.value[k]), float(tree.gain[k])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, "
                                           "value double, gain double")


def _with_margins(state: DataFrame, n_features: int, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, margin, bins = _columns(batch, n_features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_brought_up(margin, bins, trees)), batch.column(2)],
                                             names=["y", "margin", "bins"])
    return state.mapInArrow(run, STATE)


def fit(rows: DataFrame, s: Settings = Settings(), features: str = "features", label: str = "label") -> BoostedTrees:
    """Model of ``rows`` (vector column ``features``, 0/1 column ``label``)."""
    ship_package(rows.sparkSession)
    n, ones, size = rows.agg(F.count(label), F.sum(F.col(label).cast("double")),
                             F.max(F.size(vector_to_array(features)))).first()
    if not n or ones in (0, n):
        start = 0.0 if not n else math.log((ones + 0.5) / (n - ones + 0.5))
        return BoostedTrees([[] for _ in range(size or 0)], [], start, features)
    start = math.log(ones / (n - ones))
    edges = bin_edges(rows, features, size, s.max_bins)
    parts = max(1, -(-n // PART_ROWS))  # a pass over few rows should not wait for many tasks
    state = quantised(rows, features, label, edges, start)
    state = (state.coalesce(parts) if parts < state.rdd.getNumPartitions() else state).checkpoint(eager=True)
    trees: list[Tree] = []
    recent: list[Tree] = []
    for number in range(s.rounds):
        tree = grow(state, size, sampled_features(size, number, s), recent, s)
        if tree is None:
            break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == CHECKPOINT_TREES:
            state = _with_margins(state, size, recent).checkpoint(eager=True)
            recent = []
    return BoostedTrees(edges, trees, start, features)

