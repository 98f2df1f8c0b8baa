"""A random forest over sparse vectors, for tables where MLlib's forest would hold a number for every row and every term."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import freeze

DENSE_CELLS = 2**24  # rows times features that MLlib's forest may hold, four bytes each
SPLIT_ROWS = 10_000  # rows that thresholds are taken from, as in MLlib
SLICE_ROWS, SLICE_ITEMS = 1_024, 2**18  # rows and non-zero values worked on at once
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def sparse_parts(features: str = "features") -> tuple[Column, Column, Column]:
    """Size, indices and values of a vector column."""
    v = F.unwrap_udt(features)
    values = v["values"]
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(v["size"], F.size(values)), F.coalesce(v["indices"], every), values


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and items of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    items = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()
    return offsets - offsets[0], items


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that are worked on at once."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        full = int(np.searchsorted(offsets, offsets[start] + SLICE_ITEMS, "right")) - 1
        end = min(rows, start + SLICE_ROWS, max(full, start + 1))
        yield start, end
        start = end


def split_points(values: np.ndarray, rows: float, most: int) -> np.ndarray:
    """MLlib's thresholds of one feature, from the non-zero values of about ``rows`` rows."""
    v, n = np.unique(values, return_counts=True)
    n = n.astype(np.float64)
    if rows - len(values) > np.finfo(float).eps * rows * 100:
        at = int(np.searchsorted(v, 0.0))
        v, n = np.insert(v, at, 0.0), np.insert(n, at, rows - len(values))
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride = rows / (most + 1)
    found, seen, target = [], n[0], stride
    for i in range(1, len(v)):
        before, seen = seen, seen + n[i]
        if abs(before - target) < abs(seen - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


@dataclass(frozen=True)
class Bins:
    """Thresholds of all features, one after the other, and the bin that a zero falls into."""

    offsets: np.ndarray
    thresholds: np.ndarray
    zero: np.ndarray

    @classmethod
    def of(cls, size: int, features: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> Bins:
        starts, items = lists
        counts = np.zeros(size, np.int64)
        counts[features] = np.diff(starts)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        by = np.argsort(features, kind="stable")
        places = np.repeat(starts[:-1][by], np.diff(starts)[by]) + np.arange(len(items)) - np.repeat(offsets[features[by]], np.diff(starts)[by])
        whole = np.arange(size)
        zero = cls(offsets, items[places], np.zeros(size, np.int16)).find(whole, np.zeros(size))
        return cls(offsets, items[places], zero)

    def find(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The number of thresholds of its feature that lie below each value."""
        low, high = self.offsets[features], self.offsets[features + 1]
        first = low.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = open_ & (self.thresholds[np.minimum(middle, len(self.thresholds) - 1)] < values)
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return (low - first).astype(np.int16)


@dataclass
class Trees:
    """Trees as heaps (node n has the children 2n and 2n + 1): feature or -1, bin and threshold of the last value to the left, class counts."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    counts: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int, classes: int) -> Trees:
        shape = (trees, 2 ** (depth + 1))
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int16), np.zeros(shape), np.zeros((*shape, classes)))

    def merged(self) -> Trees:
        """Two leaves of one parent that predict the same class are one leaf."""
        feature = self.feature.copy()
        best = self.counts.argmax(2)
        for node in range(feature.shape[1] // 2 - 1, 0, -1):
            left, right = 2 * node, 2 * node + 1
            both = (feature[:, left] < 0) & (feature[:, right] < 0) & (best[:, left] == best[:, right])
            feature[both, node] = -1
        return Trees(feature, self.bin, self.threshold, self.counts)

    def nodes(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray, limits: np.ndarray, zero: np.ndarray | None = None) -> np.ndarray:
        """The node that each row has come to in each tree; ``zero`` holds what a row without a feature has for it."""
        rows, trees = len(offsets) - 1, len(self.feature)
        used = np.unique(self.feature[self.feature >= 0])
        table = np.zeros((rows, len(used)), values.dtype) if zero is None else np.tile(zero[used].astype(values.dtype), (rows, 1))
        if len(used):
            place = np.minimum(np.searchsorted(used, indices), len(used) - 1)
            hit = used[place] == indices
            table[np.repeat(np.arange(rows), np.diff(offsets))[hit], place[hit]] = values[hit]
        column = np.searchsorted(used, self.feature)  # of inner nodes only
        node, tree, row = np.ones((rows, trees), np.int32), np.arange(trees), np.arange(rows)[:, None]
        while len(used):
            inner = self.feature[tree, node] >= 0
            if not inner.any():
                break
            here = table[row, np.where(inner, column[tree, node], 0)]
            node = np.where(inner, 2 * node + (here > limits[tree, node]), node)
        return node


def weights(ids: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each row: Poisson numbers of mean 1 from a hash of seed, row and tree."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(trees) + np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x += np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right")


def _thresholds(batches: Iterator[pa.RecordBatch], rows: float, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, items = flat(batch.column("v"))
        found = [split_points(items[a:b], rows, most) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch({"f": batch.column("f"), "t": pa.array(found, pa.list_(pa.float64()))})


def _binned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    bins: Bins = shared.value
    for batch in batches:
        offsets, indices = flat(batch.column("indices"))
        _, values = flat(batch.column("values"))
        for start, end in slices(offsets):
            part = slice(offsets[start], offsets[end])
            f = indices[part]
            b = bins.find(f, values[part])
            told = b != bins.zero[f]
            ends = np.concatenate([[0], np.cumsum(told)])[offsets[start:end + 1] - offsets[start]].astype(np.int32)
            yield pa.record_batch({
                "id": batch.column("id").slice(start, end - start), "label": batch.column("label").slice(start, end - start),
                "indices": pa.ListArray.from_arrays(ends, pa.array(f[told], pa.int32())),
                "bins": pa.ListArray.from_arrays(ends, pa.array(b[told], pa.int16())),
            })


@dataclass(frozen=True)
class Level:
    """Open nodes of one depth, the features each may be split by, and all pairs of both in the order of features."""

    trees: Trees
    at: np.ndarray  # tree and node of each open node
    chosen: np.ndarray
    features: np.ndarray  # those of any open node, sorted, and where their pairs begin
    starts: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, trees: Trees, open_: list[tuple[int, int]], size: int, per_node: int, seed: int) -> Level:
        def draw(tree: int, node: int) -> np.ndarray:
            if per_node == size:
                return np.arange(size)
            return np.random.default_rng([seed, tree, node]).choice(size, per_node, replace=False, shuffle=False)

        chosen = np.array([draw(*x) for x in open_], np.int32)
        pairs = np.argsort(chosen, axis=None, kind="stable").astype(np.int32)
        features, starts = np.unique(chosen.ravel()[pairs], return_index=True)
        return cls(trees, np.array(open_, np.int32), chosen, features, np.append(starts, len(pairs)), pairs)


def _counted(batches: Iterator[pa.RecordBatch], shared, classes: int, most: int, seed: int | None) -> Iterator[pa.RecordBatch]:
    """Rows drawn, by open node, place of a feature in its choice (-1: all rows of the node), bin and class; zeros are left out."""
    bins, level = (x.value for x in shared)
    n_trees, per_node = len(level.trees.feature), level.chosen.shape[1]
    number = np.full(level.trees.feature.shape, -1, np.int32)
    number[level.at[:, 0], level.at[:, 1]] = np.arange(len(level.at))
    tree_of = level.at[:, 0]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys))

    for batch in batches:
        offsets, indices = flat(batch.column("indices"))
        _, values = flat(batch.column("bins"))
        labels, ids = batch.column("label").to_numpy().astype(np.int64), batch.column("id").to_numpy()
        for start, end in slices(offsets):
            part, ends = slice(offsets[start], offsets[end]), offsets[start:end + 1] - offsets[start]
            f, b, label = indices[part], values[part], labels[start:end]
            node = level.trees.nodes(ends, f, b, level.trees.bin, bins.zero)
            times = weights(ids[start:end], n_trees, seed) if seed is not None else np.ones(node.shape, np.int64)
            place = np.where(times > 0, number[np.arange(n_trees), node], -1)
            row, tree = np.nonzero(place >= 0)
            totals = ((place[row, tree].astype(np.int64) * (per_node + 1)) * most) * classes + label[row], times[row, tree].astype(np.float64)
            at = np.minimum(np.searchsorted(level.features, f), len(level.features) - 1)
            asked = level.features[at] == f
            at, row = at[asked], np.repeat(np.arange(end - start), np.diff(ends))[asked]
            many = level.starts[at + 1] - level.starts[at]
            item = np.repeat(np.arange(len(at)), many)
            pair = level.pairs[np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + level.starts[at][item]]
            row, owner = row[item], pair // per_node
            here = place[row, tree_of[owner]] == owner
            row, owner, pair = row[here], owner[here].astype(np.int64), pair[here]
            keys = ((owner * (per_node + 1) + pair % per_node + 1) * most + b[asked][item[here]]) * classes + label[row]
            held.append(fold([totals, (keys, times[row, tree_of[owner]].astype(np.float64))]))
            if sum(len(k) for k, _ in held) > 2**20:
                held = [fold(held)]
    if held:
        keys, n = fold(held)
        for i in range(0, len(keys), 100_000):
            k = keys[i:i + 100_000]
            slot = k // classes // most
            yield pa.record_batch({
                "node": pa.array((slot // (per_node + 1)).astype(np.int32)), "slot": pa.array((slot % (per_node + 1) - 1).astype(np.int32)),
                "bin": pa.array((k // classes % most).astype(np.int32)), "label": pa.array((k % classes).astype(np.int32)), "n": pa.array(n[i:i + 100_000])})


def gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(-1)
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / np.maximum(total, 1.0)
        out -= share * share
    return np.where(total > 0, out, 0.0)


def _best(table: pa.Table, shared, classes: int, most: int) -> pa.Table:
    """The split of a node with the largest gain, the first of equals."""
    bins, level = (x.value for x in shared)
    node, slot, bin_, label, n = (table[c].to_numpy() for c in ("node", "slot", "bin", "label", "n"))
    chosen, whole = level.chosen[node[0]], slot < 0
    total = np.bincount(label[whole], n[whole], classes)
    counts = np.zeros((len(chosen), most, classes))
    counts[slot[~whole], bin_[~whole], label[~whole]] = n[~whole]
    counts[np.arange(len(chosen)), bins.zero[chosen]] += total - counts.sum(1)
    left = counts.cumsum(1)[:, :-1]
    right = total - left
    rows = total.sum()
    gain = gini(total) - left.sum(2) / rows * gini(left) - right.sum(2) / rows * gini(right)
    splits = bins.offsets[chosen + 1] - bins.offsets[chosen]
    allowed = (np.arange(most - 1) < splits[:, None]) & (left.sum(2) >= 1) & (right.sum(2) >= 1)
    gain = np.where(allowed, gain, -1.0)
    i, k = np.unravel_index(gain.argmax(), gain.shape)
    lists = pa.list_(pa.float64())
    return pa.table({"node": pa.array([node[0]], pa.int32()), "feature": pa.array([chosen[i]], pa.int32()), "bin": pa.array([k], pa.int32()),
                     "gain": pa.array([gain[i, k]], pa.float64()), "total": pa.array([total], lists), "left": pa.array([left[i, k]], lists)})


def with_prediction(data: DataFrame, predict: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``prediction`` of a function of offsets, indices and values of some rows."""

    @F.arrow_udf("double")
    def predicted(indices: pa.Array, values: pa.Array) -> pa.Array:
        offsets, f = flat(indices)
        _, v = flat(values)
        found = [predict(offsets[a:b + 1] - offsets[a], f[offsets[a]:offsets[b]], v[offsets[a]:offsets[b]]) for a, b in slices(offsets)]
        return pa.array(np.concatenate(found).astype(np.float64) if found else np.zeros(0))

    _, indices, values = sparse_parts()
    return data.withColumn("prediction", predicted(indices, values))


@dataclass(frozen=True)
class ForestModel:
    trees: Trees

    def predict(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = self.trees.counts.sum(2, keepdims=True)
        votes = self.trees.counts / np.where(total > 0, total, 1.0)
        node = self.trees.nodes(offsets, indices, values, self.trees.threshold)
        return votes[np.arange(node.shape[1]), node].sum(1).argmax(1)

    def transform(self, data: DataFrame) -> DataFrame:
        return with_prediction(data, self.predict)


@dataclass(frozen=True)
class SparseForest:
    """MLlib's forest from the bins of non-zero values alone: its thresholds, bootstrap, choice of features for each node, gains, stops and
    merged leaves. Numbers are drawn by another generator, so its trees differ from MLlib's as those of another seed do.

    A depth is one job. A task sums its rows by open node, feature and bin; of these only the best split of a node comes to the driver, which
    holds trees and thresholds (31 of a feature at most), but no rows.
    """

    trees: int = 100
    depth: int = 5
    bins: int = 32
    seed: int = 42
    bootstrap: bool = True
    per_node: int | None = None  # the root of the number of features if not given

    def fit(self, data: DataFrame) -> ForestModel:
        size, indices, values = sparse_parts()
        rows = data.select(F.col("label").cast("int").alias("label"), indices.alias("indices"), values.alias("values"))
        n, classes, width = data.agg(F.count(F.lit(1)), (F.max("label") + 1).cast("int"), F.max(size)).first()
        most, context = min(self.bins, n), data.sparkSession.sparkContext
        bins = context.broadcast(self._thresholds(rows, n, width, most))
        binned = freeze(rows.withColumn("id", F.monotonically_increasing_id()).mapInArrow(
            partial(_binned, shared=bins), "id long, label int, indices array<int>, bins array<smallint>"))
        per_node = self.per_node or int(np.ceil(np.sqrt(width)))
        trees, open_ = Trees.empty(self.trees, self.depth, classes), [(t, 1) for t in range(self.trees)]
        for depth in range(self.depth):
            if not open_:
                break
            level = context.broadcast(Level.of(trees, open_, width, per_node, self.seed))
            told = {"shared": (bins, level), "classes": classes, "most": most}
            counted = binned.mapInArrow(partial(_counted, **told, seed=self.seed if self.bootstrap else None), "node int, slot int, bin int, label int, n double")
            best = partial(_best, **told)
            found = counted.groupBy("node", "slot", "bin", "label").agg(F.sum("n").alias("n")).groupBy("node").applyInArrow(
                lambda table: best(table), "node int, feature int, bin int, gain double, total array<double>, left array<double>").collect()
            open_ = self._grown(trees, open_, sorted(found), bins.value, depth + 1 == self.depth)
            level.destroy()
        bins.destroy()
        return ForestModel(trees.merged())

    def _thresholds(self, rows: DataFrame, n: int, width: int, most: int) -> Bins:
        share = min(1.0, max(most * most, SPLIT_ROWS) / n)
        some = rows.sample(False, share, self.seed) if share < 1 else rows
        items = some.select(F.explode(F.arrays_zip("indices", "values")).alias("x")).where("x.values <> 0")
        found = items.groupBy(F.col("x.indices").alias("f")).agg(F.collect_list("x.values").alias("v")).mapInArrow(
            partial(_thresholds, rows=share * n, most=most - 1), "f int, t array<double>").toArrow().combine_chunks()
        lists = found["t"].chunk(0) if found.num_rows else pa.array([], pa.list_(pa.float64()))
        return Bins.of(width, found["f"].to_numpy().astype(np.int64), flat(lists))

    @staticmethod
    def _grown(trees: Trees, open_: list[tuple[int, int]], found, bins: Bins, last: bool) -> list[tuple[int, int]]:
        """Splits put into the trees; the children that may be split in turn."""
        more = []
        for node, feature, bin_, gain, total, left in found:
            tree, at = open_[node]
            trees.counts[tree, at] = total
            if gain <= 0:
                continue
            trees.feature[tree, at], trees.bin[tree, at], trees.threshold[tree, at] = feature, bin_, bins.thresholds[bins.offsets[feature] + bin_]
            for child, counts in ((2 * at, np.array(left)), (2 * at + 1, np.array(total) - np.array(left))):
                trees.counts[tree, child] = counts
                if not last and gini(counts) >= np.finfo(float).eps:
                    more.append((tree, child))
        return more


class RandomForest:
    """MLlib's forest where its table of all rows and features is small, else the sparse one."""

    def fit(self, data: DataFrame):
        size, _, _ = sparse_parts()
        n, width = data.agg(F.count(F.lit(1)), F.max(size)).first()
        if n * (width or 0) <= DENSE_CELLS:
            return RandomForestClassifier(numTrees=100, seed=42).fit(data)
        return SparseForest().fit(data)
