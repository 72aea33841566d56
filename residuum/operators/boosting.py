"""Boosted trees for many groups at once, from histograms.

Every group (a fit) gets its own model, all in the same passes over the rows. A
pass sends each row to its node and adds its gradient, Hessian and count to the
(fit, node, feature, bin) cells inside the tasks. A task that has met all rows of a node
chooses its split at once; cells of nodes whose rows lie in several tasks are merged by a
shuffle. Only the best split of each node reaches the driver. So the number of passes depends
on the depth of trees, not on the number of fits, and a fit with most of the rows
is spread over as many tasks as it needs.

A fit of up to LOCAL_ROWS rows needs no passes: its packed rows meet in one task, which grows
all its trees. That is a bound for memory, not for results: both ways add the same
fixed-point numbers and give the same trees.

Trees grow best-first to a number of leaves. A pass measures the children of all
leaves that may be split next; the tree is then read off exactly in best-first order.
Gradients are rounded to fixed-point numbers before they are added, so sums, and with them
models, do not depend on partitions.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.operators.prefix import medians
from residuum.storage import cut

#: Rows of a fit that choose its bin edges, at most (about; those with the smallest draws).
EDGE_ROWS = 10_000
#: Rows of one fit in one slice, iterations between two writes of the margins.
SLICE_ROWS, REWRITE = 50_000, 10
#: Rows of a fit that are trained on in one task, at most (about 100 bytes each there), and tasks of that step.
LOCAL_ROWS, LOCAL_TASKS = 2_000_000, 2000
#: Nodes whose cells one task holds at once.
HELD_NODES = 128
#: Fixed-point steps of a gradient of one.
STEPS = float(1 << 24)
ROW_DDL = "fit_no int, held boolean, base_wrong double, weight double, bins binary, margin double"
SPLIT_DDL = "slot long, gain double, feature int, bin int, gl long, hl long, nl long, g long, h long, n long"


@dataclass(frozen=True)
class Boosting:
    """Growth of the models."""

    iterations: int = 100
    rate: float = 0.05
    leaves: int = 15
    min_leaf: int = 20
    l2: float = 1.0
    bins: int = 64
    min_hessian: float = 1e-3


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of at most ``bins`` bins: midpoints of neighbouring values, or of quantiles where values are many."""
    found = np.unique(values)
    if len(found) > bins:
        found = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
        return found
    return (found[1:] + found[:-1]) / 2


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def best_split(cells: np.ndarray, b: Boosting) -> tuple[float, int, int, int, int, int, int, int, int]:
    """(gain, feature, bin, left sums, all sums) of a node's cells (3, features, bins); gain 0 if no split is allowed.

    Of equal gains the first feature wins, then the first bin.
    """
    left = cells.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    (gl, hl, _), (gr, hr, _) = left / STEPS, right / STEPS
    g, h = whole[0] / STEPS, whole[1] / STEPS
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (hl + b.l2) + gr**2 / (hr + b.l2) - g**2 / (h + b.l2)
    allowed = (left[2] >= b.min_leaf) & (right[2] >= b.min_leaf) & (hl >= b.min_hessian) & (hr >= b.min_hessian)
    gain = np.where(allowed, gain, 0.0)
    feature, bin_ = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[feature, bin_]), int(feature), int(bin_), *map(int, left[:, feature, bin_]), *map(int, whole[:, 0, 0]))


class Tree:
    """One fit's tree while it grows: nodes measured so far, split best-first."""

    def __init__(self, b: Boosting):
        self.b, self.split, self.children, self.sums = b, {}, {}, {0: None}

    def measured(self, node: int, row) -> None:
        self.split[node] = (row["gain"], row["feature"], row["bin"])
        self.sums[node] = (row["g"], row["h"], row["n"])
        if row["gain"] > 0:
            a = len(self.sums)
            self.children[node] = (a, a + 1)
            left = (row["gl"], row["hl"], row["nl"])
            for child, sums in ((a, left), (a + 1, tuple(x - y for x, y in zip(self.sums[node], left)))):
                self.sums[child] = sums
                if sums[2] < 2 * self.b.min_leaf:
                    self.split[child] = (0.0, -1, -1)

    def grow(self) -> tuple[list[int], list[int]]:
        """(nodes split in best-first order, nodes still to be measured before that order is final)."""
        if 0 not in self.split:
            return [], [0]
        open_, order, missing, leaves = [(-self.split[0][0], 0)], [], [], 1
        while open_ and leaves < self.b.leaves:
            gain, node = heapq.heappop(open_)
            if gain >= 0:
                break
            order.append(node)
            leaves += 1
            for child in self.children[node]:
                if child in self.split:
                    heapq.heappush(open_, (-self.split[child][0], child))
                else:
                    missing.append(child)
        return order, missing if leaves < self.b.leaves or self._disputed(order, missing) else []

    def _disputed(self, order: list[int], missing: list[int]) -> bool:
        """Whether a node that is not measured could have come before one that was split."""
        inside = set(order)
        for node in missing:
            parent = next(p for p, c in self.children.items() if node in c)
            if order.index(parent) < len(order) - 1 and parent in inside:
                return True
        return False


class Model:
    """Trees of all fits as arrays: one row a fit, one column a node."""

    def __init__(self, fits: int, nodes: int):
        self.feature = np.full((fits, nodes), -1, np.int32)
        self.bin = np.zeros((fits, nodes), np.int32)
        self.next = np.zeros((2, fits, nodes), np.int32)
        self.value = np.zeros((fits, nodes))

    def put(self, fit: int, tree: Tree, order: Sequence[int]) -> None:
        for node in order:
            _, self.feature[fit, node], self.bin[fit, node] = tree.split[node]
            self.next[:, fit, node] = tree.children[node]

    def place(self, fit: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node, rows = np.zeros(len(fit), np.int64), np.arange(len(fit))
        while True:
            feature = self.feature[fit, node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = (bins[rows, np.maximum(feature, 0)] > self.bin[fit, node]).astype(np.int64)
            node = np.where(inner, self.next[right, fit, node], node)


def _unpacked(batch: pa.RecordBatch, width: int):
    fit = batch.column(0).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, width)
    return fit, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), bins


def _margins(batch: pa.RecordBatch, fit: np.ndarray, bins: np.ndarray, done: Sequence[Model]) -> np.ndarray:
    margin = batch.column(5).to_numpy().copy()
    for m in done:
        margin += m.value[fit, m.place(fit, bins)]
    return margin


def gradients(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point gradient and Hessian of the weighted log loss."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(weight * (p - y) * STEPS), np.rint(weight * p * (1 - p) * STEPS)


def _split_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 10, kinds)], [c.split()[0] for c in SPLIT_DDL.split(", ")])


def _cells(batches: Iterator[pa.RecordBatch], width: int, done, part: Model, slots: np.ndarray, b: Boosting) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, cells) of the pending nodes a task meets; a node may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fit, held, y, weight, bins = _unpacked(batch, width)
        slot = np.where(held, -1, slots[fit, part.place(fit, bins)])
        at = np.flatnonzero(slot >= 0)
        if not len(at):
            continue
        g, h = gradients(_margins(batch, fit, bins, done), np.where(held, 0.0, y), weight)
        own, local = np.unique(slot[at], return_inverse=True)
        for begin in range(0, len(own), HELD_NODES):
            inside = (local >= begin) & (local < begin + HELD_NODES)
            here, base = at[inside], (local[inside] - begin) * b.bins
            count = min(HELD_NODES, len(own) - begin)
            cells = np.empty((count, 3, width, b.bins), np.int64)
            for f in range(width):
                cell = base + bins[here, f]
                for k, w in enumerate((g[here], h[here], None)):
                    cells[:, k, f] = np.bincount(cell, weights=w, minlength=count * b.bins).reshape(count, b.bins)
            yield from zip(own[begin : begin + count].tolist(), cells)


def near_splits(rows: DataFrame, width: int, done: Sequence[Model], part: Model, slots: np.ndarray, sizes: Sequence[int], b: Boosting) -> DataFrame:
    """Best splits of the pending nodes of which one task meets all ``sizes`` rows; ``slots`` numbers nodes by (fit, node), -1 elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, np.ndarray] = {}
        for slot, cells in _cells(batches, width, done, part, slots, b):
            total = open_.pop(slot) + cells if slot in open_ else cells
            if total[2, 0].sum() == sizes[slot]:
                yield _split_batch([(slot, *best_split(total, b))])
                continue
            open_[slot] = total
            if len(open_) > HELD_NODES:  # rows come by fit, so the oldest is not complete here
                open_.pop(next(iter(open_)))

    return rows.mapInArrow(run, SPLIT_DDL)


def far_splits(rows: DataFrame, width: int, done: Sequence[Model], part: Model, slots: np.ndarray, b: Boosting) -> DataFrame:
    """Best splits of pending nodes whose rows lie in several tasks."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, cells in _cells(batches, width, done, part, slots, b):
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([cells.tobytes()], pa.binary())], ["slot", "cells"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = -1, None
        for batch in batches:
            for slot, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(cells, np.int64).reshape(3, width, b.bins)
                if slot == own:
                    total = total + piece
                    continue
                if total is not None:
                    yield _split_batch([(own, *best_split(total, b))])
                own, total = slot, piece
        if total is not None:
            yield _split_batch([(own, *best_split(total, b))])

    cells = rows.mapInArrow(measure, "slot long, cells binary")
    return cells.repartition("slot").sortWithinPartitions("slot").mapInArrow(choose, SPLIT_DDL)


def next_trees(rows: DataFrame, width: int, fit_sizes: Sequence[int], done: Sequence[Model], b: Boosting) -> Model:
    """One more tree for every fit."""
    fits = len(fit_sizes)
    trees = [Tree(b) for _ in range(fits)]
    grown = [t.grow() for t in trees]
    while any(missing for _, missing in grown):
        nodes = max(len(t.sums) for t in trees)
        part, slots, pending, sizes = Model(fits, nodes), np.full((fits, nodes), -1, np.int64), [], []
        for i, (tree, (order, missing)) in enumerate(zip(trees, grown)):
            part.put(i, tree, order)
            for node in missing:
                slots[i, node] = len(pending)
                pending.append((i, node))
                sizes.append(fit_sizes[i] if node == 0 else tree.sums[node][2])
        whole = np.array(fit_sizes) <= SLICE_ROWS
        found = near_splits(rows, width, done, part, np.where(whole[:, None], slots, -1), sizes, b).collect() if whole.any() else []
        met = np.zeros(len(pending) + 1, bool)
        met[[r["slot"] for r in found]] = True
        if not met[:-1].all():
            found += far_splits(rows, width, done, part, np.where(met[slots], -1, slots), b).collect()
        for r in found:  # one row a node
            fit, node = pending[r["slot"]]
            trees[fit].measured(node, r)
        grown = [t.grow() for t in trees]
    return _model([(tree, order) for tree, (order, _) in zip(trees, grown)], b)


def _node_cells(columns: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, b: Boosting) -> np.ndarray:
    """Cells (3, features, bins) of the given rows; ``columns`` holds one row a feature."""
    cells = np.empty((3, len(columns), b.bins), np.int64)
    own_g, own_h = g[rows], h[rows]
    for f, column in enumerate(columns):
        own = column[rows]
        for k, w in enumerate((own_g, own_h, None)):
            cells[k, f] = np.bincount(own, weights=w, minlength=b.bins)
    return cells


def grow_local(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, b: Boosting) -> list[Model]:
    """All trees of one fit whose rows are here; a child's cells are its parent's less its smaller sibling's."""
    columns, margin, models = np.ascontiguousarray(bins.T), np.zeros(len(y)), []
    names = [c.split()[0] for c in SPLIT_DDL.split(", ")]
    for _ in range(b.iterations):
        g, h = gradients(margin, y, weight)
        tree, rows_of, cells_of = Tree(b), {0: np.arange(len(y))}, {}
        order, missing = tree.grow()
        while missing:
            for node in missing:
                if node not in cells_of:
                    cells_of[node] = _node_cells(columns, g, h, rows_of[node], b)
                tree.measured(node, dict(zip(names, (node, *best_split(cells_of[node], b)))))
                if node not in tree.children:
                    continue
                _, feature, bin_ = tree.split[node]
                own = rows_of[node]
                right = columns[feature][own] > bin_
                pair = tree.children[node]
                for child, rows in zip(pair, (own[~right], own[right])):
                    rows_of[child] = rows
                if any(child not in tree.split for child in pair):
                    few, many = sorted(pair, key=lambda c: len(rows_of[c]))
                    cells_of[few] = _node_cells(columns, g, h, rows_of[few], b)
                    cells_of[many] = cells_of[node] - cells_of[few]
                del cells_of[node]
            order, missing = tree.grow()
        model = _model([(tree, order)], b)
        models.append(model)
        for node in set(model.next[:, 0, order].ravel().tolist()) - set(order) or {0}:
            margin[rows_of[node]] += model.value[0, node]
    return models


def _model(grown: Sequence[tuple[Tree, Sequence[int]]], b: Boosting) -> Model:
    """The trees of all fits with the values of their nodes."""
    model = Model(len(grown), max(len(t.sums) for t, _ in grown))
    for i, (tree, order) in enumerate(grown):
        model.put(i, tree, order)
        for node, sums in tree.sums.items():
            model.value[i, node] = -b.rate * (sums[0] / STEPS) / (sums[1] / STEPS + b.l2)
    return model


def near_models(rows: DataFrame, width: int, fits: int, b: Boosting) -> list[Model]:
    """Models of all ``fits``, each trained in one task; the driver gets their trees."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        fit, _, y, weight, bins = _unpacked(batch, width)
        models = grow_local(bins, y, weight, b)
        blob = pickle.dumps([(m.feature[0], m.bin[0], m.next[:, 0], m.value[0]) for m in models])
        return pa.table({"fit_no": pa.array([int(fit[0])], pa.int32()), "model": pa.array([blob], pa.binary())})

    # as many tasks as fits: by their bytes they would be packed into a few
    dealt = rows.repartition(min(fits, LOCAL_TASKS), "fit_no").groupBy("fit_no")
    found = {r["fit_no"]: pickle.loads(bytes(r["model"])) for r in dealt.applyInArrow(run, "fit_no int, model binary").collect()}
    models = []
    for k in range(b.iterations):
        model = Model(fits, max(len(trees[k][0]) for trees in found.values()))
        for i, trees in found.items():
            feature, bin_, next_, value = trees[k]
            n = len(feature)
            model.feature[i, :n], model.bin[i, :n], model.next[:, i, :n], model.value[i, :n] = feature, bin_, next_, value
        models.append(model)
    return models


def _carried(rows: DataFrame, width: int, done: Sequence[Model], row_id: str) -> DataFrame:
    """``rows`` with the margins after ``done``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, _, _, _, bins = _unpacked(batch, width)
            yield batch.set_column(5, "margin", pa.array(_margins(batch, fit, bins, done)))

    return rows.mapInArrow(run, f"{ROW_DDL}, row_id {row_id}")


def usable(rows: DataFrame, keys: Sequence[str], features: Sequence[int], min_n: int) -> DataFrame:
    """(keys, n, ones, used): rows, positive rows, and features with ``min_n`` values that differ, of each fit."""
    item = lambda i: F.get(F.col("x"), F.lit(i))
    good = lambda i: (F.count(item(i)) >= min_n) & F.coalesce(F.min(item(i)) < F.max(item(i)), F.lit(False))
    found = F.array_compact(F.array(*[F.when(good(i), F.lit(i)) for i in features]))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_wrong") > 0.5).alias("ones"), found.alias("used"))


def boost(
    frames: DataFrame, keys: Sequence[str], features: Sequence[int], needs: Sequence[Sequence[int]] = (), min_feature_n: int = 20,
    b: Boosting = Boosting(), limit: int = LOCAL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Scores of held rows and the fits, one boosted model per ``keys``.

    ``frames``: keys, role ('fit' or 'held'), row_id, base_wrong (0, 1; null in
    held rows at most), draw in [0, 1) and x, an array of features. A fit uses those of ``features`` with at least
    ``min_feature_n`` values that differ; it needs one of each block of ``needs`` and both classes, else its status is
    ``unavailable`` or ``single_class`` and it gives no scores. Missing values become the fit's median. Rows of a class
    weigh n / (2 * class size), so models start at even odds.

    Returns (keys, row_id, base_wrong, score) and (keys, n, ones, used, status).
    """
    keys = list(keys)
    spark = frames.sparkSession
    train = frames.where("role = 'fit' and base_wrong is not null")
    size = [frames.schema[k] for k in keys]
    met = F.lit(True)
    for block in needs:
        met = met & F.arrays_overlap("used", F.array(*map(F.lit, block)))
    status = F.when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), "single_class").when((F.size("used") == 0) | ~met, "unavailable").otherwise("complete")
    fits = cut(usable(train, keys, features, min_feature_n).withColumn("status", status), "boost-fits")
    # one row a fit: the size of the grid; large fits come first
    grid = fits.where("status = 'complete'").orderBy(F.col("n") <= limit, *keys).collect()
    out = T.StructType([*size, *[frames.schema[c] for c in ("row_id", "base_wrong")], T.StructField("score", T.DoubleType())])
    if not grid:
        return spark.createDataFrame([], out), fits
    width = max(len(r["used"]) for r in grid)
    number = spark.createDataFrame(
        [(*[r[k] for k in keys], i, len(r["used"]) and int(r["n"]), r["used"], r["n"] / (2.0 * r["ones"]), r["n"] / (2.0 * (r["n"] - r["ones"])))
         for i, r in enumerate(grid)],
        T.StructType([*size, *T.StructType.fromDDL("fit_no int, fit_n long, used array<int>, w1 double, w0 double").fields]),
    )
    rows = frames.where("role = 'held' or base_wrong is not null").join(F.broadcast(number), keys)
    rows = rows.withColumn("v", F.transform("used", lambda i: F.get(F.col("x"), i)))
    own = rows.where("role = 'fit'")
    fill = [np.zeros(len(r["used"])) for r in grid]
    for r in medians(own.select("fit_no", F.posexplode("v").alias("feature", "value")), ["fit_no", "feature"], "value").collect():
        fill[r["fit_no"]][r["feature"]] = r["median"]
    sample = own.where(F.col("draw") * F.col("fit_n") < EDGE_ROWS).select("fit_no", "v")

    def edges_of(frame: pd.DataFrame) -> pd.DataFrame:
        i = int(frame["fit_no"].iloc[0])
        x = np.array([np.asarray(v, float) for v in frame["v"]])
        x = np.where(np.isnan(x), fill[i], x)
        return pd.DataFrame({"fit_no": [i], "edges": [[bin_edges(x[:, j], b.bins).tolist() for j in range(x.shape[1])]]})

    edges = [[np.zeros(0)] * len(r["used"]) for r in grid]
    for r in sample.groupBy("fit_no").applyInPandas(edges_of, "fit_no int, edges array<array<double>>").collect():
        edges[r["fit_no"]] = [np.array(e) for e in r["edges"]]
    row_id = frames.schema["row_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fit = batch.column(0).to_numpy()
            values = batch.column(4).to_pylist()
            bins = np.zeros((n, width), np.uint8)
            order = np.argsort(fit, kind="stable")
            starts = np.flatnonzero(np.append(True, fit[order][1:] != fit[order][:-1])) if n else []
            for begin, end in zip(starts, [*starts[1:], n]):
                at, i = order[begin:end], int(fit[order[begin]])
                x = np.array([values[k] for k in at], float)
                bins[at, : x.shape[1]] = to_bins(np.where(np.isnan(x), fill[i], x), edges[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(np.zeros(n)), batch.column(5)],
                [*[c.split()[0] for c in ROW_DDL.split(", ")], "row_id"])

    slice_ = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("fit_n") / SLICE_ROWS))
    dealt = rows.select(
        "fit_no", (F.col("role") == "held").alias("held"), F.col("base_wrong").cast("double").alias("base_wrong"),
        F.when(F.col("base_wrong") > 0.5, F.col("w1")).otherwise(F.col("w0")).alias("weight"), "v", "row_id", slice_.alias("slice"))
    dealt = dealt.repartition("fit_no", "slice").sortWithinPartitions("fit_no").drop("slice")
    ready = cut(dealt.mapInArrow(pack, f"{ROW_DDL}, row_id {row_id}"), "boost-rows")
    large = sum(r["n"] > limit for r in grid)
    last = []
    if large < len(grid):
        own = ready.where(F.col("fit_no") >= large).withColumn("fit_no", F.col("fit_no") - large)
        models = near_models(own.where("not held"), width, len(grid) - large, b)
        last.append(_carried(own.where("held"), width, models, row_id).withColumn("fit_no", F.col("fit_no") + large))
    if large:
        own, done = ready.where(F.col("fit_no") < large), []
        for _ in range(b.iterations):
            done.append(next_trees(own.where("not held"), width, [r["n"] for r in grid[:large]], done, b))
            if len(done) == REWRITE:
                own, done = cut(_carried(own, width, done, row_id), "boost-rows"), []
        last.append(_carried(own.where("held"), width, done, row_id))
    last = last[0] if len(last) == 1 else last[0].unionByName(last[1])
    scores = last.join(F.broadcast(number.select(*keys, "fit_no")), "fit_no")
    return scores.select(*keys, "row_id", "base_wrong", (1 / (1 + F.exp(-F.col("margin")))).alias("score")), fits
