"""Softmax gradient boosting on histograms.

Features are binned once. A level of all class trees of a round is one job: every task adds up gradients and hessians by
(class tree, node, bin) over its blocks, the sums of a node meet in one place, and the best split by the penalised gain
comes back - one short row per node, whatever the data. Leaf values are read off the same sums. So a round takes as many
jobs as trees have levels, however many classes there are. Gradients are summed as integers (fixed point), hence the
trees do not depend on how rows are dealt out.

Where all binned rows fit into ``GATHERED`` bytes, they are sent to the executors once, and a round is one small job with a task for
each class tree; tasks are sent the trees since and keep the margins up to date. Where just the rows of the nodes asked for
fit, those are brought together by node and the rest of the tree below is grown there: one job in place of a level each.
All three ways use the same sums and the same rule, with equal results.

``max_leaves`` grows leaf by leaf, best gain first: the splits of all leaves that may come next are asked for in one job,
and the order is settled from the gains. ``early_stopping`` keeps a share of the rows back and stops when their loss has
not improved for some rounds.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.functions.probability import softmax
from blotter.models import binned
from blotter.models.nodes import SCHEMA, SENT_BYTES, Walker, summed, summed_by_shards
from blotter.models.prior import class_counts
from blotter.session import scratch_path

MIN_HESSIAN = 1e-16
MIN_GAIN = 1e-6
#: Cells of a task's sums; levels with more are done in several jobs.
CELLS = 1 << 24
#: Rows of a block from which its sums are added up feature by feature, not in one call.
BY_FEATURE = 4096
#: Cells of sums that one task puts together.
REDUCED = 1 << 18
#: Bytes of rows that a job may bring together to grow whole subtrees, or that are sent to every task.
GATHERED = 128 << 20
#: Rows whose whole numbers of 36 bits add up exactly in a double.
EXACT_ROWS = 1 << 16
#: Bytes of the margins, and of the sums of a tree, that a task may hold beside the rows sent to it.
HELD_BYTES = 128 << 20
#: Nodes up to which rows are sent through a whole tree at once, node by node.
SMALL_TREE = 256
#: Above so many rows ``early_stopping="auto"`` stops early.
AUTO_ROWS = 10_000
PATIENCE, TOLERANCE, HELD_SHARE = 10, 1e-7, 0.1
LOSS = -1  # stands for a class tree in rows that carry the loss of kept-back rows


def leaf_value(g: float, h: float, alpha: float, lam: float) -> float:
    """Newton step with soft-thresholded gradient sum."""
    pulled = math.copysign(max(abs(g) - alpha, 0.0), g)
    return -pulled / (h + lam) if h + lam > 0 else 0.0


def score_of(g: np.ndarray, h: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    """What a node's Newton step takes off the loss, doubled."""
    pulled = np.maximum(np.abs(g) - alpha, 0.0)
    return np.divide(pulled * pulled, h + lam, out=np.zeros_like(pulled), where=h + lam > 0)


@dataclass
class Split:
    feature: int
    bin: int
    gain: float
    left: tuple[float, float, float]
    right: tuple[float, float, float]


@dataclass
class Known:
    """What a job found out about a node: its sums, its best split, and the places of its children in the answer (or None)."""

    total: tuple[float, float, float]
    split: Split | None
    children: tuple[int, int] | None = None


@dataclass
class Rule:
    """How splits are chosen: the settings, and where the bins of each feature begin."""

    offsets: np.ndarray
    scale: float
    alpha: float
    lam: float
    gamma: float
    least: float
    min_leaf: int

    @property
    def counted(self) -> bool:
        """Whether a split depends on numbers of rows."""
        return self.min_leaf > 1

    def best(self, part: np.ndarray, take: list[int] | None) -> Known:
        """From the sums (gradients, hessians, rows) of a node by bin."""
        offsets, scale = self.offsets, self.scale
        total = part[:, : offsets[1]].sum(axis=1)
        # Sums up to each bin, feature by feature.
        upto = np.cumsum(part, axis=1)
        upto -= np.repeat((upto - part)[:, offsets[:-1]], np.diff(offsets), axis=1)
        gl, hl = upto[0] / scale, upto[1] / scale
        gr, hr = (total[0] - upto[0]) / scale, (total[1] - upto[1]) / scale
        g, h, n = total[0] / scale, total[1] / scale, float(total[2])
        least = max(self.least, 1e-300)
        # Both sides have a hessian, and so a row at least.
        may = (hl >= least) & (hr >= least)
        if self.counted:
            may &= (upto[2] >= self.min_leaf) & (total[2] - upto[2] >= self.min_leaf)
        if take is not None:
            chosen = np.zeros(len(offsets) - 1, bool)
            chosen[take] = True
            may &= np.repeat(chosen, np.diff(offsets))
        at = np.flatnonzero(may)
        if not len(at):
            return Known((g, h, n), None)
        gain = score_of(gl[at], hl[at], self.alpha, self.lam) + score_of(gr[at], hr[at], self.alpha, self.lam) - score_of(np.array([g]), np.array([h]), self.alpha, self.lam)
        # Equal gains go to the first feature and bin, also when they differ in the last digits.
        first = int(np.argmax(gain >= gain.max() - 1e-12 * abs(gain.max())))
        if gain[first] <= MIN_GAIN or gain[first] < self.gamma:
            return Known((g, h, n), None)
        best, top = int(at[first]), float(gain[first])
        f = int(np.searchsorted(offsets, best, "right")) - 1
        sides = [(float(a[best]), float(b[best]), float(c)) for a, b, c in ((gl, hl, upto[2][best]), (gr, hr, total[2] - upto[2][best]))]
        return Known((g, h, n), Split(f, best - int(offsets[f]), top, *sides))

    def sums(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray | int = 0, slots: int = 1) -> np.ndarray:
        """(3, slots, bins) sums of rows; exact, since a block's whole numbers fit into doubles."""
        cells = int(self.offsets[-1])
        out = np.empty((3, slots, cells), np.int64)
        if x.shape[1] >= BY_FEATURE:
            # Feature by feature nothing of the size of the block is made.
            for v, start, end in zip(x, self.offsets[:-1], self.offsets[1:]):
                at = v.astype(np.intp) + slot * (end - start)
                for channel, weight in enumerate((g, h, None)):
                    out[channel, :, start:end] = np.bincount(at, weight, slots * (end - start)).reshape(slots, -1)
            return out
        at = (x + self.offsets[:-1, None] + slot * cells).ravel()
        for channel, weight in enumerate((g, h)):
            out[channel] = np.bincount(at, np.broadcast_to(weight, x.shape).ravel(), slots * cells).astype(np.int64).reshape(slots, cells)
        out[2] = np.bincount(at, minlength=slots * cells).reshape(slots, cells)
        return out

    def subtree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, take: list[int] | None, depth: int | None, leaves: int | None) -> list[Known]:
        """The tree below a node whose rows are all here, the best gain first when the number of leaves is bounded."""

        def whole(rows: np.ndarray) -> np.ndarray:
            # Few enough rows at a time for exact sums in doubles.
            return sum(self.sums(x[:, part], g[part], h[part])[:, 0] for part in np.array_split(rows, len(rows) // binned.BLOCK_ROWS + 1))

        rows = np.arange(x.shape[1])
        part = whole(rows)
        out = [self.best(part, take)]
        heap = [(0.0 if leaves is None else -out[0].split.gain, 0, 0, rows, part)] if out[0].split else []
        grown = 1
        while heap and (leaves is None or grown < leaves):
            _, place, level, rows, part = heapq.heappop(heap)
            if depth is not None and level >= depth:
                continue
            split = out[place].split
            goes = x[split.feature, rows] <= split.bin
            sides = [rows[goes], rows[~goes]]
            small = int(len(sides[1]) < len(sides[0]))
            sums = [None, None]
            sums[small] = whole(sides[small])
            sums[1 - small] = part - sums[small]
            out[place].children = (len(out), len(out) + 1)
            grown += 1
            for side in (0, 1):
                found = self.best(sums[side], take)
                if found.split:
                    heapq.heappush(heap, (float(len(out)) if leaves is None else -found.split.gain, len(out), level + 1, sides[side], sums[side]))
                out.append(found)
        return out


    def by_node(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, groups: list[np.ndarray | None], take: list[int] | None) -> np.ndarray:
        """(groups, 3, bins) sums of the rows of some nodes; None stands for all rows. Rows are counted only if a split depends on it."""
        m, offsets = len(groups), self.offsets
        out = np.zeros((m, 3, int(offsets[-1])), np.int64)
        rows = None if groups[0] is None else np.concatenate(groups)
        slot = None if m == 1 else np.repeat(np.arange(m) * binned.MAX_BINS, [len(group) for group in groups])
        # The first feature gives the totals.
        chosen = range(len(x)) if take is None else sorted({0, *take})
        for at in range(0, x.shape[1] if rows is None else len(rows), EXACT_ROWS):
            part = slice(at, at + EXACT_ROWS)
            some = part if rows is None else rows[part]
            own = (g[some], h[some], None) if self.counted else (g[some], h[some])
            place = None if slot is None else slot[part]
            for f in chosen:
                v = x[f][some]
                cell = v.astype(np.intp) if place is None else v + place
                start, end = offsets[f], offsets[f + 1]
                for channel, weight in enumerate(own):
                    sums = np.bincount(cell, weight, m * binned.MAX_BINS).reshape(m, -1)
                    out[:, channel, start:end] += sums[:, : end - start].astype(np.int64)
        return out

    def whole_tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None, take: list[int] | None, depth: int | None, leaves: int | None) -> list[Known]:
        """As ``subtree`` for some rows of a matrix that stays as it is, the nodes of a level at a time unless leaves are bounded."""
        part = self.by_node(x, g, h, [rows], take)[0]
        out = [self.best(part, take)]
        # Place, level, rows and sums of nodes that have a split.
        heap = [(0.0 if leaves is None else -out[0].split.gain, 0, 0, rows, part)] if out[0].split else []
        grown = 1
        while heap and (leaves is None or grown < leaves):
            asked, heap = (heap, []) if leaves is None else ([heapq.heappop(heap)], heap)
            asked = [a for a in asked if depth is None or a[2] < depth]
            if not asked:
                continue
            if depth is not None and asked[0][2] + 1 >= depth and leaves is None:
                # Their children are leaves, whose sums the splits have.
                for _, place, *_ in asked:
                    out[place].children = (len(out), len(out) + 1)
                    out += [Known(total, None) for total in (out[place].split.left, out[place].split.right)]
                break
            sides = []
            for _, place, _, own, _ in asked:
                split = out[place].split
                goes = (x[split.feature] if own is None else x[split.feature][own]) <= split.bin
                sides.append((np.flatnonzero(goes), np.flatnonzero(~goes)) if own is None else (own[goes], own[~goes]))
            small = [int(len(right) < len(left)) for left, right in sides]
            for (_, place, level, _, whole), pair, least, part in zip(asked, sides, small, self.by_node(x, g, h, [pair[least] for pair, least in zip(sides, small)], take)):
                out[place].children = (len(out), len(out) + 1)
                grown += 1
                parts = (whole - part, part) if least else (part, whole - part)
                for side in (0, 1):
                    found = self.best(parts[side], take)
                    if found.split:
                        entry = (float(len(out)) if leaves is None else -found.split.gain, len(out), level + 1, pair[side], parts[side])
                        heap.append(entry) if leaves is None else heapq.heappush(heap, entry)
                    out.append(found)
        return out


@dataclass
class Tree:
    """A class tree while it grows: parallel lists by node, and the splits known for leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float, int] | None] = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, s: Split) -> None:
        self.feature[node], self.bin[node], self.gain[node] = s.feature, s.bin, s.gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for sums in (s.left, s.right):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.value, 0.0)):
                column.append(empty)
            self.sums.append(sums)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.bin, np.uint8), np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value)


def walk(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Node of each row of a binned block."""
    feature, bins, left, right, _ = tree
    at, rows = np.zeros(x.shape[1], np.int32), np.arange(x.shape[1])
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        at = np.where(inner, np.where(x[np.maximum(f, 0), rows] <= bins[at], left[at], right[at]), at)


def leaf_values(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Value of each row of a binned block."""
    feature, bins, left, right, value = tree
    if len(feature) == 1 or len(feature) > SMALL_TREE:
        return value[walk(x, tree)]
    # From the last node to the root: which node a row ends in below each node. Children come after their parents.
    ends: dict[int, np.ndarray | np.uint8] = {}
    for node in range(len(feature) - 1, -1, -1):
        if feature[node] < 0:
            ends[node] = np.uint8(node)
            continue
        goes = np.negative((x[feature[node]] <= bins[node]).view(np.uint8))
        a, b = ends.pop(int(left[node])), ends.pop(int(right[node]))
        ends[node] = b ^ ((a ^ b) & goes)
    return value[ends[0]]


class SoftmaxBoosting(Estimator):
    """``prior_start`` begins with the logs of the class shares instead of equal margins; ``hessian`` scales p (1 - p)."""

    def __init__(
        self,
        rounds: int = 300,
        depth: int | None = 6,
        eta: float = 0.1,
        subsample: float = 1.0,
        colsample: float = 1.0,
        min_child_weight: float = 1.0,
        alpha: float = 0.0,
        lam: float = 1.0,
        gamma: float = 0.0,
        max_bins: int = binned.MAX_BINS,
        seed: int = 12345,
        features_col: str = "features",
        label_col: str = "label",
        checkpoint_every: int = 10,
        min_leaf: int = 1,
        max_leaves: int | None = None,
        early_stopping: bool | str = False,
        prior_start: bool = False,
        hessian: float = 2.0,
    ):
        super().__init__()
        if depth is None and max_leaves is None:
            raise ValueError("trees need a depth or a number of leaves")
        self.rounds, self.depth, self.eta, self.min_leaf, self.max_leaves = rounds, depth, eta, min_leaf, max_leaves
        self.subsample, self.colsample, self.min_child_weight = subsample, colsample, min_child_weight
        self.alpha, self.lam, self.gamma, self.max_bins, self.seed = alpha, lam, gamma, max_bins, seed
        self.features_col, self.label_col, self.checkpoint_every = features_col, label_col, checkpoint_every
        self.early_stopping, self.prior_start, self.hessian = early_stopping, prior_start, hessian

    @classmethod
    def histogram(cls, rounds: int = 200, eta: float = 0.1, max_leaves: int = 31, lam: float = 0.0, seed: int = 12345, **options) -> "SoftmaxBoosting":
        """Leaf-wise boosting with early stopping above ``AUTO_ROWS`` rows."""
        settings = dict(depth=None, min_child_weight=1e-3, min_leaf=20, early_stopping="auto", prior_start=True, hessian=1.0)
        return cls(rounds, eta=eta, lam=lam, seed=seed, max_leaves=max_leaves, **{**settings, **options})

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        counts = class_counts(dataset, self.label_col)
        rows, n = sum(counts.values()), max(counts) + 1
        array = binned.as_array(dataset, self.features_col)
        width = dataset.select(F.size(array)).first()[0]
        edges = binned.learn_edges(dataset, self.features_col, width, self.max_bins)
        others = [c for c in dataset.columns if c != self.features_col]
        key = F.xxhash64(*others, self.features_col)
        sent = _may_be_sent(self, edges, n, rows)
        data = binned.blocks(dataset, self.features_col, self.label_col, key, edges, rows, 0 if sent else n)
        return (_SentFit if sent else _Fit)(self, data.persist(), edges, counts, n, rows, dataset.sparkSession).run()


class _Fit:
    """The state of one fit on the driver: the trees since the margins were last written, and nothing that grows with rows."""

    def __init__(self, settings: SoftmaxBoosting, data: DataFrame, edges: list[np.ndarray], counts: dict[int, int], classes: int, rows: int, spark: SparkSession):
        self.s, self.data, self.edges, self.classes = settings, data, edges, classes
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        # Sums of so many whole numbers stay exact in 64 bits, and those of a block in a double.
        self.scale = 2.0 ** min(36, 61 - math.ceil(math.log2(rows + 1)))
        self.stopping = settings.early_stopping is True or (settings.early_stopping == "auto" and rows > AUTO_ROWS)
        base = np.zeros(classes)
        if settings.prior_start:
            shares = np.log([max(counts.get(k, 0), 0.5) / rows for k in range(classes)])
            base = shares - shares.mean()
        self.base, self.recent, self.grown, self.rows = base, [], [], rows
        self.spark, self.jobs = spark, 0

    def run(self) -> "SoftmaxBoostingModel":
        try:
            self._rounds()
        finally:
            self._end()
        return SoftmaxBoostingModel(self.classes, len(self.edges), self._table(), self.s.features_col, self.base.tolist(), len(self.grown))

    def _end(self) -> None:
        self.data.unpersist()

    def _rounds(self) -> None:
        losses, rng = [], random.Random(self.s.seed)
        width = len(self.edges)
        for r in range(self.s.rounds + self.stopping):
            take = [sorted(rng.sample(range(width), max(1, math.ceil(self.s.colsample * width)))) if self.s.colsample < 1 else None for _ in range(self.classes)]
            trees = [Tree() for _ in range(self.classes)]
            found, loss = self._look(r, trees, [(k, 0) for k in range(self.classes)], take, 0, r == 0, self.rows * self.classes)
            if self.stopping:
                losses.append(loss)
                if r == self.s.rounds or (len(losses) > PATIENCE and not min(losses[-PATIENCE:]) < losses[-PATIENCE - 1] - TOLERANCE):
                    break
            trees = [_in_order(tree) for tree in self._grow(r, trees, found, take)]
            for tree in trees:
                tree.value = [0.0 if f >= 0 else self.s.eta * leaf_value(t[0], t[1], self.s.alpha, self.s.lam) for f, t in zip(tree.feature, tree.sums)]
            self.grown.append(trees)
            self.recent.append([t.arrays() for t in trees])
            if len(self.recent) >= self.s.checkpoint_every and r + 1 < self.s.rounds:
                self._settle()

    def _grow(self, r: int, trees: list[Tree], found: dict[tuple[int, int], list[Known]], take: list) -> list[Tree]:
        s = self.s
        known: list[dict[int, Known]] = [{} for _ in trees]
        level = [{0: 0} for _ in trees]

        def graft(k: int, node: int, answer: list[Known], place: int) -> None:
            tree, entry = trees[k], answer[place]
            known[k][node], tree.sums[node] = entry, entry.total
            if entry.split and s.depth is not None and level[k][node] >= s.depth:
                entry.split = None
            if entry.split and (entry.children or s.max_leaves is None):
                tree.split(node, entry.split)
                for side, child in enumerate((tree.left[node], tree.right[node])):
                    level[k][child] = level[k][node] + 1
                    if entry.children:
                        graft(k, child, answer, entry.children[side])

        while True:
            for (k, node), answer in found.items():
                graft(k, node, answer, 0)
            asked = []
            for k, tree in enumerate(trees):
                if s.max_leaves is None:
                    ends = [node for node, f in enumerate(tree.feature) if f < 0]
                else:
                    # Leaf by leaf: trees hold every split asked for so far, more than they will keep.
                    _, missing = _best_first(tree, known[k], s.max_leaves)
                    for node in missing:
                        if tree.feature[node] < 0:
                            tree.split(node, known[k][node].split)
                            level[k].update({c: level[k][node] + 1 for c in (tree.left[node], tree.right[node])})
                    ends = [c for node in missing for c in (tree.left[node], tree.right[node])]
                asked += [(k, node) for node in ends if node not in known[k] and (s.depth is None or level[k][node] < s.depth)]
            if not asked:
                break
            rows = sum(trees[k].sums[node][2] for k, node in asked)
            found, _ = self._look(r, trees, asked, take, min(level[k][node] for k, node in asked), False, rows)
        if s.max_leaves is None:
            return trees
        return [_pruned(tree, known[k], _best_first(tree, known[k], s.max_leaves)[0]) for k, tree in enumerate(trees)]

    def _look(self, r: int, trees: list[Tree], asked: list[tuple[int, int]], take: list, level: int, loss: bool, rows: float):
        """What is known of the nodes asked for: from their rows where those are few, else one job for as many as ``CELLS`` allow."""
        found, held = {}, None
        arrays = [t.arrays() for t in trees]
        loss = (loss or (level == 0)) and self.stopping
        if rows * (len(self.edges) + 16) <= GATHERED:
            return self._job(r, arrays, asked, take, loss, None if self.s.depth is None else self.s.depth - level, True)
        per = max(1, CELLS // (int(self.offsets[-1]) * 3))
        for at in range(0, len(asked), per):
            some, lost = self._job(r, arrays, asked[at : at + per], take, loss and at == 0, None, False)
            found.update(some)
            held = held if lost is None else lost
        return found, held

    def _job(self, r: int, trees: list, asked: list[tuple[int, int]], take: list, with_loss: bool, depth: int | None, gather: bool):
        self.jobs += 1
        s, classes, scale, base, recent, stopping = self.s, self.classes, self.scale, self.base, self.recent, self.stopping
        rule = Rule(self.offsets, scale, s.alpha, s.lam, s.gamma, s.min_child_weight, s.min_leaf)
        width, cells, subsample, seed, hessian, leaves = len(self.edges), int(self.offsets[-1]), s.subsample, s.seed, s.hessian, s.max_leaves
        nodes = [[node for k, node in asked if k == c] for c in range(classes)]
        take = [take[k] for k in range(classes)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((3, len(own), cells), np.int64) for own in nodes] if not gather else []
            lost = np.zeros(2, np.int64)

            def rows_of(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["k", "node", "cell"])

            for block in binned.each(batches):
                margin = margins(block, base, recent)
                margin -= margin.max(axis=0)
                p = np.exp(margin)
                p /= p.sum(axis=0)
                used = np.ones(block.n, bool)
                if stopping:
                    kept = held_back(block.hash, seed)
                    used &= ~kept
                    if with_loss:
                        own = p[block.label[kept], np.flatnonzero(kept)]
                        lost += [int(np.rint(-np.log(np.maximum(own, 1e-300)) * 2.0**24).sum()), len(own)]
                if subsample < 1:
                    used &= binned.uniform(binned.keyed(block.hash, seed, r)) < subsample
                for k, own in enumerate(nodes):
                    if not own:
                        continue
                    place = np.full(len(trees[k][0]), -1.0)
                    place[own] = np.arange(len(own))
                    slot = leaf_values(block.x, (*trees[k][:4], place.astype(np.int64)))
                    rows = np.flatnonzero(used & (slot >= 0))
                    g = np.rint((p[k, rows] - (block.label[rows] == k)) * scale)
                    h = np.rint(np.maximum(hessian * p[k, rows] * (1 - p[k, rows]), MIN_HESSIAN) * scale)
                    if not gather:
                        sums[k] += rule.sums(block.x[:, rows], g, h, slot[rows], len(own))
                        continue
                    for i, node in enumerate(own):
                        mine = slot[rows] == i
                        yield rows_of([(k, node, np.int64(mine.sum()).tobytes() + block.x[:, rows[mine]].tobytes() + g[mine].tobytes() + h[mine].tobytes())])
            out = [] if gather else [(k, node, sums[k][:, i].tobytes()) for k, own in enumerate(nodes) for i, node in enumerate(own)]
            if with_loss:
                out.append((LOSS, 0, lost.tobytes()))
            yield rows_of(out)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list[np.ndarray] | np.ndarray] = {}
            for batch in batches:
                for k, node, cell in zip(*(batch.column(i) for i in range(3))):
                    name, data = (k.as_py(), node.as_py()), cell.as_buffer()
                    if gather and name[0] != LOSS:
                        held.setdefault(name, []).append(cell.as_py())
                    else:
                        part = np.frombuffer(data, np.int64)
                        held[name] = held[name] + part if name in held else part
            rows = []
            for (k, node), part in held.items():
                if k == LOSS:
                    rows.append((k, node, 0, -1, 0, 0.0, [float(part[0]) / 2.0**24, float(part[1])], -1, -1))
                    continue
                if gather:
                    pieces = []
                    for cell in part:
                        n = int(np.frombuffer(cell, np.int64, 1)[0])
                        x = np.frombuffer(cell, np.uint8, n * width, 8).reshape(width, n)
                        pieces.append((x, *(np.frombuffer(cell, np.float64, n, 8 + n * (width + 8 * j)) for j in range(2))))
                    answer = rule.subtree(*(np.concatenate([p[j] for p in pieces], axis=-1) for j in range(3)), take[k], depth, leaves)
                else:
                    answer = [rule.best(part.reshape(3, cells), take[k])]
                for i, known in enumerate(answer):
                    f, b, gain, sides = (known.split.feature, known.split.bin, known.split.gain, [*known.split.left, *known.split.right]) if known.split else (-1, 0, 0.0, [])
                    rows.append((k, node, i, f, b, gain, [*known.total, *sides], *(known.children or (-1, -1))))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.int32())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "node", "i", "f", "b", "gain", "sums", "l", "r"])

        partial = self.data.mapInArrow(add, "k int, node int, cell binary")
        most = self.data.sparkSession.sparkContext.defaultParallelism
        reducers = min(most, len(asked)) if gather else min(most, len(asked) * cells // REDUCED + 1)
        # One short row for each node that was looked at comes back.
        answers = partial.repartition(reducers, "k", "node").mapInArrow(choose, "k int, node int, i int, f int, b int, gain double, sums array<double>, l int, r int").collect()
        found, lost = {}, None
        for k, node, i, f, b, gain, sums, left, right in sorted(answers):
            if k == LOSS:
                lost = sums[0] / max(sums[1], 1.0)
            else:
                split = Split(f, b, gain, tuple(sums[3:6]), tuple(sums[6:9])) if f >= 0 else None
                found.setdefault((k, node), []).append(Known(tuple(sums[:3]), split, (left, right) if left >= 0 else None))
        return found, lost

    def _settle(self) -> None:
        """Write the margins, so that later jobs walk only the trees since."""
        base, recent = self.base, self.recent

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [(margins(binned.Block(batch, i), base, recent) - base[:, None]).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(4)), pa.array(cells, pa.binary())], batch.schema.names)

        path = scratch_path(self.spark, "margins")
        self.data.mapInArrow(moved, self.data.schema).write.parquet(path)
        self.data.unpersist()
        self.data = self.data.sparkSession.read.parquet(path).persist()
        self.recent = []

    def _table(self) -> pa.Table:
        rows = []
        for r, trees in enumerate(self.grown):
            for k, t in enumerate(trees):
                for node, f in enumerate(t.feature):
                    cut = float(self.edges[f][t.bin[node]]) if f >= 0 else 0.0
                    left, right = (t.left[node], t.right[node]) if f >= 0 else (-1, -1)
                    rows.append((r, k, node, f, cut, left, right, t.gain[node], t.sums[node][1] if t.sums[node] else 0.0, [t.value[node]]))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)


def _may_be_sent(s: SoftmaxBoosting, edges: list[np.ndarray], classes: int, rows: int) -> bool:
    """Whether rows, margins and the sums of a tree's nodes are few enough for every task."""
    ends = min(rows, 2 * s.max_leaves if s.max_leaves else 1 << min(s.depth, 40))
    held = ends * sum(len(e) + 1 for e in edges) * 24
    return rows * (len(edges) + 16) <= GATHERED and max(rows * classes * 8, held) <= HELD_BYTES


class _Rows:
    """All rows as sent to tasks; each worker process keeps the margins of the trees it has met so far."""

    def __init__(self, x: np.ndarray, label: np.ndarray, hashes: np.ndarray, base: np.ndarray):
        self.x, self.label, self.hash, self.base = x, label, hashes, base
        self.margin, self.settled, self.met = None, 0, 0

    def follow(self, settled: list, recent: list) -> None:
        """Margins of all trees: of rounds ``settled`` before, a list in each broadcast, and of those since."""
        if self.margin is None:
            self.margin = np.tile(self.base[:, None], (1, len(self.label)))
        for rounds in (*settled[self.settled :], None):
            trees = recent if rounds is None else rounds.value
            for at in range(0, len(self.label), EXACT_ROWS):
                part = slice(at, at + EXACT_ROWS)
                x = self.x[:, part]
                for own in trees[self.met :]:
                    for k, tree in enumerate(own):
                        self.margin[k, part] += leaf_values(x, tree)
            self.met = len(trees)
            if rounds is not None:
                # To the last digit as margins that are written without their base and read again.
                self.margin -= self.base[:, None]
                self.margin += self.base[:, None]
                self.settled, self.met = self.settled + 1, 0


class _SentFit(_Fit):
    """A fit whose rows were sent to the executors: a round is one job with a task for each class tree."""

    def __init__(self, settings, data, edges, counts, classes, rows, spark):
        super().__init__(settings, data, edges, counts, classes, rows, spark)
        # At most ``GATHERED`` bytes.
        parts = [binned.Block(batch, i) for batch in data.select("n", "x", "label", "hash", "margin").toArrow().to_batches() for i in range(batch.num_rows)]
        data.unpersist()
        whole = [np.concatenate([getattr(part, name) for part in parts], axis=-1) for name in ("x", "label", "hash")]
        parts.clear()
        context = spark.sparkContext
        self.shared, self.settled = context.broadcast(_Rows(*whole, self.base)), []
        self.tasks = context.parallelize(range(classes), classes)

    def _look(self, r: int, trees: list[Tree], asked: list[tuple[int, int]], take: list, level: int, loss: bool, rows: float):
        """The whole trees of a round."""
        self.jobs += 1
        s, scale, shared, settled, recent, stopping = self.s, self.scale, self.shared, self.settled, self.recent, self.stopping
        rule = Rule(self.offsets, scale, s.alpha, s.lam, s.gamma, s.min_child_weight, s.min_leaf)
        subsample, seed, hessian, depth, leaves = s.subsample, s.seed, s.hessian, s.depth, s.max_leaves

        def grown(numbers: Iterator[int]) -> Iterator[tuple]:
            k, held = next(iter(numbers)), shared.value
            held.follow(settled, recent)
            n, used, lost = len(held.label), None, None
            if stopping:
                kept = held_back(held.hash, seed)
                used, lost = ~kept, [0, 0]
            if subsample < 1:
                drawn = binned.uniform(binned.keyed(held.hash, seed, r)) < subsample
                used = drawn if used is None else used & drawn
            g, h = np.empty((2, n))
            for at in range(0, n, binned.BLOCK_ROWS):
                part = slice(at, at + binned.BLOCK_ROWS)
                margin = held.margin[:, part] - held.margin[:, part].max(axis=0)
                p = np.exp(margin)
                p /= p.sum(axis=0)
                if lost and k == 0:
                    own = p[held.label[part][kept[part]], np.flatnonzero(kept[part])]
                    lost[0] += int(np.rint(-np.log(np.maximum(own, 1e-300)) * 2.0**24).sum())
                    lost[1] += len(own)
                g[part] = np.rint((p[k] - (held.label[part] == k)) * scale)
                h[part] = np.rint(np.maximum(hessian * p[k] * (1 - p[k]), MIN_HESSIAN) * scale)
            rows = None if used is None else np.flatnonzero(used)
            yield k, rule.whole_tree(held.x, g, h, rows, take[k], depth, leaves), lost

        answers = {k: (tree, lost) for k, tree, lost in self.tasks.mapPartitions(grown).collect()}
        lost = answers[0][1]
        return {(k, 0): tree for k, (tree, _) in answers.items()}, lost and lost[0] / 2.0**24 / max(lost[1], 1.0)

    def _settle(self) -> None:
        """Trees that may be sent once more to workers that have not met them."""
        self.settled.append(self.spark.sparkContext.broadcast(self.recent))
        self.recent = []

    def _end(self) -> None:
        for one in (self.shared, *self.settled):
            one.destroy()


def margins(block: binned.Block, base: np.ndarray, recent: list) -> np.ndarray:
    out = block.margin + base[:, None]
    for trees in recent:
        for k, tree in enumerate(trees):
            out[k] += leaf_values(block.x, tree)
    return out


def held_back(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The rows that only measure the loss."""
    return binned.uniform(binned.keyed(hashes, seed, -1)) < HELD_SHARE


def _best_first(tree: Tree, known: dict[int, Known], most: int) -> tuple[set[int], list[int]]:
    """Nodes split by best-first growth, and those among them whose children are not known yet."""
    splits = lambda node: node in known and known[node].split is not None
    heap = [(-known[0].split.gain, 0)] if splits(0) else []
    kept, missing, leaves = set(), [], 1
    while heap and leaves < most:
        _, node = heapq.heappop(heap)
        kept.add(node)
        leaves += 1
        children = (tree.left[node], tree.right[node]) if tree.feature[node] >= 0 else ()
        if leaves < most and (not children or any(c not in known for c in children)):
            missing.append(node)
        for child in children:
            if splits(child):
                heapq.heappush(heap, (-known[child].split.gain, child))
    return kept, missing


def _in_order(tree: Tree) -> Tree:
    """The same tree with nodes numbered level by level, whichever jobs it came from."""
    out, queue = Tree(), [(0, 0)]
    out.sums = [tree.sums[0]]
    for old, new in queue:
        if tree.feature[old] >= 0:
            left, right = tree.left[old], tree.right[old]
            out.split(new, Split(tree.feature[old], tree.bin[old], tree.gain[old], tree.sums[left], tree.sums[right]))
            queue += [(left, out.left[new]), (right, out.right[new])]
    return out


def _pruned(tree: Tree, known: dict[int, Known], kept: set[int]) -> Tree:
    """The tree with the splits in ``kept`` only, nodes numbered anew."""
    out = Tree()
    out.sums = [tree.sums[0]]
    queue = [(0, 0)]
    for old, new in queue:
        if old in kept:
            out.split(new, known[old].split)
            if tree.feature[old] >= 0:
                queue += [(tree.left[old], out.left[new]), (tree.right[old], out.right[new])]
    return out


class SoftmaxBoostingModel(Model, MLWritable, MLReadable):
    """``table`` is the node table (see ``nodes``), ``base`` the margins before the first round."""

    def __init__(self, classes=0, width=0, table: pa.Table | None = None, features_col="features", base=(), rounds=0):
        super().__init__()
        self.classes, self.width, self.table, self.features_col = classes, width, table, features_col
        self.base, self.rounds = list(base) or [0.0] * classes, rounds
        self._walker = None

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table."""
        return spark.createDataFrame(self.table).to(spark.createDataFrame([], SCHEMA).schema)

    def margins(self, dataset: DataFrame) -> DataFrame:
        self._walker = self._walker or Walker(self.table)
        spark = dataset.sparkSession
        if self._walker.bytes <= SENT_BYTES:
            scored = dataset.withColumn("margin", summed(spark, self._walker, self.classes, binned.as_array(dataset, self.features_col)))
        else:
            scored = summed_by_shards(dataset, self.nodes(spark), self.classes, self.features_col, "margin")
        start = F.array(*[F.lit(b) for b in self.base])
        return scored.withColumn("margin", F.zip_with("margin", start, lambda a, b: a + b)) if any(self.base) else scored

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return softmax(self.margins(dataset), self.classes, "margin").drop("margin")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        m, spark = self.model, SparkSession.active()
        fitted = {"classes": m.classes, "width": m.width, "features_col": m.features_col, "base": m.base, "rounds": m.rounds}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"fitted": json.dumps(fitted)})
        m.nodes(spark).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = SparkSession.active()
        name = self.cls.__module__ + "." + self.cls.__name__
        metadata = DefaultParamsReader.loadMetadata(path, spark, name)
        f = json.loads(metadata["fitted"])
        model = self.cls(f["classes"], f["width"], spark.read.parquet(f"{path}/nodes").toArrow(), f["features_col"], f["base"], f["rounds"])
        model._resetUid(metadata["uid"])
        return model
