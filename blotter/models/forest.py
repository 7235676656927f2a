"""Random forests and extremely randomised trees without a limit of depth.

Nodes with many rows are split level by level for all trees at once: class counts by (tree, node, bin), added up in tasks
and put together by node, give the best split; drawn thresholds take a pass for the least and largest values and one for
the counts. Once a node's rows fit into ``GATHERED`` bytes they are brought together, and the tree below is grown there, all
its nodes of a level at a time. Where twice ``GATHERED`` bytes hold all rows, these are sent to the executors once instead,
and every task grows whole trees from them; for drawn thresholds rows then hold places in the sorted values. Bootstrap weights are Poisson draws of a row's hash, and the features and thresholds a node
tries are draws of its path, so a forest depends on its rows and seed only, not on partitions or executors. The node table
is written by the executors; only nodes that are split level by level pass through the driver.

A node tries features in random order until ``max_features`` of them vary. Equal gains go to the one tried first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.models import binned
from blotter.models.binned import GOLDEN, MASK, mixed, uniform
from blotter.models.mllib import balanced_weights
from blotter.models.nodes import SCHEMA, SENT_BYTES, Walker, summed, summed_by_shards
from blotter.models.prior import class_counts
from blotter.operators.quantiles import FEW_VALUES, value_counts
from blotter.session import cached, scratch_path

#: Bytes of a node's rows up to which its subtree is grown in one task, and of all rows that one job brings together.
GATHERED, GATHERED_JOB = 64 << 20, 1 << 30
#: Rows of neighbouring nodes that are split together, and the rows per node from which bins are counted, not rows sorted.
TOGETHER, COUNTED = 1 << 16, 1024
#: Rows of neighbouring nodes that try their features together, few enough to stay in a core's cache.
TRYING = 1 << 16
#: Different values, of all features together, up to which rows hold places in them.
LISTED_VALUES = 1 << 22
#: Classes up to which a running count of each is kept, three of them in one number.
FEW_CLASSES, FIELD = 12, 21
#: Cells of the sums of one task in a level's job.
CELLS = 1 << 24
ORDER, THRESHOLD, SIDE = 2, 1, 3  # what a node's path is drawn for
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def drawn(paths: np.ndarray, features: np.ndarray, use: int) -> np.ndarray:
    """Mixed numbers by (path, feature) and use."""
    x = mixed(paths)[..., None] ^ (features.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(1))
    return mixed(mixed(x) ^ np.uint64((use * GOLDEN + 1) & MASK))


def child_path(paths: np.ndarray, side: int) -> np.ndarray:
    return binned.keyed(paths, SIDE + side)


def impurity(counts: np.ndarray, entropy: bool) -> np.ndarray:
    """Weight times impurity of class weights in the last axis."""
    total = counts.sum(axis=-1)
    if entropy:
        return _xlogx(total) - _xlogx(counts).sum(axis=-1)
    return total - np.divide((counts * counts).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-300))


def _xlogx_of_counts(counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``_xlogx(scale * counts)`` for whole counts: logarithms are read off a table."""
    most = int(counts.max(initial=0))
    if most > 4 * len(counts) + 1024:
        return _xlogx(scale * counts)
    table = np.log2(np.maximum(np.arange(most + 1), 1))
    x = scale * counts
    return x * table[counts.astype(np.int64)] + (x * np.log2(scale) if (scale != 1).any() else 0.0)


@dataclass
class Rule:
    """How trees grow; ``class_weight`` has an entry per class, ``edges`` are None for drawn thresholds."""

    classes: int
    class_weight: np.ndarray
    entropy: bool
    max_depth: int | None
    min_split: int
    min_leaf: int
    tried: int
    bootstrap: bool
    seed: int
    edges: list[np.ndarray] | None
    #: The different values of all features, and where those of each begin, for rows that hold places in them.
    values: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def kind(self):
        if self.values is not None:
            return code_kind(self.values[1])
        return np.float64 if self.edges is None else np.uint8

    def values_at(self, x: np.ndarray, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Of each row the value of one feature; ``x`` holds the values of a row side by side."""
        v = x.ravel()[rows * x.shape[1] + features]
        return v if self.values is None else self.values[0][self.values[1][features] + v]

    def root(self, tree: int) -> np.ndarray:
        return binned.keyed(np.array([self.seed]), tree)

    def weights(self, hashes: np.ndarray, tree: int) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(hashes), np.int64)
        return np.searchsorted(POISSON, uniform(binned.keyed(hashes, self.seed, tree)), "right")

    def threshold(self, feature: int, cut: float) -> float:
        return float(cut) if self.edges is None else float(self.edges[feature][int(cut)])

    def splittable(self, rows: np.ndarray, counts: np.ndarray, level: int) -> np.ndarray:
        pure = counts.max(axis=-1) >= counts.sum(axis=-1)
        return (rows >= max(self.min_split, 2 * self.min_leaf)) & ~pure & (self.max_depth is None or level < self.max_depth)

    def order(self, paths: np.ndarray, width: int) -> np.ndarray:
        return np.argsort(drawn(paths, np.arange(width), ORDER), axis=-1, kind="stable")

    def cuts(self, paths: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Thresholds drawn between the least and the largest value of each node."""
        share = uniform(drawn(paths, features[:, None], THRESHOLD))[:, 0]
        cut = low + share * (high - low)
        return np.where(cut >= high, low, cut)


def code_kind(starts: np.ndarray):
    """Numbers that hold places in the lists of values that begin there, the end of the last one included."""
    return np.uint16 if np.diff(starts).max(initial=0) <= 1 << 16 else np.uint32


def listed_values(df: DataFrame, features: str, width: int, rows: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The sorted values of all features one after the other and where each feature's begin, unless they are many or some are missing."""
    if rows > FEW_VALUES:
        return None
    names = [f"f{i}" for i in range(width)]
    array = binned.as_array(df, features)
    with cached(value_counts(df.select(array.alias("x")).select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)]), names)) as counts:
        sizes = {r["feature"]: (r["different"], r["n"]) for r in counts.groupBy("feature").agg(F.count("*").alias("different"), F.sum("n").alias("n")).collect()}
        if any(sizes.get(n, (0, 0))[1] < rows for n in names) or sum(different for different, _ in sizes.values()) > LISTED_VALUES:
            return None
        table = counts.select(F.expr("int(substr(feature, 2))").alias("f"), "value").toArrow()  # at most ``LISTED_VALUES`` rows
    f, values = table.column("f").to_numpy(), table.column("value").to_numpy()
    return values[np.lexsort((values, f))], np.concatenate([[0], np.cumsum(np.bincount(f, minlength=width))])


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The order of small whole numbers, equal ones as they come: sorted together with their places, in one number each."""
    bits = max(1, int(len(keys) - 1).bit_length())
    if len(keys) == 0 or int(keys.max()) >> (62 - bits):
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def best_cuts(rule: Rule, v: np.ndarray, seg: np.ndarray, label: np.ndarray, weight: np.ndarray, totals: np.ndarray):
    """Per segment the best gain over all cuts of its values, the cut, and whether values vary. ``seg`` is sorted.

    Neighbouring segments go together up to ``TOGETHER`` rows: those of ``COUNTED`` rows on average by counts per bin, the
    others by their sorted rows.
    """
    sizes = np.bincount(seg, minlength=len(totals))
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(totals):
        first = int(ends[at] - sizes[at])
        end = max(at + 1, int(np.searchsorted(ends, first + TOGETHER, "right")))
        rows = slice(first, int(ends[end - 1]))
        few = rows.stop - first < COUNTED * (end - at)
        out.append((_sorted_cuts if few else _counted_cuts)(rule, v[rows], seg[rows] - at, label[rows], weight[rows], totals[at:end]))
        at = end
    return [np.concatenate([o[i] for o in out]) for i in range(3)] if out else (np.empty(0), np.empty(0), np.empty(0, bool))


def _counted_cuts(rule: Rule, v, seg, label, weight, totals):
    """By counts per bin: the work beyond counting does not depend on the rows."""
    m, classes = totals.shape
    at = seg * 256 + v
    by = np.bincount(at * classes + label, weights=weight, minlength=m * 256 * classes).reshape(m, 256, classes)
    rows = np.bincount(at, minlength=m * 256).reshape(m, 256)
    upto, n = np.cumsum(by, axis=1), np.cumsum(rows, axis=1)
    gain = gain_of(rule, totals[:, None, :], upto)
    gain = np.where((n >= rule.min_leaf) & (n[:, -1:] - n >= rule.min_leaf) & (n < n[:, -1:]) & (rows > 0), gain, -np.inf)
    top = gain.max(axis=1)
    slack = 1e-9 * np.maximum((totals * rule.class_weight).sum(axis=1), 1.0)
    cut = np.where(np.isfinite(top), np.argmax(gain >= (top - slack)[:, None], axis=1), 0).astype(np.float64)
    return top, cut, (rows > 0).sum(axis=1) > 1


def _packed_cuts(rule: Rule, v, seg, label, weight, totals):
    """By running counts of all classes over the rows in order of (segment, value), looked at where a cut may be only."""
    m, classes = totals.shape
    most = int(weight.max(initial=0))
    bits = most.bit_length()
    low = (classes << bits) - 1
    low = (1 << low.bit_length()) - 1
    key = (seg << 8) + v
    key = np.sort((key << low.bit_length()) | (label << bits) | weight)
    cell, mark = key >> low.bit_length(), key & low
    at = cell >> 8
    sizes = np.bincount(seg, minlength=m)
    start = np.cumsum(sizes) - sizes
    # Three classes share a number: their counts stay below its fields.
    codes = np.arange(low + 1)
    run = []
    for word in range(-(-classes // 3)):
        field = (codes >> bits) - 3 * word
        table = np.where((field >= 0) & (field < 3), (codes & ((1 << bits) - 1)) << (FIELD * np.clip(field, 0, 2)), 0)
        run.append(np.cumsum(table[mark]))
    ends = np.flatnonzero(cell[1:] != cell[:-1])
    ends = ends[at[ends] == at[ends + 1]]
    place = ends - start[at[ends]]
    ends = ends[(place + 1 >= rule.min_leaf) & (sizes[at[ends]] - place - 1 >= rule.min_leaf)]
    node = at[ends]
    whole, cw = totals.astype(np.int64), rule.class_weight
    weighted = totals * cw
    total = weighted.sum(axis=1)
    logs = np.log2(np.maximum(np.arange(int(whole.sum(axis=1).max(initial=0)) + 1), 1)) if rule.entropy else None
    wl, left, right = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
    for word, counts in enumerate(run):
        before = np.concatenate([[0], counts])[start]
        here = counts[ends] - before[node]
        for field in range(min(3, classes - 3 * word)):
            k = 3 * word + field
            l = (here >> (FIELD * field)) & ((1 << FIELD) - 1)
            r = whole[node, k] - l
            if rule.entropy:
                table = np.arange(len(logs)) * logs if cw[k] == 1 else _xlogx(np.arange(len(logs)) * cw[k])
                left += table[l]
                right += table[r]
            else:
                left += (cw[k] * l) ** 2
                right += (cw[k] * r) ** 2
            wl += cw[k] * l
    wr = np.maximum(total[node] - wl, 0)
    if rule.entropy:
        if (cw == 1).all():
            table = np.arange(len(logs)) * logs
            rest = table[wl.astype(np.int64)] - left + table[wr.astype(np.int64)] - right
        else:
            rest = _xlogx(wl) - left + _xlogx(wr) - right
    else:
        rest = wl - left / wl + wr - np.divide(right, wr, out=np.zeros_like(right), where=wr > 0)
    gain = impurity(weighted, rule.entropy)[node] - rest
    top, cut = np.full(m, -np.inf), np.zeros(m)
    if len(ends):
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top[node[first]] = np.maximum.reduceat(gain, first)
        good = np.flatnonzero(gain >= (top - 1e-9 * np.maximum(total, 1.0))[node])
        cut[node[good][::-1]] = (cell[ends[good]] & 255)[::-1]
    varied = np.zeros(m, bool)
    some = sizes > 0
    varied[some] = cell[start[some]] != cell[(start + sizes - 1)[some]]
    return top, cut, varied


def _sorted_cuts(rule: Rule, v, seg, label, weight, totals):
    """By running sums over the rows in order of (segment, value)."""
    m, classes = totals.shape
    if classes <= FEW_CLASSES and float(totals.sum()) < 1 << FIELD:
        return _packed_cuts(rule, v, seg, label, weight, totals)
    order = stable_order(seg * 256 + v)
    v, y, w = v[order].astype(np.int64), label[order], weight[order].astype(np.float64)
    sizes = np.bincount(seg, minlength=m)
    start = np.cumsum(sizes) - sizes
    cw = rule.class_weight[y]
    # The weight of a row's own class before it, within its node: a running sum in order of (node, class).
    by = stable_order(seg * classes + y)
    run = np.cumsum(w[by])
    held = totals.ravel()
    before = np.empty(len(v))
    before[by] = run - w[by] - (np.cumsum(held) - held)[(seg * classes + y)[by]]
    own = totals[seg, y]
    f = (lambda c: _xlogx_of_counts(c, cw)) if rule.entropy else (lambda c: (cw * c) ** 2)

    def upto(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - (total[start[seg]] - x[start[seg]])

    left = upto(f(before + w) - f(before))
    weighted = totals * rule.class_weight
    whole = weighted.sum(axis=1)
    right = (_xlogx(weighted).sum(axis=1) if rule.entropy else (weighted**2).sum(axis=1))[seg] + upto(f(own - before - w) - f(own - before))
    wl = upto(w * cw)
    wr = np.maximum(whole[seg] - wl, 0)
    if rule.entropy:
        rest = _xlogx(wl) - left + _xlogx(wr) - right
    else:
        rest = wl - left / wl + wr - np.divide(right, wr, out=np.zeros_like(right), where=wr > 0)
    gain = impurity(weighted, rule.entropy)[seg] - rest
    place = np.arange(len(v)) - start[seg]
    last = np.append((v[1:] != v[:-1]) & (seg[1:] == seg[:-1]), False)
    may = last & (place + 1 >= rule.min_leaf) & (sizes[seg] - place - 1 >= rule.min_leaf)
    gain = np.where(may, gain, -np.inf)
    some = sizes > 0
    top = np.full(m, -np.inf)
    top[some] = np.maximum.reduceat(gain, start[some])
    slack = 1e-9 * np.maximum(whole, 1.0)
    at = np.flatnonzero(gain >= (top - slack)[seg]) if len(gain) else np.empty(0, int)
    at = at[np.isfinite(gain[at])]
    cut = np.zeros(m)
    cut[seg[at][::-1]] = v[at][::-1]
    varied = np.zeros(m, bool)
    varied[some] = v[start[some]] != v[(start + sizes - 1)[some]]
    return top, cut, varied


def drawn_cuts(rule: Rule, v, seg, label, weight, totals, paths, features):
    """As ``best_cuts`` for one drawn threshold per segment."""
    m, classes = totals.shape
    sizes = np.bincount(seg, minlength=m)
    start, some = np.cumsum(sizes) - sizes, sizes > 0
    low, high = np.zeros(m), np.zeros(m)
    low[some], high[some] = np.fmin.reduceat(v, start[some]), np.fmax.reduceat(v, start[some])
    varied = high > low
    cut = rule.cuts(paths, features, low, high)
    goes = v <= np.repeat(cut, sizes)
    if rule.bootstrap:
        left = np.bincount(seg * classes + label, weights=weight * goes, minlength=m * classes).reshape(m, classes)
        rows = np.bincount(seg, weights=goes, minlength=m)
    else:
        left = np.bincount((seg * classes + label)[goes], minlength=m * classes).reshape(m, classes).astype(np.float64)
        rows = left.sum(axis=1)
    gain = gain_of(rule, totals, left)
    return np.where(varied & (rows >= rule.min_leaf) & (sizes - rows >= rule.min_leaf), gain, -np.inf), cut, varied


def gain_of(rule: Rule, totals: np.ndarray, left: np.ndarray) -> np.ndarray:
    cw, entropy = rule.class_weight, rule.entropy
    return impurity(totals * cw, entropy) - impurity(left * cw, entropy) - impurity((totals - left) * cw, entropy)


def grow(rule: Rule, x: np.ndarray, label: np.ndarray, weight: np.ndarray, hashes: np.ndarray, path: int, level: int):
    """The subtree over some rows: lists of feature, cut, left, right, gain, cover and class shares by node.

    Rows are kept in the order of their nodes, the values of a row side by side. Nodes of up to ``TRYING`` rows together try
    their features in turn.
    """
    order = np.argsort(hashes, kind="stable")
    width, k = x.shape[0], rule.classes
    x, label, weight = np.ascontiguousarray(x.T[order]), label[order].astype(np.int64), weight[order]
    seg = np.zeros(len(label), np.int64)
    paths = np.array([path], np.uint64)
    size, out = 1, []
    while len(paths):
        m = len(paths)
        totals = np.bincount(seg * k + label, weights=weight, minlength=m * k).reshape(m, k)
        weighted = totals * rule.class_weight
        cover = weighted.sum(axis=1)
        sizes = np.bincount(seg, minlength=m)
        ends = np.cumsum(sizes)
        can = rule.splittable(sizes, totals, level)
        top, feature, cut = np.full(m, -np.inf), np.full(m, -1), np.zeros(m)
        at = 0
        while at < m:
            first = int(ends[at] - sizes[at])
            end = max(at + 1, int(np.searchsorted(ends, first + TRYING, "right")))
            part, rows = slice(at, end), slice(first, int(ends[end - 1]))
            if can[part].any():
                _try(rule, x[rows], label[rows], weight[rows], sizes[part], totals[part], cover[part], can[part], paths[part], top[part], feature[part], cut[part])
            at = end
        split = feature >= 0
        left = np.where(split, size + 2 * (np.cumsum(split) - 1), -1)
        out.append((feature, cut, left, np.where(split, left + 1, -1), np.where(split, top, 0.0) / np.maximum(cover, 1e-300), cover, weighted / np.maximum(cover, 1e-300)[:, None]))
        rows = np.flatnonzero(np.repeat(split, sizes))
        old = seg[rows]
        right = ~(rule.values_at(x, rows, feature[old]) <= cut[old])
        seg = 2 * (np.cumsum(split) - 1)[old] + right
        order = stable_order(seg)
        rows, seg = rows[order], seg[order]
        x, label, weight = x[rows], label[rows], weight[rows]
        paths = np.stack([child_path(paths[split], 0), child_path(paths[split], 1)], axis=1).ravel()
        size += len(paths)
        level += 1
    return [np.concatenate([o[i] for o in out]) for i in range(7)]


def _try(rule: Rule, x, label, weight, sizes, totals, cover, can, paths, top, feature, cut) -> None:
    """The best cut of each of some neighbouring nodes, into ``top``, ``feature`` and ``cut``. Rows are in order of their nodes."""
    m, width = len(sizes), x.shape[1]
    seg = np.repeat(np.arange(m), sizes)
    tries, turns, trying = np.zeros(m, int), np.zeros((m, width), int), np.zeros(m, bool)
    turns[can] = rule.order(paths[can], width)
    for turn in range(width):
        active = can & (tries < rule.tried)
        if not active.any():
            return
        f = turns[active, turn]
        if (active != trying).any():
            # Only nodes that still try are numbered through, again when some have stopped.
            trying, r = active, np.flatnonzero(active[seg])
            n = sizes[active]
            s, y, w = np.repeat(np.arange(len(n)), n), label[r], weight[r]
        v = rule.values_at(x, r, np.repeat(f, n))
        if rule.edges is None:
            gain, where, varied = drawn_cuts(rule, v, s, y, w, totals[active], paths[active], f)
        else:
            gain, where, varied = best_cuts(rule, v, s, y, w, totals[active])
        tries[active] += varied
        better = gain > top[active] + 1e-9 * np.maximum(cover[active], 1.0)
        chosen = np.flatnonzero(active)[better]
        top[chosen], feature[chosen], cut[chosen] = gain[better], f[better], where[better]


class Forest(Estimator):
    """Random forest; ``log_loss`` is the entropy criterion. ``drawn`` draws one threshold per feature instead of searching it.

    ``balanced_subsample`` weighs classes like ``balanced``: by all rows, not by each tree's draw.
    """

    def __init__(
        self,
        trees=200,
        criterion="log_loss",
        max_depth=24,
        min_leaf=5,
        max_features="sqrt",
        bootstrap=True,
        class_weight=None,
        seed=12345,
        max_bins=binned.MAX_BINS,
        label_col="label",
        features_col="features",
        min_split=2,
        drawn=False,
    ):
        super().__init__()
        if criterion not in ("gini", "entropy", "log_loss"):
            raise ValueError(f"criterion {criterion!r}")
        self.trees, self.criterion, self.max_depth, self.min_leaf, self.min_split = trees, criterion, max_depth, min_leaf, min_split
        self.max_features, self.bootstrap, self.class_weight, self.drawn = max_features, bootstrap, class_weight, drawn
        self.seed, self.max_bins, self.label_col, self.features_col = seed, max_bins, label_col, features_col

    @classmethod
    def extra(cls, trees: int = 300, min_leaf: int = 2, seed: int = 12345, **options) -> "Forest":
        """Extremely randomised trees over all rows."""
        settings = dict(criterion="gini", max_depth=None, max_features="sqrt", bootstrap=False)
        return cls(trees, min_leaf=min_leaf, seed=seed, drawn=True, **{**settings, **options})

    def tried(self, width: int) -> int:
        chosen = self.max_features
        if isinstance(chosen, str) and chosen not in ("sqrt", "log2"):
            chosen = float(chosen)
        if chosen is None:
            return width
        if chosen in ("sqrt", "log2"):
            return max(1, int(math.sqrt(width) if chosen == "sqrt" else math.log2(width)))
        return max(1, chosen if isinstance(chosen, int) else int(chosen * width))

    def _fit(self, dataset: DataFrame) -> "ForestModel":
        spark = dataset.sparkSession
        counts = class_counts(dataset, self.label_col)
        rows, classes = sum(counts.values()), max(counts) + 1
        width = dataset.select(F.size(binned.as_array(dataset, self.features_col))).first()[0]
        weights = balanced_weights(counts) if self.class_weight in ("balanced", "balanced_subsample") else {}
        edges = None if self.drawn else binned.learn_edges(dataset, self.features_col, width, self.max_bins)
        rule = Rule(classes, np.array([weights.get(k, 1.0) for k in range(classes)]), self.criterion != "gini", self.max_depth, self.min_split, self.min_leaf, self.tried(width), self.bootstrap, self.seed, edges)
        others = [c for c in dataset.columns if c != self.features_col]
        may = lambda kind: rows * (width * np.dtype(kind).itemsize + 12) <= 2 * GATHERED
        cuts = edges
        if self.drawn and may(np.uint16):
            values = listed_values(dataset, self.features_col, width, rows)
            if values is not None and may(code_kind(values[1])):
                rule.values, cuts = values, np.split(values[0], values[1][1:-1])
        data = binned.blocks(dataset, self.features_col, self.label_col, F.xxhash64(*others, self.features_col), cuts, rows, kind=rule.kind).persist()
        try:
            nodes = _Growth(rule, data, width, rows, self.trees, spark, may(rule.kind)).run()
        finally:
            data.unpersist()
        return ForestModel(classes, self.trees, nodes, self.features_col)


class _Growth:
    """Trees above the nodes that are grown in one task, on the driver."""

    def __init__(self, rule: Rule, data: DataFrame, width: int, rows: int, trees: int, spark: SparkSession, send: bool = False):
        self.send = send
        self.rule, self.data, self.width, self.spark = rule, data, width, spark
        self.row_bytes = width * np.dtype(rule.kind).itemsize + 24
        # By tree and node: feature, cut, left, right, gain, cover, shares; and of ends: path, level, rows.
        self.nodes: list[list[list]] = [[[-1, 0.0, -1, -1, 0.0, 0.0, None]] for _ in range(trees)]
        self.ends = {(t, 0): (int(rule.root(t)[0]), 0, rows) for t in range(trees)}
        self.jobs = 0

    def run(self) -> DataFrame:
        while not self.send and (large := [e for e, (_, _, n) in self.ends.items() if n * self.row_bytes > GATHERED]):
            per = max(1, CELLS // (self.width * binned.MAX_BINS * self.rule.classes if self.rule.edges is not None else self.width * self.rule.classes))
            for at in range(0, len(large), per):
                (self._searched if self.rule.edges is not None else self._drawn)(large[at : at + per])
        path = scratch_path(self.spark, "nodes")
        packs, done = self._packs(), 0
        while done < len(packs):
            size, at = 0, done
            while at < len(packs) and (self.send or at == done or size + self.ends[packs[at][0]][2] * self.row_bytes <= GATHERED_JOB):
                size += self.ends[packs[at][0]][2] * self.row_bytes
                at += 1
            self._gather(packs[done:at]).write.mode("append").parquet(path)
            done = at
        inner = [(t, -1, i, n[0], self.rule.threshold(n[0], n[1]), n[2], n[3], n[4], n[5], n[6]) for t, tree in enumerate(self.nodes) for i, n in enumerate(tree) if n[0] >= 0 or (t, i) not in self.ends]
        if inner:
            self.spark.createDataFrame([(*n[:3], n[3], n[4] if n[3] >= 0 else 0.0, *n[5:]) for n in inner], SCHEMA).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def _arrays(self, trees: set[int]) -> dict[int, tuple[np.ndarray, ...]]:
        kinds = (np.int32, np.float64, np.int32, np.int32)
        return {t: tuple(np.array([n[i] for n in self.nodes[t]], kind) for i, kind in enumerate(kinds)) for t in trees}

    def _summed(self, add, merge, asked: list[tuple[int, int]]) -> DataFrame:
        """(``tree``, ``node``, ``cell``): arrays that ``add`` gives for the nodes of a block, put together by ``merge``."""
        self.jobs += 1
        rule, arrays = self.rule, self._arrays({t for t, _ in asked})
        wanted: dict[int, list[int]] = {}
        for t, node in asked:
            wanted.setdefault(t, []).append(node)

        def put(held: dict, name, part: np.ndarray) -> None:
            held[name] = merge(held[name], part) if name in held else part

        def emit(held: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n[0] for n in held], pa.int32()), pa.array([n[1] for n in held], pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["tree", "node", "cell"])

        def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for block in binned.each(batches, rule.kind):
                for t, own in wanted.items():
                    weight, slot = rule.weights(block.hash, t), slots(block.x, arrays[t], own)
                    rows = np.flatnonzero((weight > 0) & (slot >= 0))
                    for node, part in zip(own, add(block, t, own, slot[rows], weight[rows], rows)):
                        put(held, (t, node), part)
            yield emit(held)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for t, node, cell in zip(*(batch.column(i) for i in range(3))):
                    put(held, (t.as_py(), node.as_py()), np.frombuffer(cell.as_buffer(), np.float64))
            yield emit(held)

        kind = "tree int, node int, cell binary"
        reducers = min(self.data.sparkSession.sparkContext.defaultParallelism, len(asked))
        return self.data.mapInArrow(partials, kind).repartition(reducers, "tree", "node").mapInArrow(merged, kind)

    def _searched(self, asked: list[tuple[int, int]]) -> None:
        rule, width = self.rule, self.width
        offsets = np.concatenate([[0], np.cumsum([len(e) + 1 for e in rule.edges])])
        cells, k = int(offsets[-1]), rule.classes

        def add(block, t, own, slot, weight, rows):
            at = (block.x[:, rows] + offsets[:-1, None] + slot * cells).ravel()
            label = np.tile(block.label[rows], width)
            by = np.bincount(at * k + label, weights=np.tile(weight, width), minlength=len(own) * cells * k).reshape(len(own), cells, k)
            counts = np.bincount(at, minlength=len(own) * cells).reshape(len(own), cells, 1)
            return np.concatenate([by, counts], axis=2).reshape(len(own), -1).astype(np.float64)

        ends = {e: self.ends[e] for e in asked}

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                for t, node, cell in zip(*(batch.column(i) for i in range(3))):
                    t, node = t.as_py(), node.as_py()
                    part = np.frombuffer(cell.as_buffer(), np.float64).reshape(cells, k + 1)
                    totals, n = part[: offsets[1], :k].sum(axis=0), part[: offsets[1], k].sum()
                    path, level, _ = ends[t, node]
                    found = (-1, 0.0, 0.0, [])
                    if rule.splittable(np.array([n]), totals[None], level)[0]:
                        top, tries = -np.inf, 0
                        for f in rule.order(np.array([path], np.uint64), width)[0]:
                            if tries >= rule.tried:
                                break
                            own = part[offsets[f] : offsets[f + 1]]
                            tries += (own[:, k] > 0).sum() > 1
                            upto = np.cumsum(own, axis=0)
                            gain = gain_of(rule, totals[None], upto[:, :k])
                            # A cut at an empty bin is the cut before it.
                            may = (upto[:, k] >= rule.min_leaf) & (n - upto[:, k] >= rule.min_leaf) & (own[:, k] > 0)
                            gain = np.where(may, gain, -np.inf)
                            slack = 1e-9 * max(1.0, (totals * rule.class_weight).sum())
                            if gain.max() > top + slack:
                                b = int(np.argmax(gain >= gain.max() - slack))
                                top, found = gain[b], (int(f), float(b), float(gain[b]), [*upto[b]])
                    rows.append((t, node, *found[:3], [*totals, n], found[3]))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)], ["tree", "node", "f", "cut", "gain", "total", "below"])

        # One short row per node asked for.
        for t, node, f, cut, gain, total, below in self._summed(add, np.add, asked).mapInArrow(choose, "tree int, node int, f int, cut double, gain double, total array<double>, below array<double>").collect():
            self._take(t, node, f, cut, gain, np.array(total), np.array(below))

    def _drawn(self, asked: list[tuple[int, int]]) -> None:
        rule, width, k = self.rule, self.width, self.rule.classes

        def extremes(block, t, own, slot, weight, rows):
            out = np.full((len(own), 2 * width + k + 1), np.inf)
            out[:, 2 * width :] = 0
            for i in range(len(own)):
                x, y = block.x[:, rows[slot == i]], block.label[rows[slot == i]]
                if x.shape[1]:
                    out[i, :width], out[i, width : 2 * width] = np.fmin.reduce(x, axis=1), -np.fmax.reduce(x, axis=1)
                    out[i, 2 * width : -1] = np.bincount(y, weights=weight[slot == i], minlength=k)
                    out[i, -1] = x.shape[1]
            return out

        def outer(a, b):
            return np.concatenate([np.fmin(a[: 2 * width], b[: 2 * width]), a[2 * width :] + b[2 * width :]])

        seen = {(t, node): np.frombuffer(cell) for t, node, cell in self._summed(extremes, outer, asked).collect()}
        plan: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for t, node in asked:
            part, (path, level, _) = seen[t, node], self.ends[t, node]
            low, high, totals, n = part[:width], -part[width : 2 * width], part[2 * width : -1], part[-1]
            if rule.splittable(np.array([n]), totals[None], level)[0]:
                turns = rule.order(np.array([path], np.uint64), width)[0]
                features = turns[high[turns] > low[turns]][: rule.tried]
                if len(features):
                    plan[t, node] = features, rule.cuts(np.full(len(features), path, np.uint64), features, low[features], high[features])
            if (t, node) not in plan:
                self._take(t, node, -1, 0.0, 0.0, part[2 * width :], np.empty(0))

        def below(block, t, own, slot, weight, rows):
            for i, node in enumerate(own):
                mine = rows[slot == i]
                features, cuts = plan[t, node]
                goes = block.x[features][:, mine] <= cuts[:, None]
                label, w = block.label[mine], weight[slot == i]
                yield np.concatenate([np.append(np.bincount(label[g], weights=w[g], minlength=k), g.sum()) for g in goes])

        if not plan:
            return
        for t, node, cell in self._summed(below, np.add, sorted(plan)).collect():
            features, cuts = plan[t, node]
            total, part = seen[t, node][2 * width :], np.frombuffer(cell).reshape(len(features), k + 1)
            gain = gain_of(rule, np.broadcast_to(total[:k], part[:, :k].shape), part[:, :k])
            gain = np.where((part[:, k] >= rule.min_leaf) & (total[k] - part[:, k] >= rule.min_leaf), gain, -np.inf)
            slack, best = 1e-9 * max(1.0, (total[:k] * rule.class_weight).sum()), -1
            for i, g in enumerate(gain):
                if g > (gain[best] if best >= 0 else -np.inf) + slack:
                    best = i
            if best < 0:
                self._take(t, node, -1, 0.0, 0.0, total, np.empty(0))
            else:
                self._take(t, node, int(features[best]), float(cuts[best]), float(gain[best]), total, part[best])

    def _take(self, t: int, node: int, f: int, cut: float, gain: float, total: np.ndarray, below: np.ndarray) -> None:
        path, level, _ = self.ends.pop((t, node))
        weighted = total[:-1] * self.rule.class_weight
        cover = float(weighted.sum())
        entry = self.nodes[t][node]
        entry[5], entry[6] = cover, (weighted / cover).tolist()
        if f < 0:
            return
        entry[:5] = [f, cut, len(self.nodes[t]), len(self.nodes[t]) + 1, gain / cover]
        for side, n in enumerate((below[-1], total[-1] - below[-1])):
            self.ends[t, len(self.nodes[t])] = (int(child_path(np.array([path], np.uint64), side)[0]), level + 1, int(n))
            self.nodes[t].append([-1, 0.0, -1, -1, 0.0, 0.0, None])

    def _packs(self) -> list[list[tuple[int, int]]]:
        """Ends by the rows they hold: without bootstrap every root holds all rows, and several are grown from one copy."""
        ends = sorted(self.ends)
        roots = [] if self.rule.bootstrap else [e for e in ends if e[1] == 0]
        copies = min(len(roots), 4 * self.data.sparkSession.sparkContext.defaultParallelism)
        return [roots[i::copies] for i in range(copies)] + [[e] for e in ends if self.rule.bootstrap or e[1] != 0]

    def _gather(self, packs: list[list[tuple[int, int]]]) -> DataFrame:
        """Rows of the node table below (and with) the nodes of the packs, each pack grown in one place, tree by tree."""
        self.jobs += 1
        if self.send:
            return self._grown(packs)
        # A pack travels under the name of its first node.
        together = {pack[0]: pack for pack in packs}
        rule, arrays, width = self.rule, self._arrays({t for t, _ in together}), self.width
        ends, wanted = {e: self.ends[e] for pack in packs for e in pack}, {}
        for t, node in together:
            wanted.setdefault(t, []).append(node)
        kind = np.dtype(rule.kind)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in binned.each(batches, rule.kind):
                for t, own in wanted.items():
                    weight, slot = rule.weights(block.hash, t), slots(block.x, arrays[t], own)
                    for i, node in enumerate(own):
                        rows = np.flatnonzero((weight > 0) & (slot == i))
                        cell = b"".join([np.int64(len(rows)).tobytes(), weight[rows].astype(np.int64).tobytes(), block.hash[rows].tobytes(), block.label[rows].astype(np.int64).tobytes(), block.x[:, rows].tobytes()])
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([node], pa.int32()), pa.array([cell], pa.binary())], ["tree", "node", "cell"])

        def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, first = [], None
            for batch in batches:
                for t, node, cell in zip(*(batch.column(c) for c in ("tree", "node", "cell"))):
                    first = t.as_py(), node.as_py()
                    data = cell.as_buffer()
                    n = int(np.frombuffer(data, np.int64, 1)[0])
                    long = [np.frombuffer(data, np.int64, n, 8 + 8 * n * j) for j in range(3)]
                    parts.append((np.frombuffer(data, kind, n * width, 8 + 24 * n).reshape(width, n), *long))
            x, weight, hashes, label = (np.concatenate([p[j] for p in parts], axis=-1) for j in range(4))
            parts.clear()
            for t, node in together[first]:
                path, level, _ = ends[t, node]
                yield below(rule, t, node, grow(rule, x, label, weight, hashes.view(np.uint64), path, level))

        gathered = self.data.mapInArrow(pieces, "tree int, node int, cell binary")
        tasks = min(len(packs), 4 * self.data.sparkSession.sparkContext.defaultParallelism)
        return gathered.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(subtrees, SCHEMA)


    def _grown(self, packs: list[list[tuple[int, int]]]) -> DataFrame:
        """The same for packs of roots, from rows that are sent to the executors, at most twice ``GATHERED`` bytes."""
        rule, context = self.rule, self.spark.sparkContext
        parts = [binned.Block(batch, i, rule.kind) for batch in self.data.toArrow().to_batches() for i in range(batch.num_rows)]
        label, hashes = (np.concatenate([getattr(part, name) for part in parts]) for name in ("label", "hash"))
        order = np.argsort(hashes, kind="stable")
        # The values of a row lie side by side, rows in the order in which trees take them.
        x = np.concatenate([part.x.T for part in parts])[order]
        parts.clear()
        shared, starts = context.broadcast((x, label[order], hashes[order])), {e: self.ends[e] for pack in packs for e in pack}

        def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, label, hashes = shared.value
            for batch in batches:
                for t, node in (e for i in batch.column(0).to_pylist() for e in packs[i]):
                    path, level, _ = starts[t, node]
                    weight = rule.weights(hashes, t)
                    rows = np.flatnonzero(weight > 0) if rule.bootstrap else slice(None)
                    yield below(rule, t, node, grow(rule, x[rows].T, label[rows], weight[rows], hashes[rows], path, level))

        tasks = min(len(packs), 16 * context.defaultParallelism)
        return self.spark.range(0, len(packs), 1, tasks).mapInArrow(trees, SCHEMA)


def below(rule: Rule, t: int, node: int, grown: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the node table for what ``grow`` found below a node of a tree."""
    feature, cut, left, right, gain, cover, shares = grown
    n, inner = len(feature), feature >= 0
    names = (np.int64(node + 1) << 32) + np.arange(n)
    names[0] = node
    threshold = np.array([rule.threshold(f, c) if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist())])
    links = [np.where(inner, names[np.maximum(side, 0)], -1) for side in (left, right)]
    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * rule.classes, pa.int32()), pa.array(shares.ravel()))
    columns = [pa.array([t] * n, pa.int32()), pa.array([-1] * n, pa.int32()), pa.array(names), pa.array(feature, pa.int32()), pa.array(threshold), *(pa.array(s, pa.int64()) for s in links), pa.array(gain), pa.array(cover), values]
    return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in SCHEMA.split(", ")])


def slots(x: np.ndarray, tree: tuple[np.ndarray, ...], own: list[int]) -> np.ndarray:
    """Place in ``own`` of the node each row of a block is in, or -1."""
    feature, cut, left, right = tree
    at, rows = np.zeros(x.shape[1], np.int32), np.arange(x.shape[1])
    while (inner := feature[at] >= 0).any():
        goes = x[np.maximum(feature[at], 0), rows] <= cut[at]
        at = np.where(inner, np.where(goes, left[at], right[at]), at)
    place = np.full(len(feature), -1)
    place[own] = np.arange(len(own))
    return place[at]


class ForestModel(Model, MLWritable, MLReadable):
    """Mean class shares over trees; ``nodes`` is the node table (see ``nodes``), which stays in shared storage."""

    def __init__(self, classes=0, trees=0, nodes: DataFrame | None = None, features_col="features"):
        super().__init__()
        self.classes, self.trees, self.table, self.features_col = classes, trees, nodes, features_col
        self._walker = None

    def nodes(self, spark: SparkSession) -> DataFrame:
        return self.table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._walker is None:
            # A node is about 24 bytes, and a leaf has its shares beside; counted before anything is fetched.
            inner, leaves = self.table.agg(F.sum(F.expr("int(feature >= 0)")), F.sum(F.expr("int(feature < 0)"))).first()
            if 24 * (inner + leaves) + 8 * self.classes * leaves <= SENT_BYTES:
                self._walker = Walker(self.table.withColumn("value", F.expr("if(feature < 0, value, array())")).toArrow())
        if self._walker is not None:
            sums = dataset.withColumn("probability", summed(dataset.sparkSession, self._walker, self.classes, binned.as_array(dataset, self.features_col)))
        else:
            sums = summed_by_shards(dataset, self.table, self.classes, self.features_col, "probability")
        return sums.withColumn("probability", F.transform("probability", lambda p: p / self.trees))

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
        fitted = {"classes": m.classes, "trees": m.trees, "features_col": m.features_col}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"fitted": json.dumps(fitted)})
        m.table.write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark, self.cls.__module__ + "." + self.cls.__name__)
        f = json.loads(metadata["fitted"])
        model = self.cls(f["classes"], f["trees"], spark.read.parquet(f"{path}/nodes"), f["features_col"])
        model._resetUid(metadata["uid"])
        return model
