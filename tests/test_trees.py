"""Tree growth: whole levels against gathered rows, partitions, stopping rules, saving, scoring by joins."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blotter.models import binned, boosting, forest, nodes
from blotter.models.boosting import SoftmaxBoosting
from blotter.models.forest import Forest
from blotter.plans import assemble, config
from blotter.session import cut_lineage

CLASSES = 3


def rows_of(n, seed=5):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(draw.randrange(24)), float(draw.randrange(7)), draw.gauss(0, 1), draw.random(), 1.0]
        y = int(x[0] // 8) if draw.random() < 0.6 else draw.randrange(CLASSES)
        out.append((i, float(y), x))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    data = spark.createDataFrame(rows_of(3000), "id long, label double, x array<double>")
    return cut_lineage(data.select("id", "label", array_to_vector("x").alias("features")))


def listed(model, spark):
    """A model's nodes, free of how they are numbered: by the way that leads to them."""
    found = {}
    for r in model.nodes(spark).collect():
        found.setdefault((r["round"], r["class"]), {})[r["node"]] = r
    out = []
    for tree, own in found.items():
        ways = [("", min(own))]
        for way, node in ways:
            r = own[node]
            out.append((tree, way, r["feature"], r["threshold"], round(r["gain"], 9), round(r["cover"], 6), tuple(round(v, 9) for v in r["value"]) if r["feature"] < 0 else ()))
            if r["feature"] >= 0:
                ways += [(way + "l", r["left"]), (way + "r", r["right"])]
        assert len(ways) == len(own)
    return sorted(out)


@pytest.mark.parametrize("make", [lambda: SoftmaxBoosting(3, 4, 0.3, subsample=0.8, colsample=0.7, min_child_weight=2.0, alpha=0.1, lam=2.0, gamma=0.5, checkpoint_every=2), lambda: SoftmaxBoosting.histogram(3, max_leaves=9, early_stopping=True)])
def test_boosting_by_levels_and_by_rows(spark, frame, make, monkeypatch):
    """The same trees from histograms of whole levels, from gathered rows, and from other partitions."""
    gathered = listed(make().fit(frame), spark)
    monkeypatch.setattr(boosting, "GATHERED", 0)
    monkeypatch.setattr(boosting, "CELLS", 30_000)
    assert listed(make().fit(frame.repartition(16)), spark) == gathered
    monkeypatch.setattr(binned, "TASK_ROWS", 300)
    assert listed(make().fit(frame.repartition(3, "id")), spark) == gathered


@pytest.mark.parametrize("make", [lambda: Forest(4, max_depth=6, class_weight="balanced"), lambda: Forest(3, "gini", None, 1, None, min_split=9), lambda: Forest.extra(4), lambda: Forest.extra(2, 5, max_depth=5, bootstrap=True)])
def test_forest_by_levels_and_by_rows(spark, frame, make, monkeypatch):
    gathered = listed(make().fit(frame), spark)
    monkeypatch.setattr(forest, "GATHERED", 20_000)
    monkeypatch.setattr(forest, "GATHERED_JOB", 100_000)
    monkeypatch.setattr(forest, "CELLS", 10_000)
    monkeypatch.setattr(binned, "TASK_ROWS", 300)
    assert listed(make().fit(frame.repartition(16)), spark) == gathered
    assert listed(make().fit(frame.repartition(4, "id")), spark) == gathered


def test_jobs_of_a_round_do_not_count_classes(spark, frame, monkeypatch):
    monkeypatch.setattr(boosting, "GATHERED", 0)
    jobs = []
    run = boosting._Fit._table
    monkeypatch.setattr(boosting._Fit, "_table", lambda self: jobs.append(self.jobs) or run(self))
    SoftmaxBoosting(2, 3).fit(frame)
    SoftmaxBoosting(2, 3).fit(frame.withColumn("label", F.col("id") % 12))
    assert jobs == [6, 6]


def test_rules_of_forests(spark, frame):
    deep = Forest(1, "gini", None, 1, None, False).fit(frame.withColumn("label", F.col("id") % 2))
    assert max(len(way) for _, way, *_ in listed(deep, spark)) > 9
    small = Forest(2, min_leaf=40, min_split=200, bootstrap=False).fit(frame)
    for _, _, feature, _, _, cover, _ in listed(small, spark):
        assert cover >= 40 and (feature < 0 or cover >= 200)
    with pytest.raises(ValueError):
        Forest(criterion="other")
    assert [Forest(max_features=m).tried(30) for m in ("sqrt", "log2", None, 0.5, "0.5", 7)] == [5, 4, 30, 15, 15, 7]
    unlimited = assemble.model_stage(config.random_forest_baseline().but(forest_max_depth=None, forest_min_samples_split=12))
    assert unlimited.max_depth is None and unlimited.min_split == 12
    extra = assemble.model_stage(config.tree_baseline("extra_trees"))
    assert (extra.trees, extra.drawn, extra.bootstrap, extra.min_leaf) == (300, True, False, 2)


def test_one_class_and_one_value(spark):
    data = spark.createDataFrame([(i, 0.0, [1.0, None if i % 3 else 2.0]) for i in range(40)], "id long, label double, x array<double>")
    for estimator in (Forest(2, features_col="x"), Forest.extra(2, features_col="x"), SoftmaxBoosting(1, 2, features_col="x")):
        scored = estimator.fit(data).transform(data).select("probability").collect()
        assert all(r["probability"] == [1.0] for r in scored)


# --- leaf by leaf, with early stopping: a plain version --------------------------------------


def plain_histogram_boosting(x, y, held, rounds, eta, leaves, min_leaf, least):
    """(rounds kept, losses of the held rows) of best-first boosting by sorting all values."""
    k = y.max() + 1
    shares = np.log(np.bincount(y, minlength=k) / len(y))
    margin = np.tile((shares - shares.mean())[:, None], (1, len(y)))
    losses, fit = [], np.flatnonzero(~held)

    def best(rows, g, h):
        found = None
        base = g[rows].sum() ** 2 / h[rows].sum()
        for f in range(len(x)):
            for cut in np.unique(x[f, rows])[:-1]:
                goes = x[f, rows] <= cut
                a, b = rows[goes], rows[~goes]
                if min(len(a), len(b)) < min_leaf or min(h[a].sum(), h[b].sum()) < least:
                    continue
                gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - base
                if gain > 1e-6 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, cut, a, b)
        return found

    for done in range(rounds + 1):
        p = np.exp(margin - margin.max(axis=0))
        p /= p.sum(axis=0)
        losses.append(-np.log(p[y[held], held]).mean())
        if done == rounds or (len(losses) > 10 and not min(losses[-10:]) < losses[-11] - 1e-7):
            return done, losses
        step = np.zeros_like(margin)
        for c in range(k):
            g, h = p[c] - (y == c), p[c] * (1 - p[c])
            ends = [(fit, best(fit, g, h), np.ones(len(y), bool))]
            while len(ends) < leaves and any(e[1] for e in ends):
                i = max((i for i, e in enumerate(ends) if e[1]), key=lambda i: ends[i][1][0])
                _, (_, f, cut, a, b), where = ends.pop(i)
                ends += [(a, best(a, g, h), where & (x[f] <= cut)), (b, best(b, g, h), where & (x[f] > cut))]
            for rows, _, where in ends:
                step[c, where] = -eta * g[rows].sum() / h[rows].sum()
        margin += step


def test_leafwise_stopping_equals_plain(spark):
    data = [(i, y, [x[0], x[1]]) for i, y, x in rows_of(400, 9)]
    frame = cut_lineage(spark.createDataFrame(data, "id long, label double, x array<double>"))
    model = SoftmaxBoosting.histogram(40, 0.5, 6, features_col="x", early_stopping=True).fit(frame)
    hashes = {r["id"]: r["h"] for r in frame.select("id", F.xxhash64("id", "label", "x").alias("h")).collect()}
    held = boosting.held_back(np.array([hashes[i] for i, _, _ in data], np.int64).view(np.uint64), 12345)
    x, y = np.array([r[2] for r in data]).T, np.array([int(r[1]) for r in data])
    kept, losses = plain_histogram_boosting(x, y, held, 40, 0.5, 6, 20, 1e-3)
    assert model.rounds == kept < 40
    scored = {r["id"]: r["probability"] for r in model.transform(frame).collect()}
    mine = np.mean([-math.log(scored[i][int(label)]) for (i, label, _), h in zip(data, held) if h])
    assert mine == pytest.approx(losses[kept], rel=1e-6)


def test_leaves_beyond_depth_five(spark, frame):
    model = SoftmaxBoosting.histogram(1, early_stopping=False).fit(frame)
    found = listed(model, spark)
    for k in range(CLASSES):
        assert sum(feature < 0 for (_, c), _, feature, *_ in found if c == k) <= 31
    assert max(len(way) for _, way, *_ in found) > 5
    assert assemble.model_stage(config.tree_baseline("hist_gradient_boosting")).max_leaves == 31
    assert SoftmaxBoosting.histogram().early_stopping == "auto" and boosting.AUTO_ROWS == 10_000


# --- scoring and saving -----------------------------------------------------------------------


@pytest.mark.parametrize("estimator", [SoftmaxBoosting(3, 3, 0.3), SoftmaxBoosting.histogram(2), Forest(3, max_depth=4), Forest.extra(2)])
def test_scores_by_joins_and_after_saving(spark, frame, estimator, tmp_path, monkeypatch):
    some = frame.filter("id < 60").withColumn("features", F.when(F.col("id") == 1, array_to_vector(F.array(*[F.lit(float("nan"))] * 5))).otherwise(F.col("features")))
    some = cut_lineage(some.unionByName(some.filter("id = 7")))
    model = estimator.fit(frame)
    scores = lambda m: sorted((r["id"], [round(p, 12) for p in r["probability"]]) for r in m.transform(some).collect())
    walked = scores(model)
    assert len(walked) == 61 and all(sum(p) == pytest.approx(1) for _, p in walked)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert scores(again) == walked and listed(again, spark) == listed(model, spark)
    monkeypatch.setattr(boosting, "SENT_BYTES", 0)
    monkeypatch.setattr(forest, "SENT_BYTES", 0)
    monkeypatch.setattr(nodes, "cut_lineage", lambda df: df)
    assert scores(type(model).load(str(tmp_path / "m"))) == walked


def test_roots_share_a_copy_of_the_rows(spark, frame, monkeypatch):
    """Without bootstrap a copy of the rows serves several trees; the trees are those that are grown from copies of their own."""
    copies, whole = [], forest._Growth._gather

    def counted(growth, packs):
        copies.append(([len(pack) for pack in packs], growth.rule.bootstrap))
        return whole(growth, packs)

    monkeypatch.setattr(forest._Growth, "_gather", counted)
    trees = 9 * spark.sparkContext.defaultParallelism
    shared = listed(Forest.extra(trees, max_depth=2).fit(frame), spark)
    assert sum(sum(sizes) for sizes, _ in copies) == trees and sum(len(sizes) for sizes, _ in copies) <= 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(forest._Growth, "_packs", lambda growth: [[e] for e in sorted(growth.ends)])
    assert listed(Forest.extra(trees, max_depth=2).fit(frame), spark) == shared
    monkeypatch.undo()
    monkeypatch.setattr(forest._Growth, "_gather", counted)
    copies.clear()
    Forest(3, max_depth=2).fit(frame)
    assert [sizes for sizes, _ in copies] == [[1, 1, 1]]


def test_scores_by_shards(spark, frame, monkeypatch):
    """A model too large to be sent whole meets the rows once, not level by level, in any number of shards and slices."""
    model = Forest.extra(5).fit(frame)
    some = frame.filter("id < 40")
    some = cut_lineage(some.unionByName(some.filter("id = 7")))
    scores = lambda: sorted((r["id"], [round(p, 12) for p in r["probability"]]) for r in model.transform(some).collect())
    walked, levels = scores(), []
    model._walker = None
    monkeypatch.setattr(forest, "SENT_BYTES", 0)
    monkeypatch.setattr(nodes, "SHARD_BYTES", 1)
    monkeypatch.setattr(nodes, "SLICE_BYTES", 500)
    monkeypatch.setattr(nodes, "cut_lineage", lambda df: levels.append(1) or df)
    assert scores() == walked and len(walked) == 41 and not levels
    # A tree too large for one place is walked by joins.
    shallow = Forest.extra(2, max_depth=2).fit(frame)
    expected = sorted((r["id"], [round(p, 12) for p in r["probability"]]) for r in shallow.transform(some).collect())
    monkeypatch.setattr(nodes, "SENT_BYTES", 0)
    joined = sorted((r["id"], [round(p, 12) for p in r["probability"]]) for r in shallow.transform(some).collect())
    assert joined == expected and levels


def test_edges(spark):
    data = spark.createDataFrame([(float(i % 5), float(i), None if i % 2 else float("nan")) for i in range(1000)], "a double, b double, c double")
    few, many, none = binned.learn_edges(data.select(F.array("a", "b", "c").alias("x")), "x", 3, 16)
    assert few.tolist() == [0, 1, 2, 3] and none.tolist() == []
    assert len(many) == 15 and max(abs(m - 1000 / 16 * (i + 1)) for i, m in enumerate(many)) < 1000 / 16 / 4


def test_poisson_weights():
    hashes = binned.mixed(np.arange(200_000))
    made = forest.Rule(2, np.ones(2), True, None, 2, 1, 1, True, 7, [])
    w = made.weights(hashes, 3)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w != made.weights(hashes, 4)).any() and (w == made.weights(hashes, 3)).all()


@pytest.mark.parametrize("make", [lambda: SoftmaxBoosting(12, 4, 0.3), lambda: SoftmaxBoosting(3, 4, 0.3, subsample=0.8, colsample=0.7, min_child_weight=2.0, alpha=0.1, lam=2.0, gamma=0.5, checkpoint_every=2), lambda: SoftmaxBoosting.histogram(3, max_leaves=9, early_stopping=True)])
def test_boosting_on_sent_rows(spark, frame, make, monkeypatch):
    """A round is one job over rows that are sent once: the trees of rounds that take a job for each level."""
    jobs, run = [], boosting._Fit._table
    monkeypatch.setattr(boosting._Fit, "_table", lambda self: jobs.append((type(self), self.jobs - len(self.grown))) or run(self))
    sent = listed(make().fit(frame), spark)
    monkeypatch.setattr(boosting, "EXACT_ROWS", 700)
    assert listed(make().fit(frame.repartition(5)), spark) == sent
    assert all(kind is boosting._SentFit and more <= 1 for kind, more in jobs)
    monkeypatch.setattr(boosting, "GATHERED", 0)
    assert listed(make().fit(frame), spark) == sent and jobs[-1][0] is boosting._Fit


def test_values_of_small_trees(monkeypatch):
    """Leaf by leaf and node by node: the same values, for rows of any place in the tree."""
    rng = np.random.default_rng(3)
    x, tree = rng.integers(0, 200, (4, 5000)).astype(np.uint8), boosting.Tree()
    for _ in range(60):
        node = int(rng.choice(np.flatnonzero(np.array(tree.feature) < 0)))
        tree.split(node, boosting.Split(int(rng.integers(4)), int(rng.integers(200)), 1.0, (0, 0, 0), (0, 0, 0)))
    tree.value = rng.normal(size=len(tree.feature)).tolist()
    fast = boosting.leaf_values(x, tree.arrays())
    assert np.array_equal(fast, tree.arrays()[4][boosting.walk(x, tree.arrays())])
    monkeypatch.setattr(boosting, "SMALL_TREE", 1)
    assert np.array_equal(boosting.leaf_values(x, tree.arrays()), fast)


@pytest.mark.parametrize("make", [lambda: Forest(4, max_depth=6, class_weight="balanced"), lambda: Forest.extra(4), lambda: Forest.extra(2, 5, max_depth=5, bootstrap=True)])
def test_forest_on_sent_rows(spark, frame, make, monkeypatch):
    """Trees from rows that are sent once are those from rows brought together, with values or with their places."""
    ways, grown = [], forest._Growth._grown
    monkeypatch.setattr(forest._Growth, "_grown", lambda self, packs: ways.append(self.rule.values) or grown(self, packs))
    sent = listed(make().fit(frame), spark)
    assert [v is not None for v in ways] == [make().drawn]
    monkeypatch.setattr(forest, "LISTED_VALUES", 10)
    assert listed(make().fit(frame.repartition(5)), spark) == sent and len(ways) == 2 and ways[1] is None
    monkeypatch.setattr(forest._Growth, "__init__", lambda self, *a, start=forest._Growth.__init__: start(self, *a[:-1]))
    assert listed(make().fit(frame), spark) == sent and len(ways) == 2


@pytest.mark.parametrize("entropy", [True, False])
def test_cuts_by_packed_counts(entropy, monkeypatch):
    """Few classes share numbers while they are counted; the cuts are those of running sums for any number of classes."""
    rng = np.random.default_rng(4)
    rule = forest.Rule(4, np.array([1.0, 2.5, 0.5, 1.0]), entropy, None, 2, 3, 3, True, 1, [np.arange(255.0)])
    seg = np.sort(rng.integers(0, 90, 4000))
    v, label, weight = rng.integers(0, 30, 4000).astype(np.uint8), rng.integers(0, 4, 4000), rng.integers(1, 6, 4000)
    totals = np.bincount(seg * 4 + label, weights=weight, minlength=360).reshape(90, 4)
    packed = forest._packed_cuts(rule, v, seg, label, weight, totals)
    monkeypatch.setattr(forest, "FEW_CLASSES", 0)
    plain = forest._sorted_cuts(rule, v, seg, label, weight, totals)
    assert np.allclose(packed[0], plain[0]) and np.array_equal(packed[1], plain[1]) and np.array_equal(packed[2], plain[2])
