"""Splits of one task: counted and sorted ones are the same, and large nodes are taken piece by piece."""

import numpy as np
import pytest

from blotter.models import binned, forest


@pytest.mark.parametrize("entropy", [True, False])
def test_counted_splits_equal_sorted_ones(entropy, monkeypatch):
    rng = np.random.default_rng(3)
    n, width = 6000, 5
    x = rng.integers(0, [[3], [20], [256], [1], [90]], (width, n)).astype(np.uint8)
    label, weight = ((x[1] > 9) + (x[2] > 100) * rng.integers(0, 2, n)).astype(np.int64), rng.poisson(1, n) + 1
    rule = forest.Rule(3, np.array([1.0, 2.5, 0.5]), entropy, None, 2, 3, 3, True, 1, [np.arange(255.0)] * width)
    hashes = binned.mixed(np.arange(n))
    met, found = [], []
    for name in ("_counted_cuts", "_sorted_cuts"):
        plain = getattr(forest, name)
        monkeypatch.setattr(forest, name, lambda *a, name=name, plain=plain: met.append((name, len(a[1]))) or plain(*a))
    for together, counted in ((1 << 16, 1 << 30), (1 << 16, 0), (500, 40)):
        monkeypatch.setattr(forest, "TOGETHER", together)
        monkeypatch.setattr(forest, "COUNTED", counted)
        found.append(forest.grow(rule, x, label, weight, hashes, 7, 0))
        assert len(found[-1][0]) > 100
    assert {name for name, _ in met} == {"_counted_cuts", "_sorted_cuts"}
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0][:4], other[:4]))
        assert all(np.allclose(a, b) for a, b in zip(found[0][4:], other[4:]))


def test_stable_order():
    rng = np.random.default_rng(5)
    for keys in (rng.integers(0, 7, 1000), rng.integers(0, 1 << 60, 1000), np.empty(0, int), np.zeros(1, int)):
        assert np.array_equal(forest.stable_order(keys), np.argsort(keys, kind="stable"))
