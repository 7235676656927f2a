"""The sums of a block, feature by feature and in one call."""

import numpy as np
import pytest

from blotter.models import boosting


@pytest.mark.parametrize("slots", [1, 5])
def test_sums_by_feature(slots, monkeypatch):
    rng = np.random.default_rng(2)
    offsets, n = np.array([0, 1, 4, 260]), 500
    x = (rng.integers(0, 1 << 20, (3, n)) % np.diff(offsets)[:, None]).astype(np.uint8)
    g, h, slot = np.rint(rng.normal(0, 1, n) * 2**36), np.rint(rng.random(n) * 2**36), rng.integers(0, slots, n)
    rule, found = boosting.Rule(offsets, 2.0**36, 0, 1, 0, 1, 1), []
    for rows in (1, 1 << 30):
        monkeypatch.setattr(boosting, "BY_FEATURE", rows)
        found.append(rule.sums(x, g, h, slot, slots))
    assert found[0].shape == (3, slots, 260) and np.array_equal(*found)
    for i in range(slots):
        assert found[0][0, i, 1:4].tolist() == [int(g[(slot == i) & (x[1] == b)].sum()) for b in range(3)]
