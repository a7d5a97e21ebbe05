"""Limits of the fingerprint's parts: how many pairs they leave to be compared."""

import numpy as np

from orbitlake.llm import simhash


def test_limits_lose_no_pair_within_the_radius():
    for radius in range(0, 41):
        limits = simhash.limits(radius)
        assert len(limits) == simhash.PARTS and sum(t + 1 for t in limits) == radius + 1  # beyond all of them is beyond the radius


def test_parts_leave_few_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    side = (*rng.integers(0, 1 << 64, (3, 4000), dtype=np.uint64), np.full(4000, 64))
    looked = 0
    count = np.bitwise_count

    def counted(x):
        nonlocal looked
        looked += x.size if x.ndim == 2 else 0
        return count(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    simhash.compare_parts(side, None, simhash.RADIUS, range(simhash.PARTS))
    assert 0 < looked < 0.04 * 4000 * 3999 / 2
