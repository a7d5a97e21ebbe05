"""The last comparison of the line stage: tiles of a bucket's lines."""

import numpy as np

from orbitlake.llm import line_dedup
from orbitlake.llm.components import forest


def _variants(rng, base, shares):
    out = []
    for share in shares:
        x = base.copy()
        new = rng.random(len(x)) < share
        x[new] = rng.integers(0, 1 << 63, int(new.sum()), dtype=np.uint64)
        out.append(np.unique(x))
    return out


def test_tiles_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    for trial in range(40):
        n, m = int(rng.integers(2, 30)), int(rng.choice([1, 3, 20, 200, 3000]))
        sets = _variants(rng, rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.choice([0, 0.02, 0.05, 0.1, 0.12, 0.2, 0.5], n))
        group, part = rng.integers(0, n // 2 + 1, n), rng.integers(0, 1 + trial % 2, n)
        across = part.min() != part.max()
        near = []
        for i in range(n):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if not (across and part[i] == part[j]) and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                    near.append((i, j))
        got = line_dedup._joins(sets, group.copy(), part, line_dedup._parity(sets))
        assert {frozenset(p) for p in got} <= {frozenset(p) for p in near}
        first = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]
        roots = [forest(n, np.array([*np.arange(n), *(a for a, _ in links)]), np.array([*first, *(b for _, b in links)])).tolist() for links in (got, near)]
        assert roots[0] == roots[1]


def test_few_pairs_of_a_family_are_compared_in_full():
    rng = np.random.default_rng(6)
    sets = _variants(rng, rng.integers(0, 1 << 63, 550, dtype=np.uint64), [0.03] * 400 + [0.3] * 200)
    group = np.array([0] * 400 + [*range(1, 201)])
    one, _ = line_dedup._possible(np.array([*map(len, sets)]), group, np.zeros(600, np.int64), line_dedup._parity(sets))
    assert len(one) < 1_000  # of the 99,900 pairs of different groups
