import tracemalloc

import numpy as np

from lodeseek.llm import nbsvm


def plain_fit(rows, y, size):
    """The weights with all rows' values at once."""
    p, q = (np.bincount(np.concatenate([f for f, c in zip(rows, y) if c == s]), minlength=size) + 1.0 for s in (1, -1))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [ratio[f] / max(np.sqrt((ratio[f] * ratio[f]).sum()), 1e-12) for f in rows]
    part = [i for i in range(len(rows)) if i % 4 != 3]
    cost = np.where(y > 0, 1.0, (y > 0).sum() / (y <= 0).sum())
    w, a, rng = np.zeros(size), np.zeros(len(part)), np.random.default_rng(7)
    for _ in range(12):
        moved = 0.0
        for i in rng.permutation(len(part)):
            f, v, c = rows[part[i]], values[part[i]], y[part[i]]
            g, norm = c * (w[f] @ v) - 1, v @ v
            if norm == 0 or a[i] == 0 and g >= 0 or a[i] == cost[part[i]] and g <= 0:
                continue
            new = min(max(a[i] - g / norm, 0.0), cost[part[i]])
            w[f] += (new - a[i]) * c * v
            moved = max(moved, abs(new - a[i]))
            a[i] = new
        if moved < 1e-3:
            break
    return ratio, w


def test_fit_holds_no_second_copy_of_its_rows():
    rng = np.random.default_rng(1)
    size = 1 << 15
    rows = [np.unique(rng.integers(0, size, 12_000)).astype(np.int32) for _ in range(900)]
    y = np.where(np.arange(900) % 3 == 0, 1, -1)
    held = sum(f.nbytes for f in rows)
    tracemalloc.start()
    model = nbsvm.fit(rows, y, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * held  # values of all rows alone take twice their numbers
    ratio, w = plain_fit(rows, y, size)
    assert np.array_equal(model.ratio, ratio) and np.array_equal(model.weight, w)
