import numpy as np
import pytest

from residuum.operators import fingerprints


def by_pairs(left, right, order, k):
    a, b = (np.unpackbits(x, axis=1).astype(np.int64) for x in (left, right))
    both = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    far = 1.0 - np.divide(both, union, out=np.zeros(both.shape), where=union > 0)
    return [(i, int(j), far[i, j]) for i in range(len(left)) for j in np.lexsort((order, far[i]))[:k]]


@pytest.mark.parametrize("block", [64, 192, 8192])
@pytest.mark.parametrize("fill", [0.0, 0.01, 0.2, 0.98])
def test_counts_by_adders_find_the_same_neighbours_as_all_pairs(monkeypatch, block, fill):
    """Ties, empty and equal rows, few rows, one byte and many: the k nearest are those of all pairs, distances to the last bit."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block)
    monkeypatch.setattr(fingerprints, "SEED_WORDS", 1 if block == 192 else 32)
    rng = np.random.default_rng(block)
    for queries, rows, width in ((1, 1, 1), (70, 3, 4), (130, 700, 32), (40, 900, 256)):
        left, right = (
            np.packbits(rng.random((n, width * 8)) < fill * rng.choice([0.0, 0.3, 1.0], (n, 1)), axis=1) for n in (queries, rows)
        )
        right[: min(rows, queries) // 2] = left[: min(rows, queries) // 2]
        order = rng.permutation(rows) - rows // 2
        row, col, far = fingerprints.nearest_fingerprints(left, right, order, 5)
        got = sorted(zip(row.tolist(), far.tolist(), order[col].tolist(), col.tolist()))
        assert [(i, j, d) for i, d, _, j in got] == by_pairs(left, right, order, 5)
