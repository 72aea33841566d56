"""Grouped boosting against a plain best-first learner, one group at a time."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import boosting
from residuum.operators.boosting import STEPS, Boosting


def plain_model(x, y, held, b):
    """Scores of held rows from one model grown in plain loops over rows."""
    fill = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    x, held = np.where(np.isnan(x), fill, x), np.where(np.isnan(held), fill, held)
    edges = [boosting.bin_edges(c, b.bins) for c in x.T]
    xb, hb = boosting.to_bins(x, edges), boosting.to_bins(held, edges)
    w = np.where(y == 1, len(y) / (2.0 * y.sum()), len(y) / (2.0 * (len(y) - y.sum())))
    margin, out = np.zeros(len(y)), np.zeros(len(held))
    for _ in range(b.iterations):
        g, h = boosting.gradients(margin, y, w)

        def split(rows):
            best = (0.0, None)
            whole_g, whole_h = g[rows].sum() / STEPS, h[rows].sum() / STEPS
            for f in range(x.shape[1]):
                for cut_ in range(len(edges[f])):
                    left = rows[xb[rows, f] <= cut_]
                    right = rows[xb[rows, f] > cut_]
                    if min(len(left), len(right)) < b.min_leaf:
                        continue
                    gl, hl = g[left].sum() / STEPS, h[left].sum() / STEPS
                    gr, hr = g[right].sum() / STEPS, h[right].sum() / STEPS
                    if min(hl, hr) < b.min_hessian:
                        continue
                    gain = gl**2 / (hl + b.l2) + gr**2 / (hr + b.l2) - whole_g**2 / (whole_h + b.l2)
                    if gain > best[0]:
                        best = (gain, (f, cut_, left, right))
            return best

        everything = np.arange(len(y))
        leaves, heap, count = [(everything, np.arange(len(held)))], [], 0
        first = split(everything)
        done = []
        heapq.heappush(heap, (-first[0], count, first[1], everything, np.arange(len(held))))
        n = 1
        while heap and n < b.leaves and heap[0][0] < 0:
            _, _, (f, cut_, left, right), _, inside = heapq.heappop(heap)
            n += 1
            for rows, hin in ((left, inside[hb[inside, f] <= cut_]), (right, inside[hb[inside, f] > cut_])):
                count += 1
                s = split(rows) if len(rows) >= 2 * b.min_leaf else (0.0, None)
                heapq.heappush(heap, (-s[0], count, s[1], rows, hin))
        done = [(item[3], item[4]) for item in heap]
        for rows, hin in done:
            value = -b.rate * (g[rows].sum() / STEPS) / (h[rows].sum() / STEPS + b.l2)
            margin[rows] += value
            out[hin] += value
    return 1 / (1 + np.exp(-out))


def groups(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name, n, m in (("a", 90, 15), ("b", 160, 40), ("c", 45, 5), ("one class", 50, 5), ("no support", 60, 5)):
        x = np.round(rng.normal(0, 1, (n + m, 4)), 1)
        x[rng.random(x.shape) < 0.1] = np.nan
        if name == "no support":
            x[:, 2] = np.nan
        z = np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2])
        y = (z + rng.normal(0, 0.5, n + m) > 0.2).astype(float)
        if name == "one class":
            y[:] = 1.0
        for i in range(n + m):
            rows.append((name, "fit" if i < n else "held", len(rows), float(y[i]), float(rng.random()), [None if np.isnan(v) else float(v) for v in x[i]]))
    return rows


@pytest.mark.parametrize("leaves,parts", [(15, 3), (4, 7)])
def test_models_equal_the_plain_learner(spark, monkeypatch, leaves, parts):
    monkeypatch.setattr(boosting, "REWRITE", 3)
    monkeypatch.setattr(boosting, "SLICE_ROWS", 40)
    b = Boosting(iterations=4, leaves=leaves, min_leaf=8, bins=16)
    rows = groups()
    frames = spark.createDataFrame(rows, "g string, role string, row_id long, base_wrong double, draw double, x array<double>").repartition(parts)
    scores, fits = boosting.boost(frames, ["g"], [0, 1, 2], [[2]], 20, b)
    got = {r["row_id"]: r["score"] for r in scores.collect()}
    status = {r["g"]: (r["n"], r["status"], list(r["used"])) for r in fits.collect()}
    assert status["one class"][1] == "single_class" and status["no support"] == (60, "unavailable", [0, 1])
    assert status["a"] == (90, "complete", [0, 1, 2])
    want = {}
    for name in "abc":
        own = [r for r in rows if r[0] == name]
        x = np.array([[np.nan if v is None else v for v in r[5][:3]] for r in own])
        fit = np.array([r[1] == "fit" for r in own])
        y = np.array([r[3] for r in own])
        scored = plain_model(x[fit], y[fit], x[~fit], b)
        want |= dict(zip([r[2] for r, f in zip(own, fit) if not f], scored))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_best_first_needs_no_more_than_it_measures():
    b = Boosting(leaves=4, min_leaf=1)
    tree = boosting.Tree(b)

    def measure(node, gain, n):
        tree.measured(node, {"gain": gain, "feature": 0, "bin": 0, "gl": 0, "hl": 0, "nl": n // 2, "g": 0, "h": 0, "n": n})

    assert tree.grow() == ([], [0])
    measure(0, 5.0, 40)
    assert tree.grow() == ([0], [1, 2])
    measure(1, 1.0, 20), measure(2, 3.0, 20)
    order, missing = tree.grow()
    assert order == [0, 2, 1] and set(missing) == {3, 4, 5, 6}  # node 1 was split only if no child of 2 gains more
    for child, gain in ((3, 0.0), (4, 0.0), (5, 2.0), (6, 0.0)):
        measure(child, gain, 10)
    assert tree.grow()[0][:3] in ([0, 2, 5], [0, 2, 6]) and tree.grow()[1] == []


def test_scores_do_not_depend_on_partitions(spark):
    rows = groups(4)
    schema = "g string, role string, row_id long, base_wrong double, draw double, x array<double>"
    b = Boosting(iterations=3, min_leaf=8, bins=16)
    a, c = (
        {r["row_id"]: r["score"] for r in boosting.boost(spark.createDataFrame(rows, schema).repartition(p, F.col("row_id")), ["g"], [0, 1, 2, 3], (), 20, b)[0].collect()}
        for p in (1, 6)
    )
    assert a == c


def test_empty_input(spark):
    none = spark.createDataFrame([], "g string, role string, row_id long, base_wrong double, draw double, x array<double>")
    scores, fits = boosting.boost(none, ["g"], [0])
    assert scores.count() == 0 and fits.count() == 0


def test_fits_of_one_task_equal_passes(spark, monkeypatch):
    """Fits up to the limit need no pass over the rows; trees are the same, also where small and large fits mix."""
    rng = np.random.default_rng(11)
    rows = []
    for g, n in (("a", 150), ("b", 400), ("c", 90)):
        x = rng.normal(size=(n, 4))
        x[rng.random((n, 4)) < 0.05] = np.nan
        y = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) > 0).astype(float)
        rows += [(g, "held" if i % 4 == 0 else "fit", i, float(y[i]), float(rng.random()), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    frames = spark.createDataFrame(rows, "g string, role string, row_id long, base_wrong double, draw double, x array<double>")
    b = Boosting(iterations=12, leaves=6, min_leaf=5)
    score = lambda limit: {(r.g, r.row_id): r.score for r in boosting.boost(frames, ["g"], [0, 1, 2, 3], (), 20, b, limit)[0].collect()}
    passes = score(0)
    assert len(passes) == sum(r[1] == "held" for r in rows) and score(150) == passes
    monkeypatch.setattr(boosting, "next_trees", None)
    assert score(boosting.LOCAL_ROWS) == passes
