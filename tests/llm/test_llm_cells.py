"""Confirmation in cells, the choice of frequent keys and thresholds against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from residuum.llm import near_dedup, trees
from residuum.llm.frequent import most_frequent


def joined(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("cell,weight,columns", [(256, 2_000_000, 4096), (3, 2_000_000, 7), (5, 60, 4096)])
def test_cells_find_all_links_between_components(spark, monkeypatch, cell, weight, columns):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    monkeypatch.setattr(near_dedup, "CELL_SHINGLES", weight)
    monkeypatch.setattr(near_dedup, "COLUMNS", columns)
    rng = random.Random(cell)
    sets, members = {}, []
    for bucket in range(6):
        template = [rng.randrange(1 << 40) for _ in range(30)]
        for k in range(rng.choice([2, 5, 20, 33])):
            node = f"n{bucket}-{k}" if rng.random() < 0.9 else "n0-0"
            if node not in sets:
                drop = rng.randint(0, 9)
                sets[node] = sorted(set(rng.sample(template, 30 - drop) + [rng.randrange(1 << 40) for _ in range(rng.randint(0, drop))]))
            members.append((bucket, node))
    members = sorted(set(members))
    roots = {n: (n if rng.random() < 0.5 else f"n{n[1]}-0" if f"n{n[1]}-0" in sets else n) for n in sets}
    rows = spark.createDataFrame([(b, n, len(sets[n]), roots[n]) for b, n in members], "bucket long, node string, n_shingles long, root string")
    table = spark.createDataFrame(list(sets.items()), "node string, shingles array<long>")
    got = [(r.a, r.b) for r in near_dedup.in_cells(rows, table, 80).collect()]
    want = []
    for b, n in members:
        for c, m in members:
            if b == c and n < m and roots[n] != roots[m]:
                shared = len(set(sets[n]) & set(sets[m]))
                if 100 * shared >= 80 * (len(sets[n]) + len(sets[m]) - shared):
                    want.append((n, m))
    assert {tuple(sorted(p)) for p in got} <= set(want)  # links only
    known = list(roots.items())
    assert joined(known + got, sets) == joined(known + want, sets)


def test_equal_counts_fill_the_head(spark):
    counts = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("c"))
    counts = counts.unionByName(spark.createDataFrame([("top", 70_000), ("next", 500)], "word string, c long"))
    assert most_frequent(counts, "c", 5000).count() == 2
    picked = most_frequent(counts, "c", 5000, split=True)
    assert picked.count() == 5000 and picked.where("c > 1").count() == 2
    again = most_frequent(counts.repartition(7), "c", 5000, split=True)
    assert picked.exceptAll(again).isEmpty()
    assert most_frequent(counts, "c", 30_000, split=True).count() == 20_002
    assert most_frequent(counts.limit(0), "c", 3, split=True).count() == 0


def test_one_bad_top_cell_closes_no_kind(spark):
    rows = [("a", 0.99, 0.0)] + [("a", 0.9, 1.0)] * 500 + [("a", 0.3, 0.0)] * 400 + [("b", 0.7, 0.0)] * 3
    scored = spark.createDataFrame(rows, "kind string, score double, y double")
    limits = trees.thresholds(scored, ["a", "b", "c"], 0.95)
    assert limits["a"] == pytest.approx(0.9) and limits["b"] == 2.0 and limits["c"] == 2.0
