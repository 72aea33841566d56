import glob

import numpy as np

from residuum.operators import neighbours
from residuum.storage import shared_folder


def test_visits_to_groups_of_pieces_are_exact_and_few(spark, monkeypatch):
    """Small pieces: a vector goes once to each group of pieces, not once to each piece."""
    monkeypatch.setattr(neighbours, "VISIT_ROWS", 256)
    x = np.random.default_rng(4).normal(size=(1100, 5))
    df = spark.createDataFrame([(str(i), i, v.tolist()) for i, v in enumerate(x)], "id string, ord long, vec array<double>")
    folder = shared_folder(spark).replace("file:", "")
    before = set(glob.glob(f"{folder}/knn-routes-*"))
    out = neighbours.nearest_neighbours(df.select("id", "vec"), df, "euclidean", 3, block_rows=8)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in out.collect()}
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for i, order in enumerate(np.argsort(far, axis=1, kind="stable")[:, :3]):
        for rank, j in enumerate(order):
            assert got[(str(i), rank + 1)][0] == str(j) and abs(got[(str(i), rank + 1)][1] - far[i, j]) < 1e-9
    (routes,) = set(glob.glob(f"{folder}/knn-routes-*")) - before
    assert spark.read.parquet(routes).count() <= 5 * len(x)


def test_fingerprints_travel_as_bits_and_queries_are_stored_once(spark, monkeypatch):
    """One row a query however many groups it visits, its fingerprint in one bit a position; ties and exact neighbours as by brute force."""
    monkeypatch.setattr(neighbours, "VISIT_ROWS", 256)
    rng = np.random.default_rng(6)
    bits = rng.random((900, 2048)) < rng.choice([0.02, 0.1, 0.3], (900, 1))
    bits[5], bits[6:9] = False, bits[9]
    df = spark.createDataFrame([(str(i), i, np.flatnonzero(v).tolist()) for i, v in enumerate(bits)], "id string, ord long, vec array<int>")
    folder = shared_folder(spark).replace("file:", "")
    before = set(glob.glob(f"{folder}/knn-routes-*"))
    out = neighbours.nearest_neighbours(df.select("id", "vec"), df, "tanimoto", 5, block_rows=64)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in out.collect()}
    both = bits.astype(np.int64) @ bits.T.astype(np.int64)
    union = bits.sum(1)[:, None] + bits.sum(1)[None, :] - both
    far = 1.0 - np.divide(both, union, out=np.zeros(both.shape), where=union > 0)
    assert len(got) == 5 * len(bits)
    for i, order in enumerate(np.argsort(far, axis=1, kind="stable")[:, :5]):
        for rank, j in enumerate(order):
            assert got[(str(i), rank + 1)] == (str(j), far[i, j])
    (routes,) = set(glob.glob(f"{folder}/knn-routes-*")) - before
    stored = spark.read.parquet(routes)
    assert stored.count() == len(bits) and {len(r.vec) for r in stored.select("vec").collect()} == {256}
