"""Work that is merged before rows are moved or repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import logistic, neighbours, registry


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_positions_become_rows_after_one_shuffle(spark):
    """Chunks across block ends, with a gap between them: means and counts as in a plain loop."""
    rng = np.random.default_rng(3)
    chunks = [(d, s, rng.integers(0, 9, (n, 2)).astype(float).tolist()) for d, s, n in
              [(1, 0, 700), (1, 500, 600), (1, 510, 3), (2, 255, 2), (2, 2000, 1), (3, 5, 0)]]
    df = spark.createDataFrame(chunks, "doc int, start int, vecs array<array<double>>")
    found = registry.merge_positions(df, ["doc"])
    assert exchanges(found) == 1
    want = {}
    for d, s, vecs in chunks:
        for i, v in enumerate(vecs):
            want.setdefault((d, s + i), []).append(v)
    got = {(r.doc, r.position): r for r in found.collect()}
    assert set(got) == set(want)
    for key, vecs in want.items():
        assert got[key].n == len(vecs) and got[key].vec == pytest.approx(np.mean(vecs, axis=0))


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    """A group of many rows and few values needs no pass over its rows, and its fit is that of the rows."""
    rows = spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") % 7 / 2.0).alias("v"), (F.col("id") % 7 + F.col("id") % 5 > 5).cast("double").alias("y"))

    def forbidden(*args, **kwargs):
        raise AssertionError("passes over rows for a group of 14 distinct rows")

    monkeypatch.setattr(logistic, "solve_spread", forbidden)
    fit = logistic.fit_platt(rows, ["k"], "v", "y", limit=100).first()
    own = rows.toPandas()
    beta = logistic.solve(own[["v"]].to_numpy(), own["y"].to_numpy(), np.ones(len(own)), logistic.PLATT_C)
    assert fit.fit_n == 3000 and (fit.slope, fit.intercept) == pytest.approx(tuple(beta), rel=1e-7)
    merged = rows.groupBy("k", "v", "y").agg(F.count(F.lit(1)).alias("w"))
    again = logistic.fit_platt(merged, ["k"], "v", "y", limit=100, copies="w").first()
    assert again == fit


def test_stores_of_a_column_meet_before_the_rows(spark):
    ids = lambda *n: spark.createDataFrame([(str(i),) for i in n], "id string")
    rows = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "dr_id int, pr_id int")
    out = neighbours.covered_rows(rows, [("dr_id", ids(0, 1)), ("pr_id", ids(1, 2, 3)), ("pr_id", ids(2, 2, 3))])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert sorted(map(tuple, out.collect())) == [(0, 2), (0, 3), (1, 2), (1, 3)]


def test_positions_are_summed_as_arrays(spark):
    """No position is worked out by itself; null components count but add nothing, empty and missing vectors do not, widths may differ."""
    chunks = [("a", 250, [[1.0, None], [2.0], [], None, [None, 4.0, 6.0]] * 3), ("a", 252, [[5.0, 7.0]] * 9), ("b", 3, [[None]])]
    df = spark.createDataFrame(chunks, "doc string, start int, vecs array<array<float>>")
    found = registry.merge_positions(df, ["doc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    want = {}
    for d, s, vecs in chunks:
        for i, v in enumerate(vecs):
            if v:
                want.setdefault((d, s + i), []).append(v)
    got = {(r.doc, r.position): r for r in found.collect()}
    assert set(got) == set(want)
    for key, vecs in want.items():
        assert got[key].n == len(vecs) and len(got[key].vec) == max(map(len, vecs))
        for i, x in enumerate(got[key].vec):
            values = [v[i] for v in vecs if len(v) > i]
            known = [v for v in values if v is not None]
            assert x == (pytest.approx(sum(known) / len(values)) if known else None)
