"""Predictors are fitted where their rows lie; their areas under the curve move a row once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixture import Tables
from residuum.operators import ranking
from residuum.operators.logistic import solve
from residuum.plans import strengthening
from residuum.plans.strengthening import PREDICTOR_RIDGE, train_predictors


def frame(spark):
    rng = np.random.default_rng(7)
    out = []
    for i in range(1200):
        a, b = float(rng.normal()), float(rng.integers(0, 2))
        y = float(rng.random() < 1 / (1 + np.exp(-(0.8 * a + (1.0 if i % 2 else -1.0) * b))))
        out.append((i, None if i % 2 else "m", "validation" if i % 3 else "test", a, b, y))
    return spark.createDataFrame(out, "row_id long, model string, split string, a double, b double, label double")


def test_fits_equal_plain_ones_and_store_no_rows(spark, monkeypatch):
    """One table of cells is stored, whatever the rows; a column that does not vary changes nothing; null is a group."""
    stored = []
    real = ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, label: (stored.append(label), real(df, label))[1])
    monkeypatch.setattr(strengthening, "cut", lambda df, label: pytest.fail(f"{label} is stored"))
    rows = frame(spark).withColumn("same", F.lit(0.1))
    got = train_predictors(rows, ["a", "same"], ["b"]).toPandas()
    assert stored == ["auc-cells"] and len(got) == 1200
    for _, part in got.groupby("model", dropna=False):
        train = part[part["split"] == "validation"]
        y = train["label"].to_numpy()
        w = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        c = 1 / (PREDICTOR_RIDGE * len(y))
        beta = solve(train[["a"]].to_numpy(), y, w, c)
        assert np.abs(part["s_base"] - (part["a"] * beta[0] + beta[1])).max() < 1e-4
        # the optimum beside the frozen base: no part of the weighted residual is left in the head's columns
        left = w * (1 / (1 + np.exp(-train["s_full"].to_numpy())) - y)
        assert abs(left.sum()) < 1e-4 * len(y) and abs(left @ train["b"].to_numpy()) < 1e-4 * len(y)
        assert np.abs(part["s_full"] - part["s_base"] - part["s_prior"]).max() < 1e-9


def test_areas_of_large_groups(spark):
    """Equal to auc_metrics: ties within and across tasks, both signs, zeros, null keys left out, single classes."""
    rng = np.random.default_rng(1)
    rows = [(g, float(s), float(rng.random() < 0.4)) for g, scores in (
        ("ties", rng.integers(-3, 4, 900)), ("free", rng.normal(size=900)), ("near", 1 + rng.random(600) / 1000), ("one", np.zeros(300))) for s in scores]
    rows += [("positive", 1.0, 1.0), ("odd", None, 1.0), ("odd", float("nan"), 0.0), ("ties", -0.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, y double").repartition(5)
    for keys in (["k"], []):
        want = {tuple(r[k] for k in keys): r for r in ranking.auc_metrics(df, keys, "v", "y").collect()}
        found = {tuple(r[k] for k in keys): r for r in ranking.auc_of_large_groups(df, keys, "v", "y").collect()}
        assert want.keys() == found.keys() and len(found) == (5 if keys else 1)
        for key, r in want.items():
            other = found[key]
            assert (r.n, r.positives) == (other.n, other.positives)
            assert (r.auroc, r.auprc) == pytest.approx((other.auroc, other.auprc), abs=1e-12)
    plan = ranking.auc_of_large_groups(df, ["k"], "v", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_id") == 1


def test_entity_counts_equal_the_whole_ones(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    narrow = t.entity_counted()
    whole = t.counted().select(*narrow.columns)
    assert narrow.schema.simpleString() == whole.schema.simpleString()
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty() and not narrow.isEmpty()
