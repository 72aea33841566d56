"""Base predictor and prior head: the head adds to a frozen base, judged on rows it did not see."""

import numpy as np
from pyspark.sql import functions as F

from residuum.operators import ranking
from residuum.plans.strengthening import train_predictors


def rows(spark, n=1600):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        a, b = rng.normal(size=2)
        curved = i % 2 == 1  # the second model's prior enters by its square
        z = 1.2 * a + (2.0 * (b * b - 1) if curved else 1.5 * b)
        y = float(rng.random() < 1 / (1 + np.exp(-z)))
        out.append((i, "curved" if curved else "straight", "validation" if i % 4 < 2 else "test", float(a), None if i % 50 == 0 else float(b), None if i % 97 == 0 else y))
    out += [(n + i, "one class", "validation", 0.0, 0.0, 1.0) for i in range(5)]
    return spark.createDataFrame(out, "row_id long, model string, split string, a double, b double, label double")


def test_heads_add_to_a_frozen_base(spark):
    frame = rows(spark)
    out = train_predictors(frame, ["a"], ["b"]).cache()
    assert out.count() == frame.count()
    heads = {(r.model, r.head) for r in out.select("model", "head").distinct().collect()}
    assert ("curved", "squares") in heads and ("one class", None) in heads and len(heads) == 3  # the straight model's heads are nearly alike
    assert out.where("model = 'one class' and s_full is not null").isEmpty()
    assert out.where("abs(s_full - s_base - s_prior) > 1e-9").isEmpty()
    for channel in ("s_base", "s_full"):
        got = ranking.auc_metrics(out.where("split = 'test' and s_full is not null"), ["model"], channel, "label").collect()
        for r in got:
            if channel == "s_base":
                low = r.auroc if r.model == "straight" else None
                assert low is None or low < 0.85
            else:
                assert r.auroc > 0.8
    base = {r.model: r.auroc for r in ranking.auc_metrics(out.where("split = 'test' and s_full is not null"), ["model"], "s_base", "label").collect()}
    full = {r.model: r.auroc for r in ranking.auc_metrics(out.where("split = 'test' and s_full is not null"), ["model"], "s_full", "label").collect()}
    assert all(full[m] > base[m] + 0.03 for m in base)
    again = train_predictors(frame.repartition(3).withColumn("b", F.lit(0.0)), ["a"], ["b"])
    same = out.select("row_id", "s_base").join(again.select("row_id", F.col("s_base").alias("other")), "row_id")
    assert same.where("abs(s_base - other) > 1e-6").isEmpty()  # the base does not know the prior
