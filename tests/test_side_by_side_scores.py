import math

import numpy as np

from residuum.operators import profiles

WIDTH = len(profiles.FEATURES)


def test_rows_are_scored_under_all_profiles_at_once(spark):
    """No row is copied for a profile; scores are those of a loop over the features, to the last bit; unfitted profiles and other fits have none."""
    rng = np.random.default_rng(8)
    vector = lambda: [None if v < -1 else float(v) for v in rng.normal(size=WIDTH)]
    rows = [(run, fit, role, i, float(i % 2), vector()) for run in "ab" for fit in (-1, 0, 1) for role in ("fit", "held") for i in range(20)]
    frames = spark.createDataFrame(rows, "run string, fit int, role string, row_id long, base_wrong double, x array<double>")
    full = lambda: [float(v) for v in rng.normal(size=WIDTH)]
    fitted = [(run, fit, p, full(), full(), float(rng.normal())) for run in "ab" for fit in (-1, 0) for p in ("one", "two")]
    fitted.append(("a", 1, "one", None, None, None))
    coefs = spark.createDataFrame(fitted, "run string, fit int, profile string, slope array<double>, fill array<double>, intercept double")
    out = profiles.score_rows(frames, coefs, ["run"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    assert out.columns == ["run", "fit", "profile", "row_id", "base_wrong", "score"]
    want = {}
    for run, fit, role, i, wrong, x in rows:
        for r, f, profile, slope, fill, total in fitted:
            if (run, fit, role) == (r, f, "held") and slope is not None:
                for a, v, b in zip(slope, x, fill):
                    total += a * (b if v is None else v)
                want[run, fit, profile, i] = (wrong, 1.0 / (1.0 + math.exp(-total)))
    got = {(r.run, r.fit, r.profile, r.row_id): (r.base_wrong, r.score) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == w and abs(got[k][1] - s) < 1e-15 for k, (w, s) in want.items())
    assert profiles.score_rows(frames, coefs.limit(0), ["run"]).count() == 0
