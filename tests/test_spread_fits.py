"""Ranker fits of groups too large for one task carry only what their profiles can use."""

import numpy as np

from residuum.operators import profiles


def test_only_usable_features_of_the_profiles_are_carried(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = [*profiles.RISK, *profiles.PRIOR[:2]]
    at = [profiles.FEATURES.index(n) for n in names]
    rows = []
    for i in range(240):
        x = [float(v) for v in rng.normal(size=len(profiles.FEATURES))]
        x[profiles.FEATURES.index(profiles.PRIOR[2])] = 1.0  # constant: no fit can use it
        for n in profiles.PRIOR[3:]:
            x[profiles.FEATURES.index(n)] = None
        x[at[1]] = None if i % 7 == 0 else x[at[1]]
        rows.append(("a", -1, "fit", i, float(x[at[0]] + rng.normal() > 0), float(rng.random()), x))
    frames = spark.createDataFrame(rows, "k string, fit int, role string, row_id long, base_wrong double, draw double, x array<double>")
    use = [p for p in profiles.PRIMARY_PROFILES if p.name in ("prior", "uncertainty_prior")]
    near = {r.profile: r for r in profiles.fit_rankers(frames, ["k"], use).collect()}
    widths, plain = [], profiles.solve_spread
    seen = []
    monkeypatch.setattr(profiles, "solve_spread", lambda stack, *rest: (widths.append(len(stack.first().x)), plain(stack, *rest))[1])
    whole = profiles.medians
    monkeypatch.setattr(profiles, "medians", lambda long, *rest: (seen.append(long.select("feature").distinct().count()), whole(long, *rest))[1])
    far = {r.profile: r for r in profiles.fit_rankers(frames, ["k"], use, limit=10).collect()}
    assert widths == [len(names)] and seen == [len(names)]
    for name, row in near.items():
        other = far[name]
        assert row.used == other.used and (row.rows, row.pairs) == (other.rows, other.pairs) and other.converged
        np.testing.assert_allclose(other.slope, row.slope, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(other.fill, row.fill)
        assert abs(other.intercept - row.intercept) < 1e-6
