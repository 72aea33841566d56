import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import folds, permute, profiles
from residuum.operators.calibration import cross_fitted_calibration, held_out_calibration
from residuum.operators.logistic import curvature, fit_platt, solve
from residuum.plans import audit
from residuum.storage import cut

S = audit.AuditSettings(min_universe_n=2, max_pairs=500)
BY_NAME = {p.name: p for p in profiles.ALL_PROFILES}


def table(spark, n, groups, prior=True):
    rows = []
    for i in range(n):
        wrong = float(i % 2)
        rows.append((i, wrong, 1.0 - wrong, 1.0, 0.9, 2.0, 2.0 - 1.5 * wrong if prior else None, f"d{i % 20}", f"p{i * groups // n}"))
    df = spark.createDataFrame(
        rows, "row_id bigint, base_wrong double, label double, base_pred double, p_base double, s_base double, s_prior double, dr_id string, pr_id string"
    )
    if not prior:
        df = df.drop("s_prior")
    df = df.withColumns({"p_cal": F.lit(0.8), "risk": F.lit(0.2), "model": F.lit("M"), "dataset": F.lit("D"),
                         "test_run": F.lit("seed_1"), "confidence_source": F.lit("base"), "confidence_threshold": F.lit(0.8),
                         "uncertainty_reject_fraction": F.lit(0.1), "state": F.lit("residual"), "split": F.lit("validation")})
    return folds.by_axes(df, ["target"])


def stage(spark, rows, names, settings=S):
    states = cut(rows.unionByName(rows.where("row_id < 10").withColumn("split", F.lit("test"))))
    frame = states.groupBy(*audit.KEYS, "split").agg(F.lit("x").alias("calibration_status"))
    coverage = cut(audit.full_coverage(states, frame))
    use = audit.AuditSettings(**{**settings.__dict__, "profiles": [BY_NAME[n] for n in names]})
    return audit.profile_stage(states, coverage, use)


def test_grouped_profile_recovers_the_signal(spark):
    got = stage(spark, table(spark, 120, 12), ["uncertainty_prior"])
    row = got.statuses.first()
    assert row.validation_status == "complete" and row.test_status == "complete"
    assert row.validation_finite_folds == 3 and row.validation_fold_mean_auprc > 0.9
    assert got.validation_scores.where("score is not null").count() == 120


def test_missing_evidence_is_a_status_not_a_score(spark):
    got = stage(spark, table(spark, 40, 8, prior=False), ["uncertainty_prior", "general_target_joint_support"])
    status = {r.profile: r for r in got.statuses.collect()}
    assert status["uncertainty_prior"].test_status == "profile_unavailable"
    assert status["general_target_joint_support"].test_status == "diagnostic_unavailable"
    assert got.test_scores.count() == 0


def test_small_universes_are_not_fitted(spark):
    got = stage(spark, table(spark, 12, 4), ["uncertainty", "prior"])
    status = {r.profile: r.validation_status for r in got.statuses.collect()}
    assert status == {"uncertainty": "complete", "prior": "insufficient_residual_n"}


def test_both_fit_paths_agree(spark):
    rng = np.random.default_rng(2)
    n = 240
    x = rng.normal(size=(n, len(profiles.FEATURES)))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) > 0).astype(float)
    rows = [("g", 0, "fit", i, float(y[i]), int(i * 7919 % 1009), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, fit int, role string, row_id bigint, base_wrong double, draw bigint, x array<double>")
    use = [BY_NAME["prior"], BY_NAME["combined_support"]]
    for pairs in (50, 5000):
        near = {r.profile: r for r in profiles.fit_rankers(df, ["k"], use, max_pairs=pairs).collect()}
        far = {r.profile: r for r in profiles.fit_rankers(df, ["k"], use, max_pairs=pairs, limit=10).collect()}
        for name in near:
            assert np.abs(np.array(near[name].slope) - np.array(far[name].slope)).max() < 1e-7
            assert near[name].fill == pytest.approx(far[name].fill) and near[name].used == far[name].used
            for one in (near[name], far[name]):
                assert one.converged and one.gradient < 1e-6 and one.rows == n and one.pairs == min(pairs, int(y.sum() * (n - y.sum())))


def test_fits_end_at_a_stationary_point():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 6)), (rng.random(80) < 0.4).astype(float)
    w = rng.random(80)
    beta = solve(x, y, w, 1.0)
    g = curvature(x, y, w, beta)[1] + np.append(beta[:-1], 0.0)
    assert np.abs(g).max() < 1e-6
    separable = (x[:, 0] > 0).astype(float)
    assert np.isfinite(solve(x, separable, np.ones(80), 1e6)).all()


def test_platt_needs_four_rows_and_two_classes(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)] * 9 + [("b", 0.1, 1.0), ("b", 0.2, 0.0), ("b", 0.3, 1.0)], "k string, v double, y double")
    assert fit_platt(df, ["k"], "v", "y").count() == 0


def predictions(spark, n=200):
    rng = np.random.default_rng(7)
    rows = [(i, f"p{i % 23}", f"d{i % 31}", float(rng.normal()), float(rng.random() < 0.5)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, pr_id string, dr_id string, s_base double, label double")
    return df.withColumn("run", F.lit("r"))


def test_calibration_keeps_rows_and_names_fallbacks(spark):
    df = predictions(spark)
    out = cross_fitted_calibration(df, ["run"], ["target", "drug"])
    assert out.count() == 400 and {r[0] for r in out.select("calibration_status").distinct().collect()} == {"cross_fitted"}
    one = cross_fitted_calibration(df.withColumn("pr_id", F.lit("p")), ["run"], ["target"])
    assert one.select("calibration_status").first()[0] == "raw_probability_group_fallback"
    loose = cross_fitted_calibration(df.withColumn("pr_id", F.lit("p")), ["run"], ["target"], strict=False)
    assert loose.select("calibration_status").first()[0] == "cross_fitted" and loose.where("cal_fold >= 0").count() == 200
    none = cross_fitted_calibration(df.withColumn("label", F.lit(1.0)), ["run"], ["target"])
    assert none.select("calibration_status").first()[0] == "raw_probability_fallback"
    gap = held_out_calibration(df, df.withColumn("s_base", F.when(F.col("row_id") > 0, F.col("s_base"))), ["run"])
    assert {r[0] for r in gap.select("calibration_status").distinct().collect()} == {"raw_probability_fallback"}


@pytest.mark.parametrize("parts", [1, 5])
def test_folds_never_split_groups(spark, parts):
    df = folds.by_axes(predictions(spark).repartition(parts), ["target", "drug", "pair", "none"])
    out = folds.make_folds(df, ["group_axis"], "label")
    assert out.groupBy("group_axis", "group_id").count().where("count > 1").count() == 0
    joined = df.join(out, ["group_axis", "group_id"])
    assert joined.count() == 800
    both = joined.groupBy("group_axis", "fold").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    assert both.count() == 12 and both.where("a = b").count() == 0


def test_permutation_keeps_every_column_as_a_multiset(spark):
    df = predictions(spark).select("run", "row_id", "s_base", "label")
    out = permute.permute_columns(df, ["run"], ["s_base"], 3)
    values = lambda d: sorted(r.s_base for r in d.collect())
    assert values(out) == values(df)
    moved = out.join(df.withColumnRenamed("s_base", "was"), ["run", "row_id"]).where("s_base <> was").count()
    assert moved > 150


def test_features_do_not_depend_on_labels(spark):
    rows = table(spark, 60, 6)
    frames = lambda df: {
        (r.row_id, r.fit): r.x[profiles.FEATURES.index("log_drug_fit_count")]
        for r in profiles.fit_frames(cut(folds.assign_folds(df, audit.KEYS, "base_wrong")), None, audit.KEYS, 3).where("fit = -1").collect()
    }
    shuffled = rows.withColumns({"base_wrong": 1.0 - F.col("base_wrong"), "label": 1.0 - F.col("label")})
    assert frames(rows) == frames(shuffled)
