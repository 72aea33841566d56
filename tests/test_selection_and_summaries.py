import pytest
from pyspark.sql import functions as F

from residuum.operators import quality, selection, stats
from residuum.plans import audit, strengthening

KEYS = audit.KEYS
POLICY = dict(model="M", dataset="D", test_run="seed_4", group_axis="target", confidence_source="base",
              confidence_threshold=0.8, uncertainty_reject_fraction=0.1)


def candidates(spark, means, ses=(0.01, 0.05, 0.02)):
    rows = [("g", n, True, c, m, s) for (n, c), m, s in
            zip((("uncertainty", 0), ("uncertainty_prior", 2), ("prior", 3)), means, ses)]
    return spark.createDataFrame(rows, "g string, profile string, primary_candidate boolean, complexity int, validation_fold_mean_auprc double, validation_fold_se_auprc double")


def test_one_standard_error(spark):
    pick = selection.select_one_standard_error(candidates(spark, (0.30, 0.34, 0.35)), ["g"]).first()
    assert pick.selected_profile == "uncertainty_prior" and pick.selection_reason == "one_standard_error"
    gated = selection.select_one_standard_error(candidates(spark, (0.30, 0.303, 0.304)), ["g"], 0.005).first()
    assert gated.selected_profile == "uncertainty" and gated.selection_fallback
    none = selection.select_one_standard_error(candidates(spark, (None, None, None)), ["g"]).first()
    assert none.selected_profile == "uncertainty" and none.selection_reason == "no_finite_group_cv_candidate"
    few = candidates(spark, (0.30, 0.34, 0.35)).withColumn("validation_finite_folds", F.lit(1))
    assert selection.select_one_standard_error(few, ["g"], min_folds=2).first().selection_reason == "no_finite_group_cv_candidate"


def global_rows(spark, values):
    rows = [("M", "D", f"seed_{i}", p, c, v) for i, row in enumerate(values) for (p, c), v in row.items()]
    return spark.createDataFrame(rows, "model string, dataset string, test_run string, profile string, complexity int, validation_fold_mean_auprc double").withColumn("g", F.lit(1))


def test_global_selection(spark):
    u, p, e = ("uncertainty", 0), ("prior", 1), ("uncertainty_prior_support", 3)
    rows = [{u: a, p: 0.255, e: b} for a, b in ((0.20, 0.24), (0.21, 0.30), (0.19, 0.24), (0.20, 0.30))]
    assert selection.select_global(global_rows(spark, rows), ["g"]).first().selected_profile == "prior"
    got = selection.select_global(global_rows(spark, [{u: 0.300, p: 0.303}] * 4), ["g"]).first()
    assert got.selected_profile == "uncertainty" and got.selection_reason == "gain_below_minimum"
    assert got.source_cluster_n == 4


def test_action_curve_area(spark):
    rows = [{**POLICY, "review_fraction": r, "total_action_fraction": 0.1 + 0.9 * r,
             "combined_recall_of_candidate_errors": y, "uncertainty_combined_recall_of_candidate_errors": u}
            for r, y, u in ((0.05, 0.3, 0.2), (0.1, 0.5, 0.35), (0.2, 0.7, 0.55), (0.3, 0.8, 0.65))]
    df = spark.createDataFrame(rows)
    got = stats.action_curve_area(df, KEYS).collect()
    assert len(got) == 1 and got[0].delta_normalized_action_auc_vs_uncertainty > 0
    x = [0.1 + 0.9 * r for r in (0.05, 0.1, 0.2, 0.3)]
    y = [0.3, 0.5, 0.7, 0.8]
    want = sum((x[i + 1] - x[i]) * (y[i + 1] + y[i]) / 2 for i in range(3)) / (x[3] - x[0])
    assert got[0].selected_normalized_action_auc == pytest.approx(want)
    assert stats.action_curve_area(df.limit(1), KEYS).count() == 0


def paired(spark):
    cand, sel = [], []
    for review in (0.05, 0.10):
        base = {**POLICY, "review_fraction": review}
        sel.append({**base, "selected_profile": "prior", "error_detection_auprc": 0.40, "deduplicated_error_detection_auprc": 0.35})
        for split, method, score, fold, unique in (
            ("validation", "prior", 0.50, 0.48, None), ("validation", "fixed_hgb_upe", 0.45, 0.44, None),
            ("test", "fixed_hgb_upe", 0.60, None, 0.50)):
            cand.append({**base, "split": split, "method": method, "model_status": "complete", "error_detection_auprc": score,
                         "validation_fold_mean_auprc": fold, "deduplicated_error_detection_auprc": unique})
    return spark.createDataFrame(cand), spark.createDataFrame(sel)


def test_paired_policies(spark):
    cand, sel = paired(spark)
    runs = strengthening.paired_policy_runs(cand, sel)
    row = runs.first()
    assert runs.count() == 1
    assert (row.delta_validation_auprc, row.delta_test_auprc, row.delta_test_deduplicated_auprc) == pytest.approx((-0.05, 0.20, 0.15))
    cluster = strengthening.paired_clusters(runs).first()
    assert cluster.same_direction == 0.0 and cluster.both_positive == 0.0


def test_paired_policies_refuse_bad_tables(spark):
    cand, sel = paired(spark)
    with pytest.raises(quality.ShardError, match="duplicate keys"):
        strengthening.paired_policy_runs(cand.unionByName(cand.limit(1)), sel)
    bent = cand.withColumn("error_detection_auprc", F.when(
        (F.col("review_fraction") == 0.1) & (F.col("split") == "test"), 0.61).otherwise(F.col("error_detection_auprc")))
    with pytest.raises(quality.ShardError, match="review-fraction-dependent"):
        strengthening.paired_policy_runs(bent, sel)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rows = [("m%d" % (i % 3), "d%d" % (i % 2), f"s{i}", float(i % 7) / 7, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "model string, dataset string, test_run string, value double, measure string").withColumn("g", F.lit(1))
    a = stats.bootstrap_interval(df, ["g"], 300, 1).first()
    b = stats.bootstrap_interval(df.repartition(5), ["g"], 300, 1).first()
    mean = stats.summary_of_strata(df, ["g"]).first().mean
    assert tuple(a) == tuple(b) and a.ci_low < mean < a.ci_high


def test_checks_find_gaps(spark):
    grid = quality.grid(spark, model=["A", "B"], threshold=[0.8, 0.9])
    assert grid.count() == 4
    have = grid.where("not (model = 'A' and threshold = 0.9)").unionByName(quality.grid(spark, model=["C"], threshold=[0.8]))
    got = {(r.model, r.threshold, r.problem) for r in quality.coverage_gaps(grid, have, ["model", "threshold"]).collect()}
    assert got == {("A", "0.9", "missing"), ("C", "0.8", "unexpected")}
    with pytest.raises(quality.ShardError):
        quality.merge_shards([grid, grid], ["model", "threshold"])
    assert quality.table_difference(grid, grid).count() == 0
    check = {r.table: r.ok for r in quality.count_check({"a": (grid, 4), "b": (grid, 5)}).collect()}
    assert check == {"a": True, "b": False}
    bad = spark.createDataFrame([("p", "unavailable"), ("p", "complete")], "profile string, model_status string")
    assert quality.blocked_statuses(bad, "p").count() == 1
