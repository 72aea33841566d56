import itertools
import random

import pytest
from pyspark.sql import functions as F

from residuum.operators import policy, prefix, ranking

GRID = ["confidence_threshold", "uncertainty_reject_fraction"]


def test_policy_defers_the_highest_risk(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9, 0.95, 0.9), (2, 1.0, 0.9, 0.95, 0.2), (3, 1.0, 0.9, 0.95, 0.6)],
                               "row_id bigint, base_pred double, base_confidence double, p_base double, p_cal double")
    rows = policy.candidates(df, [0.8], [0.34])
    got = {r.row_id: r.state for r in policy.defer_riskiest(rows, GRID).collect()}
    assert got == {1: "residual", 2: "deferred", 3: "residual"}
    assert policy.candidates(df, [0.8], [0.0], source="calibrated").count() == 1
    with pytest.raises(ValueError):
        policy.candidates(df, [0.8], [0.1], source="other")


def test_deferral_is_exact_when_most_risks_are_equal(spark):
    random.seed(3)
    rows = [(k, random.choice([0.5, 0.5, 0.5, random.random()]), i, 0.3) for i, k in enumerate("a" * 700 + "b" * 55 + "c")]
    df = spark.createDataFrame(rows, "k string, risk double, row_id bigint, uncertainty_reject_fraction double")
    got = {r.row_id for r in policy.defer_riskiest(df, ["k"]).where("state = 'deferred'").collect()}
    want = set()
    for k in "abc":
        part = sorted((-r[1], r[2]) for r in rows if r[0] == k)
        want |= {i for _, i in part[: round(len(part) * 0.3)]}
    assert got == want


def test_fallbacks_are_decided_per_table(spark):
    df = spark.createDataFrame([("a", None, None, 0.9), ("a", None, None, None), ("b", 0.0, None, 0.9), ("b", None, 0.4, 0.9)],
                               "t string, base_pred double, base_confidence double, p_base double")
    got = {(r.t, r.base_pred, r.base_confidence) for r in policy.table_fallbacks(df, ["t"]).collect()}
    assert ("a", 1.0, pytest.approx(0.8)) in [tuple(g) for g in got]
    assert ("b", None, 0.4) in got and ("b", 0.0, None) in got


def test_calibration_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "base_wrong double, risk double")
    row = policy.calibration_metrics(df.withColumn("k", F.lit(1)), ["k"], "risk", 2).first()
    assert (row.calibration_n, row.brier_error_risk, row.ece_error_risk) == (4, 0.0, 0.0)


def quality(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(1 for s, y in rows if s >= t and y), sum(1 for s, _ in rows if s >= t)
        ap, before = ap + (tp - before) / len(pos) * tp / n, tp
    return auroc, ap


def test_auc_is_exact_and_unchanged_by_monotone_maps(spark):
    random.seed(5)
    rows = [(random.choice([0.1, 0.5, random.gauss(0, 1)]), float(random.random() < 0.3)) for _ in range(400)]
    want = quality(rows)
    df = spark.createDataFrame(rows, "s double, y double").withColumn("k", F.lit("a"))
    for score in ("s", "exp(s)", "s * 3 - 7"):
        got = ranking.auc_metrics(df.withColumn("v", F.expr(score)).repartition(7), ["k"], "v", "y").first()
        assert (got.auroc, got.auprc) == pytest.approx(want, abs=1e-12)


def test_expected_top_k_lies_between_all_tie_orders(spark):
    rows = [(0.9, 1.0), (0.5, 1.0), (0.5, 0.0), (0.5, 0.0), (0.1, 1.0)]
    df = spark.createDataFrame(rows, "s double, y double").withColumn("k", F.lit("a"))
    for fraction in (0.2, 0.4, 0.6, 0.8):
        got = ranking.expected_top_k(df, ["k"], "s", "y", fraction).first()
        totals = [
            sum(y for _, y in sorted(order, key=lambda r: -r[0])[: got.reviewed_n]) for order in itertools.permutations(rows)
        ]
        assert min(totals) <= got.review_error_count <= max(totals)
        assert got.review_error_count == pytest.approx(sum(totals) / len(totals))


def test_evaluation_reports_every_group(spark):
    rows = [("a", "residual", 0.3, 1.0)] * 2 + [("b", "deferred", 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k string, state string, score double, base_wrong double")
    got = {r.k: r for r in ranking.evaluate_ranking(df, ["k"], [0.2], 20).collect()}
    assert got["a"].universe_n == 2 and got["a"].reviewed_n == 0 and got["a"].error_detection_auprc is None
    assert got["b"].universe_n == 0 and got["b"].universe_error_rate is None


def test_fractional_labels_have_no_auc(spark):
    df = spark.createDataFrame([("residual", 0.3, 0.5), ("residual", 0.4, 1.0), ("residual", 0.1, 0.0)], "state string, score double, base_wrong double")
    got = ranking.evaluate_ranking(df.withColumn("k", F.lit(1)), ["k"], [0.5], 2).first()
    assert got.error_detection_auroc is None and got.review_error_count is not None


def test_cells_keep_the_order(spark):
    values = sorted([0.0, 1e-300, 1e-9, 0.1, 0.5, 0.9999999, 1.0, 2.0, 3.7, 1e17, -1e-9, -0.5, -40.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = [r.c for r in df.select("v", prefix.magnitude_cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cells == sorted(cells)


def test_numbering_matches_a_plain_sort(spark):
    random.seed(9)
    rows = [(random.choice("ab"), random.choice([0.2, random.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i bigint").withColumn("c", prefix.magnitude_cell(F.col("v")))
    got = prefix.number_rows(df, ["k"], ["c"], [F.col("v"), F.col("i")]).collect()
    for k in "ab":
        order = [i for _, i in sorted((v, i) for kk, v, i in rows if kk == k)]
        assert [r.i for r in sorted((r for r in got if r.k == k), key=lambda r: r.position)] == order
