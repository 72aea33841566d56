import random

from pyspark.sql import functions as F

from checks.fixture import Tables
from checks.runs_and_summaries import runs
from residuum.operators import packed, policy, ranking

GRID = ["k", "confidence_threshold", "uncertainty_reject_fraction"]


def table(spark, n=600):
    draw = random.Random(3)
    rows = [(i, draw.choice("ab"), float(draw.random() < 0.4), draw.choice([None, float("nan"), -2.5, 0.0, round(draw.gauss(0, 2), 1), draw.gauss(0, 2)]),
             draw.choice([None, 0]), draw.choice([None, 0, 1, 2])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, k string, base_wrong double, s double, one int, fold int")


def test_packed_sums_equal_one_table_at_a_time(spark):
    df = table(spark)
    scores = {"up": F.col("s"), "down": -F.col("s"), "same": F.lit(1.0)}
    # small arrow batches: cells and equal scores run over their ends
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = packed.packed_ranking(df, ["k"], scores, {"one": 1, "fold": 3}, "base_wrong", [0.1, 0.3])
        got = {(r.k, r.profile, r.member, r.part): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2 * 3 * 4
    for (name, column) in scores.items():
        for member, part in [("one", 0), ("fold", 0), ("fold", 1), ("fold", 2)]:
            rows = df.where(F.col(member) == part).withColumn("score", column)
            for r in ranking.auc_metrics(rows, ["k"], "score", "base_wrong").collect():
                mine = got[(r.k, name, member, part)]
                assert (mine.total_n, mine.total_pos) == (r.n, r.positives)
                assert abs(mine.auroc - r.auroc) < 1e-12 and abs(mine.auprc - r.auprc) < 1e-12
            for i, f in enumerate((0.1, 0.3)):
                for r in ranking.expected_top_k(rows, ["k"], "score", "base_wrong", f).collect():
                    hit = got[(r.k, name, member, part)].hits[i]
                    assert hit._size == r.reviewed_n and abs(hit._hits - r.review_error_count) < 1e-9


def test_states_in_columns_equal_states_in_rows(spark):
    df = table(spark).select("row_id", "k", "base_wrong", (F.abs(F.round(F.sin("row_id"), 1))).alias("base_confidence"),
                             F.lit(1.0).alias("base_pred"), F.round(F.abs(F.cos("row_id")), 1).alias("p_cal"))
    policies = [(0.2, 0.1), (0.2, 0.35), (0.6, 0.1), (0.6, 0.35)]
    wide = policy.policy_states(df, ["k"], policies).collect()
    long = policy.defer_riskiest(policy.candidates(df, [0.2, 0.6], [0.1, 0.35]), GRID).collect()
    got = {(r.row_id, *p): ["residual", "deferred"][r[f"state_{i}"]] for r in wide for i, p in enumerate(policies) if r[f"state_{i}"] is not None}
    assert got == {(r.row_id, r.confidence_threshold, r.uncertainty_reject_fraction): r.state for r in long}


def test_run_rows_are_stored_once_each(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert runs(t).count() <= t.base().count()


def test_deferral_moves_no_rows(spark):
    """Cut rows come to the rows: beside counts per cell nothing is exchanged."""
    df = table(spark).select("k", "row_id", F.abs("s").alias("risk"), F.lit(0.2).alias("uncertainty_reject_fraction"))
    plan = policy.defer_riskiest(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("broadcast" in line for line in joins)
