"""Runs are computed once, verified and published whole; a killed call loses only what it had not published."""

import pytest
from pyspark.sql import functions as F

from residuum.plans import publish

RUN = ["model", "run"]


def test_a_killed_call_is_resumed(spark, tmp_path):
    path = str(tmp_path / "table")
    wanted = spark.createDataFrame([(m, r) for m in "ab" for r in (1, 2)], "model string, run int")
    asked = []

    def compute(fail):
        def run(runs):
            asked.append({tuple(r) for r in runs.collect()})
            rows = runs.withColumn("profile", F.explode(F.array(F.lit("p"), F.lit("q")))).withColumn("v", F.col("run") / 3.0)
            return rows.withColumn("v", F.when(fail(F.col("model"), F.col("run")), F.raise_error(F.lit("killed"))).otherwise(F.col("v")))

        return run

    keys = [*RUN, "profile"]
    expected = wanted.withColumn("profile", F.explode(F.array(F.lit("p"), F.lit("q"))))
    checks = [publish.rows_are_unique(RUN, keys), publish.rows_are_complete(RUN, keys, expected)]
    good, problems = publish.publish(wanted.where("model = 'a'"), compute(lambda m, r: F.lit(False)), path, RUN, checks)
    assert good.count() == 2 and problems.count() == 0
    with pytest.raises(Exception, match="killed"):
        publish.publish(wanted, compute(lambda m, r: r == 2), path, RUN, checks)
    assert publish.stored_runs(spark, path).count() == 4  # nothing of the killed call
    good, _ = publish.publish(wanted, compute(lambda m, r: F.lit(False)), path, RUN, checks)
    assert sorted(tuple(r) for r in good.collect()) == [("b", 1), ("b", 2)]
    assert asked[1:] == [{("b", 1), ("b", 2)}] * 2  # the runs of a are not computed again
    assert publish.stored_runs(spark, path).count() == 8
    assert publish.publish(wanted, compute(lambda m, r: F.lit(False)), path, RUN, checks)[0].count() == 0


def test_only_whole_runs_are_published(spark, tmp_path):
    path = str(tmp_path / "table")
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "model string, run int")
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 2, "p"), ("b", 1, "p"), ("b", 1, "p"), ("b", 1, "q")]
    keys = [*RUN, "profile"]
    expected = wanted.withColumn("profile", F.explode(F.array(F.lit("p"), F.lit("q"))))
    good, problems = publish.publish(
        wanted, lambda runs: spark.createDataFrame(rows, "model string, run int, profile string"), path, RUN,
        [publish.rows_are_unique(RUN, keys), publish.rows_are_complete(RUN, keys, expected)])
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert {(r.model, r.run) for r in problems.collect()} == {("a", 2), ("b", 1), ("b", 2)}
    assert publish.stored_runs(spark, path).count() == 2
