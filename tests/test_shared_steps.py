"""Steps that many registered queries share: dealing of files, states of one policy, rows with their state."""

import pytest
from pyspark.sql import functions as F

from checks import ranking_and_policy, support_and_joins
from checks.fixture import Tables


@pytest.fixture
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_by_key_and_not_in_turns(tables):
    for name in ("lineitem", "documents"):
        assert "RoundRobin" not in plan(tables.spread(name))
        assert tables.spread(name).count() == tables.raw(name).count()


def test_derived_columns_are_not_written(tables):
    tables.base()
    stored = tables.stored("predictions", tables.predictions)
    assert "p_base" not in stored.columns and {"p_base", "base_wrong", "base_prior_conflict"} <= set(tables.base().columns)


def test_one_policy_has_its_rows_of_all_policies(tables):
    one = ranking_and_policy.first_states(tables)
    of_all = ranking_and_policy.states(tables).where("confidence_threshold = 0.8 and uncertainty_reject_fraction = 0.1")
    assert one.exceptAll(of_all.select(one.columns)).isEmpty() and one.count() == of_all.count()


def test_rows_get_their_state_without_a_join(tables):
    rows = support_and_joins._pair_rows(tables)
    assert "Join" not in plan(rows)
    assert rows.count() == tables.base().count() == rows.select("row_id").distinct().count()
    marks = ranking_and_policy.first_states(tables).select("row_id", F.col("state").alias("mark"))
    assert rows.join(marks, "row_id", "left").where(~F.col("state").eqNullSafe(F.col("mark"))).isEmpty()
