"""Pair-level view of test rows: validation overlap out, duplicates collapsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions.columns import canonical_id


def with_pair_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"pair_a": canonical_id("dr_id"), "pair_b": canonical_id("pr_id")})


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the first when ``order`` goes down, then ``columns`` for ties.

    A maximum with map-side merging, so a hot key is not sorted in one task.
    """
    names = [*order, *columns]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in names])


def drop_overlap(test: DataFrame, validation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows whose pair never occurs in validation."""
    seen = with_pair_key(validation).select(*keys, "pair_a", "pair_b").distinct()
    return with_pair_key(test).join(seen, [*keys, "pair_a", "pair_b"], "left_anti")


def collapse_pairs(rows: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """One row per pair: mean label, deferral wins over residual, mean residual score.

    ``state`` may be null for rows outside the candidate set.
    """
    keys = [*keys, "pair_a", "pair_b"]
    residual = F.col("state") == "residual"
    flags = rows.groupBy(*keys).agg(
        F.avg("base_wrong").alias("base_wrong"),
        F.coalesce(F.min("base_wrong") != F.max("base_wrong"), F.lit(False)).alias("label_conflict"),
        F.coalesce(F.bool_or(F.col("state") == "deferred"), F.lit(False)).alias("_deferred"),
        F.coalesce(F.bool_or(residual), F.lit(False)).alias("_residual"),
        F.avg(F.when(residual, F.col(score))).alias(score),
        F.count(F.lit(1)).alias("pair_rows"),
    )
    return flags.select(
        *keys,
        "base_wrong",
        score,
        "pair_rows",
        "label_conflict",
        (F.col("_deferred") & F.col("_residual")).alias("mixed_state"),
        F.when(F.col("_deferred"), "deferred").when(F.col("_residual"), "residual").alias("state"),
    )


def dedup_diagnostics(
    test: DataFrame, validation: DataFrame, run_keys: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Nine counts about overlap, duplicates and conflicts per group.

    ``test`` rows carry the group ``keys`` (run keys included) and ``state``;
    ``validation`` rows only the run keys.
    """
    run_keys, keys = list(run_keys), list(keys)
    seen = (
        with_pair_key(validation).select(*run_keys, "pair_a", "pair_b").distinct().withColumn("_seen", F.lit(True))
    )
    sizes = seen.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("validation_unique_pairs"))
    pairs = collapse_pairs(with_pair_key(test), keys, "score").join(
        seen, [*run_keys, "pair_a", "pair_b"], "left"
    )
    overlap = F.coalesce(F.col("_seen"), F.lit(False))
    rows = lambda c: F.sum(F.when(c, F.col("pair_rows")).otherwise(0))
    out = pairs.groupBy(*keys).agg(
        F.sum("pair_rows").alias("test_rows_before"),
        rows(overlap).alias("cross_split_overlap_rows_removed"),
        F.count_if(overlap).alias("cross_split_overlap_pairs_removed"),
        rows(~overlap).alias("eligible_test_rows"),
        F.count_if(~overlap).alias("eligible_unique_pairs"),
        (rows(~overlap) - F.count_if(~overlap)).alias("within_test_duplicate_rows_collapsed"),
        F.count_if(~overlap & F.col("label_conflict")).alias("pair_label_conflicts"),
        F.count_if(~overlap & F.col("mixed_state")).alias("mixed_policy_state_pairs"),
    )
    return out.join(sizes, run_keys, "left").withColumn(
        "validation_unique_pairs", F.coalesce("validation_unique_pairs", F.lit(0).cast("bigint"))
    )
