"""Summaries over runs: cluster means, strata, directions, curves, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions.columns import hex_draw

STRATUM = ["model", "dataset"]


def fold_mean_se(folds: DataFrame, keys: Sequence[str], value: str = "auprc") -> DataFrame:
    """Mean of finite folds and its standard error (zero for one fold).

    Both are cut to twelve digits, so equal profiles stay equal whatever order
    their folds were added in.
    """
    n = F.count(value)
    error = F.when(n == 1, 0.0).otherwise(F.stddev_samp(value) / F.sqrt(n))
    return folds.groupBy(*keys).agg(
        F.round(F.avg(value), 12).alias("validation_fold_mean_auprc"),
        F.round(error, 12).alias("validation_fold_se_auprc"),
        n.cast("int").alias("validation_finite_folds"),
    )


def cluster_means(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def long_measures(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per measure with a finite value."""
    return rows.unpivot(list(keys), list(values), "measure", "value").where("value is not null")


def summary_of_strata(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of stratum means; counts and win rate over runs."""
    keys = [*keys, "measure"]
    strata = long.groupBy(*keys, *STRATUM).agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("w")
    )
    return strata.groupBy(*keys).agg(
        F.sum("n").alias("num_independent_runs"),
        F.count(F.lit(1)).alias("num_model_dataset_strata"),
        F.avg("m").alias("mean"),
        (F.sum("w") / F.sum("n")).alias("run_win_rate"),
    )


def summary_of_runs(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over runs; share of positive runs."""
    return long.groupBy(*keys, "measure").agg(
        F.avg("value").alias("mean"),
        F.count(F.lit(1)).alias("independent_runs"),
        (F.count_if(F.col("value") > 0) / F.count(F.lit(1))).alias("positive_fraction"),
    )


def strata_table(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, *STRATUM, "measure").agg(
        F.count(F.lit(1)).alias("num_independent_runs"),
        F.avg("value").alias("mean"),
        (F.count_if(F.col("value") > 0) / F.count(F.lit(1))).alias("run_win_rate"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def leave_one_out(rows: DataFrame, column: str) -> DataFrame:
    """Rows repeated once per value of ``column`` that is left out (``excluded``)."""
    values = rows.select(F.col(column).alias("excluded")).distinct()
    return rows.join(F.broadcast(values), F.col(column) != F.col("excluded"))


def heterogeneity(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means by each axis in turn, stacked: one aggregate over grouping sets. Rows without a value on an axis are its null stratum."""
    keys, axes = list(keys), list(axes)
    sets = [[*keys, a] for a in axes]
    level = rows.groupingSets(sets, *keys, *axes).agg(
        *[F.avg(v).alias(v) for v in values], *[F.grouping(a).alias(f"_off_{a}") for a in axes])
    axis = F.coalesce(*[F.when(F.col(f"_off_{a}") == 0, F.lit(a)) for a in axes])
    stratum = F.coalesce(*[F.when(F.col(f"_off_{a}") == 0, F.col(a).cast("string")) for a in axes])
    return level.select(*keys, axis.alias("heterogeneity_axis"), stratum.alias("stratum"), *values)


def direction_columns(validation: Column, test: Column) -> dict[str, Column]:
    """Do two deltas agree in sign, and are both positive? Null when one is missing."""
    paired = validation.isNotNull() & test.isNotNull()
    return {
        "same_direction": F.when(paired, F.signum(validation) == F.signum(test)),
        "both_positive": F.when(paired, (validation > 0) & (test > 0)),
    }


def split_pair(clusters: DataFrame, keys: Sequence[str], validation: str, test: str) -> DataFrame:
    """Validation and test deltas side by side, kept where only one exists."""
    side = lambda split, value, out: clusters.where(F.col("split") == split).select(*keys, F.col(value).alias(out))
    both = side("validation", validation, "validation_delta").join(
        side("test", test, "test_delta"), list(keys), "full_outer"
    )
    return both.withColumns(direction_columns(F.col("validation_delta"), F.col("test_delta")))


def direction_summary(directions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return directions.groupBy(*keys).agg(
        F.count("same_direction").alias("num_independent_runs"),
        F.avg(F.col("same_direction").cast("double")).alias("same_direction_rate"),
        F.avg(F.col("both_positive").cast("double")).alias("both_positive_rate"),
    )


def budget_invariant(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Groups whose metrics change with the review fraction (there must be none)."""
    changed = F.lit(False)
    for m in metrics:
        varies = (F.min(m) != F.max(m)) | ((F.count(m) > 0) & (F.count(m) < F.count(F.lit(1))))
        changed = changed | F.coalesce(varies, F.lit(False))
    return rows.groupBy(*keys).agg(changed.alias("changed")).where("changed").drop("changed")


def smallest_budget(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("review_fraction").alias("review_fraction"),
        *[F.min_by(m, "review_fraction").alias(m) for m in metrics],
    )


def action_columns(rows: DataFrame) -> DataFrame:
    """Deferred plus reviewed rows, also as a share of the candidates."""
    total = F.col("deferred_n") + F.col("reviewed_n")
    return rows.withColumns(
        {"total_action_n": total, "total_action_fraction": F.try_divide(total, F.col("candidate_n"))}
    )


def action_curve_area(
    rows: DataFrame, keys: Sequence[str], x: str = "total_action_fraction",
    own: str = "combined_recall_of_candidate_errors", base: str = "uncertainty_combined_recall_of_candidate_errors",
) -> DataFrame:
    """Trapezoid area over the action share divided by its span; one short curve per group."""
    valid = rows.where(F.col(x).isNotNull() & F.col(own).isNotNull() & F.col(base).isNotNull())
    at = Window.partitionBy(*keys).orderBy(x, "review_fraction")
    before = lambda c: F.lag(c).over(at)
    steps = valid.withColumns({"_dx": F.col(x) - before(x), "_y": F.col(own) + before(own), "_u": F.col(base) + before(base)})
    span = F.max(x) - F.min(x)
    area = lambda c: F.sum(F.col("_dx") * F.col(c)) / 2.0
    out = steps.groupBy(*keys).agg(
        span.alias("_span"), area("_y").alias("_own"), area("_u").alias("_base"), F.count(F.lit(1)).alias("_n")
    )
    return out.where("_n >= 2 and _span > 0").select(
        *keys,
        (F.col("_own") / F.col("_span")).alias("selected_normalized_action_auc"),
        (F.col("_base") / F.col("_span")).alias("uncertainty_normalized_action_auc"),
        ((F.col("_own") - F.col("_base")) / F.col("_span")).alias("delta_normalized_action_auc_vs_uncertainty"),
    )


def bootstrap_interval(long: DataFrame, keys: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """Two-level stratified bootstrap interval of each (keys, measure).

    Strata are redrawn with replacement, then rows inside each drawn stratum;
    every draw is a hash of its place, so results do not depend on partitioning.
    Input is one row per run; work is resamples x runs, spread by resample.
    """
    keys = [*keys, "measure"]
    order = Window.partitionBy(*keys, *STRATUM).orderBy("value", "test_run")
    rows = long.withColumn("_i", F.row_number().over(order) - 1)
    strata = rows.groupBy(*keys, *STRATUM).agg(F.count(F.lit(1)).alias("_size"))
    numbered = strata.withColumn("_s", F.row_number().over(Window.partitionBy(*keys).orderBy(*STRATUM)) - 1)
    groups = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_strata"))
    rows = rows.join(numbered, [*keys, *STRATUM]).select(*keys, "_s", "_i", "value")
    draws = groups.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(int(resamples) - 1))))
    draws = draws.withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col("_strata") - 1).cast("int"))))
    draws = draws.withColumn("_s", F.pmod(hex_draw(seed, F.col("_b"), F.col("_slot")), F.col("_strata")).cast("int"))
    draws = draws.join(numbered.select(*keys, "_s", "_size"), [*keys, "_s"])
    draws = draws.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_size") - 1).cast("int"))))
    draws = draws.withColumn(
        "_i", F.pmod(hex_draw(seed, F.col("_b"), F.col("_slot"), F.col("_j")), F.col("_size")).cast("int")
    )
    means = draws.join(rows, [*keys, "_s", "_i"]).groupBy(*keys, "_b", "_slot").agg(F.avg("value").alias("m"))
    values = means.groupBy(*keys, "_b").agg(F.avg("m").alias("m"))
    return values.groupBy(*keys).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high")
    )


def ablation_matrix(summary: DataFrame, value: str = "error_detection_auprc") -> DataFrame:
    """Profiles as rows, (axis, split) as columns: mean value and change against uncertainty."""
    cells = [(a, s) for a in ("drug", "target") for s in ("validation", "test")]
    at = lambda a, s: (F.col("group_axis") == a) & (F.col("split") == s)
    wide = summary.groupBy("profile").agg(*[F.avg(F.when(at(a, s), F.col(value))).alias(f"{a}_{s}") for a, s in cells])
    wide = wide.withColumn("_all", F.lit(1))
    base = wide.where("profile = 'uncertainty'").select("_all", *[F.col(f"{a}_{s}").alias(f"_{a}_{s}") for a, s in cells])
    out = wide.join(base, "_all")
    return out.select(
        "profile", *[f"{a}_{s}" for a, s in cells],
        *[(F.col(f"{a}_{s}") - F.col(f"_{a}_{s}")).alias(f"{a}_{s}_delta") for a, s in cells],
    )


def residual_space(coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means and quartiles of candidates, residuals and errors per group of policies."""
    prevalence = F.try_divide(F.col("residual_error_count"), F.col("residual_n"))
    rows = coverage.withColumn("_p", prevalence)
    mid = lambda c, q: F.percentile(c, F.lit(q))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("policy_rows"),
        F.avg("candidate_n").alias("mean_high_conf_positive"),
        mid("candidate_n", 0.5).alias("median_high_conf_positive"),
        F.avg("residual_n").alias("mean_residual_candidates"),
        mid("residual_n", 0.5).alias("median_residual_candidates"),
        F.avg("residual_error_count").alias("mean_residual_errors"),
        mid("residual_error_count", 0.5).alias("median_residual_errors"),
        mid("residual_error_count", 0.25).alias("p25_residual_errors"),
        mid("residual_error_count", 0.75).alias("p75_residual_errors"),
        F.avg("_p").alias("mean_residual_error_prevalence"),
        mid("_p", 0.5).alias("median_residual_error_prevalence"),
    )


def residual_space_ratios(space: DataFrame, focus: str) -> DataFrame:
    """One dataset against every other: ratios of means, difference of prevalence."""
    own = space.where(F.col("dataset") == focus)
    own = own.select(*[F.col(c).alias(f"f_{c}") for c in own.columns])
    ratio = lambda c: F.try_divide(F.col(f"f_{c}"), F.col(c))
    others = space.where(F.col("dataset") != focus).join(F.broadcast(own), F.col("dataset") != F.col("f_dataset"))
    return others.select(
        F.concat_ws("_vs_", F.col("f_dataset"), F.col("dataset")).alias("comparison"),
        ratio("mean_high_conf_positive").alias("high_conf_positive_ratio"),
        ratio("mean_residual_candidates").alias("residual_candidates_ratio"),
        ratio("mean_residual_errors").alias("residual_errors_ratio"),
        (F.col("f_mean_residual_error_prevalence") - F.col("mean_residual_error_prevalence")).alias(
            "residual_error_prevalence_difference"
        ),
    )
