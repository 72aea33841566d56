"""Conservative choice of a profile, comparisons between profiles, transfer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Declared comparisons (baseline, augmented, component).
CORE_COMPARISONS = (
    ("uncertainty", "uncertainty_prior", "prior"),
    ("uncertainty", "uncertainty_support", "empirical_support"),
    ("uncertainty_prior", "uncertainty_prior_support", "empirical_support_after_prior"),
    ("uncertainty_support", "uncertainty_prior_support", "prior_after_empirical_support"),
    ("fit_support", "legacy_support", "legacy_source_domain_support_after_fit"),
    ("source_domain_support", "legacy_support", "fit_support_after_legacy_source_domain"),
    ("fit_support", "uncertainty_support", "native_source_domain_support_after_fit"),
    ("native_source_domain_support", "uncertainty_support", "fit_support_after_native_source_domain"),
    ("legacy_support", "combined_support", "native_support_after_legacy"),
    ("uncertainty_support", "combined_support", "legacy_support_after_native"),
)
DIAGNOSTIC_COMPARISONS = (
    ("uncertainty", "fit_support", "fit_support"),
    ("uncertainty", "source_domain_support", "source_domain_support"),
    ("uncertainty", "native_source_domain_support", "native_source_domain_support"),
    ("uncertainty_support", "target_sequence_support", "target_sequence_support"),
    ("uncertainty_support", "general_target_joint_support", "general_target_joint_support"),
    ("uncertainty", "legacy_support", "legacy_empirical_support"),
    ("uncertainty", "combined_support", "combined_empirical_support"),
)


def comparison_table(spark: SparkSession, comparisons: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = list(comparisons if comparisons is not None else CORE_COMPARISONS + DIAGNOSTIC_COMPARISONS)
    return spark.createDataFrame(rows, "baseline_profile string, augmented_profile string, added_component string")


def select_one_standard_error(
    candidates: DataFrame,
    keys: Sequence[str],
    min_gain: float = 0.0,
    fallback: str = "uncertainty",
    min_folds: int | None = None,
    mean: str = "validation_fold_mean_auprc",
    se: str = "validation_fold_se_auprc",
) -> DataFrame:
    """Simplest profile within one standard error of the best, per group.

    Rows are a handful of profiles per group. ``min_folds`` asks for that many
    finite folds (column ``validation_finite_folds``).
    """
    keys = list(keys)
    pool = candidates.where("primary_candidate")
    ready = F.col(mean).isNotNull()
    if min_folds is not None:
        ready = ready & (F.coalesce("validation_finite_folds", F.lit(0)) >= min_folds)
    pool = pool.withColumn("_ok", ready)
    group = Window.partitionBy(*keys)
    best_order = group.orderBy(
        F.col("_ok").desc(), F.col(mean).desc(), F.col("complexity").asc(), F.col("profile").asc()
    )
    ranked = pool.withColumns(
        {
            "_best": F.first("profile").over(best_order),
            "_best_mean": F.first(mean).over(best_order),
            "_best_se": F.coalesce(F.first(se).over(best_order), F.lit(0.0)),
            "_any": F.max("_ok").over(group),
            "_base": F.max(F.when(F.col("profile") == fallback, F.col(mean))).over(group),
            "_has_base": F.max((F.col("profile") == fallback)).over(group),
        }
    )
    ranked = ranked.withColumn("_limit", F.col("_best_mean") - F.col("_best_se"))
    eligible = F.col("_ok") & (F.col(mean) >= F.col("_limit"))
    choice_order = group.orderBy(
        eligible.desc(),
        F.when(F.col("_any"), F.col("complexity")).asc(),
        F.when(F.col("_any"), F.col(mean)).desc(),
        F.when(F.col("_any"), F.lit(0)).otherwise((F.col("profile") != fallback).cast("int")).asc(),
        F.col("profile").asc(),
    )
    chosen = ranked.withColumn("_r", F.row_number().over(choice_order)).where("_r = 1")
    gain = F.when(F.col("_any"), F.col(mean) - F.col("_base"))
    low = F.coalesce(
        F.col("_any") & (F.col("profile") != fallback) & (gain < float(min_gain)) & F.col("_has_base"), F.lit(False)
    )
    selected = F.when(low, F.lit(fallback)).otherwise(F.col("profile"))
    reason = (
        F.when(~F.col("_any"), "no_finite_group_cv_candidate")
        .when(low, "gain_below_minimum")
        .when(F.col("profile") == fallback, "uncertainty_selected")
        .otherwise("one_standard_error")
    )
    return chosen.select(
        *keys,
        selected.alias("selected_profile"),
        (~F.col("_any") | low | (F.col("profile") == fallback)).alias("selection_fallback"),
        reason.alias("selection_reason"),
        F.when(F.col("_any"), F.col("_best")).alias("best_profile"),
        F.when(F.col("_any"), F.col("_best_mean")).alias("best_mean"),
        F.when(F.col("_any"), F.col("_limit")).alias("one_se_threshold"),
        gain.alias("validation_gain_vs_uncertainty"),
    )


def pooled_profiles(clusters: DataFrame, keys: Sequence[str], value: str = "validation_fold_mean_auprc") -> DataFrame:
    """Mean, deviation, count and standard error of each profile over source clusters."""
    n = F.count(value)
    return clusters.groupBy(*keys, "profile", "complexity").agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        n.alias("count"),
        (F.stddev_samp(value) / F.sqrt(F.greatest(n, F.lit(1)))).alias("se"),
    )


def select_global(
    clusters: DataFrame, keys: Sequence[str], min_gain: float = 0.005, value: str = "validation_fold_mean_auprc"
) -> DataFrame:
    """One profile per group of source domains by the same rule on pooled means."""
    keys = list(keys)
    stats = pooled_profiles(clusters, keys, value).withColumn("primary_candidate", F.lit(True))
    pick = select_one_standard_error(stats, keys, min_gain, mean="mean", se="se")
    reason = F.when(F.col("selection_reason") == "one_standard_error", "global_one_standard_error").when(
        F.col("selection_reason") == "no_finite_group_cv_candidate", "no_finite_source_validation"
    ).otherwise(F.col("selection_reason"))
    sizes = clusters.groupBy(*keys).agg(F.count_distinct("model", "dataset", "test_run").alias("source_cluster_n"))
    base = stats.where("profile = 'uncertainty'").select(*keys, F.col("mean").alias("uncertainty_source_mean"))
    return (
        pick.withColumn("selection_reason", reason)
        .withColumnRenamed("validation_gain_vs_uncertainty", "selected_gain_vs_uncertainty")
        .join(base, keys, "left")
        .join(sizes, keys, "left")
    )


def component_increments(
    candidates: DataFrame, comparisons: DataFrame, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Metrics of both profiles of every declared comparison and their difference."""
    keys = list(keys)

    def side(prefix: str) -> DataFrame:
        status = [F.col("model_status").alias(f"{prefix}_model_status")] if "model_status" in candidates.columns else []
        return candidates.select(
            *keys, F.col("profile").alias(f"{prefix}_profile"), *status,
            *[F.col(m).alias(f"{prefix}_{m}") for m in metrics],
        )

    baseline = side("baseline").join(F.broadcast(comparisons), "baseline_profile")
    both = baseline.join(side("augmented"), [*keys, "augmented_profile"])
    return both.withColumns({f"delta_{m}": F.col(f"augmented_{m}") - F.col(f"baseline_{m}") for m in metrics})


def selected_vs_uncertainty(
    candidates: DataFrame, selection: DataFrame, keys: Sequence[str], metrics: Sequence[str], fallback: str = "uncertainty"
) -> DataFrame:
    """Test metrics of the selected profile, those of uncertainty, and their difference."""
    keys = list(keys)
    own = candidates.join(
        selection.withColumnRenamed("selected_profile", "profile"), [*keys, "profile"]
    ).withColumnRenamed("profile", "selected_profile")
    base = candidates.where(F.col("profile") == fallback).select(
        *keys, *[F.col(m).alias(f"uncertainty_{m}") for m in metrics]
    )
    out = own.join(base, keys)
    return out.withColumns({f"delta_{m}_vs_uncertainty": F.col(m) - F.col(f"uncertainty_{m}") for m in metrics})


def methods_vs_selected(
    candidates: DataFrame,
    selected: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str],
    metrics: Sequence[str],
    prefix: str = "selected",
) -> DataFrame:
    """Baseline methods minus the selected profile on the same policy and budget."""
    chosen = selected.select(*keys, *[F.col(m).alias(f"{prefix}_{m}") for m in metrics])
    rows = candidates.where(F.col("method").isin(*methods)).join(chosen, list(keys), "left")
    return rows.withColumns({f"delta_{m}_vs_{prefix}": F.col(m) - F.col(f"{prefix}_{m}") for m in metrics})


def held_out_domains(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Repeat rows for every domain left out of them.

    ``kinds`` maps a transfer name to its domain column; the domains are few.
    """
    out = None
    for name, column in kinds.items():
        domains = rows.select(F.col(column).alias("held_out_domain")).distinct()
        part = rows.join(F.broadcast(domains), F.col(column) != F.col("held_out_domain")).withColumn(
            "transfer_type", F.lit(name)
        )
        out = part if out is None else out.unionByName(part)
    return out
