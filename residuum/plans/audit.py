"""The formal residual audit: all runs, axes, policies and profiles in shared plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.columns import canonical_id, error_risk, finite, or_null
from residuum.operators import dedup, policy, profiles, ranking, selection, stats, support
from residuum.operators.calibration import cross_fitted_calibration, held_out_calibration
from residuum.operators.folds import assign_folds, by_axes
from residuum.operators.logistic import LOCAL_ROWS
from residuum.storage import cut

RUN_KEYS = policy.RUN_KEYS
KEYS = [*RUN_KEYS, "group_axis", "confidence_source", *policy.GRID_KEYS]
POLICY_KEYS = [*KEYS, "review_fraction"]
SELECTED_MEASURES = [
    "delta_error_detection_auprc_vs_uncertainty",
    "delta_review_error_rate_vs_uncertainty",
    "delta_retained_accuracy_gain_vs_residual_vs_uncertainty",
]
INCREMENT_MEASURES = [
    "delta_validation_fold_mean_auprc",
    "delta_error_detection_auprc",
    "delta_review_lift",
    "delta_retained_accuracy_gain_vs_residual",
]


@dataclass(frozen=True)
class AuditSettings:
    """Grid and protocol of an audit."""

    thresholds: Sequence[float] = (0.8, 0.9)
    reject_fractions: Sequence[float] = (0.1, 0.2)
    axes: Sequence[str] = ("target",)
    review_fractions: Sequence[float] = (0.2,)
    confidence_source: str = "base"
    folds: int = 3
    seed: int = 2026
    strict_groups: bool = True
    min_fit_n: int = profiles.MIN_FIT_N
    min_feature_n: int = profiles.MIN_FEATURE_N
    min_universe_n: int = 20
    min_validation_gain: float = 0.005
    ranking_weight: float = profiles.RANKING_WEIGHT
    max_pairs: int = profiles.MAX_PAIRS
    resamples: int = 20_000
    bootstrap_seed: int = 2026
    dedup_dataset: str | None = None
    profiles: Sequence[profiles.Profile] = field(default=profiles.ALL_PROFILES)
    local_rows: int = LOCAL_ROWS


def calibrated_states(predictions: DataFrame, s: AuditSettings) -> tuple[DataFrame, DataFrame]:
    """Calibrated rows of both splits per axis, and the candidate rows of every policy."""
    base = policy.table_fallbacks(predictions, [*RUN_KEYS, "split"])
    validation, test = base.where("split = 'validation'"), base.where("split = 'test'")
    fitted = cross_fitted_calibration(
        validation, RUN_KEYS, s.axes, s.folds, s.seed, s.strict_groups, s.local_rows
    ).drop("cal_fold")
    held = by_axes(held_out_calibration(validation, test, RUN_KEYS, s.local_rows), s.axes)
    rows = cut(fitted.unionByName(held), "calibrated")
    rows = rows.withColumn("raw_risk", error_risk(F.col("p_base"), F.col("base_pred")))
    picked = policy.candidates(rows, s.thresholds, s.reject_fractions, "p_cal", s.confidence_source)
    return rows, cut(policy.defer_riskiest(picked, [*KEYS, "split"]), "states")


def policy_frame(rows: DataFrame, s: AuditSettings) -> DataFrame:
    """Every run, axis, policy and split, whether or not it has candidates."""
    tables = rows.groupBy(*RUN_KEYS, "group_axis", "split").agg(
        F.first("calibration_status").alias("calibration_status")
    )
    tables = tables.withColumn("_p", F.explode(policy.policy_grid(s.thresholds, s.reject_fractions)))
    return tables.select("*", "_p.*").drop("_p").withColumn("confidence_source", F.lit(s.confidence_source))


def full_coverage(states: DataFrame, frame: DataFrame) -> DataFrame:
    """Coverage counts of every policy, zero where nothing is a candidate."""
    counts = policy.coverage(states, [*KEYS, "split"])
    out = frame.join(counts, [*KEYS, "split"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("candidate_n", "deferred_n", "residual_n")}
    zero |= {
        c: F.coalesce(F.col(c), F.lit(0.0))
        for c in ("candidate_error_count", "deferred_error_count", "residual_error_count")
    }
    zero["residual_has_two_classes"] = F.coalesce("residual_has_two_classes", F.lit(False))
    return out.withColumns(zero)


@dataclass
class ProfileStage:
    """Scores and fit tables of one audit."""

    validation_scores: DataFrame
    test_scores: DataFrame
    folds: DataFrame
    statuses: DataFrame
    frames: DataFrame
    residual: DataFrame


def _status(profile: Column, primary: Column) -> Column:
    return F.when(primary, "profile_unavailable").otherwise("diagnostic_unavailable")


def profile_stage(states: DataFrame, coverage: DataFrame, s: AuditSettings) -> ProfileStage:
    """Fit and score all profiles; folds and statuses per (policy, profile)."""
    spark = states.sparkSession
    residual = states.where("state = 'residual'")
    test = residual.where("split = 'test'")
    own = residual.where("split = 'validation'")
    valid = own.where("base_wrong is not null")
    valid = cut(assign_folds(valid, KEYS, "base_wrong", s.folds, s.seed, s.strict_groups), "residual-folds")
    sizes = valid.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("fit_n"),
        F.coalesce(F.min("base_wrong") != F.max("base_wrong"), F.lit(False)).alias("two_classes"),
        F.max("n_folds").alias("n_folds"),
    )
    ready = sizes.where((F.col("fit_n") >= s.min_fit_n) & F.col("two_classes")).select(*KEYS)
    frames = cut(
        profiles.fit_frames(
            valid.join(ready, KEYS, "left_semi"), test.join(ready, KEYS, "left_semi"), KEYS, s.folds, s.local_rows
        ),
        "features",
    )
    coefs = cut(
        profiles.fit_rankers(
            frames, KEYS, s.profiles, s.seed, s.min_feature_n, s.ranking_weight, s.max_pairs, s.local_rows
        ),
        "coefficients",
    )
    scored = lambda part: profiles.score_rows(frames.where(part), coefs, KEYS)
    columns = [*KEYS, "fit", "profile", "row_id", "base_wrong", "score"]
    risk = lambda df, fit: df.select(
        *KEYS, fit.alias("fit"), F.lit("uncertainty").alias("profile"), "row_id", "base_wrong", F.col("risk").alias("score")
    )
    plain = any(p.name == "uncertainty" for p in s.profiles)
    validation_scores = scored("fit >= 0").select(*columns)
    test_scores = scored("fit = -1").select(*columns)
    if plain:
        validation_scores = validation_scores.unionByName(risk(valid, F.col("fold")))
        validation_scores = validation_scores.unionByName(risk(own.where("base_wrong is null"), F.lit(None).cast("int")))
        test_scores = test_scores.unionByName(risk(test, F.lit(-1)))
    validation_scores = cut(validation_scores, "validation-scores")
    test_scores = cut(test_scores, "test-scores")

    in_folds = validation_scores.where("fit is not null and base_wrong is not null")
    fold_quality = ranking.auc_metrics(in_folds, [*KEYS, "profile", "fit"], "score", "base_wrong")
    folds = stats.fold_mean_se(fold_quality, [*KEYS, "profile"], "auprc")

    table = profiles.profile_table(spark, s.profiles)
    table = table.withColumn("_all", F.lit(1))  # one row per declared profile
    frame = coverage.where("split = 'validation'").select(*KEYS, F.lit(1).alias("_all"))
    frame = frame.join(F.broadcast(table), "_all").drop("_all")
    none = F.array().cast("array<string>")
    used = coefs.groupBy(*KEYS, "profile").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.when((F.col("fit") >= 0) & F.col("slope").isNotNull(), F.col("used")).otherwise(none))))).alias("fold_used"),
        F.max(F.when(F.col("fit") == -1, F.col("used"))).alias("test_used"),
        F.max(F.when((F.col("fit") == -1) & F.col("slope").isNotNull(), F.lit(1))).alias("test_fit"),
    )
    finite_n = validation_scores.where("base_wrong is not null").groupBy(*KEYS, "profile").agg(
        F.count("score").alias("finite_n")
    )
    test_n = coverage.where("split = 'test'").select(*KEYS, F.col("residual_n").alias("test_n"))
    out = (
        frame.join(sizes, KEYS, "left")
        .join(used, [*KEYS, "profile"], "left")
        .join(finite_n, [*KEYS, "profile"], "left")
        .join(test_n, KEYS, "left")
        .join(folds, [*KEYS, "profile"], "left")
    )
    plain_profile = F.col("profile") == "uncertainty"
    n = F.coalesce("fit_n", F.lit(0))
    got = F.coalesce("finite_n", F.lit(0))
    fold_used = F.when(plain_profile, F.col("features")).otherwise(F.coalesce("fold_used", none))
    test_used = F.when(plain_profile, F.col("features")).otherwise(F.coalesce("test_used", none))
    met = lambda u: profiles.requirements_met(u, F.col("required_blocks"), F.col("required_any"))
    two = F.coalesce("two_classes", F.lit(False))
    short = (n < 2) | (~plain_profile & (n < s.min_fit_n))
    lacks = _status(F.col("profile"), F.col("primary_candidate"))
    validation_status = (
        F.when(short, "insufficient_residual_n")
        .when(~two, "single_residual_class")
        .when(F.col("n_folds").isNull(), "group_cv_unavailable")
        .when(~met(fold_used), lacks)
        .when(got == 0, "unavailable")
        .when(got < n, "partial")
        .otherwise("complete")
    )
    test_status = (
        F.when(plain_profile, "complete")
        .when(n < s.min_fit_n, "insufficient_residual_n")
        .when(~two, "single_residual_class")
        .when(F.coalesce("test_n", F.lit(0)) == 0, "empty_test_residual")
        .when(~met(test_used), lacks)
        .when(F.col("test_fit").isNull(), "unavailable")
        .otherwise("complete")
    )
    done = validation_status.isin("complete", "partial")
    statuses = out.select(
        *KEYS, "profile", "primary_candidate", "complexity",
        validation_status.alias("validation_status"),
        test_status.alias("test_status"),
        F.array_join(F.when(done, F.array_sort(fold_used)).otherwise(none), "|").alias("validation_used_features"),
        F.array_join(F.when(test_status == "complete", test_used).otherwise(none), "|").alias("test_used_features"),
        "validation_fold_mean_auprc", "validation_fold_se_auprc",
        F.coalesce("validation_finite_folds", F.lit(0)).alias("validation_finite_folds"),
    )
    return ProfileStage(validation_scores, test_scores, folds, cut(statuses, "statuses"), frames, valid)


def candidate_rows(stage: ProfileStage, coverage: DataFrame, s: AuditSettings, split: str) -> DataFrame:
    """Metrics and status of every (policy, profile) on one split."""
    scores = stage.validation_scores if split == "validation" else stage.test_scores
    names = stage.statuses.select(*KEYS, "profile")
    errors = coverage.where(F.col("split") == split).select(*KEYS, "deferred_error_count")
    groups = names.join(errors, KEYS)
    metrics = ranking.evaluate_scores(scores, [*KEYS, "profile"], groups, s.review_fractions, s.min_universe_n)
    status = stage.statuses.withColumnsRenamed(
        {f"{split}_status": "model_status", f"{split}_used_features": "used_features"}
    )
    folds = ["validation_fold_mean_auprc", "validation_fold_se_auprc", "validation_finite_folds"]
    keep = [*KEYS, "profile", "primary_candidate", "complexity", "model_status", "used_features",
            *(folds if split == "validation" else [])]
    return status.select(*keep).join(metrics, [*KEYS, "profile"])


def dedup_rows(
    predictions: DataFrame, states: DataFrame, scores: DataFrame, coverage: DataFrame, dataset: str, s: AuditSettings,
    extra: Sequence[str] = ("profile",),
) -> DataFrame:
    """Ranking metrics on unique pairs of one dataset, validation pairs left out.

    Labels, states and scores are collapsed to pairs separately: labels do not
    depend on the policy and states do not depend on the profile.
    """
    keys, pair = [*KEYS, *extra], ["pair_a", "pair_b"]
    only = F.lower(F.col("dataset")) == dataset.lower()
    rows = predictions.where(only)
    eligible = dedup.drop_overlap(rows.where("split = 'test'"), rows.where("split = 'validation'"), RUN_KEYS)
    labels = eligible.groupBy(*RUN_KEYS, *pair).agg(F.avg("base_wrong").alias("base_wrong"))
    pairs = dedup.with_pair_key(states.where(only & (F.col("split") == "test")))
    pairs = pairs.join(labels.select(*RUN_KEYS, *pair), [*RUN_KEYS, *pair], "left_semi")
    flags = pairs.groupBy(*KEYS, *pair).agg(F.min("state").alias("state"))  # 'deferred' sorts first
    labelled = flags.join(labels, [*RUN_KEYS, *pair])
    ids = pairs.where("state = 'residual'").select(*KEYS, "row_id", *pair)
    means = scores.where(only).join(ids, [*KEYS, "row_id"]).groupBy(*keys, *pair).agg(F.avg("score").alias("score"))
    ranked = means.join(labelled.where("state = 'residual'"), [*KEYS, *pair])
    errors = labelled.where("state = 'deferred'").groupBy(*KEYS).agg(F.sum("base_wrong").alias("_e"))
    groups = coverage.where((F.col("split") == "test") & only).select(*KEYS).join(errors, KEYS, "left")
    groups = groups.select(*KEYS, F.coalesce("_e", F.lit(0.0)).alias("deferred_error_count"))
    groups = groups.join(scores.where(only).select(*keys).distinct(), KEYS)
    out = ranking.evaluate_scores(ranked, keys, groups, s.review_fractions, s.min_universe_n)
    return out.withColumnsRenamed(
        {c: f"deduplicated_{c}" for c in out.columns if c not in (*keys, "review_fraction")}
    )


def domain_rows(states: DataFrame, source_counts: bool) -> DataFrame:
    """Residual test rows tagged as seen or unseen in the fit and the source reference."""
    residual = states.where("state = 'residual'")
    test, fit = residual.where("split = 'test'"), residual.where("split = 'validation'")
    d = fit.select(*KEYS, "dr_id").distinct().withColumn("_d", F.lit(True))
    t = fit.select(*KEYS, "pr_id").distinct().withColumn("_t", F.lit(True))
    tagged = test.join(d, [*KEYS, "dr_id"], "left").join(t, [*KEYS, "pr_id"], "left")
    side = lambda name, a, b: F.struct(
        F.lit(name).alias("support_reference"), F.coalesce(a, F.lit(False)).alias("drug_seen"),
        F.coalesce(b, F.lit(False)).alias("target_seen"),
    )
    sides = [side("audit_fit", F.col("_d"), F.col("_t"))]
    if source_counts:
        sides.append(side("source_train", F.col("source_drug_count") > 0, F.col("source_target_count") > 0))
    long = tagged.select(*KEYS, "base_wrong", F.explode(F.array(*sides)).alias("_s")).select(*KEYS, "base_wrong", "_s.*")
    return support.domain_strata(long, KEYS).withColumn("split", F.lit("test"))


def summarise_selected(selected: DataFrame, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cluster means of the selected profile and their summary with intervals."""
    keys = [*RUN_KEYS, "group_axis", "confidence_source"]
    clusters = stats.cluster_means(selected, keys, SELECTED_MEASURES)
    return clusters, _summary(clusters, keys, ["group_axis"], SELECTED_MEASURES, resamples, seed)


def summarise_increments(increments: DataFrame, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    keys = [*RUN_KEYS, "group_axis", "confidence_source", "split", "added_component"]
    measures = [m for m in INCREMENT_MEASURES if m in increments.columns]
    clusters = stats.cluster_means(increments, keys, measures)
    groups = ["split", "group_axis", "added_component"]
    return clusters, _summary(clusters, keys, groups, measures, resamples, seed)


def _summary(clusters, keys, groups, measures, resamples, seed) -> DataFrame:
    long = stats.long_measures(clusters, keys, measures)
    out = stats.summary_of_strata(long, groups)
    return out.join(stats.bootstrap_interval(long, groups, resamples, seed), [*groups, "measure"])


def dedup_sensitivity(selected: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Selected rows of one dataset on unique pairs; all rows with that dataset replaced."""
    only = F.lower(F.col("dataset")) == dataset.lower()
    swap = {}
    for m in ("error_detection_auprc", "review_error_rate", "retained_accuracy_gain_vs_residual"):
        plain, unique = f"delta_{m}_vs_uncertainty", f"delta_deduplicated_{m}_vs_uncertainty"
        if unique in selected.columns:
            swap[plain] = F.when(only, F.col(unique)).otherwise(F.col(plain))
    adjusted = selected.withColumns(swap)
    return adjusted.where(only), adjusted


def summaries(selected: DataFrame, increments: DataFrame, s: AuditSettings) -> dict[str, DataFrame]:
    """All aggregate tables from stored run-level rows."""
    n, seed = s.resamples, s.bootstrap_seed
    out = {}
    out["selected_cluster_runs"], out["selected_summary"] = summarise_selected(selected, n, seed)
    clusters, summary = summarise_increments(increments, n, seed)
    out["component_increment_cluster_runs"], out["component_increment_summary"] = clusters, summary
    if s.dedup_dataset:
        alone, adjusted = dedup_sensitivity(selected, s.dedup_dataset)
        out["deduplicated_selected_summary"] = summarise_selected(alone, n, seed + 10_000)[1]
        out["deduplication_adjusted_selected_summary"] = summarise_selected(adjusted, n, seed + 20_000)[1]
    measures = [m for m in INCREMENT_MEASURES if m in increments.columns]
    keys = [*RUN_KEYS, "group_axis", "confidence_source", "split", "added_component"]
    for component, offset in (("target_sequence_support", 30_000), ("general_target_joint_support", 40_000)):
        part = clusters.where(F.col("added_component") == component)
        out[f"{component}_strata"] = stats.strata_table(
            stats.long_measures(part, keys, measures), ["split", "group_axis"]
        )
        for column in ("dataset", "model") if component.startswith("general") else ("dataset",):
            left = stats.leave_one_out(increments.where(F.col("added_component") == component), column)
            group = ["excluded", "split", "group_axis", "added_component"]
            means = stats.cluster_means(left, ["excluded", *keys], measures)
            out[f"{component}_leave_one_{column}_out"] = _summary(
                means, ["excluded", *keys], group, measures, n, seed + offset
            )
    return out


def run_audit(predictions: DataFrame, s: AuditSettings = AuditSettings()) -> dict[str, DataFrame]:
    """Run-level and summary tables of the formal audit.

    ``predictions``: one row per prediction with run keys, ``split`` (validation
    or test), ``row_id``, ids, scores, base columns and any support columns.
    """
    spark = predictions.sparkSession
    rows, states = calibrated_states(predictions, s)
    coverage = cut(full_coverage(states, policy_frame(rows, s)), "coverage")
    stage = profile_stage(states, coverage, s)
    validation = cut(candidate_rows(stage, coverage, s, "validation"), "candidates-validation")
    test = candidate_rows(stage, coverage, s, "test")
    metrics = list(ranking.METRICS)
    if s.dedup_dataset:
        unique = dedup_rows(predictions, states, stage.test_scores, coverage, s.dedup_dataset, s)
        test = test.join(unique, [*POLICY_KEYS, "profile"], "left")
        metrics += [f"deduplicated_{m}" for m in ranking.METRICS]
    test = cut(test, "candidates-test")
    comparisons = selection.comparison_table(spark)
    increments = selection.component_increments(
        validation, comparisons, POLICY_KEYS, ["validation_fold_mean_auprc", *ranking.METRICS]
    ).withColumn("split", F.lit("validation"))
    increments = increments.unionByName(
        selection.component_increments(test, comparisons, POLICY_KEYS, metrics).withColumn("split", F.lit("test")),
        allowMissingColumns=True,
    )
    increments = cut(increments, "increments")
    choices = cut(
        selection.select_one_standard_error(validation, POLICY_KEYS, s.min_validation_gain, min_folds=2), "choices"
    )
    selected = cut(selection.selected_vs_uncertainty(test, choices, POLICY_KEYS, metrics), "selected")
    residual = states.where("state = 'residual'")
    calibration = policy.calibration_rows(states, [*KEYS, "split"])
    out = {
        "capability_manifest": support.capabilities(predictions, [*RUN_KEYS, "split"]),
        "policy_coverage": coverage,
        "calibration_diagnostics": calibration,
        "domain_support_diagnostics": domain_rows(states, "source_drug_count" in states.columns),
        "audit_fit_reference_diagnostics": support.reference_row(
            support.key_overlap(residual.where("split = 'validation'"), residual.where("split = 'test'"), KEYS)
        ),
        "candidate_validation_runs": validation,
        "candidate_test_runs": test,
        "component_increment_runs": increments,
        "selection_choices": choices,
        "selected_test_runs": selected,
    }
    if s.dedup_dataset:
        only = F.lower(F.col("dataset")) == s.dedup_dataset.lower()
        part = predictions.where(only)
        frame = coverage.where((F.col("split") == "test") & only).select(*KEYS)
        marks = states.where(only & (F.col("split") == "test")).select(*KEYS, "row_id", "state")
        crossed = part.where("split = 'test'").join(frame, RUN_KEYS).join(marks, [*KEYS, "row_id"], "left")
        out["pair_deduplication_diagnostics"] = dedup.dedup_diagnostics(
            crossed.withColumn("score", F.lit(0.0)), part.where("split = 'validation'"), RUN_KEYS, KEYS
        )
    return out | summaries(selected, increments, s)
