"""Experiments around the audit: budgets, baselines, falsification, transfer."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import finite, or_null
from residuum.operators import permute, profiles, quality, ranking, selection, stats
from residuum.operators.boosting import Boosting, boost
from residuum.operators.logistic import solve_spread
from residuum.plans.audit import KEYS, RUN_KEYS, AuditSettings, ProfileStage
from residuum.storage import cut

SCALAR_METHODS = {
    "raw_uncertainty": "raw_risk",
    "native_max_shift": "native_domain_shift_score",
    "native_density": "native_domain_density_distance",
}
BOOSTED = "fixed_hgb_upe"
#: Ridge of predictors and heads on standardised columns, a unit of weight: it settles collinear columns.
PREDICTOR_RIDGE = 1.0e-6
# Evidence blocks whose columns each falsification variant permutes.
FALSIFICATION = {
    "permute_prior": profiles.PRIOR,
    "permute_support": profiles.SUPPORT,
    "permute_prior_support": profiles.PRIOR + profiles.SUPPORT,
}
FULL_PROFILE = next(p for p in profiles.PRIMARY_PROFILES if p.name == "uncertainty_prior_support")
TRANSFER_METRICS = [
    "error_detection_auprc",
    "review_error_rate",
    "combined_recall_of_candidate_errors",
    "retained_accuracy_gain_vs_residual",
]


def scalar_scores(states: DataFrame, methods: dict[str, str] = SCALAR_METHODS) -> DataFrame:
    """Fixed scores of residual rows that need no fit."""
    rows = states.where("state = 'residual'")
    items = [F.struct(F.lit(m).alias("method"), finite(or_null(rows, c)).alias("score")) for m, c in methods.items()]
    long = rows.select(*KEYS, "split", "row_id", "base_wrong", F.explode(F.array(*items)).alias("_m"))
    return long.select(*KEYS, "split", "row_id", "base_wrong", "_m.*")


def boosted_scores(
    frames: DataFrame, keys: Sequence[str], growth: Boosting = Boosting(), min_feature_n: int = profiles.MIN_FEATURE_N
) -> tuple[DataFrame, DataFrame]:
    """Boosted-tree scores of held rows and the fits, for every (keys, fit) of ``frames`` in the same passes.

    A fit without usable features of each required block of the full profile has a status and no scores.
    """
    at = lambda names: [profiles.FEATURES.index(f) for f in names]
    rows = frames.withColumn("draw", F.col("draw") / float(16**13))
    return boost(rows, [*keys, "fit"], at(FULL_PROFILE.features), [at(block) for block in FULL_PROFILE.needs], min_feature_n, growth)


def boosted_statuses(fits: DataFrame, scores: DataFrame, coverage: DataFrame, residual: DataFrame, s: AuditSettings) -> DataFrame:
    """Status of the boosted baseline of each policy on both splits, with the features its fits used."""
    sizes = residual.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.min("base_wrong") != F.max("base_wrong"), F.lit(False)).alias("_two"), F.max("n_folds").alias("_folds"))
    scored = scores.groupBy(*KEYS).agg(F.count_if((F.col("fit") >= 0) & F.col("score").isNotNull()).alias("_scored"))
    names = F.array(*map(F.lit, profiles.FEATURES))
    own = fits.where("status = 'complete'").withColumn("names", F.transform("used", lambda i: F.get(names, i)))
    used = own.groupBy(*KEYS).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("fit") >= 0, F.col("names")))))).alias("_fold_used"),
        F.max(F.when(F.col("fit") == -1, F.col("names"))).alias("_test_used"))
    test = coverage.where("split = 'test'").select(*KEYS, F.col("residual_n").alias("_test_n"))
    out = coverage.where("split = 'validation'").select(*KEYS)
    for part in (sizes, scored, used, test):
        out = out.join(part, KEYS, "left")
    n, got = F.coalesce("_n", F.lit(0)), F.coalesce("_scored", F.lit(0))
    short = F.when(n < s.min_fit_n, "insufficient_residual_n").when(~F.coalesce("_two", F.lit(False)), "single_residual_class")
    return out.select(
        *KEYS, F.lit(BOOSTED).alias("method"),
        short.when(F.col("_folds").isNull(), "group_cv_unavailable").when(got == 0, "unavailable").when(got < n, "partial")
        .otherwise("complete").alias("validation_status"),
        short.when(F.coalesce("_test_n", F.lit(0)) == 0, "empty_test_residual").when(F.col("_test_used").isNull(), "unavailable")
        .otherwise("complete").alias("test_status"),
        F.array_join(F.coalesce("_fold_used", F.array().cast("array<string>")), "|").alias("validation_used_features"),
        F.array_join(F.coalesce("_test_used", F.array().cast("array<string>")), "|").alias("test_used_features"),
    )


def falsified_folds(stage: ProfileStage, s: AuditSettings) -> DataFrame:
    """Fold quality of the full profile on true and on permuted evidence."""
    scored = stage.validation_scores.where(F.col("profile") == FULL_PROFILE.name)
    actual = scored.select(*KEYS, "fit", "base_wrong", "score").withColumn("variant", F.lit("actual"))
    frames = stage.frames.where("fit >= 0")
    variants = {v: [profiles.FEATURES.index(c) for c in columns] for v, columns in FALSIFICATION.items()}
    mixed = cut(permute.permute_variants(frames, KEYS, variants, len(profiles.FEATURES), s.seed), "permuted")
    # a variant is fitted as a group of its own: draws and pairs are those of the rows
    coefs = cut(profiles.fit_rankers(
        mixed, [*KEYS, "variant"], [FULL_PROFILE], s.seed, s.min_feature_n, s.ranking_weight, s.max_pairs, s.local_rows
    ), "falsified-fits")
    part = profiles.score_rows(mixed, coefs, [*KEYS, "variant"])
    rows = actual.unionByName(part.select(*KEYS, "fit", "base_wrong", "score", "variant"))
    quality_rows = ranking.auc_metrics(rows, [*KEYS, "variant", "fit"], "score", "base_wrong")
    return stats.fold_mean_se(quality_rows, [*KEYS, "variant"], "auprc")


def falsification_deltas(folds: DataFrame) -> DataFrame:
    """Actual minus control fold quality per policy and variant."""
    value = "validation_fold_mean_auprc"
    actual = folds.where("variant = 'actual'").select(*KEYS, F.col(value).alias(f"actual_{value}"))
    controls = folds.where("variant <> 'actual'").join(actual, KEYS, "left")
    return controls.withColumn("actual_minus_control_auprc", F.col(f"actual_{value}") - F.col(value))


def budget_methods(
    states: DataFrame, stage: ProfileStage, coverage: DataFrame, s: AuditSettings, boosted: DataFrame | None = None
) -> DataFrame:
    """Every method on both splits under every review budget, with action totals."""
    primary = [p.name for p in profiles.PRIMARY_PROFILES]
    columns = [*KEYS, "split", "method", "row_id", "base_wrong", "score"]
    fitted = lambda df, split: df.where(F.col("profile").isin(*primary)).select(
        *KEYS, F.lit(split).alias("split"), F.col("profile").alias("method"), "row_id", "base_wrong", "score"
    )
    scores = scalar_scores(states).select(*columns)
    scores = scores.unionByName(fitted(stage.validation_scores, "validation"))
    scores = scores.unionByName(fitted(stage.test_scores, "test"))
    methods = [*primary, *SCALAR_METHODS]
    if boosted is not None:
        split = F.when(F.col("fit") >= 0, "validation").otherwise("test")
        scores = scores.unionByName(
            boosted.select(*KEYS, split.alias("split"), F.lit(BOOSTED).alias("method"), "row_id", "base_wrong", "score")
        )
        methods.append(BOOSTED)
    groups = coverage.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    metrics = ranking.evaluate_scores(scores, [*KEYS, "split", "method"], groups, s.review_fractions, s.min_universe_n)
    sizes = coverage.select(*KEYS, "split", "candidate_n", "deferred_n")
    return stats.action_columns(metrics.join(sizes, [*KEYS, "split"]))


def selected_budgets(methods: DataFrame, choices: DataFrame, metrics: Sequence[str] = ranking.METRICS) -> DataFrame:
    """Test rows of the selected method per policy and budget beside uncertainty."""
    keys = [*KEYS, "review_fraction"]
    test = methods.where("split = 'test'").withColumnRenamed("method", "profile")
    budgets = test.select("review_fraction").distinct()
    picks = choices.select(*KEYS, "selected_profile", "selection_fallback", "selection_reason").dropDuplicates(KEYS)
    picks = picks.join(F.broadcast(budgets.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).drop("_k")
    return selection.selected_vs_uncertainty(test, picks, keys, metrics)


def budget_summaries(selected: DataFrame, methods: DataFrame, resamples: int, seed: int) -> dict[str, DataFrame]:
    """Cluster means, summaries, heterogeneity and action-curve areas of the budget runs."""
    deltas = [c for c in selected.columns if c.startswith("delta_") and c.endswith("_vs_uncertainty")]
    keys = [*RUN_KEYS, "group_axis", "review_fraction"]
    clusters = stats.cluster_means(selected, keys, deltas)
    measures = [f"delta_{m}_vs_uncertainty" for m in TRANSFER_METRICS]
    out = {"equal_budget_cluster_runs": clusters}
    out["equal_budget_summary"] = _with_interval(
        stats.long_measures(clusters, keys, measures), ["group_axis", "review_fraction"], resamples, seed
    )
    out["equal_budget_heterogeneity"] = stats.heterogeneity(clusters, ["group_axis", "review_fraction"], RUN_KEYS, measures[:3])
    curve = stats.action_curve_area(selected, KEYS)
    run = [*RUN_KEYS, "group_axis"]
    areas = [c for c in curve.columns if c.endswith("action_auc") or c.endswith("vs_uncertainty")]
    curve = stats.cluster_means(curve, run, areas)
    out["equal_budget_curve_auc_runs"] = curve
    area = ["delta_normalized_action_auc_vs_uncertainty"]
    out["equal_budget_curve_auc_summary"] = _with_interval(
        stats.long_measures(curve, run, area), ["group_axis"], resamples, seed + 1_000
    )
    test = methods.where("split = 'test'")
    names = [*SCALAR_METHODS, BOOSTED]
    against = selection.methods_vs_selected(test, selected, [*KEYS, "review_fraction"], names, TRANSFER_METRICS)
    values = [f"delta_{m}_vs_selected" for m in TRANSFER_METRICS]
    means = stats.cluster_means(against, [*keys, "method"], values)
    out["strong_baseline_cluster_runs"] = means
    out["strong_baseline_summary"] = _with_interval(
        stats.long_measures(means, [*keys, "method"], values), ["group_axis", "review_fraction", "method"],
        resamples, seed + 3_000,
    )
    return out


def _with_interval(long: DataFrame, groups: list[str], resamples: int, seed: int) -> DataFrame:
    out = stats.summary_of_runs(long, groups)
    return out.join(stats.bootstrap_interval(long, groups, resamples, seed), [*groups, "measure"])


def transfer(validation: DataFrame, test: DataFrame, min_gain: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Profile chosen on all other domains, evaluated on the held-out one.

    Both frames are run-level candidate rows with a ``profile`` column.
    """
    keys = [*RUN_KEYS, "group_axis", "profile", "complexity"]
    clusters = stats.cluster_means(validation.where("primary_candidate"), keys, ["validation_fold_mean_auprc"])
    kinds = {"leave_one_dataset_out": "dataset", "leave_one_model_out": "model"}
    group = ["transfer_type", "held_out_domain", "group_axis"]
    choices = selection.select_global(selection.held_out_domains(clusters, kinds), group, min_gain)
    policy = [*KEYS, "review_fraction"]
    base = test.where("profile = 'uncertainty'").select(
        *policy, *[F.col(m).alias(f"uncertainty_{m}") for m in TRANSFER_METRICS]
    )
    paired = test.join(base, policy, "left")
    picks = choices.select(*group, F.col("selected_profile").alias("profile"))
    domain = F.when(F.col("transfer_type") == "leave_one_dataset_out", F.col("dataset")).otherwise(F.col("model"))
    runs = paired.join(F.broadcast(picks), ["group_axis", "profile"]).where(domain == F.col("held_out_domain"))
    runs = runs.withColumnRenamed("profile", "transferred_profile").withColumns(
        {f"delta_{m}_vs_uncertainty": F.col(m) - F.col(f"uncertainty_{m}") for m in TRANSFER_METRICS}
    )
    return choices, runs


def transfer_summary(runs: DataFrame, resamples: int, seed: int) -> DataFrame:
    groups = ["transfer_type", "held_out_domain", "group_axis", "transferred_profile"]
    values = [f"delta_{m}_vs_uncertainty" for m in TRANSFER_METRICS]
    keys = [*groups, *RUN_KEYS]
    long = stats.long_measures(stats.cluster_means(runs, keys, values), keys, values)
    return _with_interval(long, groups, resamples, seed)


# --- one baseline against the selected profile -------------------------------------


def paired_policy_runs(candidates: DataFrame, selected: DataFrame, method: str = BOOSTED) -> DataFrame:
    """One row per policy: the method and the selected profile on both splits.

    Refuses repeated keys and ranking quality that depends on the review budget.
    """
    quality.require_unique(candidates, [*KEYS, "review_fraction", "split", "method"], "candidates")
    quality.require_unique(selected, [*KEYS, "review_fraction"], "selected")
    own = ["error_detection_auprc", "validation_fold_mean_auprc", "deduplicated_error_detection_auprc"]
    have = [m for m in own if m in candidates.columns]
    pick = [m for m in own[::2] if m in selected.columns]
    for df, keys, metrics, name in (
        (candidates, [*KEYS, "split", "method"], have, "candidates"), (selected, KEYS, pick, "selected")
    ):
        if not stats.budget_invariant(df, keys, metrics).isEmpty():
            raise quality.ShardError(f"{name} has review-fraction-dependent values for budget-independent metrics")
    rows = stats.smallest_budget(candidates, [*KEYS, "split", "method"], [*have, "model_status"])
    chosen = stats.smallest_budget(selected, KEYS, [*pick, "selected_profile"])
    rename = lambda df, names: df.select(*KEYS, *[F.col(a).alias(b) for a, b in names.items() if a in df.columns])
    validation = rows.where("split = 'validation'")
    picked = validation.join(chosen.select(*KEYS, "selected_profile"), KEYS).where("method = selected_profile")
    dedup = "deduplicated_error_detection_auprc"
    out = rename(picked, {
        "selected_profile": "selected_profile", "error_detection_auprc": "selected_validation_auprc",
        "validation_fold_mean_auprc": "selected_validation_fold_mean_auprc"})
    parts = [
        rename(validation.where(F.col("method") == method), {
            "model_status": "method_validation_status", "error_detection_auprc": "method_validation_auprc",
            "validation_fold_mean_auprc": "method_validation_fold_mean_auprc"}),
        rename(rows.where((F.col("split") == "test") & (F.col("method") == method)), {
            "model_status": "method_test_status", "error_detection_auprc": "method_test_auprc",
            dedup: "method_test_deduplicated_auprc"}),
        rename(chosen, {"error_detection_auprc": "selected_test_auprc", dedup: "selected_test_deduplicated_auprc"}),
    ]
    for part in parts:
        out = out.join(part, KEYS)
    pairs = ["validation_auprc", "validation_fold_mean_auprc", "test_auprc", "test_deduplicated_auprc"]
    pairs = [p for p in pairs if f"method_{p}" in out.columns and f"selected_{p}" in out.columns]
    return out.withColumns({f"delta_{p}": F.col(f"method_{p}") - F.col(f"selected_{p}") for p in pairs})


def paired_clusters(runs: DataFrame) -> DataFrame:
    """Policies averaged per run and axis, with agreement of both splits."""
    deltas = [c for c in runs.columns if c.startswith("delta_")]
    out = runs.groupBy(*RUN_KEYS, "group_axis").agg(
        *[F.avg(d).alias(d) for d in deltas], *[F.count(d).alias(f"finite_policy_n_{d}") for d in deltas]
    )
    v, t = F.col("delta_validation_auprc"), F.col("delta_test_auprc")
    agree = stats.direction_columns(v, t)
    extra = {"validation_positive": (v > 0).cast("double"), "test_positive": (t > 0).cast("double")}
    extra |= {k: c.cast("double") for k, c in agree.items()}
    if "delta_test_deduplicated_auprc" in deltas:
        extra["dedup_minus_ordinary_delta"] = F.col("delta_test_deduplicated_auprc") - t
    return out.withColumns(extra)


def paired_summaries(clusters: DataFrame, resamples: int, seed: int) -> dict[str, DataFrame]:
    keys = [*RUN_KEYS, "group_axis"]
    effects = [c for c in ("delta_validation_auprc", "delta_validation_fold_mean_auprc", "delta_test_auprc") if c in clusters.columns]
    both = ["delta_validation_auprc", "delta_test_auprc"]
    directions = ["validation_positive", "test_positive", "same_direction", "both_positive"]
    out = {
        "overall_summary": _with_interval(stats.long_measures(clusters, keys, effects), ["group_axis"], resamples, seed),
        "direction_consistency": _with_interval(
            stats.long_measures(clusters, keys, directions), ["group_axis"], resamples, seed + 1_000),
    }
    parts = F.array(*[F.struct(F.lit(a).alias("stratum_type"), F.col(a).alias("stratum")) for a in RUN_KEYS])
    tagged = clusters.withColumn("_s", F.explode(parts)).select("*", "_s.*")
    group = ["group_axis", "stratum_type", "stratum"]
    out["strata_summary"] = _with_interval(
        stats.long_measures(tagged, [*keys, *group[1:]], both), group, resamples, seed + 2_000)
    held = None
    for column in ("dataset", "model"):
        part = stats.leave_one_out(clusters, column).withColumn("held_out_type", F.lit(column))
        held = part if held is None else held.unionByName(part)
    group = ["group_axis", "held_out_type", "excluded"]
    out["leave_one_out_summary"] = _with_interval(
        stats.long_measures(held, [*keys, *group[1:]], both), group, resamples, seed + 3_000)
    return out


# --- diagnostic component ----------------------------------------------------------


def diagnostic_analysis(increments: DataFrame, component: str, resamples: int, seed: int) -> dict[str, DataFrame]:
    """Direction per run, direction summary and overall effect of one component."""
    work = increments.where(F.col("added_component") == component)
    keys = [*RUN_KEYS, "group_axis", "split"]
    values = ["delta_validation_fold_mean_auprc", "delta_error_detection_auprc"]
    clusters = stats.cluster_means(work, keys, values)
    directions = stats.split_pair(clusters, [*RUN_KEYS, "group_axis"], *values)
    measure = F.when(F.col("split") == "validation", F.lit(values[0])).otherwise(F.lit(values[1]))
    value = F.when(F.col("split") == "validation", F.col(values[0])).otherwise(F.col(values[1]))
    long = clusters.select(*keys, measure.alias("measure"), value.alias("value")).where("value is not null")
    groups = ["split", "group_axis"]
    overall = stats.summary_of_strata(long, groups).join(
        stats.bootstrap_interval(long, groups, resamples, seed), [*groups, "measure"])
    return {
        "seed_strata": clusters,
        "direction_runs": directions,
        "direction_summary": stats.direction_summary(directions, ["group_axis"]),
        "overall": overall,
    }


# --- predictors ----------------------------------------------------------------------


def train_predictors(
    rows: DataFrame, base: Sequence[str], prior: Sequence[str], label: str = "label", by: Sequence[str] = ("model",), row_id: str = "row_id",
    held: float = 0.25, seed: int = 2026,
) -> DataFrame:
    """Base predictor first, then a prior head on prior columns beside the frozen base; one of each per ``by``.

    Rows of split 'validation' train. The base logit enters the head as an offset, so the head learns what the base
    leaves over. The head is linear, or linear with squares: each is fitted on a part of the training rows, and the one whose
    full logit has the higher AUROC + AUPRC on the other part (``held`` of the rows, by a hash of ``row_id``) is fitted again on all of them.
    Returns all rows with s_base, s_prior (the head alone), s_full (their sum) and head. Null columns count as 0; rows without a label
    are scored only. A group whose training rows lack a class gets null scores.

    All groups are fitted together, in passes over rows that stay where they are; scores follow from a row and its group's
    coefficients, so nothing is stored. ``rows`` is read in every pass: it should be a stored table.
    """
    by, rows = list(by), rows.drop("s_base", "s_prior", "s_full", "head")
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    values = [*[number(c) for c in base], *[number(c) for c in prior], *[number(c) * number(c) for c in prior]]
    in_base, in_linear = list(range(len(base))), list(range(len(base), len(base) + len(prior)))
    heads = {"linear": in_linear, "squares": list(range(len(base), len(values)))}
    part = F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1_000_000)) < int(held * 1_000_000)
    own = rows.withColumns({"_y": F.col(label).cast("double"), "_part": part})
    train = own.where("split = 'validation' and _y is not null")
    # one row a group
    moments = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") > 0.5).alias("positives"), F.count_if(~F.col("_part")).alias("fitting"),
        F.array(*[F.avg(v) for v in values]).alias("mean"), F.array(*[F.stddev_pop(v) for v in values]).alias("scale")).collect()
    groups = [_Group(i, r, by) for i, r in enumerate(r for r in moments if 0 < r.positives < r.n)]
    strength = {(g.number,): g.strength for g in groups}

    def known(frame: DataFrame) -> DataFrame:
        """``frame`` with what its groups know so far; rows of other groups have nulls."""
        schema = T.StructType([*[T.StructField(f"_by_{k}", rows.schema[k].dataType) for k in by], *T.StructType.fromDDL(
            "_k int, _mean array<double>, _scale array<double>, _positive double, _negative double, _base array<double>, "
            "_linear array<double>, _squares array<double>, head string").fields])
        table = frame.sparkSession.createDataFrame([g.row() for g in groups], schema)
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        found = frame.join(F.broadcast(table), same, "left").drop(*[f"_by_{k}" for k in by])
        bound = float(np.log(1e9))
        return found.withColumn("s_base", F.greatest(F.lit(-bound), F.least(F.lit(bound), logit("_base", in_base))))

    def logit(name: str, used: list[int]) -> Column:
        out = F.get(F.col(name), F.lit(len(used)))
        for j, i in enumerate(used):
            out = out + F.get(F.col(name), F.lit(j)) * values[i]
        return out

    def solved(frame: DataFrame, problems: dict[int, dict[str, list[int]]], offset: Column | None = None) -> None:
        """Fits over ``frame``, their coefficients put into the groups in terms of the columns themselves."""
        x = F.array(*[(v - F.get("_mean", F.lit(i))) / F.get("_scale", F.lit(i)) for i, v in enumerate(values)])
        w = F.when(F.col("_y") > 0.5, F.col("_positive")).otherwise(F.col("_negative"))
        stack = known(frame).select("_k", x.alias("x"), F.col("_y").alias("y"), w.alias("w"), *([offset.alias("o")] if offset is not None else []))
        fits = solve_spread(stack, ["_k"], {(k,): p for k, p in problems.items() if p}, strength) if any(problems.values()) else {}
        for (k,), found in fits.items():
            for name, beta in found.items():
                groups[k].learn(name, problems[k][name], beta)

    solved(train, {g.number: {"base": in_base} for g in groups})
    solved(train.where("not _part"), {g.number: heads if g.fitting else {} for g in groups}, F.col("s_base"))
    if groups:
        names = list(heads)
        full = F.explode(F.array(*[F.struct(F.lit(h).alias("tried"), (F.col("s_base") + logit(f"_{h}", heads[h])).alias("s")) for h in names]))
        tried = known(train.where("_part")).select("_k", "_y", full.alias("_s")).select("_k", "_y", "_s.*")
        got = {(r["_k"], r.tried): (r.auroc or 0.0) + (r.auprc or 0.0) for r in ranking.auc_of_large_groups(tried, ["_k", "tried"], "s", "_y").collect()}
        for g in groups:
            g.head = max(names, key=lambda h: got.get((g.number, h), 0.0))  # the first of equal ones
        solved(train, {g.number: {g.head: heads[g.head]} for g in groups}, F.col("s_base"))
    s_prior = F.when(F.col("head") == "linear", logit("_linear", heads["linear"])).when(F.col("head") == "squares", logit("_squares", heads["squares"]))
    return known(rows).withColumn("s_prior", s_prior).select(*rows.columns, "s_base", "s_prior", (F.col("s_base") + s_prior).alias("s_full"), "head")


class _Group:
    """What ``train_predictors`` knows of one group: scales, class weights, coefficients (the intercept last), the chosen head."""

    def __init__(self, number: int, moments: Row, by: list[str]):
        self.number, self.key, self.fitting = number, tuple(moments[k] for k in by), moments.fitting
        self.mean = list(moments["mean"])
        # a column that does not vary stays out of the fits
        self.scale = [s if s > 1e-12 * abs(m) else float("inf") for m, s in zip(self.mean, moments["scale"])]
        self.weights = (moments.n / (2.0 * moments.positives), moments.n / (2.0 * (moments.n - moments.positives)))
        self.strength = 1.0 / (PREDICTOR_RIDGE * moments.n)
        self.found: dict[str, list[float]] = {}
        self.head: str | None = None

    def learn(self, name: str, used: list[int], beta: np.ndarray) -> None:
        slopes = [float(b) / self.scale[i] for b, i in zip(beta, used)]
        self.found[name] = [*slopes, float(beta[-1]) - sum(s * self.mean[i] for s, i in zip(slopes, used))]

    def row(self) -> tuple:
        return (*self.key, self.number, self.mean, self.scale, *self.weights, *[self.found.get(n) for n in ("base", "linear", "squares")], self.head)
