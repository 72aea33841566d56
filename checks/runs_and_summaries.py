"""Checked queries over run-level tables: selection, comparisons, summaries, checks.

The run-level tables come from fixed profile scores (risk, prior gap and source
counts), so Spark and SQL derive the same candidates; the fitted profiles are in
``fitted_profiles``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ranking_and_policy import BUDGETS, FOLD_CTES, METRIC_CTES, GRID_SQL, states
from checks.registry import check
from residuum.operators import folds, packed, policy, quality, ranking, selection, stats, support
from residuum.plans import audit, strengthening
from residuum.storage import cut

RUN = ["model", "dataset", "test_run"]
KEYS = audit.KEYS
KEYS_SQL = ", ".join(KEYS)
POLICY = audit.POLICY_KEYS
POLICY_SQL = ", ".join(POLICY)
KEY_DOUBLES = ["confidence_threshold", "uncertainty_reject_fraction"]
POLICY_DOUBLES = [*KEY_DOUBLES, "review_fraction"]
FOLD_VALUES = ["validation_fold_mean_auprc", "validation_fold_se_auprc"]

# profile, complexity, primary, score in SQL and in Spark
SCORES = {
    "uncertainty": (0, True, "risk"),
    "prior": (1, True, "s_base - s_prior"),
    "uncertainty_prior": (2, True, "risk * 2.0 + (s_base - s_prior) * 0.25"),
    "uncertainty_support": (2, True, "risk + 1.0 / (1.0 + source_drug_count)"),
    "uncertainty_prior_support": (3, True, "risk * 2.0 + (s_base - s_prior) * 0.25 + 1.0 / (1.0 + source_drug_count)"),
    "target_sequence_support": (3, False, "risk + 1.0 / (1.0 + source_target_count)"),
    "general_target_joint_support": (3, False, "risk + 1.0 / (1.0 + source_pair_count)"),
}
_double = lambda text: text.replace("2.0", "2.0::DOUBLE").replace("0.25", "0.25::DOUBLE").replace("1.0", "1.0::DOUBLE")

RUN_CTES = {
    "ax": f"""SELECT s.*, a.group_axis, CASE a.group_axis WHEN 'target' THEN pr_id ELSE dr_id END AS group_id,
                     coalesce(d.n, 0)::DOUBLE AS source_drug_count, coalesce(t.n, 0)::DOUBLE AS source_target_count, coalesce(p.n, 0)::DOUBLE AS source_pair_count
              FROM states s CROSS JOIN (VALUES ('target'), ('drug')) a(group_axis) LEFT JOIN source_counts d ON d.kind = 'drug' AND d.key_a = dr_id
              LEFT JOIN source_counts t ON t.kind = 'target' AND t.key_a = pr_id LEFT JOIN source_counts p ON p.kind = 'pair' AND p.key_a = dr_id AND p.key_b = pr_id""",
    "scored": "\nUNION ALL\n".join(
        f"SELECT {KEYS_SQL}, split, '{p}' AS profile, {c} AS complexity, {str(m).lower()} AS primary_candidate, row_id, group_id, state, base_wrong, {_double(e)} AS score FROM ax"
        for p, (c, m, e) in SCORES.items()),
    **{k: v for k, v in METRIC_CTES("SELECT * FROM scored", f"{KEYS_SQL}, split, profile").items()},
    **FOLD_CTES("SELECT * FROM ax WHERE split = 'validation' AND state = 'residual'", KEYS_SQL, "base_wrong"),
    "f_rows": f"""SELECT {KEYS_SQL}, profile, fold, score, base_wrong FROM scored JOIN fo_folds USING ({KEYS_SQL}, group_id)
                  WHERE split = 'validation' AND state = 'residual' AND score IS NOT NULL""",
    "f_steps": f"SELECT {KEYS_SQL}, profile, fold, score, count(*) AS n, sum(base_wrong) AS pos FROM f_rows GROUP BY ALL",
    "f_cum": f"""SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER k AS tn, sum(pos) OVER k AS tp FROM f_steps
                 WINDOW w AS (PARTITION BY {KEYS_SQL}, profile, fold ORDER BY score DESC), k AS (PARTITION BY {KEYS_SQL}, profile, fold)""",
    "f_ap": f"SELECT {KEYS_SQL}, profile, fold, CASE WHEN any_value(tp) > 0 AND any_value(tp) < any_value(tn) THEN sum(pos * cp / cn) / any_value(tp) END AS auprc FROM f_cum GROUP BY ALL",
    "f_mean": f"""SELECT {KEYS_SQL}, profile, round(avg(auprc), 12) AS validation_fold_mean_auprc, round(CASE WHEN count(auprc) = 1 THEN 0 ELSE stddev_samp(auprc) / sqrt(count(auprc)) END, 12) AS validation_fold_se_auprc,
                         count(auprc)::INT AS validation_finite_folds FROM f_ap GROUP BY ALL""",
    "info": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {c}, {str(m).lower()})" for p, (c, m, _) in SCORES.items()) + ") v(profile, complexity, primary_candidate)",
    "cv": f"SELECT o.* EXCLUDE (split), i.complexity, i.primary_candidate, f.* EXCLUDE ({KEYS_SQL}, profile) FROM m_out o JOIN info i USING (profile) LEFT JOIN f_mean f USING ({KEYS_SQL}, profile) WHERE split = 'validation'",
    "ct": "SELECT o.* EXCLUDE (split), i.complexity, i.primary_candidate FROM m_out o JOIN info i USING (profile) WHERE split = 'test'",
    **BUDGETS(0.1, 0.2),
    "cmp": "SELECT * FROM (VALUES " + ", ".join(str(c) for c in selection.CORE_COMPARISONS + selection.DIAGNOSTIC_COMPARISONS) + ") v(baseline_profile, augmented_profile, added_component)",
    "inc": f"""SELECT a.{', a.'.join(POLICY)}, 'validation' AS split, added_component, b.profile AS baseline_profile, a.profile AS augmented_profile,
                      a.validation_fold_mean_auprc - b.validation_fold_mean_auprc AS delta_validation_fold_mean_auprc, a.error_detection_auprc - b.error_detection_auprc AS delta_error_detection_auprc,
                      a.review_lift - b.review_lift AS delta_review_lift, a.retained_accuracy_gain_vs_residual - b.retained_accuracy_gain_vs_residual AS delta_retained_accuracy_gain_vs_residual
               FROM cmp JOIN cv b ON b.profile = baseline_profile JOIN cv a ON a.profile = augmented_profile AND {' AND '.join(f'a.{k} = b.{k}' for k in POLICY)}
               UNION ALL
               SELECT a.{', a.'.join(POLICY)}, 'test', added_component, b.profile, a.profile, NULL, a.error_detection_auprc - b.error_detection_auprc,
                      a.review_lift - b.review_lift, a.retained_accuracy_gain_vs_residual - b.retained_accuracy_gain_vs_residual
               FROM cmp JOIN ct b ON b.profile = baseline_profile JOIN ct a ON a.profile = augmented_profile AND {' AND '.join(f'a.{k} = b.{k}' for k in POLICY)}""",
    # one standard error selection
    "se_ok": f"""SELECT *, validation_fold_mean_auprc IS NOT NULL AND coalesce(validation_finite_folds, 0) >= 2 AS ok FROM cv WHERE primary_candidate""",
    "se_best": f"SELECT {POLICY_SQL}, profile AS best_profile, validation_fold_mean_auprc AS best_mean, coalesce(validation_fold_se_auprc, 0) AS best_se FROM se_ok WHERE ok QUALIFY row_number() OVER (PARTITION BY {POLICY_SQL} ORDER BY validation_fold_mean_auprc DESC, complexity, profile) = 1",
    "se_pick": f"""SELECT {POLICY_SQL}, profile, validation_fold_mean_auprc AS m, best_profile, best_mean, best_mean - best_se AS one_se_threshold FROM se_ok JOIN se_best USING ({POLICY_SQL})
                   WHERE ok AND validation_fold_mean_auprc >= best_mean - best_se QUALIFY row_number() OVER (PARTITION BY {POLICY_SQL} ORDER BY complexity, validation_fold_mean_auprc DESC, profile) = 1""",
    "se_base": f"SELECT {POLICY_SQL}, validation_fold_mean_auprc AS u FROM se_ok WHERE profile = 'uncertainty'",
    "se_gate": f"SELECT *, coalesce(profile <> 'uncertainty' AND m - u < 0.005, false) AS low FROM (SELECT DISTINCT {POLICY_SQL} FROM cv) LEFT JOIN se_pick USING ({POLICY_SQL}) LEFT JOIN se_base USING ({POLICY_SQL})",
    "sel": f"""SELECT {POLICY_SQL}, CASE WHEN profile IS NULL OR low THEN 'uncertainty' ELSE profile END AS selected_profile, profile IS NULL OR low OR profile = 'uncertainty' AS selection_fallback,
                      CASE WHEN profile IS NULL THEN 'no_finite_group_cv_candidate' WHEN low THEN 'gain_below_minimum' WHEN profile = 'uncertainty' THEN 'uncertainty_selected' ELSE 'one_standard_error' END AS selection_reason,
                      best_profile, best_mean, one_se_threshold, m - u AS validation_gain_vs_uncertainty FROM se_gate""",
    "sv": f"""SELECT c.*, s.selected_profile, {', '.join(f'u.{m} AS uncertainty_{m}, c.{m} - u.{m} AS delta_{m}_vs_uncertainty' for m in ranking.METRICS)}
              FROM sel s JOIN ct c USING ({POLICY_SQL}) JOIN ct u USING ({POLICY_SQL}) WHERE c.profile = s.selected_profile AND u.profile = 'uncertainty'""",
    "clus": f"""SELECT model, dataset, test_run, group_axis, confidence_source, {', '.join(f'avg({m}) AS {m}' for m in audit.SELECTED_MEASURES)} FROM sv GROUP BY ALL""",
    "clus_long": "SELECT * FROM (UNPIVOT clus ON " + ", ".join(audit.SELECTED_MEASURES) + " INTO NAME measure VALUE value)",
    "iclus": f"""SELECT model, dataset, test_run, group_axis, confidence_source, split, added_component, {', '.join(f'avg({m}) AS {m}' for m in audit.INCREMENT_MEASURES)} FROM inc GROUP BY ALL""",
    "iclus_long": "SELECT * FROM (UNPIVOT iclus ON " + ", ".join(audit.INCREMENT_MEASURES) + " INTO NAME measure VALUE value)",
}


POLICIES = [(0.8, 0.1), (0.8, 0.2), (0.9, 0.1), (0.9, 0.2)]
AXES = {"target": "pr_id", "drug": "dr_id"}
STATES = [f"state_{i}" for i in range(len(POLICIES))]


def runs(t):
    """Stored candidates of both splits, each once, with a state per policy and the profile scores' inputs."""

    def build_rows():
        rows = policy.policy_states(t.base(), [*RUN, "split"], POLICIES, "p_base")
        rows = rows.select(*RUN, "split", "confidence_source", "dr_id", "pr_id", "base_wrong", "risk", "s_base", "s_prior", *STATES)
        return support.attach_counts(rows, *t.counts(), kinds=["drug", "target", "pair"])

    return t.stored("run-rows", build_rows)


def _scores():
    return {p: F.expr(e.replace(".0", ".0D").replace("0.25", "0.25D")) for p, (_, _, e) in SCORES.items()}


def _policy_columns(i):
    """Threshold and fraction of the policy with number ``i``."""
    pick = lambda j: F.element_at(F.array(*[F.lit(float(p[j])) for p in POLICIES]), i + 1)
    return {"confidence_threshold": pick(0), "uncertainty_reject_fraction": pick(1)}


def _folded(t):
    """Validation candidates with their fold in each policy and group axis."""
    rows = runs(t).where("split = 'validation'")
    ids = packed.table_ids(rows, RUN, "_run")
    # one row per run
    rows = cut(rows.join(F.broadcast(ids), RUN), "run-validation-rows")
    out = rows
    for axis, column in AXES.items():
        counts = [
            f(F.when(F.col(s) == 0, v)).cast("bigint").alias(f"{n}{i}")
            for i, s in enumerate(STATES) for n, f, v in (("n", F.count, F.lit(1)), ("pos", F.sum, F.col("base_wrong")))
        ]
        groups = rows.groupBy("_run", F.col(column).alias("group_id")).agg(*counts)
        each = [F.struct(F.lit(i).alias("_policy"), F.col(f"n{i}").alias("n"), F.coalesce(f"pos{i}", F.lit(0)).alias("pos")) for i in range(len(POLICIES))]
        groups = groups.select("_run", "group_id", F.explode(F.array(*each)).alias("_g")).where("_g.n > 0").select("_run", "group_id", "_g.*")
        # dealing reads the groups several times: they are counted once
        dealt = folds.deal_groups(cut(groups, "run-groups"), ["_run", "_policy"])
        fold = [F.max(F.when(F.col("_policy") == i, F.col("fold"))).alias(f"{axis}_{i}") for i in range(len(POLICIES))]
        table = dealt.groupBy("_run", F.col("group_id").alias(column)).agg(*fold)
        out = out.join(table, ["_run", column], "left")
    member = {f"{a}_{i}": F.when(F.col(STATES[i]) == 0, F.col(f"{a}_{i}")) for a in AXES for i in range(len(POLICIES))}
    scores = {f"score_{p}": s for p, s in _scores().items()}
    # what the ranking reads, and no more: it passes over the rows more than once
    return cut(out.select(*RUN, "confidence_source", "base_wrong", *[c.alias(n) for n, c in {**member, **scores}.items()]), "run-folded")


def fold_table(t):
    def build():
        members = {f"{a}_{i}": 3 for a in AXES for i in range(len(POLICIES))}
        out = packed.packed_ranking(_folded(t), [*RUN, "confidence_source"], {p: F.col(f"score_{p}") for p in SCORES}, members, "base_wrong")
        out = out.withColumn("group_axis", F.split_part("member", F.lit("_"), F.lit(1)))
        out = out.withColumns(_policy_columns(F.split_part("member", F.lit("_"), F.lit(2)).cast("int")))
        return out.select(*KEYS, "profile", F.col("part").alias("fold"), F.col("total_n").alias("n"), F.col("total_pos").alias("positives"), "auroc", "auprc")

    return t.stored("run-folds", build)


def _candidates(t, split):
    def build():
        rows, keys = runs(t), [*RUN, "split", "confidence_source"]
        residual = rows.withColumns({s: F.when(F.col(s) == 0, 0) for s in STATES})
        ranked = packed.packed_ranking(residual, keys, _scores(), {s: 1 for s in STATES}, "base_wrong", [0.1, 0.2])
        ranked = ranked.select(
            *keys, "profile", F.split_part("member", F.lit("_"), F.lit(2)).cast("int").alias("_policy"),
            F.col("total_n").alias("universe_n"), F.col("total_pos").alias("universe_error_count"),
            F.col("auroc").alias("error_detection_auroc"), F.col("auprc").alias("error_detection_auprc"), F.col("hits").alias("_reviews"),
        )
        sides = [F.struct(F.lit(i).alias("_policy"), F.count(s).alias("n"), F.coalesce(F.sum(F.when(F.col(s) == 1, F.col("base_wrong"))), F.lit(0.0)).alias("e"))
                 for i, s in enumerate(STATES)]
        groups = rows.groupBy(*keys).agg(F.array(*sides).alias("_g")).select(*keys, F.explode("_g").alias("_g")).where("_g.n > 0")
        groups = groups.select(*keys, "_g._policy", F.col("_g.e").alias("deferred_error_count"))
        info = t.spark.createDataFrame(
            [(p, c, m) for p, (c, m, _) in SCORES.items()], "profile string, complexity int, primary_candidate boolean"
        )
        groups = groups.crossJoin(F.broadcast(info.select("profile")))
        out = ranking.review_metrics(ranked, [*keys, "_policy", "profile"], groups, [0.1, 0.2])
        out = out.withColumns(_policy_columns(F.col("_policy"))).drop("_policy")
        # the candidates of a policy do not depend on the axis: only its folds do
        out = out.withColumn("group_axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
        return out.join(F.broadcast(info), "profile")

    rows = t.stored("run-candidates", build).where(F.col("split") == split).drop("split")
    if split == "validation":
        rows = rows.join(stats.fold_mean_se(fold_table(t), [*KEYS, "profile"]), [*KEYS, "profile"], "left")
    return rows


def validation_runs(t):
    return t.stored("run-validation", lambda: _candidates(t, "validation"))


def test_runs(t):
    return t.stored("run-test", lambda: _candidates(t, "test"))


def increments(t):
    def build():
        table = selection.comparison_table(t.spark)
        v = selection.component_increments(
            validation_runs(t), table, POLICY, ["validation_fold_mean_auprc", *ranking.METRICS]
        ).withColumn("split", F.lit("validation"))
        e = selection.component_increments(test_runs(t), table, POLICY, ranking.METRICS).withColumn("split", F.lit("test"))
        return v.unionByName(e, allowMissingColumns=True)

    return t.stored("run-increments", build)


def choices(t):
    return t.stored(
        "run-choices",
        lambda: selection.select_one_standard_error(validation_runs(t), POLICY, 0.005, min_folds=2),
    )


def selected(t):
    return t.stored(
        "run-selected",
        lambda: selection.selected_vs_uncertainty(test_runs(t), choices(t), POLICY, ranking.METRICS),
    )


@check("fold_mean_and_error", f"SELECT {KEYS_SQL}, profile, validation_fold_mean_auprc, validation_fold_se_auprc, validation_finite_folds FROM f_mean",
       [*KEY_DOUBLES, *FOLD_VALUES], RUN_CTES)
def fold_mean_and_error(t):
    return stats.fold_mean_se(fold_table(t), [*KEYS, "profile"])


@check("parameter_grid_candidates", f"SELECT {POLICY_SQL}, profile, universe_n, reviewed_n, error_detection_auprc, review_error_rate FROM ct",
       [*POLICY_DOUBLES, "error_detection_auprc", "review_error_rate"], RUN_CTES)
def parameter_grid_candidates(t):
    return test_runs(t).select(*POLICY, "profile", "universe_n", "reviewed_n", "error_detection_auprc", "review_error_rate")


SEL_DOUBLES = [*POLICY_DOUBLES, "best_mean", "one_se_threshold", "validation_gain_vs_uncertainty"]


@check("one_standard_error_selection", "SELECT * FROM sel", SEL_DOUBLES, RUN_CTES)
def one_standard_error_selection(t):
    return selection.select_one_standard_error(validation_runs(t), POLICY, 0.005, min_folds=2)


POOL = {
    **RUN_CTES,
    "pool": f"SELECT model, dataset, test_run, group_axis, profile, complexity, avg(validation_fold_mean_auprc) AS v FROM cv WHERE primary_candidate GROUP BY ALL",
    "held": """SELECT p.*, d.dataset AS held_out_domain, 'leave_one_dataset_out' AS transfer_type FROM pool p, (SELECT DISTINCT dataset FROM pool) d WHERE p.dataset <> d.dataset
               UNION ALL SELECT p.*, d.model, 'leave_one_model_out' FROM pool p, (SELECT DISTINCT model FROM pool) d WHERE p.model <> d.model""",
    "g_stats": "SELECT transfer_type, held_out_domain, group_axis, profile, complexity, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS count, stddev_samp(v) / sqrt(greatest(count(v), 1)) AS se FROM held GROUP BY ALL",
    "g_best": "SELECT transfer_type, held_out_domain, group_axis, profile AS best_profile, mean AS best_mean, mean - coalesce(se, 0) AS one_se_threshold FROM g_stats QUALIFY row_number() OVER (PARTITION BY transfer_type, held_out_domain, group_axis ORDER BY mean DESC, complexity, profile) = 1",
    "g_pick": """SELECT s.*, best_profile, best_mean, one_se_threshold FROM g_stats s JOIN g_best USING (transfer_type, held_out_domain, group_axis) WHERE mean >= one_se_threshold
                 QUALIFY row_number() OVER (PARTITION BY transfer_type, held_out_domain, group_axis ORDER BY complexity, mean DESC, profile) = 1""",
    "g_sel": """SELECT p.transfer_type, p.held_out_domain, p.group_axis, CASE WHEN p.profile <> 'uncertainty' AND p.mean - u.mean < 0.005 THEN 'uncertainty' ELSE p.profile END AS selected_profile,
                       CASE WHEN p.profile <> 'uncertainty' AND p.mean - u.mean < 0.005 THEN 'gain_below_minimum' WHEN p.profile = 'uncertainty' THEN 'uncertainty_selected' ELSE 'global_one_standard_error' END AS selection_reason,
                       p.best_profile, p.best_mean, p.one_se_threshold, u.mean AS uncertainty_source_mean, p.mean - u.mean AS selected_gain_vs_uncertainty,
                       (SELECT count(DISTINCT (model, dataset, test_run)) FROM held h WHERE h.transfer_type = p.transfer_type AND h.held_out_domain = p.held_out_domain AND h.group_axis = p.group_axis) AS source_cluster_n
                FROM g_pick p JOIN g_stats u ON u.profile = 'uncertainty' AND u.transfer_type = p.transfer_type AND u.held_out_domain = p.held_out_domain AND u.group_axis = p.group_axis""",
}


def _held(t):
    keys = [*RUN, "group_axis", "profile", "complexity"]
    clusters = stats.cluster_means(validation_runs(t).where("primary_candidate"), keys, ["validation_fold_mean_auprc"])
    return selection.held_out_domains(clusters, {"leave_one_dataset_out": "dataset", "leave_one_model_out": "model"})


DOMAIN = ["transfer_type", "held_out_domain", "group_axis"]


@check("pooled_profile_statistics", "SELECT * FROM g_stats", ["mean", "std", "se"], POOL)
def pooled_profile_statistics(t):
    return selection.pooled_profiles(_held(t), DOMAIN)


@check("global_one_standard_error_selection", "SELECT * FROM g_sel",
       ["best_mean", "one_se_threshold", "uncertainty_source_mean", "selected_gain_vs_uncertainty"], POOL)
def global_one_standard_error_selection(t):
    return selection.select_global(_held(t), DOMAIN).drop("selection_fallback")


@check("component_increments", "SELECT * FROM inc", [*POLICY_DOUBLES, *audit.INCREMENT_MEASURES], RUN_CTES)
def component_increments(t):
    return increments(t).select(
        *POLICY, "split", "added_component", "baseline_profile", "augmented_profile", *audit.INCREMENT_MEASURES
    )


SV = ["delta_error_detection_auroc_vs_uncertainty", *audit.SELECTED_MEASURES, "uncertainty_review_lift"]


@check("selected_against_uncertainty", f"SELECT {POLICY_SQL}, selected_profile, {', '.join(SV)} FROM sv", [*POLICY_DOUBLES, *SV], RUN_CTES)
def selected_against_uncertainty(t):
    return selection.selected_vs_uncertainty(test_runs(t), choices(t), POLICY, ranking.METRICS).select(*POLICY, "selected_profile", *SV)


@check(
    "method_against_selected",
    f"""SELECT {POLICY_SQL}, c.profile AS method, c.error_detection_auprc - s.error_detection_auprc AS delta_error_detection_auprc_vs_selected,
               c.review_error_rate - s.review_error_rate AS delta_review_error_rate_vs_selected
        FROM ct c JOIN sv s USING ({POLICY_SQL}) WHERE c.profile IN ('prior', 'uncertainty_support')""",
    [*POLICY_DOUBLES, "delta_error_detection_auprc_vs_selected", "delta_review_error_rate_vs_selected"],
    RUN_CTES,
)
def method_against_selected(t):
    metrics = ["error_detection_auprc", "review_error_rate"]
    out = selection.methods_vs_selected(
        test_runs(t).withColumnRenamed("profile", "method"), selected(t), POLICY, ["prior", "uncertainty_support"], metrics
    )
    return out.select(*POLICY, "method", *[f"delta_{m}_vs_selected" for m in metrics])


# --- summaries ------------------------------------------------------------------------

CLUSTER = [*RUN, "group_axis", "confidence_source"]


@check("cluster_means", "SELECT * FROM clus", audit.SELECTED_MEASURES, RUN_CTES)
def cluster_means(t):
    return stats.cluster_means(selected(t), CLUSTER, audit.SELECTED_MEASURES)


def _long(t):
    return stats.long_measures(cluster_means(t), CLUSTER, audit.SELECTED_MEASURES)


STRATA = """SELECT group_axis, measure, sum(n)::BIGINT AS num_independent_runs, count(*) AS num_model_dataset_strata, avg(m) AS mean, sum(w) / sum(n)::DOUBLE AS run_win_rate FROM (
    SELECT group_axis, measure, model, dataset, avg(value) AS m, count(*) AS n, count(*) FILTER (value > 0) AS w FROM clus_long GROUP BY ALL) GROUP BY ALL"""


@check("summary_by_strata", STRATA, ["mean", "run_win_rate"], RUN_CTES)
def summary_by_strata(t):
    return stats.summary_of_strata(_long(t), ["group_axis"])


@check("summary_by_runs", "SELECT group_axis, measure, avg(value) AS mean, count(*) AS independent_runs, count(*) FILTER (value > 0) / count(*)::DOUBLE AS positive_fraction FROM clus_long GROUP BY ALL",
       ["mean", "positive_fraction"], RUN_CTES)
def summary_by_runs(t):
    return stats.summary_of_runs(_long(t), ["group_axis"])


ICLUSTER = [*RUN, "group_axis", "confidence_source", "split", "added_component"]


def _increment_long(t):
    clusters = stats.cluster_means(increments(t), ICLUSTER, audit.INCREMENT_MEASURES)
    return stats.long_measures(clusters, ICLUSTER, audit.INCREMENT_MEASURES)


@check("diagnostic_strata", """SELECT split, group_axis, model, dataset, measure, count(*) AS num_independent_runs, avg(value) AS mean, count(*) FILTER (value > 0) / count(*)::DOUBLE AS run_win_rate,
              min(value) AS min, max(value) AS max FROM iclus_long WHERE added_component = 'target_sequence_support' GROUP BY ALL""", ["mean", "run_win_rate", "min", "max"], RUN_CTES)
def diagnostic_strata(t):
    rows = _increment_long(t).where("added_component = 'target_sequence_support'")
    return stats.strata_table(rows, ["split", "group_axis"])


@check("leave_one_out_summary", """SELECT x.model AS excluded, split, group_axis, added_component, measure, avg(value) AS mean, count(*) AS independent_runs, count(*) FILTER (value > 0) / count(*)::DOUBLE AS positive_fraction
       FROM iclus_long l, (SELECT DISTINCT model FROM iclus) x WHERE l.model <> x.model GROUP BY ALL""", ["mean", "positive_fraction"], RUN_CTES)
def leave_one_out_summary(t):
    return stats.summary_of_runs(stats.leave_one_out(_increment_long(t), "model"), ["excluded", "split", "group_axis", "added_component"])


@check("heterogeneity_axes", "\nUNION ALL\n".join(
    f"SELECT group_axis, '{a}' AS heterogeneity_axis, {a} AS stratum, {', '.join(f'avg({m}) AS {m}' for m in audit.SELECTED_MEASURES)} FROM clus GROUP BY ALL" for a in RUN), audit.SELECTED_MEASURES, RUN_CTES)
def heterogeneity_axes(t):
    return stats.heterogeneity(cluster_means(t), ["group_axis"], RUN, audit.SELECTED_MEASURES)


DIRECTION = """SELECT coalesce(v.model, e.model) AS model, coalesce(v.dataset, e.dataset) AS dataset, coalesce(v.test_run, e.test_run) AS test_run, coalesce(v.group_axis, e.group_axis) AS group_axis,
      v.delta_validation_fold_mean_auprc AS validation_delta, e.delta_error_detection_auprc AS test_delta,
      CASE WHEN v.delta_validation_fold_mean_auprc IS NOT NULL AND e.delta_error_detection_auprc IS NOT NULL THEN sign(v.delta_validation_fold_mean_auprc) = sign(e.delta_error_detection_auprc) END AS same_direction,
      CASE WHEN v.delta_validation_fold_mean_auprc IS NOT NULL AND e.delta_error_detection_auprc IS NOT NULL THEN v.delta_validation_fold_mean_auprc > 0 AND e.delta_error_detection_auprc > 0 END AS both_positive
   FROM (SELECT * FROM iclus WHERE split = 'validation' AND added_component = 'prior') v FULL OUTER JOIN (SELECT * FROM iclus WHERE split = 'test' AND added_component = 'prior') e
     ON v.model = e.model AND v.dataset = e.dataset AND v.test_run = e.test_run AND v.group_axis = e.group_axis"""


def _directions(t):
    return strengthening.diagnostic_analysis(increments(t), "prior", 10, 2026)


@check("outer_pair_of_splits", DIRECTION, ["validation_delta", "test_delta"], RUN_CTES)
def outer_pair_of_splits(t):
    return _directions(t)["direction_runs"]


@check("direction_consistency", f"""SELECT group_axis, count(same_direction) AS num_independent_runs, avg(same_direction::INT) AS same_direction_rate, avg(both_positive::INT) AS both_positive_rate FROM ({DIRECTION}) GROUP BY group_axis""",
       ["same_direction_rate", "both_positive_rate"], RUN_CTES)
def direction_consistency(t):
    return _directions(t)["direction_summary"]


@check("budget_invariance", f"""SELECT {KEYS_SQL}, profile FROM ct GROUP BY ALL HAVING coalesce(min(review_lift) <> max(review_lift), false) OR (count(review_lift) > 0 AND count(review_lift) < count(*))""", KEY_DOUBLES, RUN_CTES)
def budget_invariance(t):
    return stats.budget_invariant(test_runs(t), [*KEYS, "profile"], ["review_lift"])


@check("smallest_budget_rows", f"SELECT {KEYS_SQL}, profile, review_fraction, error_detection_auprc, review_lift FROM ct WHERE review_fraction = 0.1", [*POLICY_DOUBLES, "error_detection_auprc", "review_lift"], RUN_CTES)
def smallest_budget_rows(t):
    return stats.smallest_budget(test_runs(t), [*KEYS, "profile"], ["error_detection_auprc", "review_lift"])


AB = [(a, s) for a in ("drug", "target") for s in ("validation", "test")]


@check("ablation_matrix", f"""WITH r AS (SELECT profile, group_axis, 'validation' AS split, error_detection_auprc AS v FROM cv UNION ALL SELECT profile, group_axis, 'test', error_detection_auprc FROM ct),
        w AS (SELECT profile, {', '.join(f"avg(v) FILTER (group_axis = '{a}' AND split = '{s}') AS {a}_{s}" for a, s in AB)} FROM r GROUP BY profile)
        SELECT w.*, {', '.join(f'w.{a}_{s} - u.{a}_{s} AS {a}_{s}_delta' for a, s in AB)} FROM w, w u WHERE u.profile = 'uncertainty'""",
       [f"{a}_{s}{d}" for a, s in AB for d in ("", "_delta")], RUN_CTES)
def ablation_matrix(t):
    rows = validation_runs(t).select("profile", "group_axis", F.lit("validation").alias("split"), "error_detection_auprc")
    return stats.ablation_matrix(rows.unionByName(
        test_runs(t).select("profile", "group_axis", F.lit("test").alias("split"), "error_detection_auprc")))


SPACE = f"""SELECT dataset, count(*) AS policy_rows, avg(c) AS mean_high_conf_positive, median(c)::DOUBLE AS median_high_conf_positive, avg(r) AS mean_residual_candidates, median(r)::DOUBLE AS median_residual_candidates,
     avg(e) AS mean_residual_errors, median(e) AS median_residual_errors, quantile_cont(e, 0.25) AS p25_residual_errors, quantile_cont(e, 0.75) AS p75_residual_errors,
     avg(e / r) AS mean_residual_error_prevalence, median(e / r) AS median_residual_error_prevalence FROM (
       SELECT {GRID_SQL}, count(*) AS c, count(*) FILTER (state = 'residual') AS r, sum(base_wrong) FILTER (state = 'residual') AS e FROM states WHERE split = 'test' GROUP BY ALL) GROUP BY dataset"""
SPACE_DOUBLES = ["mean_high_conf_positive", "median_high_conf_positive", "mean_residual_candidates", "median_residual_candidates", "mean_residual_errors",
                 "median_residual_errors", "p25_residual_errors", "p75_residual_errors", "mean_residual_error_prevalence", "median_residual_error_prevalence"]


def _space(t):
    keys = [*RUN, "split", *KEY_DOUBLES]
    return stats.residual_space(policy.coverage(states(t).where("split = 'test'"), keys), ["dataset"])


@check("residual_space_summary", SPACE, SPACE_DOUBLES)
def residual_space_summary(t):
    return _space(t)


@check("residual_space_ratios", f"""WITH s AS ({SPACE}) SELECT f.dataset || '_vs_' || o.dataset AS comparison, f.mean_high_conf_positive / o.mean_high_conf_positive AS high_conf_positive_ratio,
       f.mean_residual_candidates / o.mean_residual_candidates AS residual_candidates_ratio, f.mean_residual_errors / o.mean_residual_errors AS residual_errors_ratio,
       f.mean_residual_error_prevalence - o.mean_residual_error_prevalence AS residual_error_prevalence_difference FROM s f, s o WHERE f.dataset = 'F' AND o.dataset <> 'F'""",
       ["high_conf_positive_ratio", "residual_candidates_ratio", "residual_errors_ratio", "residual_error_prevalence_difference"])
def residual_space_ratios(t):
    return stats.residual_space_ratios(_space(t), "F")


CURVE = {
    **RUN_CTES,
    "cov": f"SELECT {KEYS_SQL}, count(*) AS candidate_n, count(*) FILTER (state = 'deferred') AS deferred_n FROM ax WHERE split = 'test' GROUP BY ALL",
    "act": f"SELECT s.*, (deferred_n + reviewed_n)::DOUBLE / candidate_n AS x, combined_recall_of_candidate_errors AS y, uncertainty_combined_recall_of_candidate_errors AS u FROM sv s JOIN cov USING ({KEYS_SQL})",
    "seg": f"SELECT *, x - lag(x) OVER w AS dx, y + lag(y) OVER w AS yy, u + lag(u) OVER w AS uu FROM act WHERE y IS NOT NULL AND u IS NOT NULL WINDOW w AS (PARTITION BY {KEYS_SQL} ORDER BY x, review_fraction)",
    "area": f"""SELECT {KEYS_SQL}, sum(dx * yy) / 2 / (max(x) - min(x)) AS selected_normalized_action_auc, sum(dx * uu) / 2 / (max(x) - min(x)) AS uncertainty_normalized_action_auc,
                       sum(dx * (yy - uu)) / 2 / (max(x) - min(x)) AS delta_normalized_action_auc_vs_uncertainty FROM seg GROUP BY ALL HAVING count(*) >= 2 AND max(x) > min(x)""",
}
CURVE_VALUES = ["selected_normalized_action_auc", "uncertainty_normalized_action_auc", "delta_normalized_action_auc_vs_uncertainty"]


def _actions(t):
    sizes = policy.coverage(folds.by_axes(states(t).where("split = 'test'"), ["target", "drug"]), KEYS)
    return stats.action_columns(selected(t).join(sizes.select(*KEYS, "candidate_n", "deferred_n"), KEYS))


@check("action_curve_area", "SELECT * FROM area", [*KEY_DOUBLES, *CURVE_VALUES], CURVE)
def action_curve_area(t):
    return stats.action_curve_area(_actions(t), KEYS)


@check("equal_action_budget", f"""SELECT {POLICY_SQL}, selected_profile, deferred_n + reviewed_n AS total_action_n, (deferred_n + reviewed_n)::DOUBLE / candidate_n AS total_action_fraction,
       delta_combined_recall_of_candidate_errors_vs_uncertainty FROM sv JOIN cov USING ({KEYS_SQL})""",
       [*POLICY_DOUBLES, "total_action_fraction", "delta_combined_recall_of_candidate_errors_vs_uncertainty"], CURVE)
def equal_action_budget(t):
    return _actions(t).select(*POLICY, "selected_profile", "total_action_n", "total_action_fraction",
                              "delta_combined_recall_of_candidate_errors_vs_uncertainty")


def BOOT(long: str, keys: str, n: int, seed: int) -> dict[str, str]:
    draw = lambda *p: "CAST(concat('0x', substr(md5(concat_ws('-', " + ", ".join(p) + ")), 1, 7)) AS BIGINT)"
    return {
        "b_rows": f"SELECT {keys}, measure, model, dataset, value, row_number() OVER (PARTITION BY {keys}, measure, model, dataset ORDER BY value, test_run) - 1 AS i FROM {long}",
        "b_str": f"SELECT *, row_number() OVER (PARTITION BY {keys}, measure ORDER BY model, dataset) - 1 AS s FROM (SELECT {keys}, measure, model, dataset, count(*) AS size FROM b_rows GROUP BY ALL)",
        "b_n": f"SELECT {keys}, measure, count(*) AS strata FROM b_str GROUP BY ALL",
        "b_slot": f"SELECT {keys}, measure, b, slot, {draw(str(seed), 'b', 'slot')} % strata AS s FROM b_n, range(0, {n}) x(b), LATERAL (SELECT unnest(range(0, strata)) AS slot)",
        "b_draw": f"SELECT p.{', p.'.join(keys.split(', '))}, p.measure, b, slot, p.s, j, {draw(str(seed), 'b', 'slot', 'j')} % size AS i FROM b_slot p JOIN b_str USING ({keys}, measure, s), LATERAL (SELECT unnest(range(0, size)) AS j)",
        "b_mean": f"SELECT {keys}, measure, b, slot, avg(value) AS m FROM b_draw JOIN b_str USING ({keys}, measure, s) JOIN b_rows USING ({keys}, measure, model, dataset, i) GROUP BY ALL",
        "b_val": f"SELECT {keys}, measure, b, avg(m) AS m FROM b_mean GROUP BY ALL",
        "b_ci": f"SELECT {keys}, measure, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM b_val GROUP BY ALL",
    }


@check("stratified_bootstrap_interval", "SELECT * FROM b_ci", ["ci_low", "ci_high"], {**RUN_CTES, **BOOT("clus_long", "group_axis", 2000, 2026)})
def stratified_bootstrap_interval(t):
    return stats.bootstrap_interval(_long(t), ["group_axis"], 2000, 2026)


@check("summary_only_rebuild", f"SELECT * FROM ({STRATA}) JOIN b_ci USING (group_axis, measure)", ["mean", "run_win_rate", "ci_low", "ci_high"],
       {**RUN_CTES, **BOOT("clus_long", "group_axis", 1000, 2026)})
def summary_only_rebuild(t):
    return audit.summarise_selected(selected(t), 1000, 2026)[1]


@check("deduplication_sensitivity", f"""SELECT model, dataset, test_run, group_axis, confidence_source, avg(CASE WHEN dataset = 'F' THEN delta_error_detection_auprc_vs_uncertainty / 2 ELSE delta_error_detection_auprc_vs_uncertainty END) AS delta_error_detection_auprc_vs_uncertainty
       FROM sv GROUP BY ALL""", ["delta_error_detection_auprc_vs_uncertainty"], RUN_CTES)
def deduplication_sensitivity(t):
    rows = selected(t).withColumn(
        "delta_deduplicated_error_detection_auprc_vs_uncertainty", F.col("delta_error_detection_auprc_vs_uncertainty") / 2
    )
    adjusted = audit.dedup_sensitivity(rows, "f")[1]
    return stats.cluster_means(adjusted, CLUSTER, ["delta_error_detection_auprc_vs_uncertainty"])


@check("diagnostic_analysis", """SELECT split, group_axis, measure, sum(n)::BIGINT AS num_independent_runs, count(*) AS num_model_dataset_strata, avg(m) AS mean, sum(w) / sum(n)::DOUBLE AS run_win_rate FROM (
      SELECT split, group_axis, CASE split WHEN 'validation' THEN 'delta_validation_fold_mean_auprc' ELSE 'delta_error_detection_auprc' END AS measure, model, dataset, avg(value) AS m, count(*) AS n, count(*) FILTER (value > 0) AS w
      FROM iclus_long WHERE added_component = 'prior' AND measure = CASE split WHEN 'validation' THEN 'delta_validation_fold_mean_auprc' ELSE 'delta_error_detection_auprc' END GROUP BY ALL) GROUP BY ALL""",
       ["mean", "run_win_rate"], RUN_CTES)
def diagnostic_analysis(t):
    return _directions(t)["overall"].drop("ci_low", "ci_high")


TR = {
    **POOL,
    "tr": f"""SELECT g.transfer_type, g.held_out_domain, {', '.join(f'c.{k}' for k in POLICY)}, c.profile AS transferred_profile, {', '.join(f'c.{m} - u.{m} AS delta_{m}_vs_uncertainty' for m in strengthening.TRANSFER_METRICS)}
              FROM ct c JOIN ct u ON u.profile = 'uncertainty' AND {' AND '.join(f'c.{k} = u.{k}' for k in POLICY)} JOIN g_sel g ON g.group_axis = c.group_axis AND g.selected_profile = c.profile
               AND g.held_out_domain = CASE g.transfer_type WHEN 'leave_one_dataset_out' THEN c.dataset ELSE c.model END""",
}
TR_VALUES = [f"delta_{m}_vs_uncertainty" for m in strengthening.TRANSFER_METRICS]


@check("cross_domain_transfer", f"SELECT * FROM tr", [*POLICY_DOUBLES, *TR_VALUES], TR)
def cross_domain_transfer(t):
    out = strengthening.transfer(validation_runs(t), test_runs(t))[1]
    return out.select("transfer_type", "held_out_domain", *POLICY, "transferred_profile", *TR_VALUES)


@check("cross_domain_transfer_summary", f"""SELECT transfer_type, held_out_domain, group_axis, transferred_profile, 'delta_error_detection_auprc_vs_uncertainty' AS measure, avg(v) AS mean, count(v) AS independent_runs,
       count(*) FILTER (v > 0) / count(v)::DOUBLE AS positive_fraction FROM (SELECT transfer_type, held_out_domain, group_axis, transferred_profile, model, dataset, test_run, avg(delta_error_detection_auprc_vs_uncertainty) AS v FROM tr GROUP BY ALL)
       WHERE v IS NOT NULL GROUP BY ALL""", ["mean", "positive_fraction"], TR)
def cross_domain_transfer_summary(t):
    runs_ = strengthening.transfer(validation_runs(t), test_runs(t))[1]
    out = strengthening.transfer_summary(runs_, 10, 2026)
    return out.where("measure = 'delta_error_detection_auprc_vs_uncertainty'").drop("ci_low", "ci_high")


def _paired(t):
    methods = (
        validation_runs(t).withColumn("split", F.lit("validation"))
        .unionByName(test_runs(t).withColumn("split", F.lit("test")), allowMissingColumns=True)
        .withColumnRenamed("profile", "method").withColumn("model_status", F.lit("complete"))
    )
    return strengthening.paired_policy_runs(methods, selected(t), "uncertainty_prior_support")


HET = {
    **RUN_CTES,
    "pp": f"""SELECT {', '.join(f's.{k}' for k in KEYS)}, s.selected_profile, hv.error_detection_auprc - pv.error_detection_auprc AS delta_validation_auprc, hv.validation_fold_mean_auprc - pv.validation_fold_mean_auprc AS delta_validation_fold_mean_auprc,
                     ht.error_detection_auprc - pt.error_detection_auprc AS delta_test_auprc FROM sel s
              JOIN cv pv ON pv.profile = s.selected_profile AND {' AND '.join(f'pv.{k} = s.{k}' for k in POLICY)} JOIN cv hv ON hv.profile = 'uncertainty_prior_support' AND {' AND '.join(f'hv.{k} = s.{k}' for k in POLICY)}
              JOIN ct pt ON pt.profile = s.selected_profile AND {' AND '.join(f'pt.{k} = s.{k}' for k in POLICY)} JOIN ct ht ON ht.profile = 'uncertainty_prior_support' AND {' AND '.join(f'ht.{k} = s.{k}' for k in POLICY)}
              WHERE s.review_fraction = 0.1""",
}
PP = ["delta_validation_auprc", "delta_validation_fold_mean_auprc", "delta_test_auprc"]


@check("baseline_policy_pairs", "SELECT * FROM pp", [*KEY_DOUBLES, *PP], HET)
def baseline_policy_pairs(t):
    return _paired(t).select(*KEYS, "selected_profile", *PP)


@check("baseline_heterogeneity", f"""WITH c AS (SELECT model, dataset, test_run, group_axis, {', '.join(f'avg({p}) AS {p}' for p in PP)} FROM pp GROUP BY ALL),
        l AS (SELECT * FROM (UNPIVOT c ON {', '.join(PP)} INTO NAME measure VALUE value))
        SELECT group_axis, measure, avg(value) AS mean, count(*) AS independent_runs, count(*) FILTER (value > 0) / count(*)::DOUBLE AS positive_fraction FROM l GROUP BY ALL""", ["mean", "positive_fraction"], HET)
def baseline_heterogeneity(t):
    clusters = strengthening.paired_clusters(_paired(t))
    return strengthening.paired_summaries(clusters, 10, 2026)["overall_summary"].drop("ci_low", "ci_high")


# --- table checks -------------------------------------------------------------------------


@check("unique_key_check", """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_key_check(t):
    return quality.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@check("cartesian_coverage", """WITH e AS (SELECT DISTINCT model, dataset, test_run FROM base), x AS (SELECT e.*, s.split, b.p FROM e, (VALUES ('validation'), ('test')) s(split), (VALUES ('prior'), ('absent')) b(p)),
        o AS (SELECT DISTINCT model, dataset, test_run, split, CASE WHEN base_confidence > 0.5 THEN 'prior' ELSE 'other' END AS p FROM base)
        SELECT *, 'missing' AS problem FROM (SELECT * FROM x EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM x)""")
def cartesian_coverage(t):
    wanted = t.base().select(*RUN).distinct()
    wanted = wanted.withColumn("split", F.explode(F.array(F.lit("validation"), F.lit("test"))))
    wanted = wanted.withColumn("p", F.explode(F.array(F.lit("prior"), F.lit("absent"))))
    have = t.base().withColumn("p", F.when(F.col("base_confidence") > 0.5, "prior").otherwise("other"))
    return quality.coverage_gaps(wanted, have, [*RUN, "split", "p"])


@check("table_equality", """SELECT id, cluster, 'left' AS side FROM drug_map EXCEPT ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'left' FROM part
       UNION ALL (SELECT CAST(p_partkey AS VARCHAR), p_brand, 'right' FROM part EXCEPT ALL SELECT id, cluster, 'right' FROM drug_map)""")
def table_equality(t):
    left = t.counts()[1]
    right = t.raw("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("cluster"))
    return quality.table_difference(left, right)


@check("availability_gates", """SELECT model, dataset, test_run, flag FROM (SELECT model, dataset, test_run, count(*) FILTER (label = 0) > 1180 AS many, count(*) FILTER (s_prior > 3.5) > 30 AS strong FROM base GROUP BY ALL)
       UNPIVOT (ok FOR flag IN (many, strong)) WHERE NOT ok""")
def availability_gates(t):
    rows = t.base().groupBy(*RUN).agg(
        (F.count_if(F.col("label") == 0) > 1180).alias("many"), (F.count_if(F.col("s_prior") > 3.5) > 30).alias("strong")
    )
    return quality.unavailable_flags(rows, RUN, ["many", "strong"])


@check("conditional_coverage", f"""WITH w AS (SELECT {GRID_SQL} FROM states WHERE split = 'test' AND state = 'residual' GROUP BY ALL HAVING count(*) > 0), h AS (SELECT DISTINCT model, dataset, test_run, confidence_threshold FROM states WHERE split = 'test' AND confidence_threshold = 0.8)
       SELECT DISTINCT model, dataset, test_run, printf('%.12g', confidence_threshold) AS confidence_threshold, 'missing' AS problem FROM w ANTI JOIN h USING (model, dataset, test_run, confidence_threshold)""")
def conditional_coverage(t):
    cov = policy.coverage(states(t), [*RUN, "split", *KEY_DOUBLES])
    rows = states(t).where("split = 'test' and confidence_threshold = 0.8")
    return quality.conditional_gaps(rows, cov, [*RUN, "confidence_threshold"])


@check("dataset_specific_presence", """WITH w AS (SELECT DISTINCT model, dataset, test_run FROM base WHERE dataset = 'F'), h AS (SELECT DISTINCT model, dataset, test_run FROM base WHERE model <> 'A')
       SELECT *, 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""")
def dataset_specific_presence(t):
    return quality.dataset_only_gaps(t.base().where("model <> 'A'"), t.base(), "f", RUN)


@check("expected_row_counts", f"""SELECT 'candidates' AS "table", 30 * 2 * 4 * 2 * 7 AS expected, (SELECT count(*) FROM ct) AS observed, (SELECT count(*) FROM ct) = 3360 AS ok
       UNION ALL SELECT 'selected', 30 * 2 * 4 * 2, (SELECT count(*) FROM sel), (SELECT count(*) FROM sel) = 480""", ctes=RUN_CTES)
def expected_row_counts(t):
    return quality.count_check({"candidates": (test_runs(t), 30 * 2 * 4 * 2 * 7), "selected": (choices(t), 30 * 2 * 4 * 2)})


@check("shard_merge", f"SELECT {POLICY_SQL}, profile, error_detection_auprc FROM ct", [*POLICY_DOUBLES, "error_detection_auprc"], RUN_CTES)
def shard_merge(t):
    rows = test_runs(t).select(*POLICY, "profile", "error_detection_auprc")
    shards = [rows.where(F.col("model") == m) for m in ("A", "N", "R")]
    return quality.merge_shards(shards, [*POLICY, "profile"])


@check("provenance_conflicts", "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def provenance_conflicts(t):
    rows = t.raw("lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return quality.conflicting_rows(rows, ["l_partkey", "l_suppkey"])
