"""Checked queries: support attachment, fit features, fitted profiles, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ranking_and_policy import FOLD_CTES
from checks.registry import check
from checks.support_and_joins import COSINE, NEAREST
from residuum.operators import profiles, ranking, selection
from residuum.operators.folds import assign_folds, by_axes
from residuum.plans import audit, evidence, strengthening
from residuum.storage import cut

RUN = ["model", "dataset", "test_run"]
KEYS = audit.KEYS
SETTINGS = audit.AuditSettings(
    thresholds=(0.8,), reject_fractions=(0.1,), axes=("target",), review_fractions=(0.1, 0.2, 0.3),
    resamples=500, dedup_dataset="F",
)
SETS = "SELECT * FROM (VALUES {}) v(f)"


def support_tables(t):
    """Everything but the slow neighbour tables is cheap; those are stored once."""
    hits, ids = t.hits(), t.vectors()
    return evidence.build_support(
        t.train(), t.related(), t.fingerprints(), t.vectors(), hits, hits, targets=ids
    )


def supported(t):
    return t.stored("supported", lambda: evidence.attach_support(t.base(), support_tables(t)))


SUPPORT_CTES = {
    "cos_near": NEAREST(COSINE),
    "tan_near": "SELECT id, min(distance) AS nearest, avg(distance) AS density FROM drug_near GROUP BY id",
    "dir_near": "SELECT v.id, 1 - coalesce(max(score), 0) AS nearest, 1 - coalesce(sum(score), 0) / 5 AS density FROM vecs v LEFT JOIN target_near n ON n.query_id = v.id GROUP BY v.id",
    "fam_hits": "SELECT * FROM hits WHERE identity >= 30 AND query_coverage >= 0.5 AND evalue <= 0.001",
    "fam_seen": "SELECT DISTINCT target FROM fam_hits WHERE query_id IN (SELECT pr_id FROM train)",
    "fam_near": "SELECT id, 1 - coalesce(s, 0) AS distance, 1.0 / (1 + coalesce(n, 0)) AS sparsity FROM vecs LEFT JOIN (SELECT query_id, max(support_score) AS s, count(DISTINCT target) AS n FROM fam_hits WHERE target IN (SELECT target FROM fam_seen) GROUP BY query_id) ON query_id = id",
    "joint_best": """SELECT p.d, p.t, max((1 - n.distance) * m.score) AS best FROM (SELECT DISTINCT dr_id AS d, pr_id AS t FROM base) p JOIN drug_near n ON n.id = p.d JOIN target_near m ON m.query_id = p.t
                     JOIN (SELECT DISTINCT dr_id, pr_id FROM train) s ON s.dr_id = n.neighbour AND s.pr_id = m.target_id WHERE NOT (n.neighbour = p.d AND m.target_id = p.t) GROUP BY ALL""",
}
SUPPORT_COLUMNS = [
    "source_drug_count", "drug_morgan_nearest_train_distance", "target_esm_knn_distance", "native_domain_shift_score",
    "native_support_imbalance", "target_direct_knn_distance", "target_mmseqs_nearest_train_distance",
    "target_mmseqs_family_sparsity", "joint_nearest_train_distance",
]


@check(
    "support_attachment",
    """SELECT c.row_id, source_drug_count, d.nearest AS drug_morgan_nearest_train_distance, v.density AS target_esm_knn_distance,
              CASE WHEN d.nearest IS NOT NULL AND v.nearest IS NOT NULL THEN greatest(d.nearest, v.nearest) END AS native_domain_shift_score, abs(d.nearest - v.nearest) AS native_support_imbalance,
              r.density AS target_direct_knn_distance, f.distance AS target_mmseqs_nearest_train_distance, f.sparsity AS target_mmseqs_family_sparsity, 1 - coalesce(j.best, 0) AS joint_nearest_train_distance
       FROM counted c LEFT JOIN tan_near d ON d.id = c.dr_id LEFT JOIN cos_near v ON v.id = c.pr_id LEFT JOIN dir_near r ON r.id = c.pr_id LEFT JOIN fam_near f ON f.id = c.pr_id
       LEFT JOIN joint_best j ON j.d = c.dr_id AND j.t = c.pr_id""",
    SUPPORT_COLUMNS,
    SUPPORT_CTES,
)
def support_attachment(t):
    return supported(t).select("row_id", *SUPPORT_COLUMNS)


@check(
    "support_builders",
    """WITH d AS (SELECT DISTINCT dr_id AS id FROM base), r AS (SELECT DISTINCT pr_id AS id FROM base), w AS (
         SELECT 'native_drug' AS store, 'drug' AS side, true AS core, count(*) AS entities, count(s.id) AS covered FROM d LEFT JOIN tan_near s USING (id)
         UNION ALL SELECT 'native_target', 'target', true, count(*), count(s.id) FROM r LEFT JOIN cos_near s USING (id)
         UNION ALL SELECT 'sequence_family', 'target', false, count(*), count(s.id) FROM r LEFT JOIN fam_near s USING (id)
         UNION ALL SELECT 'direct_target', 'target', false, count(*), count(s.id) FROM r LEFT JOIN dir_near s USING (id))
       SELECT *, covered::DOUBLE / entities AS coverage, true AS core_complete FROM w""",
    ["coverage"],
    SUPPORT_CTES,
)
def support_builders(t):
    ids = lambda c: t.base().select(F.col(c).alias("id")).distinct()
    return evidence.support_coverage(support_tables(t), ids("dr_id"), ids("pr_id"))


@check(
    "evidence_store_build",
    """WITH ph AS (SELECT doc_id, text, lang AS phase FROM documents)
       SELECT CAST(doc_id AS VARCHAR) AS id, length(trim(text))::BIGINT AS text_length, CASE WHEN trim(text) = '' THEN 'missing' ELSE 'ok' END AS status, phase AS phases,
              CASE WHEN v.id IS NULL THEN 28 ELSE 92 END::BIGINT AS feature_dim FROM ph LEFT JOIN vecs v ON v.id = CAST(doc_id AS VARCHAR)""",
)
def evidence_store_build(t):
    docs = t.raw("documents").select(
        F.col("doc_id").alias("dr_id"), F.col("doc_id").alias("pr_id"), "text", F.col("lang").alias("phase")
    )
    store = evidence.evidence_store(docs, "text", "text", t.vectors())
    dims = store["target_prior"].select("id", F.col("feature_dim").cast("bigint").alias("feature_dim"))
    return store["target_entity"].join(dims, "id").select(
        "id", F.col("text_length").cast("bigint").alias("text_length"), "status", "phases", "feature_dim"
    )


# --- fit features ------------------------------------------------------------------------

ONE_POLICY = "confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1 AND state = 'residual'"
FIT_CTES = {
    "fx": f"SELECT *, pr_id AS group_id FROM states WHERE {ONE_POLICY}",
    **FOLD_CTES("SELECT * FROM fx WHERE split = 'validation'", "model, dataset, test_run", "base_wrong"),
    "fv": "SELECT x.*, f.fold, f.n_folds FROM fx x LEFT JOIN fo_folds f USING (model, dataset, test_run, group_id) WHERE split = 'validation'",
    "fe": """SELECT v.*, u.fit, CASE WHEN v.fold = u.fit THEN 'held' ELSE 'fit' END AS role FROM fv v, (VALUES (-1), (0), (1), (2)) u(fit) WHERE fit = -1 OR fit < n_folds""",
    "fd": "SELECT model, dataset, test_run, fit, dr_id, count(*) AS n FROM fe WHERE role = 'fit' GROUP BY ALL",
    "ft": "SELECT model, dataset, test_run, fit, pr_id, count(*) AS n FROM fe WHERE role = 'fit' GROUP BY ALL",
    "fa": """SELECT model, dataset, test_run, fit, role, row_id, dr_id, pr_id FROM fe UNION ALL SELECT model, dataset, test_run, -1, 'held', row_id, dr_id, pr_id FROM fx WHERE split = 'test'""",
    "fc": """SELECT a.*, coalesce(d.n, 0) - CASE role WHEN 'fit' THEN 1 ELSE 0 END AS cd, coalesce(t.n, 0) - CASE role WHEN 'fit' THEN 1 ELSE 0 END AS ct2 FROM fa a
             LEFT JOIN fd d USING (model, dataset, test_run, fit, dr_id) LEFT JOIN ft t USING (model, dataset, test_run, fit, pr_id)""",
}
FIT_NAMES = ["log_drug_fit_count", "log_target_fit_count", "fit_entity_support_min", "fit_entity_support_imbalance", "fit_joint_novelty", "fit_one_sided_novelty"]


def _policy_rows(t):
    from checks.ranking_and_policy import first_states

    rows = first_states(t).where("state = 'residual'")
    rows = by_axes(rows, ["target"]).withColumn("p_cal", F.col("p_base"))
    own = rows.where("split = 'validation'")
    return assign_folds(own, KEYS, "base_wrong"), rows.where("split = 'test'")


@check(
    "fit_support_features",
    """SELECT row_id, CAST(fit AS INT) AS fit, role, ln(1 + cd) AS log_drug_fit_count, ln(1 + ct2) AS log_target_fit_count, least(ln(1 + cd), ln(1 + ct2)) AS fit_entity_support_min,
              abs(ln(1 + cd) - ln(1 + ct2)) AS fit_entity_support_imbalance, CASE WHEN cd = 0 AND ct2 = 0 THEN 1.0 ELSE 0.0 END AS fit_joint_novelty,
              CASE WHEN (cd = 0) <> (ct2 = 0) THEN 1.0 ELSE 0.0 END AS fit_one_sided_novelty FROM fc""",
    FIT_NAMES,
    FIT_CTES,
)
def fit_support_features(t):
    own, test = _policy_rows(t)
    frames = profiles.fit_frames(cut(own, "own"), test, KEYS, 3)
    value = lambda n: F.get(F.col("x"), F.lit(profiles.FEATURES.index(n))).alias(n)
    return frames.select("row_id", "fit", "role", *[value(n) for n in FIT_NAMES])


def full_stage(t):
    """States, coverage and fitted profiles of one policy with all support columns."""
    rows, states = audit.calibrated_states(supported(t), SETTINGS)
    coverage = cut(audit.full_coverage(states, audit.policy_frame(rows, SETTINGS)), "coverage")
    return states, coverage, audit.profile_stage(states, coverage, SETTINGS)


_STAGES: dict = {}


def stage(t):
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STAGES:
        _STAGES[key] = full_stage(t)
    return _STAGES[key]


@check("hybrid_ranker_fit")
def hybrid_ranker_fit(t):
    frames = stage(t)[2].frames
    coefs = profiles.fit_rankers(frames, KEYS)
    return coefs.select(*KEYS, "fit", "profile", F.size("used").alias("features"), "intercept")


@check("ranker_scoring")
def ranker_scoring(t):
    frames = stage(t)[2].frames
    coefs = cut(profiles.fit_rankers(frames, KEYS, [strengthening.FULL_PROFILE]), "full-profile")
    return profiles.score_rows(frames, coefs, KEYS).select(*KEYS, "fit", "profile", "row_id", "score")


CERTIFIED = ("prior", "uncertainty_prior", "uncertainty_support", "uncertainty_prior_support")


@check(
    "ranker_certificates",
    f"""WITH f AS (SELECT model, dataset, test_run, CAST(fit AS INT) AS fit, count(*) FILTER (role = 'fit') AS rows, CAST(coalesce(sum(base_wrong) FILTER (role = 'fit'), 0) AS BIGINT) AS ones,
                      count(*) FILTER (role = 'held') AS held FROM fc JOIN (SELECT row_id, model, dataset, test_run, base_wrong FROM fx) b USING (row_id, model, dataset, test_run) GROUP BY ALL)
        SELECT model, dataset, test_run, fit, profile, rows, CASE WHEN ones BETWEEN 1 AND rows - 1 THEN least(5000, ones * (rows - ones)) ELSE 0 END AS pairs,
               ones BETWEEN 1 AND rows - 1 AS fitted, ones BETWEEN 1 AND rows - 1 AS converged, CASE WHEN ones BETWEEN 1 AND rows - 1 THEN held ELSE 0 END AS scored,
               CASE WHEN ones BETWEEN 1 AND rows - 1 THEN held ELSE 0 END AS agreeing
        FROM f, (VALUES {", ".join(f"('{p}')" for p in CERTIFIED)}) p(profile) WHERE rows > 0""",
    (),
    FIT_CTES,
)
def ranker_certificates(t):
    """Rows and pairs of each fit, its gradient at the coefficients, and scores recomputed term by term from them."""
    own, test = _policy_rows(t)
    frames = cut(profiles.fit_frames(cut(own, "own"), test, KEYS, 3), "certificate-frames")
    chosen = [p for p in profiles.PRIMARY_PROFILES if p.name in CERTIFIED]
    coefs = cut(profiles.fit_rankers(frames, KEYS, chosen), "certificates")
    scores = profiles.score_rows(frames, coefs, KEYS)
    keys = [*KEYS, "fit", "profile", "row_id"]
    terms = frames.where("role = 'held'").join(coefs.where("slope is not null"), [*KEYS, "fit"]).select(
        *keys, "intercept", "slope", "fill", F.posexplode("x").alias("i", "v"))
    sums = terms.groupBy(*keys).agg(F.sum(F.get("slope", F.col("i")) * F.coalesce("v", F.get("fill", F.col("i")))).alias("s"), F.max("intercept").alias("intercept"))
    both = scores.join(sums.select(*keys, (1 / (1 + F.exp(-F.col("s") - F.col("intercept")))).alias("again")), keys)
    counted = both.groupBy(*KEYS, "fit", "profile").agg(
        F.count("score").alias("scored"), F.count_if(F.abs(F.col("score") - F.col("again")) < 1e-9).alias("agreeing"))
    return coefs.join(counted, [*KEYS, "fit", "profile"], "left").select(
        *RUN, "fit", "profile", "rows", "pairs", F.col("slope").isNotNull().alias("fitted"),
        (F.coalesce("converged", F.lit(False)) & (F.coalesce("gradient", F.lit(1.0)) < 1e-6)).alias("converged"),
        F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"))


@check("cross_fitted_profiles")
def cross_fitted_profiles(t):
    states, coverage, fitted = stage(t)
    return audit.candidate_rows(fitted, coverage, SETTINGS, "validation")


@check("profile_fit_for_test")
def profile_fit_for_test(t):
    states, coverage, fitted = stage(t)
    return audit.candidate_rows(fitted, coverage, SETTINGS, "test")


_BOOSTED: dict = {}


def boosted(t):
    """Scores and fits of the boosted baseline over all fits of one policy, trained once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _BOOSTED:
        own, test = _policy_rows(t)
        scores, fits = strengthening.boosted_scores(profiles.fit_frames(cut(own, "own"), test, KEYS, 3), KEYS)
        _BOOSTED[key] = cut(scores, "boosted-scores"), fits
    return _BOOSTED[key]


@check("boosted_tree_baseline")
def boosted_tree_baseline(t):
    scores, _ = boosted(t)
    split = F.when(F.col("fit") >= 0, "validation").otherwise("test")
    return ranking.auc_metrics(scores.withColumn("split", split), [*KEYS, "split", "fit"], "score", "base_wrong")


@check(
    "boosted_tree_fits",
    """SELECT model, dataset, test_run, CAST(fit AS INT) AS fit, count(*) FILTER (role = 'fit') AS n, CAST(coalesce(sum(base_wrong) FILTER (role = 'fit'), 0) AS BIGINT) AS ones,
              CASE WHEN coalesce(sum(base_wrong) FILTER (role = 'fit'), 0) IN (0, count(*) FILTER (role = 'fit')) THEN 'single_class' ELSE 'complete' END AS status,
              CASE WHEN coalesce(sum(base_wrong) FILTER (role = 'fit'), 0) IN (0, count(*) FILTER (role = 'fit')) THEN 0 ELSE count(*) FILTER (role = 'held') END AS scored
       FROM fc JOIN (SELECT row_id, model, dataset, test_run, base_wrong FROM fx) b USING (row_id, model, dataset, test_run) GROUP BY ALL HAVING n > 0""",
    (),
    FIT_CTES,
)
def boosted_tree_fits(t):
    scores, fits = boosted(t)
    scored = scores.groupBy(*KEYS, "fit").agg(F.count("score").alias("scored"))
    return fits.join(scored, [*KEYS, "fit"], "left").select(*RUN, "fit", "n", "ones", "status", F.coalesce("scored", F.lit(0)).alias("scored"))


@check("falsified_ranker")
def falsified_ranker(t):
    return strengthening.falsification_deltas(strengthening.falsified_folds(stage(t)[2], SETTINGS))


@check(
    "scalar_baselines",
    f"""SELECT model, dataset, test_run, split, row_id, v.method, CASE v.method WHEN 'raw_uncertainty' THEN risk WHEN 'base_logit' THEN -s_base ELSE s_prior END AS score
        FROM states, (VALUES ('raw_uncertainty'), ('base_logit'), ('prior_logit')) v(method) WHERE {ONE_POLICY}""",
    ["score"],
)
def scalar_baselines(t):
    from checks.ranking_and_policy import first_states

    rows = first_states(t)
    rows = rows.withColumns({"group_axis": F.lit("target"), "minus_logit": -F.col("s_base")})
    methods = {"raw_uncertainty": "raw_risk", "base_logit": "minus_logit", "prior_logit": "s_prior"}
    return strengthening.scalar_scores(rows, methods).select(*RUN, "split", "row_id", "method", "score")


@check("base_and_prior_predictors")
def base_and_prior_predictors(t):
    out = strengthening.train_predictors(
        t.entity_counted(), ["l_quantity", "source_drug_count", "source_target_count"], ["base_confidence", "source_pair_count", "l_quantity"]
    )
    scores = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("score")) for c in ("s_base", "s_prior", "s_full")]))
    long = out.select("model", "dataset", "split", "label", scores.alias("_s")).select("model", "dataset", "split", "label", "_s.*")
    return ranking.auc_of_large_groups(long, ["model", "dataset", "split", "channel"], "score", "label")


@check("formal_audit")
def formal_audit(t):
    states, coverage, fitted = stage(t)
    validation = cut(audit.candidate_rows(fitted, coverage, SETTINGS, "validation"), "audit-validation")
    test = cut(audit.candidate_rows(fitted, coverage, SETTINGS, "test"), "audit-test")
    choices = cut(selection.select_one_standard_error(validation, audit.POLICY_KEYS, 0.005, min_folds=2), "audit-choices")
    return selection.selected_vs_uncertainty(test, choices, audit.POLICY_KEYS, ranking.METRICS)


@check("strengthening_methods")
def strengthening_methods(t):
    states, coverage, fitted = stage(t)
    return strengthening.budget_methods(states, fitted, coverage, SETTINGS)


@check("strengthening_summaries")
def strengthening_summaries(t):
    states, coverage, fitted = stage(t)
    methods = cut(strengthening.budget_methods(states, fitted, coverage, SETTINGS), "methods")
    validation = cut(audit.candidate_rows(fitted, coverage, SETTINGS, "validation"), "budget-validation")
    choices = selection.select_one_standard_error(validation, audit.POLICY_KEYS, 0.005)
    selected = cut(strengthening.selected_budgets(methods, cut(choices, "budget-choices")), "budget-selected")
    tables = strengthening.budget_summaries(selected, methods, 200, 2026)
    return tables["equal_budget_summary"]
