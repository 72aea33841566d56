"""Checked queries: policy states, ranking metrics, thresholds, folds, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from residuum.functions import columns as C
from residuum.operators import calibration, dedup, folds, policy, prefix, ranking, registry
from residuum.operators.logistic import fit_platt
from residuum.storage import cut

RUN = ["model", "dataset", "test_run"]
GRID = [*RUN, "split", "confidence_threshold", "uncertainty_reject_fraction"]
GRID_SQL = "model, dataset, test_run, split, confidence_threshold, uncertainty_reject_fraction"


def states(t):
    """Candidates of four policies on raw probabilities, deferred or residual."""

    def build():
        rows = policy.candidates(t.base(), [0.8, 0.9], [0.1, 0.2], "p_base")
        rows = rows.withColumn("raw_risk", F.col("risk"))
        return policy.defer_riskiest(rows, GRID)

    return t.stored("raw-states", build)


def first_states(t):
    """The rows of ``states`` under the policy (0.8, 0.1) alone: no other policy is worked out or stored."""

    def build():
        rows = policy.candidates(t.base(), [0.8], [0.1], "p_base")
        return policy.defer_riskiest(rows.withColumn("raw_risk", F.col("risk")), GRID)

    return t.stored("first-states", build)


@check(
    "uncertainty_first_deferral",
    f"SELECT {GRID_SQL}, row_id, state FROM states",
    ["confidence_threshold", "uncertainty_reject_fraction"],
)
def uncertainty_first_deferral(t):
    rows = policy.candidates(t.base(), [0.8, 0.9], [0.1, 0.2], "p_base")
    return policy.defer_riskiest(rows, GRID).select(*GRID, "row_id", "state")


@check(
    "policy_coverage",
    f"""SELECT {GRID_SQL}, count(*) AS candidate_n, sum(base_wrong) AS candidate_error_count,
               count(*) FILTER (state = 'deferred') AS deferred_n, coalesce(sum(base_wrong) FILTER (state = 'deferred'), 0) AS deferred_error_count,
               count(*) FILTER (state = 'residual') AS residual_n, coalesce(sum(base_wrong) FILTER (state = 'residual'), 0) AS residual_error_count,
               coalesce(min(base_wrong) FILTER (state = 'residual') <> max(base_wrong) FILTER (state = 'residual'), false) AS residual_has_two_classes
        FROM states GROUP BY ALL""",
    ["confidence_threshold", "uncertainty_reject_fraction", "candidate_error_count", "deferred_error_count", "residual_error_count"],
)
def policy_coverage(t):
    return policy.coverage(states(t), GRID)


@check(
    "calibration_metrics",
    """SELECT model, dataset, test_run, split, sum(n)::BIGINT AS calibration_n, sum(e) AS error_count, sum(e) / sum(n) AS error_rate, sum(m) / sum(n) AS mean_predicted_error_risk,
              sum(q) / sum(n) AS brier_error_risk, sum(abs(e - m)) / sum(n) AS ece_error_risk FROM (
         SELECT model, dataset, test_run, split, least(floor(r * 10), 9) AS b, count(*) AS n, sum(base_wrong) AS e, sum(r) AS m, sum((r - base_wrong) ** 2) AS q
         FROM (SELECT *, CASE WHEN base_pred >= 0.5 THEN 1 - p_base ELSE p_base END AS r FROM base) GROUP BY ALL) GROUP BY ALL""",
    ["error_count", "error_rate", "mean_predicted_error_risk", "brier_error_risk", "ece_error_risk"],
)
def calibration_metrics(t):
    rows = t.base().withColumn("risk", C.error_risk(F.col("p_base"), F.col("base_pred")))
    return policy.calibration_metrics(rows, [*RUN, "split"], "risk")


@check(
    "calibration_diagnostics",
    f"""WITH l AS (SELECT {GRID_SQL}, 'candidate' AS scope, risk, base_wrong FROM states UNION ALL SELECT {GRID_SQL}, state, risk, base_wrong FROM states),
             s AS (SELECT *, 'raw' AS score_source FROM l UNION ALL SELECT *, 'calibrated' FROM l),
             b AS (SELECT {GRID_SQL}, scope, score_source, least(floor(risk * 10), 9) AS b, count(*) AS n, sum(base_wrong) AS e, sum(risk) AS m,
                          sum((risk - base_wrong) ** 2) AS q FROM s GROUP BY ALL)
        SELECT {GRID_SQL}, scope, score_source, sum(n)::BIGINT AS calibration_n, sum(e) AS error_count, sum(e) / sum(n) AS error_rate, sum(m) / sum(n) AS mean_predicted_error_risk,
               sum(q) / sum(n) AS brier_error_risk, sum(abs(e - m)) / sum(n) AS ece_error_risk FROM b GROUP BY ALL""",
    ["confidence_threshold", "uncertainty_reject_fraction", "error_count", "error_rate", "mean_predicted_error_risk", "brier_error_risk", "ece_error_risk"],
)
def calibration_diagnostics(t):
    return policy.calibration_rows(states(t), GRID)


@check(
    "table_level_availability",
    """SELECT model, dataset, test_run, bool_or(label IS NOT NULL) AS has_label, false AS has_nothing,
              bool_or(s_prior IS NOT NULL AND dataset = 'F') AS has_shown, false AS has_absent FROM base GROUP BY ALL""",
)
def table_level_availability(t):
    rows = t.base().withColumns(
        {"nothing": F.lit(float("nan")), "shown": F.when(F.col("dataset") == "F", F.col("s_prior"))}
    )
    return policy.table_flags(rows, RUN, ["label", "nothing", "shown", "absent"])


# --- ranking -------------------------------------------------------------------

METRIC_CTES = lambda rows, keys: {
    "m_rows": rows,
    "m_steps": f"SELECT {keys}, score, count(*) AS n, sum(base_wrong) AS pos FROM m_rows WHERE score IS NOT NULL AND base_wrong IS NOT NULL AND state = 'residual' GROUP BY ALL",
    "m_cum": f"""SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER k AS tn, sum(pos) OVER k AS tp FROM m_steps
                 WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), k AS (PARTITION BY {keys})""",
    "m_size": """SELECT *, CASE WHEN tn > 1 THEN least(greatest(round_even(tn * review_fraction, 0), 1), tn - 1) ELSE tn END AS r
                 FROM m_cum, m_budgets""",
    "m_rank": f"""SELECT {keys}, review_fraction, any_value(tn) AS universe_n, any_value(tp) AS universe_error_count,
                        CASE WHEN any_value(tp) > 0 AND any_value(tp) < any_value(tn) THEN
                          sum(pos * ((tn - tp) - ((cn - n) - (cp - pos)) - 0.5 * (n - pos))) / any_value(tp * (tn - tp)) END AS error_detection_auroc,
                        CASE WHEN any_value(tp) > 0 AND any_value(tp) < any_value(tn) THEN sum(pos * cp / cn) / any_value(tp) END AS error_detection_auprc,
                        any_value(r) AS r, sum(pos * least(greatest((r - (cn - n)) / n, 0), 1)) AS hits FROM m_size GROUP BY {keys}, review_fraction""",
    "m_side": f"SELECT {keys}, coalesce(sum(base_wrong) FILTER (state = 'deferred'), 0) AS de FROM m_rows GROUP BY ALL",
    "m_all": f"""SELECT {keys}, review_fraction, coalesce(universe_n, 0)::BIGINT AS universe_n, coalesce(universe_error_count, 0) AS universe_error_count,
                       universe_error_count / universe_n AS universe_error_rate, error_detection_auroc, error_detection_auprc,
                       (CASE WHEN universe_n >= 20 THEN r ELSE 0 END)::BIGINT AS reviewed_n, CASE WHEN universe_n >= 20 THEN hits END AS review_error_count, de
                FROM (m_side CROSS JOIN m_budgets) LEFT JOIN m_rank USING ({keys}, review_fraction)""",
    "m_out": f"""SELECT * EXCLUDE (de), review_error_count / greatest(reviewed_n, 1) AS review_error_rate,
                       review_error_count / greatest(reviewed_n, 1) / greatest(universe_error_rate, 1e-8) AS review_lift,
                       review_error_count / greatest(universe_error_count, 1e-8) AS review_recall_of_residual_errors,
                       (de + review_error_count) / greatest(universe_error_count + de, 1e-8) AS combined_recall_of_candidate_errors,
                       CASE WHEN universe_n - reviewed_n > 0 AND review_error_count IS NOT NULL THEN 1 - (universe_error_count - review_error_count) / (universe_n - reviewed_n) END AS retained_accuracy_after_review,
                       CASE WHEN universe_n - reviewed_n > 0 AND review_error_count IS NOT NULL THEN 1 - (universe_error_count - review_error_count) / (universe_n - reviewed_n) END
                         - (1 - universe_error_rate) AS retained_accuracy_gain_vs_residual FROM m_all""",
}
BUDGETS = lambda *f: {"m_budgets": "SELECT * FROM (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in f) + ") v(review_fraction)"}
METRIC_DOUBLES = ["review_fraction", "universe_error_count", "universe_error_rate", "review_error_count", *ranking.METRICS]
GRID_DOUBLES = ["confidence_threshold", "uncertainty_reject_fraction"]


@check(
    "residual_review",
    "SELECT * FROM m_out",
    METRIC_DOUBLES,
    {**METRIC_CTES("""SELECT *, risk AS score FROM states WHERE confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1""",
                   "model, dataset, test_run, split"), **BUDGETS(0.2)},
)
def residual_review(t):
    rows = policy.candidates(t.base(), [0.8], [0.1], "p_base")
    rows = policy.defer_riskiest(rows, GRID).withColumn("score", F.col("risk"))
    return ranking.evaluate_ranking(rows, [*RUN, "split"], [0.2])


@check(
    "evaluate_ranking",
    "SELECT * FROM m_out",
    [*METRIC_DOUBLES, *GRID_DOUBLES],
    {**METRIC_CTES("SELECT *, round(abs(p_base - p_prior), 2) AS score FROM states", GRID_SQL), **BUDGETS(0.05, 0.1, 0.2, 0.3)},
)
def evaluate_ranking(t):
    rows = states(t).withColumn("score", F.round(F.abs(F.col("p_base") - F.col("p_prior")), 2))
    return ranking.evaluate_ranking(rows, GRID, [0.05, 0.1, 0.2, 0.3])


@check(
    "evaluate_ranking_without_broken_scores",
    "SELECT * FROM m_out",
    [*METRIC_DOUBLES, *GRID_DOUBLES],
    {**METRIC_CTES("SELECT *, CASE WHEN row_id % 7 <> 0 THEN round(abs(p_base - p_prior), 2) END AS score FROM states", GRID_SQL), **BUDGETS(0.05, 0.2)},
)
def evaluate_ranking_without_broken_scores(t):
    """NaN and infinite scores count like missing ones."""
    broken = F.when(F.col("row_id") % 14 == 0, F.lit(float("nan"))).when(F.col("row_id") % 7 == 0, F.lit(float("inf")))
    rows = states(t).withColumn("score", F.coalesce(broken, F.round(F.abs(F.col("p_base") - F.col("p_prior")), 2)))
    return ranking.evaluate_ranking(rows, GRID, [0.05, 0.2])


@check(
    "oracle_headroom",
    """SELECT model, dataset, test_run, split, reviewed_n, least(reviewed_n, universe_error_count) AS oracle_review_error_count,
              least(reviewed_n, universe_error_count) / greatest(reviewed_n, 1) AS oracle_review_error_rate,
              least(reviewed_n, universe_error_count) / greatest(universe_error_count, 1e-8) AS oracle_error_recall,
              least(reviewed_n, universe_error_count) - review_error_count AS max_possible_review_error_count_gain,
              CASE WHEN universe_error_count > 0 THEN review_error_count / least(reviewed_n, universe_error_count) END AS fraction_of_oracle_error_count
       FROM m_out""",
    ["oracle_review_error_count", "oracle_review_error_rate", "oracle_error_recall", "max_possible_review_error_count_gain", "fraction_of_oracle_error_count"],
    {**METRIC_CTES("""SELECT *, risk AS score FROM states WHERE confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1""",
                   "model, dataset, test_run, split"), **BUDGETS(0.2)},
)
def oracle_headroom(t):
    out = ranking.best_review(residual_review(t))
    return out.select(
        *RUN, "split", "reviewed_n", "oracle_review_error_count", "oracle_review_error_rate", "oracle_error_recall",
        "max_possible_review_error_count_gain", "fraction_of_oracle_error_count",
    )


AUC_SQL = """
    WITH v AS (SELECT model, dataset, test_run, split, round(p_prior, 2) AS s, base_wrong AS y FROM base WHERE p_prior IS NOT NULL),
         d AS (SELECT model, dataset, test_run, split, s, count(*) AS n, sum(y) AS pos FROM v GROUP BY ALL),
         w AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(n) OVER k AS tn, sum(pos) OVER k AS tp FROM d
               WINDOW o AS (PARTITION BY model, dataset, test_run, split ORDER BY s DESC), k AS (PARTITION BY model, dataset, test_run, split))"""


def _prior_rows(t):
    return t.base().withColumn("s", F.round("p_prior", 2))


@check(
    "area_under_roc",
    AUC_SQL + """, r AS (SELECT *, rank() OVER (PARTITION BY model, dataset, test_run, split ORDER BY s)
                              + (count(*) OVER (PARTITION BY model, dataset, test_run, split, s) - 1) / 2.0 AS rk FROM v)
        SELECT model, dataset, test_run, split, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc
        FROM r GROUP BY ALL""",
    ["auroc"],
)
def area_under_roc(t):
    return ranking.auc_metrics(_prior_rows(t), [*RUN, "split"], "s", "base_wrong").select(*RUN, "split", "auroc")


@check(
    "average_precision",
    AUC_SQL + " SELECT model, dataset, test_run, split, sum(pos * cp / cn) / any_value(tp) AS auprc FROM w GROUP BY ALL",
    ["auprc"],
)
def average_precision(t):
    return ranking.auc_metrics(_prior_rows(t), [*RUN, "split"], "s", "base_wrong").select(*RUN, "split", "auprc")


@check(
    "expected_top_k",
    AUC_SQL + """ SELECT model, dataset, test_run, split, any_value(k)::BIGINT AS reviewed_n,
                         sum(CASE WHEN cn <= k THEN pos WHEN cn - n < k THEN pos * (k - (cn - n)) / n ELSE 0 END) AS review_error_count
                  FROM (SELECT *, greatest(1, least(tn - 1, round_even(tn * 0.15::DOUBLE, 0))) AS k FROM w) GROUP BY ALL""",
    ["review_error_count"],
)
def expected_top_k(t):
    return ranking.expected_top_k(_prior_rows(t), [*RUN, "split"], "s", "base_wrong", 0.15)


@check(
    "confusion_metrics",
    """WITH c AS (SELECT model, dataset, test_run, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn,
                        count(*) FILTER (NOT p AND NOT y) AS tn FROM (SELECT *, p_base >= 0.5 AS p, label > 0.5 AS y FROM base WHERE label IS NOT NULL) GROUP BY ALL)
       SELECT model, dataset, test_run, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity,
              tp / (tp + fp) AS precision, (tp + tn) / (tp + tn + fp + fn) AS accuracy, 2.0 * tp / (2.0 * tp + fp + fn) AS f1,
              (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c""",
    ["tp", "fp", "fn", "tn", "sensitivity", "specificity", "precision", "accuracy", "f1", "mcc"],
)
def confusion_metrics(t):
    return ranking.confusion(t.base(), RUN, "p_base", "label")


@check(
    "class_weights",
    """SELECT model, dataset, test_run, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
              count(*) / (2.0 * count(*) FILTER (label = 1)) AS weight_positive, count(*) / (2.0 * count(*) FILTER (label = 0)) AS weight_negative,
              count(*) FILTER (label = 0) / (count(*) FILTER (label = 1))::DOUBLE AS pos_weight FROM base WHERE label IS NOT NULL GROUP BY ALL""",
    ["weight_positive", "weight_negative", "pos_weight"],
)
def class_weights(t):
    return registry.class_weights(t.base(), RUN, "label")


@check(
    "matthews_threshold",
    """WITH g AS (SELECT i, 0.05::DOUBLE + 0.005::DOUBLE * i AS th FROM range(0, 181) r(i)),
            c AS (SELECT model, dataset, test_run, i, count(*) FILTER (p >= th AND label = 1) AS tp, count(*) FILTER (p >= th AND label = 0) AS fp,
                         count(*) FILTER (p < th AND label = 1) AS fn, count(*) FILTER (p < th AND label = 0) AS tn
                  FROM (SELECT *, round(p_prior, 4) + 1e-12 AS p FROM base WHERE label IS NOT NULL AND p_prior IS NOT NULL), g GROUP BY ALL),
            m AS (SELECT *, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 12) AS mcc FROM c)
       SELECT model, dataset, test_run, round(0.05 + 0.005 * i, 3) AS threshold, mcc FROM m
       QUALIFY row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY mcc DESC, i) = 1""",
    ["threshold", "mcc"],
)
def matthews_threshold(t):
    rows = t.base().withColumn("p", F.round("p_prior", 4) + 1e-12)
    return ranking.mcc_threshold(rows, RUN, "p", "label")


RATES = """WITH d AS (SELECT model, dataset, test_run, s_prior AS s, count(*) AS n, sum(label) AS pos FROM base WHERE label IS NOT NULL AND s_prior IS NOT NULL GROUP BY ALL),
     w AS (SELECT *, sum(pos) OVER o / sum(pos) OVER k AS tpr, (sum(n) OVER o - sum(pos) OVER o) / (sum(n) OVER k - sum(pos) OVER k) AS fpr,
                  row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY s DESC) AS i FROM d
           WINDOW o AS (PARTITION BY model, dataset, test_run ORDER BY s DESC), k AS (PARTITION BY model, dataset, test_run))"""


@check(
    "youden_threshold",
    RATES + """ SELECT model, dataset, test_run, s AS threshold, round(tpr - fpr, 12) AS youden FROM w
        QUALIFY row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY round(tpr - fpr, 12) DESC, s DESC) = 1""",
    ["threshold", "youden"],
)
def youden_threshold(t):
    return ranking.youden_threshold(t.base(), RUN, "s_prior", "label")


@check(
    "rate_f1_threshold",
    RATES + """, c AS (SELECT *, lead(pos) OVER o AS np, lead(n) OVER o AS nn FROM w WINDOW o AS (PARTITION BY model, dataset, test_run ORDER BY s DESC)),
        q AS (SELECT *, row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY s DESC) AS j FROM c
              WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> n),
        f AS (SELECT *, round(2 * (tpr / (tpr + fpr)) * tpr / (tpr + tpr / (tpr + fpr) + 0.00001), 12) AS f1 FROM q WHERE j > 4)
        SELECT model, dataset, test_run, s AS threshold, f1 FROM f
        QUALIFY row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY f1 DESC, s DESC) = 1""",
    ["threshold", "f1"],
)
def rate_f1_threshold(t):
    return ranking.f1_threshold(t.base(), RUN, "s_prior", "label")


@check(
    "keep_first_dedupe",
    """SELECT query_id, target_id, support_score, bits FROM hits
       QUALIFY row_number() OVER (PARTITION BY query_id, target_id ORDER BY support_score DESC, bits DESC) = 1""",
    ["support_score", "bits"],
)
def keep_first_dedupe(t):
    return dedup.keep_first(t.hits(), ["query_id", "target_id"], ["support_score", "bits"])


@check(
    "prior_tendency_histogram",
    """WITH m AS (SELECT CAST(round_even(avg(label) * 10, 0) AS INT) AS k FROM base WHERE label IS NOT NULL GROUP BY dr_id)
       SELECT i / 10.0 AS tendency, count(k) AS entities, count(k) / (SELECT count(*) FROM m)::DOUBLE AS frequency
       FROM range(0, 11) r(i) LEFT JOIN m ON k = i GROUP BY i""",
    ["tendency", "frequency"],
)
def prior_tendency_histogram(t):
    return registry.tendency_histogram(t.base(), "dr_id", "label")


# --- folds and calibration -------------------------------------------------------

FOLD_CTES = lambda rows, keys, label, name="": {
    f"fo_groups{name}": f"SELECT {keys}, group_id, count(*) AS n, CAST(sum({label}) AS BIGINT) AS pos FROM ({rows}) GROUP BY ALL",
    f"fo_sizes{name}": f"SELECT {keys}, least(3, sum(pos), sum(n) - sum(pos), count(*)) AS k FROM fo_groups{name} GROUP BY ALL",
    f"fo_dealt{name}": f"""
        SELECT *, CASE WHEN ((pl - 1) // k) % 2 = 0 THEN (pl - 1) % k ELSE k - 1 - (pl - 1) % k END AS fold FROM (
          SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos DESC, n DESC, md5('2026-' || group_id), group_id) AS pl
          FROM fo_groups{name} JOIN fo_sizes{name} USING ({keys}) WHERE k >= 2)""",
    f"fo_checked{name}": f"""
        SELECT {keys} FROM (SELECT {keys}, fold, sum(pos) AS p, sum(n - pos) AS q, any_value(k) AS k FROM fo_dealt{name} GROUP BY {keys}, fold)
        GROUP BY {keys} HAVING min(p) > 0 AND min(q) > 0 AND sum(p) > max(p) AND sum(q) > max(q) AND count(*) = any_value(k)""",
    f"fo_folds{name}": f"SELECT {keys}, group_id, fold, k AS n_folds FROM fo_dealt{name} JOIN fo_checked{name} USING ({keys})",
}
AXES_SQL = """SELECT b.*, a.group_axis, CASE a.group_axis WHEN 'target' THEN pr_id WHEN 'drug' THEN dr_id WHEN 'pair' THEN dr_id || '::' || pr_id ELSE CAST(row_id AS VARCHAR) END AS group_id
              FROM base b, (VALUES ('target'), ('drug'), ('pair'), ('none')) a(group_axis) WHERE split = 'validation' AND label IS NOT NULL"""


@check(
    "grouped_stratified_folds",
    "SELECT model, dataset, test_run, group_axis, group_id, CAST(fold AS BIGINT) AS fold, CAST(n_folds AS BIGINT) AS n_folds FROM fo_folds",
    ctes=FOLD_CTES(AXES_SQL, "model, dataset, test_run, group_axis", "label"),
)
def grouped_stratified_folds(t):
    rows = folds.by_axes(t.base().where("split = 'validation' and label is not null"), ["target", "drug", "pair", "none"])
    out = folds.make_folds(rows, [*RUN, "group_axis"], "label")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("fold", "n_folds")})


def NEWTON(rows: str, keys: str, name: str, steps: int = 12, c: float = 1.0e6) -> dict[str, str]:
    """One-variable logistic fits by unrolled Newton steps (columns z, y)."""
    out = {
        f"{name}_in": f"SELECT {keys}, z, y FROM ({rows}) WHERE z IS NOT NULL AND y IS NOT NULL",
        f"{name}_0": f"""SELECT {keys}, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b, count(*) AS fit_n FROM {name}_in GROUP BY ALL
                         HAVING count(*) >= 4 AND min(y) <> max(y)""",
    }
    for i in range(1, steps + 1):
        out[f"{name}_{i}"] = f"""
            SELECT {keys}, w - (g1 * h22 - g2 * h12) / (h11 * h22 - h12 * h12) AS w,
                   b - (g2 * h11 - g1 * h12) / (h11 * h22 - h12 * h12) AS b, fit_n FROM (
              SELECT {keys}, any_value(w) AS w, any_value(b) AS b, any_value(fit_n) AS fit_n,
                     {c} * sum((p - y) * z) + any_value(w) AS g1, {c} * sum(p - y) AS g2,
                     {c} * sum(p * (1 - p) * z * z) + 1 AS h11, {c} * sum(p * (1 - p) * z) AS h12, {c} * sum(p * (1 - p)) AS h22
              FROM (SELECT {keys}, z, y, w, b, fit_n, 1 / (1 + exp(-(w * z + b))) AS p FROM {name}_in JOIN {name}_{i - 1} USING ({keys}))
              GROUP BY {keys})"""
    out[f"{name}_fit"] = f"SELECT {keys}, w AS slope, b AS intercept, fit_n FROM {name}_{steps}"
    return out


@check(
    "platt_fit",
    "SELECT * FROM nw_fit",
    ["slope", "intercept"],
    NEWTON("SELECT *, s_base AS z, label AS y FROM base WHERE split = 'validation'", "model, dataset, test_run", "nw"),
)
def platt_fit(t):
    return fit_platt(t.base().where("split = 'validation'"), RUN, "s_base", "label")


@check(
    "platt_fit_spread",
    "SELECT * FROM nw_fit",
    ["slope", "intercept"],
    NEWTON("SELECT *, s_base AS z, label AS y FROM base", "model, dataset", "nw"),
)
def platt_fit_spread(t):
    return fit_platt(t.base(), ["model", "dataset"], "s_base", "label", limit=100)


CAL_AXES = """SELECT b.*, a.group_axis, CASE a.group_axis WHEN 'target' THEN pr_id ELSE dr_id END AS group_id
              FROM base b, (VALUES ('target'), ('drug')) a(group_axis) WHERE split = 'validation'"""
CAL_CTES = {
    "cal_rows": CAL_AXES,
    **FOLD_CTES("SELECT * FROM cal_rows WHERE label IS NOT NULL", "model, dataset, test_run, group_axis", "label"),
    "cal_fold": """SELECT r.*, f.fold AS cal_fold, f.n_folds FROM cal_rows r LEFT JOIN fo_folds f
                   ON r.label IS NOT NULL AND r.model = f.model AND r.dataset = f.dataset AND r.test_run = f.test_run AND r.group_axis = f.group_axis AND r.group_id = f.group_id""",
    **NEWTON("SELECT c.*, u.fit, s_base AS z, label AS y FROM cal_fold c, (VALUES (0), (1), (2)) u(fit) WHERE cal_fold IS NOT NULL AND fit <> cal_fold AND fit < n_folds",
             "model, dataset, test_run, group_axis, fit", "nx"),
    "cal_done": """SELECT c.* EXCLUDE (cal_fold, n_folds), coalesce(CASE WHEN m.slope IS NOT NULL THEN cal_fold END, -1) AS cal_fold,
                          CASE WHEN m.slope IS NOT NULL THEN 1 / (1 + exp(-greatest(-40, least(40, m.slope * s_base + m.intercept)))) ELSE p_base END AS p_cal
                   FROM cal_fold c LEFT JOIN nx_fit m ON c.model = m.model AND c.dataset = m.dataset AND c.test_run = m.test_run AND c.group_axis = m.group_axis AND c.cal_fold = m.fit""",
}


@check(
    "cross_fitted_calibration",
    "SELECT model, dataset, test_run, group_axis, row_id, CAST(cal_fold AS BIGINT) AS cal_fold, p_cal FROM cal_done",
    ["p_cal"],
    CAL_CTES,
)
def cross_fitted_calibration(t):
    rows = t.base().where("split = 'validation'").select(*RUN, "row_id", "dr_id", "pr_id", "label", "s_base", "p_base")
    out = calibration.cross_fitted_calibration(rows, RUN, ["target", "drug"])
    return out.select(*RUN, "group_axis", "row_id", F.col("cal_fold").cast("bigint").alias("cal_fold"), "p_cal")


@check(
    "held_out_calibration",
    """SELECT b.model, b.dataset, b.test_run, row_id, CASE WHEN slope IS NOT NULL THEN 1 / (1 + exp(-(slope * s_base + intercept))) ELSE p_base END AS p_cal,
              CASE WHEN slope IS NOT NULL THEN 'fitted' ELSE 'raw_probability_fallback' END AS calibration_status
       FROM base b LEFT JOIN nw_fit f ON b.model = f.model AND b.dataset = f.dataset AND b.test_run = f.test_run WHERE split = 'test'""",
    ["p_cal"],
    NEWTON("SELECT *, s_base AS z, label AS y FROM base WHERE split = 'validation'", "model, dataset, test_run", "nw"),
)
def held_out_calibration(t):
    rows = t.base()
    out = calibration.held_out_calibration(rows.where("split = 'validation'"), rows.where("split = 'test'"), RUN)
    return out.select(*RUN, "row_id", "p_cal", "calibration_status")


@check(
    "prior_calibrators",
    """SELECT b.row_id, CASE WHEN slope IS NOT NULL AND s_prior IS NOT NULL THEN 1 / (1 + exp(-(slope * s_prior + intercept))) ELSE p_prior END AS p_prior_cal
       FROM base b LEFT JOIN nw_fit f ON b.model = f.model AND b.dataset = f.dataset AND b.test_run = f.test_run""",
    ["p_prior_cal"],
    NEWTON("SELECT *, s_prior AS z, label AS y FROM base WHERE split = 'validation'", "model, dataset, test_run", "nw"),
)
def prior_calibrators(t):
    rows = t.base()
    models = cut(fit_platt(rows.where("split = 'validation'"), RUN, "s_prior", "label"), "prior-models")
    return calibration.prior_probability(rows, models, RUN, "p_prior").select("row_id", "p_prior_cal")


@check(
    "group_medians",
    """SELECT model, dataset, test_run, median(s_prior) AS median FROM base WHERE s_prior IS NOT NULL GROUP BY ALL""",
    ["median"],
)
def group_medians(t):
    return prefix.medians(t.base(), RUN, "s_prior")
