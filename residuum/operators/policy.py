"""High-confidence candidates, uncertainty-first deferral and what it covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.columns import clip, error_risk, finite, or_null
from residuum.operators.prefix import kth_row

RUN_KEYS = ["model", "dataset", "test_run"]
GRID_KEYS = ["confidence_threshold", "uncertainty_reject_fraction"]


def table_flags(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per table (= key): does any row carry a finite value of each column?"""
    return df.groupBy(*keys).agg(
        *[F.bool_or(finite(or_null(df, c)).isNotNull()).alias(f"has_{c}") for c in columns]
    )


def table_fallbacks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill base_pred and base_confidence for tables that carry none at all."""
    flags = table_flags(df, keys, ["base_pred", "base_confidence"])
    out = df.join(flags, list(keys))
    p = finite(or_null(df, "p_base"))
    pred = F.when(F.col("has_base_pred"), finite(or_null(df, "base_pred"))).otherwise(
        F.coalesce(p >= 0.5, F.lit(False)).cast("double")
    )
    conf = F.when(F.col("has_base_confidence"), finite(or_null(df, "base_confidence"))).otherwise(
        clip(2.0 * F.abs(p - 0.5), 0.0, 1.0)
    )
    return out.withColumns({"base_pred": pred, "base_confidence": conf}).drop(
        "has_base_pred", "has_base_confidence"
    )


def is_candidate(probability: Column, predicted: Column, confidence: Column, threshold: Column) -> Column:
    return F.coalesce(
        probability.isNotNull() & (predicted >= 0.5) & (confidence > threshold), F.lit(False)
    )


def policy_grid(thresholds: Sequence[float], fractions: Sequence[float]) -> Column:
    """The policy grid as one array, so crossing it with rows is a narrow step."""
    return F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("confidence_threshold"),
                F.lit(float(f)).alias("uncertainty_reject_fraction"),
            )
            for t in thresholds
            for f in fractions
        ]
    )


def candidates(
    df: DataFrame,
    thresholds: Sequence[float],
    fractions: Sequence[float],
    probability: str = "p_cal",
    source: str = "base",
) -> DataFrame:
    """Candidate rows of every policy, with their risk."""
    risk = error_risk(F.col(probability), F.col("base_pred"))
    confidence = {"base": F.col("base_confidence"), "calibrated": 1.0 - risk}.get(source)
    if confidence is None:
        raise ValueError(f"unknown confidence source: {source}")
    grid = df.withColumns({"risk": risk, "_confidence": confidence}).where(
        is_candidate(F.col(probability), F.col("base_pred"), F.col("_confidence"), F.lit(min(thresholds)))
    )
    grid = grid.withColumn("_p", F.explode(policy_grid(thresholds, fractions)))
    grid = grid.where(F.col("_confidence") > F.col("_p.confidence_threshold"))
    return grid.select("*", "_p.*").drop("_p", "_confidence").withColumn("confidence_source", F.lit(source))


def defer_riskiest(
    rows: DataFrame,
    keys: Sequence[str],
    risk: str = "risk",
    tie: str = "row_id",
    fraction: str = "uncertainty_reject_fraction",
) -> DataFrame:
    """Mark the riskiest share of each group 'deferred' and the others 'residual'.

    The share is rounded half-even; equal risks go by ``tie``. Only the cut row
    of each group is located, then every row compares itself with it.
    """
    keys = [*keys, *([] if fraction in keys else [fraction])]
    cuts = kth_row(rows, keys, risk, tie, F.rint(F.col("group_n") * F.col(fraction)))
    # one cut row per group; the rows stay where they are
    out = rows.join(F.broadcast(cuts), keys, "left")
    ahead = _ahead(F.col(risk), F.col(tie), F.col("cut_value"), F.col("cut_tie"))
    return out.withColumn("state", F.when(ahead, "deferred").otherwise("residual")).drop("cut_value", "cut_tie")


def _ahead(risk: Column, tie: Column, cut_value: Column, cut_tie: Column) -> Column:
    return F.coalesce((risk > cut_value) | ((risk == cut_value) & (tie <= cut_tie)), F.lit(False))


def policy_states(
    df: DataFrame,
    keys: Sequence[str],
    policies: Sequence[tuple[float, float]],
    probability: str = "p_cal",
    source: str = "base",
    tie: str = "row_id",
) -> DataFrame:
    """Candidate rows once, with one column per policy instead of one row.

    ``state_0``, ``state_1``, ... follow ``policies`` (threshold, reject fraction): 0 for
    residual, 1 for deferred, null where the row is no candidate. They agree with
    ``candidates`` and ``defer_riskiest``.
    """
    keys = list(keys)
    thresholds, fractions = sorted({t for t, _ in policies}), sorted({f for _, f in policies})
    rows = candidates(df, thresholds, fractions, probability, source)
    cuts = kth_row(rows, [*keys, *GRID_KEYS], "risk", tie, F.rint(F.col("group_n") * F.col(GRID_KEYS[1])))
    found = F.collect_list(F.struct(*GRID_KEYS, "cut_value", "cut_tie"))
    table = cuts.groupBy(*keys).agg(found.alias("_cuts"))
    # the lowest threshold alone holds every candidate once
    once = candidates(df, thresholds[:1], fractions[:1], probability, source).drop(*GRID_KEYS)
    once = once.join(F.broadcast(table), keys, "left")
    confidence = F.col("base_confidence") if source == "base" else 1.0 - F.col("risk")
    states = {}
    for i, (t, f) in enumerate(policies):
        at = F.get(F.filter("_cuts", lambda x: (x[GRID_KEYS[0]] == float(t)) & (x[GRID_KEYS[1]] == float(f))), F.lit(0))
        state = _ahead(F.col("risk"), F.col(tie), at["cut_value"], at["cut_tie"]).cast("int")
        states[f"state_{i}"] = F.when(confidence > float(t), state)
    return once.withColumns(states).drop("_cuts")


def coverage(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and errors of the candidate, deferred and residual sets of a policy."""
    deferred, residual = F.col("state") == "deferred", F.col("state") == "residual"
    wrong = F.col("base_wrong")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_n"),
        total(wrong).alias("candidate_error_count"),
        F.count_if(deferred).alias("deferred_n"),
        total(F.when(deferred, wrong)).alias("deferred_error_count"),
        F.count_if(residual).alias("residual_n"),
        total(F.when(residual, wrong)).alias("residual_error_count"),
        F.coalesce(
            F.min(F.when(residual, wrong)) != F.max(F.when(residual, wrong)), F.lit(False)
        ).alias("residual_has_two_classes"),
    )


def calibration_metrics(rows: DataFrame, keys: Sequence[str], risk: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error of a risk score."""
    keys = list(keys)
    p = clip(F.col(risk), 0.0, 1.0)
    valid = rows.where(F.col("base_wrong").isNotNull() & F.col(risk).isNotNull())
    binned = valid.withColumn("_bin", F.least(F.floor(p * bins), F.lit(bins - 1)))
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("base_wrong").alias("errors"),
        F.sum(p).alias("mass"),
        F.sum((p - F.col("base_wrong")) ** 2).alias("squares"),
    )
    n = F.sum("n")
    return per_bin.groupBy(*keys).agg(
        n.alias("calibration_n"),
        F.sum("errors").alias("error_count"),
        (F.sum("errors") / n).alias("error_rate"),
        (F.sum("mass") / n).alias("mean_predicted_error_risk"),
        (F.sum("squares") / n).alias("brier_error_risk"),
        (F.sum(F.abs(F.col("errors") - F.col("mass"))) / n).alias("ece_error_risk"),
    )


def calibration_rows(states: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Calibration metrics of raw and calibrated risk over three row scopes."""
    sources = F.explode(
        F.array(
            F.struct(F.lit("raw").alias("score_source"), F.col("raw_risk").alias("score")),
            F.struct(F.lit("calibrated").alias("score_source"), F.col("risk").alias("score")),
        )
    )
    long = states.withColumn("_scope", F.explode(F.array(F.lit("candidate"), F.col("state"))))
    long = long.select(*keys, F.col("_scope").alias("scope"), "base_wrong", sources.alias("_s"))
    long = long.select(*keys, "scope", "base_wrong", "_s.*")
    return calibration_metrics(long, [*keys, "scope", "score_source"], "score", bins)
