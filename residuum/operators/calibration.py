"""Cross-fitted and held-out calibration of base and prior scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions.columns import clip, finite, or_null, sigmoid
from residuum.operators.folds import assign_folds, by_axes
from residuum.operators.logistic import LOCAL_ROWS, fit_platt, platt_probability
from residuum.storage import cut


def raw_probability(df: DataFrame):
    return clip(finite("p_base"), 0.0, 1.0) if "p_base" in df.columns else sigmoid(finite("s_base"))


def other_folds(rows: DataFrame) -> DataFrame:
    """Repeat each row once for every fold that trains on it, as ``fit``."""
    fits = F.filter(F.sequence(F.lit(0), F.col("n_folds") - 1), lambda f: f != F.col("fold"))
    return rows.withColumn("fit", F.explode(fits))


def cross_fitted_calibration(
    validation: DataFrame,
    keys: Sequence[str],
    axes: Sequence[str],
    folds: int = 3,
    seed: int = 2026,
    strict: bool = True,
    limit: int = LOCAL_ROWS,
) -> DataFrame:
    """Calibrated probability of every validation row under each group axis.

    Adds group_axis, group_id, p_cal, cal_fold (-1 where not cross-fitted) and
    calibration_status.
    """
    keys = [*keys, "group_axis"]
    rows = by_axes(validation, axes).withColumns(
        {"_y": finite("label"), "_z": finite(or_null(validation, "s_base")), "_raw": raw_probability(validation)}
    )
    valid = rows.where("_y is not null and _z is not null")
    counts = valid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.min("_y") != F.max("_y")).alias("_both")
    )
    fit_for = rows.join(counts, keys, "left")
    usable = F.col("_y").isNotNull() & F.col("_z").isNotNull() & (F.col("_n") >= 4) & F.col("_both")
    # fits, models and rows below all start from these folds
    tagged = cut(assign_folds(fit_for, keys, "_y", folds, seed, strict, usable), "calibration-folds")
    # equal rows of a fold are merged before they are repeated for the fits
    train = tagged.where("fold is not null").groupBy(*keys, "fold", "n_folds", "_y", "_z").agg(F.count(F.lit(1)).alias("_w"))
    models = fit_platt(other_folds(train), [*keys, "fit"], "_z", "_y", limit, copies="_w")
    models = cut(models.withColumnRenamed("fit", "fold"), "calibrators")
    done = models.select(*keys).distinct().withColumn("_fitted", F.lit(True))
    out = tagged.join(models, [*keys, "fold"], "left").join(done, keys, "left")
    enough = F.coalesce((F.col("_n") >= 4) & F.col("_both"), F.lit(False))
    status = (
        F.when(F.col("_fitted"), "cross_fitted")
        .when(~enough, "raw_probability_fallback")
        .otherwise("raw_probability_group_fallback")
    )
    fitted = F.col("slope").isNotNull()
    return out.withColumns(
        {
            "p_cal": clip(F.when(fitted, platt_probability(F.col("_z"))).otherwise(F.col("_raw")), 0.0, 1.0),
            "cal_fold": F.when(fitted, F.col("fold")).otherwise(-1),
            "calibration_status": status,
        }
    ).drop("_y", "_z", "_raw", "_fitted", "_n", "_both", "fold", "n_folds", "slope", "intercept", "fit_n")


def held_out_calibration(
    validation: DataFrame, test: DataFrame, keys: Sequence[str], limit: int = LOCAL_ROWS
) -> DataFrame:
    """Test rows with the probability of a fit on all validation rows of the table."""
    keys = list(keys)
    models = fit_platt(
        validation.withColumns({"_y": finite("label"), "_z": finite(or_null(validation, "s_base"))}),
        keys, "_z", "_y", limit,
    )
    rows = test.withColumns({"_z": finite(or_null(test, "s_base")), "_raw": raw_probability(test)})
    whole = rows.groupBy(*keys).agg(F.bool_and(F.col("_z").isNotNull()).alias("_whole"))
    out = rows.join(models, keys, "left").join(whole, keys, "left")
    fitted = F.col("slope").isNotNull() & F.col("_whole")
    return out.withColumns(
        {
            "p_cal": clip(F.when(fitted, platt_probability(F.col("_z"))).otherwise(F.col("_raw")), 0.0, 1.0),
            "calibration_status": F.when(fitted, "fitted").otherwise("raw_probability_fallback"),
        }
    ).drop("_z", "_raw", "_whole", "slope", "intercept", "fit_n")


def prior_label(df: DataFrame):
    """True label of a row; implied by the frozen prediction where none is given."""
    implied = F.when(F.col("base_wrong") < 0.5, F.col("base_pred")).otherwise(1.0 - F.col("base_pred"))
    return finite(or_null(df, "label")), implied


def prior_probability(rows: DataFrame, models: DataFrame, keys: Sequence[str], raw: str) -> DataFrame:
    """Add ``p_prior_cal``: calibrated where a model and a logit exist, else raw."""
    z = finite(or_null(rows, "s_prior"))
    out = rows.join(models, list(keys), "left")
    p = F.when(F.col("slope").isNotNull() & z.isNotNull(), platt_probability(z)).otherwise(F.col(raw))
    return out.withColumn("p_prior_cal", clip(p, 0.0, 1.0)).drop("slope", "intercept", "fit_n")
