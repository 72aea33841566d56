"""Evidence profiles: the declared list and the fits that rank residual errors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import finite, hex_draw, or_null, prior_columns, sigmoid, support_columns
from residuum.operators.calibration import prior_label, prior_probability
from residuum.operators.logistic import CONVERGED, LOCAL_ROWS, curvature, fit_platt, gradient_norm, solve, solve_spread, split_by_size
from residuum.operators.prefix import medians
from residuum.operators.support import NATIVE_COLUMNS, fold_counts, source_count_columns
from residuum.storage import cut

# Feature names by evidence block.
RISK = ("calibrated_error_risk",)
PRIOR = (
    "prior_contradiction_logit",
    "prior_support_logit",
    "prior_negative_evidence",
    "prior_contradiction_probability",
    "prior_support_probability",
)
FIT_SUPPORT = (
    "log_drug_fit_count",
    "log_target_fit_count",
    "fit_entity_support_min",
    "fit_entity_support_imbalance",
    "fit_joint_novelty",
    "fit_one_sided_novelty",
)
PAIR_FIT = ("log_pair_fit_count",)
SOURCE_COUNT = (
    "log_source_drug_count",
    "log_source_target_count",
    "log_source_pair_count",
    "log_source_drug_cluster_count",
    "log_source_target_cluster_count",
    "log_source_cluster_pair_count",
    "source_entity_support_min",
    "source_cluster_support_min",
    "source_entity_support_imbalance",
    "source_cluster_support_imbalance",
    "source_joint_novelty",
    "source_one_sided_novelty",
)
SOURCE_DISTANCE = (
    "drug_nearest_train_distance",
    "target_nearest_train_distance",
    "drug_train_knn_distance",
    "target_train_knn_distance",
    "drug_embedding_mahalanobis",
    "target_embedding_mahalanobis",
    "domain_shift_score",
    "domain_density_distance",
)
NATIVE = tuple(NATIVE_COLUMNS)
SEQUENCE = (
    "target_mmseqs_nearest_train_distance",
    "target_mmseqs_family_unseen",
    "target_mmseqs_family_sparsity",
)
JOINT = (
    "target_direct_nearest_train_distance",
    "target_direct_knn_distance",
    "joint_nearest_train_distance",
)
LEGACY_DOMAIN = SOURCE_COUNT + SOURCE_DISTANCE
LEGACY = FIT_SUPPORT + PAIR_FIT + LEGACY_DOMAIN
SUPPORT = FIT_SUPPORT + NATIVE
FEATURES = RISK + PRIOR + FIT_SUPPORT + PAIR_FIT + SOURCE_COUNT + SOURCE_DISTANCE + NATIVE + SEQUENCE + JOINT
PASSED_THROUGH = SOURCE_DISTANCE + NATIVE + SEQUENCE + JOINT


@dataclass(frozen=True)
class Profile:
    name: str
    features: tuple[str, ...]
    complexity: int
    primary: bool
    required_any: tuple[str, ...] = ()
    required_blocks: tuple[tuple[str, ...], ...] = ()

    @property
    def needs(self) -> tuple[tuple[str, ...], ...]:
        if self.required_blocks:
            return self.required_blocks
        return (self.required_any,) if self.required_any else ()


# The declared profiles with complexity and required evidence.
PRIMARY_PROFILES = (
    Profile("uncertainty", RISK, 0, True),
    Profile("prior", PRIOR, 1, True, (), (PRIOR,)),
    Profile("uncertainty_prior", RISK + PRIOR, 2, True, (), (PRIOR,)),
    Profile("uncertainty_support", RISK + SUPPORT, 2, True, SUPPORT, (SUPPORT,)),
    Profile("uncertainty_prior_support", RISK + PRIOR + SUPPORT, 3, True, SUPPORT, (PRIOR, SUPPORT)),
)
DIAGNOSTIC_PROFILES = (
    Profile("fit_support", RISK + FIT_SUPPORT, 1, False, FIT_SUPPORT),
    Profile("source_domain_support", RISK + LEGACY_DOMAIN, 1, False, LEGACY_DOMAIN),
    Profile("native_source_domain_support", RISK + NATIVE, 1, False, NATIVE),
    Profile("target_sequence_support", RISK + SUPPORT + SEQUENCE, 3, False, SEQUENCE, (SUPPORT, SEQUENCE)),
    Profile("general_target_joint_support", RISK + SUPPORT + JOINT, 3, False, JOINT, (SUPPORT, JOINT)),
    Profile("legacy_support", RISK + LEGACY, 2, False, LEGACY_DOMAIN),
    Profile("combined_support", RISK + LEGACY + NATIVE, 3, False, NATIVE),
)
ALL_PROFILES = PRIMARY_PROFILES + DIAGNOSTIC_PROFILES

# Fit settings of the declared protocol.
MIN_FIT_N, MIN_FEATURE_N, RANKING_WEIGHT, MAX_PAIRS = 20, 10, 0.5, 5000


def profile_table(spark: SparkSession, profiles: Sequence[Profile] = ALL_PROFILES) -> DataFrame:
    """The declared profiles as a small dimension table."""
    rows = [
        (p.name, list(p.features), p.complexity, p.primary, list(p.required_any), [list(b) for b in p.required_blocks])
        for p in profiles
    ]
    return spark.createDataFrame(
        rows,
        "profile string, features array<string>, complexity int, primary_candidate boolean, "
        "required_any array<string>, required_blocks array<array<string>>",
    )


def requirements_met(used: Column, blocks: Column, required_any: Column) -> Column:
    """Every required block (else ``required_any``) has at least one used feature."""
    fallback = F.when(F.size(required_any) > 0, F.array(required_any)).otherwise(F.array().cast("array<array<string>>"))
    needed = F.when(F.size(blocks) > 0, blocks).otherwise(fallback)
    return F.forall(needed, lambda block: F.arrays_overlap(block, used))


def usable_features(rows: DataFrame, keys: Sequence[str], features: Sequence[str], min_n: int = MIN_FEATURE_N) -> DataFrame:
    """Per group: features with enough finite values that are not constant."""
    ok = [
        F.when((F.count(F.col(f)) >= min_n) & (F.min(f) < F.max(f)), F.lit(f))
        for f in features
    ]
    return rows.groupBy(*keys).agg(F.array_compact(F.array(*ok)).alias("used"))


# --- features ------------------------------------------------------------------


def attach_fit_counts(fit: DataFrame, held: DataFrame, keys: Sequence[str], folds: int) -> tuple[DataFrame, DataFrame]:
    """Per-fold counts of each row's drug, target and pair among the fit rows."""
    keys = list(keys)
    out = [fit, held]
    for name, ids in (("drug", ["dr_id"]), ("target", ["pr_id"]), ("pair", ["dr_id", "pr_id"])):
        counts = fold_counts(fit, keys, ids, folds, f"_{name}")
        out = [side.join(counts, [*keys, *ids], "left") for side in out]
    return out[0], out[1]


def _count_in_fit(name: str) -> Column:
    """Count over the rows a fit trains on, the row itself left out if it is one of them."""
    all_rows = F.coalesce(F.col(f"_{name}_all"), F.lit(0))
    own = F.when(F.col("fit") >= 0, F.coalesce(F.get(F.col(f"_{name}"), F.col("fit")), F.lit(0))).otherwise(0)
    self_row = F.when(F.col("role") == "fit", 1).otherwise(0)
    return F.greatest(all_rows - own - self_row, F.lit(0)).cast("double")


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """All declared features of rows with risk, p_prior_cal and fit counts."""
    counts = {n: _count_in_fit(n) for n in ("drug", "target", "pair")}
    out = {"calibrated_error_risk": F.col("risk")}
    out |= prior_columns(
        F.col("p_cal"), F.col("p_prior_cal"), finite(or_null(df, "s_base")), finite(or_null(df, "s_prior"))
    )
    out |= {f"log_{n}_fit_count": F.log1p(c) for n, c in counts.items()}
    out |= support_columns(
        counts["drug"],
        counts["target"],
        ["fit_entity_support_min", "fit_entity_support_imbalance", "fit_joint_novelty", "fit_one_sided_novelty"],
    )
    out |= source_count_columns(df)
    return out | {c: finite(or_null(df, c)) for c in PASSED_THROUGH}


def exported_or_implied(df: DataFrame, table: Sequence[str]) -> DataFrame:
    """``df`` with ``_raw``: the exported prior probability in tables (``table`` keys) that have any, else the one its logit implies."""
    shown = finite(or_null(df, "p_prior"))
    exported = df.groupBy(*table).agg(F.bool_or(shown.isNotNull()).alias("_exported"))
    joined = df.join(cut(exported, "exported-priors"), list(table), "left")
    return joined.withColumn("_raw", F.when(F.col("_exported"), shown).otherwise(sigmoid(finite(or_null(df, "s_prior")))))


def fit_frames(
    residual: DataFrame, test_residual: DataFrame | None, keys: Sequence[str], folds: int, limit: int = LOCAL_ROWS
) -> DataFrame:
    """Feature rows of every fit: keys, fit, role, row_id, base_wrong, draw, x.

    ``residual`` rows carry ``fold``/``n_folds``. Fit -1 trains on all of them
    and scores the test rows; fit f leaves fold f out and scores it.
    """
    keys = list(keys)
    label, implied = prior_label(residual)
    known = residual.groupBy(*keys).agg(F.bool_or(label.isNotNull()).alias("_labelled"))
    rows = residual.join(known, keys).withColumn("_y", F.when(F.col("_labelled"), label).otherwise(implied))
    held = test_residual if test_residual is not None else residual.limit(0)
    held = held.withColumns({"role": F.lit("held"), "fit": F.lit(-1)})
    every = F.sequence(F.lit(-1), F.coalesce(F.col("n_folds") - 1, F.lit(-1)))
    rows, held = attach_fit_counts(rows, held, keys, folds)
    rows = rows.withColumn("fit", F.explode(every))
    rows = rows.withColumn("role", F.when(F.col("fit") == F.col("fold"), "held").otherwise("fit"))
    logit = finite(or_null(rows, "s_prior"))
    train = rows.where("role = 'fit'").select(*keys, "fit", "_y", logit.alias("_z"))
    models = cut(fit_platt(train, [*keys, "fit"], "_z", "_y", limit), "prior-fits")

    def finish(df: DataFrame) -> DataFrame:
        # each table of a fit decides for itself whether prior probabilities were exported
        df = exported_or_implied(df, [*keys, "fit", "role"])
        df = prior_probability(df, models, [*keys, "fit"], "_raw")
        named = feature_columns(df)
        return df.select(
            *keys, "fit", "role", "row_id", "base_wrong",
            hex_draw(F.col("fit"), F.col("row_id"), digits=13).alias("draw"),
            F.array(*[named[f].cast("double") for f in FEATURES]).alias("x"),
        )

    return finish(rows).unionByName(finish(held))


# --- ranker --------------------------------------------------------------------


def slot_rows(n: int, wanted: int, draws: np.ndarray, ids: np.ndarray, side: str, seed: int) -> np.ndarray:
    """Row positions of the sampled pair slots: without replacement while rows last."""
    order = np.lexsort((ids, draws))
    if wanted <= n:
        return order[:wanted]
    text = (hashlib.md5(f"{seed}-{side}-{j}".encode()).hexdigest()[:7] for j in range(wanted))
    return order[np.fromiter((int(t, 16) % n for t in text), dtype=np.int64, count=wanted)]


def balanced(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights times n / (2 * class count)."""
    ones = max(float((y == 1).sum()), 1.0)
    zeros = max(float((y == 0).sum()), 1.0)
    return weights * np.where(y == 1, len(y) / (2.0 * ones), len(y) / (2.0 * zeros))


def _used(x: np.ndarray, profile: Profile, min_n: int) -> list[int]:
    keep = []
    for name in profile.features:
        values = x[:, FEATURES.index(name)]
        values = values[~np.isnan(values)]
        if len(values) >= min_n and values.min() < values.max():
            keep.append(FEATURES.index(name))
    return keep


def _met(used: Sequence[int], profile: Profile) -> bool:
    names = {FEATURES[i] for i in used}
    return all(names.intersection(block) for block in profile.needs)


COEF_DDL = (
    "profile string, used array<string>, slope array<double>, fill array<double>, intercept double, "
    "rows bigint, pairs bigint, gradient double, converged boolean"
)


def _coefficients(used: list[int], fill: np.ndarray, mean: np.ndarray, std: np.ndarray, beta: np.ndarray):
    """Scaled coefficients turned back to raw feature units."""
    slope, filled = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    slope[used], filled[used] = beta[:-1] / std, fill
    return slope, filled, float(beta[-1] - np.sum(beta[:-1] * mean / std))


def fit_rankers(
    frames: DataFrame,
    keys: Sequence[str],
    profiles: Sequence[Profile] = ALL_PROFILES,
    seed: int = 2026,
    min_feature_n: int = MIN_FEATURE_N,
    ranking_weight: float = RANKING_WEIGHT,
    max_pairs: int = MAX_PAIRS,
    limit: int = LOCAL_ROWS,
) -> DataFrame:
    """Coefficients of every (keys, fit, profile): balanced logistic on standardised
    features plus sampled differences between wrong and right rows.

    A fit whose profile lacks required evidence comes back with no ``slope``. Each row holds the fit's certificate: the rows and
    sampled pairs it saw, its ``gradient`` norm at the coefficients a unit of weight, and whether that is small.
    """
    keys = [*keys, "fit"]
    profiles = [p for p in profiles if p.name != "uncertainty"]
    rows = frames.where("role = 'fit' and base_wrong is not null")
    small, large = split_by_size(rows, keys, limit)
    out_type = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL(COEF_DDL).fields])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        key = tuple(part[keys].iloc[0])
        x = np.array([np.asarray(v, dtype=float) for v in part["x"]])
        y, draws, ids = part["base_wrong"].to_numpy(), part["draw"].to_numpy(), part["row_id"].to_numpy()
        ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        out = []
        pairs = min(int(max_pairs), len(ones) * len(zeros)) if ranking_weight > 0 else 0
        if pairs:
            up = ones[slot_rows(len(ones), pairs, draws[ones], ids[ones], "up", seed)]
            down = zeros[slot_rows(len(zeros), pairs, draws[zeros], ids[zeros], "down", seed)]
        for profile in profiles:
            used = _used(x, profile, min_feature_n)
            names = [FEATURES[i] for i in used]
            if not used or not _met(used, profile) or not len(ones) or not len(zeros):
                out.append((*key, profile.name, names, None, None, None, len(y), pairs, None, None))
                continue
            part_x = x[:, used]
            fill = np.nanmedian(part_x, axis=0)
            part_x = np.where(np.isnan(part_x), fill, part_x)
            mean, std = part_x.mean(0), part_x.std(0)
            std = np.where(std > 0, std, 1.0)
            z = (part_x - mean) / std
            stack, target, weight = z, y, np.ones(len(y))
            if pairs:
                gap = z[up] - z[down]
                stack = np.vstack([z, gap, -gap])
                target = np.concatenate([y, np.ones(pairs), np.zeros(pairs)])
                weight = np.concatenate([weight, np.full(2 * pairs, float(ranking_weight))])
            weight = balanced(target, weight)
            beta = solve(stack, target, weight, 1.0)
            norm = gradient_norm(curvature(stack, target, weight, beta)[1], beta, float(weight.sum()), 1.0)
            out.append((*key, profile.name, names, *_coefficients(used, fill, mean, std, beta), len(y), pairs, norm, norm < CONVERGED))
        return pd.DataFrame(out, columns=out_type.names)

    fits = small.groupBy(*keys).applyInPandas(fit, out_type)
    if large is None:
        return fits
    return fits.unionByName(
        _fit_large(large, keys, profiles, seed, min_feature_n, ranking_weight, max_pairs, out_type)
    )


def _fit_large(rows, keys, profiles, seed, min_feature_n, ranking_weight, max_pairs, out_type) -> DataFrame:
    """The same fits for groups too large for one task; only per-fit numbers are collected."""
    spark = rows.sparkSession
    item = lambda i: F.get(F.col("x"), F.lit(i))
    # only features of the profiles that some fit can use are carried; ``place`` tells where
    asked = sorted({FEATURES.index(f) for p in profiles for f in p.features})
    known = rows.groupBy(*keys).agg(
        F.array(*[F.count(item(i)) for i in asked]).alias("n"),
        F.array(*[F.coalesce(F.min(item(i)) < F.max(item(i)), F.lit(False)) for i in asked]).alias("varies"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("base_wrong").alias("ones"),
    ).collect()
    key_of = lambda r: tuple(r[k] for k in keys)
    info = {key_of(r): r for r in known}
    usable_of = {k: {i for i, n, v in zip(asked, r.n, r.varies) if n >= min_feature_n and v} for k, r in info.items()}
    carried = sorted(set().union(*usable_of.values()))
    place, size = {i: at for at, i in enumerate(carried)}, len(carried)
    rows = rows.withColumn("x", F.array(*[item(i) for i in carried]).cast("array<double>"))
    # medians: one exact pass over distinct values per feature
    long = rows.select(*keys, F.posexplode("x").alias("feature", "value"))
    fills = {k: np.zeros(size) for k in info}
    for r in medians(long, [*keys, "feature"], "value").collect():
        fills[key_of(r)][r.feature] = r["median"]
    fill_table = spark.createDataFrame(
        [(*k, v.tolist()) for k, v in fills.items()],
        T.StructType([*[rows.schema[k] for k in keys], T.StructField("fill", T.ArrayType(T.DoubleType()))]),
    )
    filled = rows.join(F.broadcast(fill_table), keys).withColumn(
        "x", F.zip_with("x", "fill", lambda v, m: F.coalesce(v, m))
    ).drop("fill")
    means = filled.groupBy(*keys).agg(
        F.array(*[F.avg(item(i)) for i in range(size)]).alias("mean"),
        F.array(*[F.stddev_pop(item(i)) for i in range(size)]).alias("std"),
    ).collect()
    mean = {key_of(r): np.asarray(r["mean"]) for r in means}
    std = {key_of(r): np.where(np.asarray(r["std"]) > 0, np.asarray(r["std"]), 1.0) for r in means}
    scale_table = spark.createDataFrame(
        [(*k, mean[k].tolist(), std[k].tolist()) for k in mean],
        T.StructType(
            [*[rows.schema[k] for k in keys], *T.StructType.fromDDL("mean array<double>, std array<double>").fields]
        ),
    )
    scaled = filled.join(F.broadcast(scale_table), keys).select(
        *keys, "row_id", "draw", F.col("base_wrong").alias("y"),
        F.zip_with(
            F.zip_with("x", "mean", lambda v, m: v - m), "std", lambda v, s: v / s
        ).alias("x"),
    )
    scaled = cut(scaled, "scaled-rows")
    # bounded pair sample: the rows with the smallest draws of each class
    first = Window.partitionBy(*keys, "y").orderBy("draw", "row_id")
    pool = scaled.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max_pairs)
    sampled = {}
    out_pairs = T.StructType(
        [*[rows.schema[k] for k in keys], *T.StructType.fromDDL("x array<double>, y double, pairs int").fields]
    )
    counts = {k: (int(r.ones), int(r.rows - r.ones)) for k, r in info.items()}

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        key = tuple(part[keys].iloc[0])
        n_up, n_down = counts[key]
        wanted = min(int(max_pairs), n_up * n_down)
        if not wanted:  # one class only: no pair and no fit
            return pd.DataFrame([], columns=out_pairs.names)
        sides = {}
        for y, n, name in ((1.0, n_up, "up"), (0.0, n_down, "down")):
            side = part[part["y"] == y]
            at = slot_rows(n, wanted, side["draw"].to_numpy(), side["row_id"].to_numpy(), name, seed)
            sides[name] = np.stack(side["x"].to_numpy())[at]
        gap = sides["up"] - sides["down"]
        both = np.vstack([gap, -gap])
        y = np.repeat([1.0, 0.0], wanted)
        return pd.DataFrame([(*key, v, t, wanted) for v, t in zip(both, y)], columns=out_pairs.names)

    if ranking_weight > 0:
        sampled = pool.groupBy(*keys).applyInPandas(pair, out_pairs)
    weights = []
    for k, (ones, zeros) in counts.items():
        pairs = min(int(max_pairs), ones * zeros) if ranking_weight > 0 else 0
        total = ones + zeros + 2 * pairs
        weights.append((*k, total / (2.0 * max(ones + pairs, 1)), total / (2.0 * max(zeros + pairs, 1))))
    weight_table = F.broadcast(spark.createDataFrame(
        weights, T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL("w1 double, w0 double").fields])
    ))
    stack = scaled.select(*keys, "x", "y", F.lit(1.0).alias("w"))
    if ranking_weight > 0:
        stack = stack.unionByName(sampled.select(*keys, "x", "y", F.lit(float(ranking_weight)).alias("w")))
    stack = stack.join(weight_table, keys).withColumn(
        "w", F.col("w") * F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0"))
    )
    stack = cut(stack.select(*keys, "x", "y", "w"), "ranker-rows")
    problems, unused = {}, []
    seen = lambda k: (sum(counts[k]), min(int(max_pairs), counts[k][0] * counts[k][1]) if ranking_weight > 0 else 0)
    chosen: dict = {}
    for k in info:
        for p in profiles:
            used = [FEATURES.index(f) for f in p.features if FEATURES.index(f) in usable_of[k]]
            if used and _met(used, p) and 0 < counts[k][0] < counts[k][0] + counts[k][1]:
                chosen[k, p.name] = used
                problems.setdefault(k, {})[p.name] = [place[i] for i in used]
            else:
                unused.append((*k, p.name, [FEATURES[i] for i in used], None, None, None, *seen(k), None, None))
    norms: dict = {}
    solved = solve_spread(stack, keys, problems, 1.0, norms)
    done = []
    for k, fits in solved.items():
        for name, beta in fits.items():
            used, at = chosen[k, name], problems[k][name]
            slope, fill, intercept = _coefficients(used, fills[k][at], mean[k][at], std[k][at], beta)
            norm = norms[k][name]
            done.append((*k, name, [FEATURES[i] for i in used], slope.tolist(), fill.tolist(), intercept, *seen(k), norm, norm < CONVERGED))
    return spark.createDataFrame(done + unused, out_type)


def score_rows(frames: DataFrame, coefs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of the held rows under every fitted profile.

    The coefficients, a few per fit, go to the tasks as arrays; a row carries the number of its fit
    and its features, and is scored under all profiles of the fit side by side.
    """
    keys, width = [*keys, "fit"], len(FEATURES)
    fitted = coefs.where("slope is not null").select(*keys, "profile", "slope", "fill", "intercept").collect()
    fits: dict[tuple, list[Row]] = {}
    for r in fitted:
        fits.setdefault(tuple(r[k] for k in keys), []).append(r)
    spark, at = frames.sparkSession, {k: i for i, k in enumerate(fits)}
    key_type = T.StructType([frames.schema[k] for k in keys])
    numbers = spark.createDataFrame([(*k, i) for k, i in at.items()], T.StructType([*key_type.fields, T.StructField("_fit", T.IntegerType())]))
    models = [
        (np.array([r.slope for r in rows]), np.array([r.fill for r in rows]), np.array([r.intercept for r in rows])) for rows in fits.values()
    ]
    held_type = frames.select("row_id", "base_wrong").schema
    out_type = T.StructType([*T.StructType.fromDDL("_fit int, _profile int").fields, *held_type.fields, T.StructField("_s", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch["_fit"].to_numpy()
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            empty = batch["x"].flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, width)
            for number in np.unique(fit):
                rows = np.flatnonzero(fit == number)
                values, holes = x[rows], empty[rows]
                rest = batch.select(["row_id", "base_wrong"]).take(pa.array(rows))
                for profile, (slope, fill, total) in enumerate(zip(*models[number])):
                    terms = np.where(holes, fill, values) * slope
                    # terms are added in the order of the features, as a fold over a row's array would
                    sums = np.full(len(rows), total)
                    for i in range(width):
                        sums += terms[:, i]
                    same = [pa.array(np.full(len(rows), v, np.int32)) for v in (number, profile)]
                    yield pa.RecordBatch.from_arrays([*same, *rest.columns, pa.array(sums)], names=out_type.names)

    names = [(i, p, r.profile) for i, rows in enumerate(fits.values()) for p, r in enumerate(rows)]
    profile_of = spark.createDataFrame(names, "_fit int, _profile int, profile string")
    held = frames.where("role = 'held'").join(F.broadcast(numbers), keys).select("_fit", "row_id", "base_wrong", "x")
    scored = held.mapInArrow(score, out_type).join(F.broadcast(profile_of.join(numbers, "_fit")), ["_fit", "_profile"])
    return scored.select(*keys, "profile", "row_id", "base_wrong", sigmoid("_s").alias("score"))
