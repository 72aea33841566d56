"""Ranking metrics over distinct scores: exact, order-free, tie-aware."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.operators.prefix import is_finite, magnitude_cell, prefix_sums
from residuum.storage import cut

METRICS = [
    "error_detection_auroc",
    "error_detection_auprc",
    "review_error_rate",
    "review_lift",
    "review_recall_of_residual_errors",
    "combined_recall_of_candidate_errors",
    "retained_accuracy_after_review",
    "retained_accuracy_gain_vs_residual",
]

UNIVERSE_COLUMNS = ["universe_n", "universe_error_count", "universe_error_rate"]
#: Cells an octave of scores where rows move once, and rows a task merges before they move.
AUC_CELLS, MERGE_ROWS = 256, 1_000_000


def ranked_thresholds(
    rows: DataFrame, keys: Sequence[str], score: str, label: str, strange: bool = False, following: bool = False
) -> DataFrame:
    """Distinct scores, best first, with counts n and positives pos (also cum_, total_, next_ if ``following``).

    Rows whose score or label is null, NaN or infinite are left out.
    """
    valid = rows.where(is_finite(F.col(score)) & is_finite(F.col(label)))
    sums = {"n": F.lit(1), "pos": F.col(label).cast("double")}
    if strange:
        sums["odd"] = (~F.col(label).isin(0.0, 1.0)).cast("int")
    return prefix_sums(valid, keys, score, sums, following=following)


def auc_terms() -> tuple[Column, Column]:
    """Aggregates for AUROC and average precision over ranked thresholds.

    Null where only one class is present.
    """
    n, pos, cum_n, cum_pos = (F.col(c) for c in ("n", "pos", "cum_n", "cum_pos"))
    total_n, total_pos = F.first("total_n"), F.first("total_pos")
    negatives_above = (cum_n - n) - (cum_pos - pos)
    negatives_here = n - pos
    wins = F.sum(pos * ((F.col("total_n") - F.col("total_pos")) - negatives_above - 0.5 * negatives_here))
    both = (total_pos > 0) & (total_pos < total_n)
    auroc = F.when(both, F.try_divide(wins, total_pos * (total_n - total_pos)))
    auprc = F.when(both, F.try_divide(F.sum(pos * cum_pos / cum_n), total_pos))
    return auroc, auprc


def auc_metrics(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    auroc, auprc = auc_terms()
    return (
        ranked_thresholds(rows, keys, score, label)
        .groupBy(*keys)
        .agg(
            F.first("total_n").alias("n"),
            F.first("total_pos").alias("positives"),
            auroc.alias("auroc"),
            auprc.alias("auprc"),
        )
    )


def _merge_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _v, n, pos) of the rows (_id, _v, _y), equal pairs merged as far as they meet among ``MERGE_ROWS`` rows."""
    held: list[pa.RecordBatch] = []

    def out() -> list[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by(["_id", "_v"], use_threads=False).aggregate([("_y", "count"), ("_y", "sum")])
        held.clear()
        return found.select(["_id", "_v", "_y_count", "_y_sum"]).rename_columns(["_id", "_v", "n", "pos"]).combine_chunks().to_batches(100_000)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MERGE_ROWS:
            yield from out()
    if held:
        yield from out()


def auc_of_large_groups(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """As ``auc_metrics``, for few large groups: a row moves once, as the number of its cell, its score and its label.

    Cells come first, counted without moving rows, with what lies above them. ``rows`` is read twice: it
    should be a stored table or follow from one row by row.
    """
    keys = list(keys)
    valid = rows.where(is_finite(F.col(score)) & is_finite(F.col(label))).select(
        *keys, (F.col(score).cast("double") + F.lit(0.0)).alias("_v"), F.col(label).cast("double").alias("_y"))
    valid = valid.withColumn("_cell", magnitude_cell(F.col("_v"), AUC_CELLS))
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = valid.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_pos"))
    cells = cut(cells.select(
        *keys, "_cell", F.monotonically_increasing_id().alias("_id"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_off_n"), F.coalesce(F.sum("_pos").over(above), F.lit(0.0)).alias("_off_pos"),
        F.sum("_n").over(whole).alias("total_n"), F.sum("_pos").over(whole).alias("total_pos")), "auc-cells")
    numbered = valid.join(cells.select(*keys, "_cell", "_id"), [*keys, "_cell"]).select("_id", "_v", "_y")
    merged = numbered.mapInArrow(_merge_equal, "_id long, _v double, n long, pos double")
    # equal scores share their frame, so they need not be one row
    inside = Window.partitionBy("_id").orderBy(F.col("_v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = merged.select("*", F.sum("n").over(inside).alias("_in_n"), F.sum("pos").over(inside).alias("_in_pos")).join(cells.drop("_cell"), "_id")
    n, pos, total_n, total_pos = (F.col(c) for c in ("n", "pos", "total_n", "total_pos"))
    cum_n, cum_pos = F.col("_off_n") + F.col("_in_n"), F.col("_off_pos") + F.col("_in_pos")
    sums = summed.groupBy(*keys).agg(
        F.first(total_n).alias("n"), F.first(total_pos).alias("positives"),
        F.sum(pos * (total_n - total_pos - (cum_n - cum_pos))).alias("_won"), F.sum((n - pos) * (total_pos - cum_pos)).alias("_lost"),
        F.sum(pos * cum_pos / cum_n).alias("_precision"))
    positives, pairs = F.col("positives"), F.col("positives") * (F.col("n") - F.col("positives"))
    both = (positives > 0) & (positives < F.col("n"))
    return sums.select(
        *keys, "n", "positives", F.when(both, F.try_divide(0.5 * (F.col("_won") + (pairs - F.col("_lost"))), pairs)).alias("auroc"),
        F.when(both, F.try_divide(F.col("_precision"), positives)).alias("auprc"))


def review_size(n: Column, fraction: Column) -> Column:
    """Half-even share of n, at least one row and never all of them."""
    wanted = F.greatest(F.rint(n * fraction).cast("bigint"), F.lit(1))
    return F.when(n > 1, F.least(wanted, n - 1)).otherwise(n)


def top_k_hits(size: Column) -> Column:
    """Expected positives among the first ``size`` rows; ties share their slots."""
    here = clip01((size - (F.col("cum_n") - F.col("n"))) / F.col("n"))
    return F.sum(F.col("pos") * here)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def expected_top_k(
    rows: DataFrame, keys: Sequence[str], score: str, label: str, fraction: float
) -> DataFrame:
    size = review_size(F.col("total_n"), F.lit(float(fraction)))
    return (
        ranked_thresholds(rows, keys, score, label)
        .groupBy(*keys)
        .agg(F.max(size).alias("reviewed_n"), top_k_hits(size).alias("review_error_count"))
    )


def evaluate_ranking(
    rows: DataFrame,
    keys: Sequence[str],
    review_fractions: Sequence[float],
    min_universe_n: int = 20,
    score: str = "score",
) -> DataFrame:
    """Ranking metrics of residual rows beside the deferred rows of the same group.

    ``rows`` has ``state`` (residual or deferred), ``base_wrong`` and the score.
    """
    deferred = F.sum(F.when(F.col("state") == "deferred", F.col("base_wrong")))
    groups = rows.groupBy(*keys).agg(F.coalesce(deferred, F.lit(0.0)).alias("deferred_error_count"))
    residual = rows.where(F.col("state") == "residual")
    return evaluate_scores(residual, keys, groups, review_fractions, min_universe_n, score)


def evaluate_scores(
    scores: DataFrame,
    keys: Sequence[str],
    groups: DataFrame,
    review_fractions: Sequence[float],
    min_universe_n: int = 20,
    score: str = "score",
) -> DataFrame:
    """Thirteen ranking metrics per group and review fraction.

    ``groups`` names every group to report with its ``deferred_error_count``.
    One pass over the distinct scores serves all review fractions.
    """
    keys = list(keys)
    steps = ranked_thresholds(scores, keys, score, "base_wrong", strange=True)
    auroc, auprc = auc_terms()
    hits = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("review_fraction"),
                F.max(review_size(F.col("total_n"), F.lit(float(f)))).alias("_size"),
                top_k_hits(review_size(F.col("total_n"), F.lit(float(f)))).alias("_hits"),
            )
            for f in review_fractions
        ]
    )
    ranked = steps.groupBy(*keys).agg(
        F.first("total_n").alias("universe_n"),
        F.first("total_pos").alias("universe_error_count"),
        F.when(F.first("total_odd") == 0, auroc).alias("error_detection_auroc"),
        F.when(F.first("total_odd") == 0, auprc).alias("error_detection_auprc"),
        hits.alias("_reviews"),
    )
    return review_metrics(ranked, keys, groups, review_fractions, min_universe_n)


def review_metrics(
    ranked: DataFrame, keys: Sequence[str], groups: DataFrame, review_fractions: Sequence[float], min_universe_n: int = 20
) -> DataFrame:
    """The thirteen metrics from each group's sums over its ranked scores."""
    keys = list(keys)
    nothing = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("review_fraction"),
                F.lit(0).cast("bigint").alias("_size"),
                F.lit(0.0).alias("_hits"),
            )
            for f in review_fractions
        ]
    )
    out = groups.select(*keys, F.col("deferred_error_count").alias("_deferred_errors")).join(ranked, keys, "left")
    out = out.withColumn("_r", F.explode(F.coalesce(F.col("_reviews"), nothing)))
    out = out.withColumns(
        {
            "review_fraction": F.col("_r.review_fraction"),
            "universe_n": F.coalesce("universe_n", F.lit(0).cast("bigint")),
            "universe_error_count": F.coalesce("universe_error_count", F.lit(0.0)),
        }
    )
    n, errors = F.col("universe_n"), F.col("universe_error_count")
    enough = n >= int(min_universe_n)
    out = out.withColumns(
        {
            "universe_error_rate": F.try_divide(errors, n),
            "reviewed_n": F.when(enough, F.col("_r._size")).otherwise(0).cast("bigint"),
            "review_error_count": F.when(enough, F.col("_r._hits")),
        }
    )
    hit, size = F.col("review_error_count"), F.col("reviewed_n")
    out = out.withColumn("review_error_rate", hit / F.greatest(size, F.lit(1)))
    kept = n - size
    accuracy = F.when(hit.isNotNull() & (kept > 0), 1.0 - F.try_divide(errors - hit, kept))
    out = out.withColumns(
        {
            "review_lift": F.col("review_error_rate") / F.greatest(F.col("universe_error_rate"), F.lit(1.0e-8)),
            "review_recall_of_residual_errors": hit / F.greatest(errors, F.lit(1.0e-8)),
            "combined_recall_of_candidate_errors": (F.col("_deferred_errors") + hit)
            / F.greatest(errors + F.col("_deferred_errors"), F.lit(1.0e-8)),
            "retained_accuracy_after_review": accuracy,
            "retained_accuracy_gain_vs_residual": accuracy - (1.0 - F.col("universe_error_rate")),
        }
    )
    return out.select(
        *keys,
        "review_fraction",
        *UNIVERSE_COLUMNS,
        *METRICS[:2],
        "reviewed_n",
        "review_error_count",
        *METRICS[2:],
    )


def best_review(metrics: DataFrame) -> DataFrame:
    """Headroom: errors a perfect ranking would find against those found."""
    best = F.least(F.col("reviewed_n").cast("double"), F.col("universe_error_count"))
    ready = F.col("review_error_count").isNotNull()
    size, errors = F.greatest("reviewed_n", F.lit(1)), F.greatest("universe_error_count", F.lit(1.0e-8))
    return metrics.withColumns(
        {
            "oracle_review_error_count": F.when(ready, best),
            "oracle_review_error_rate": F.when(ready, best / size),
            "oracle_error_recall": F.when(ready, best / errors),
            "max_possible_review_error_count_gain": F.when(ready, best - F.col("review_error_count")),
            "max_possible_review_error_rate_gain": F.when(ready, (best - F.col("review_error_count")) / size),
            "max_possible_error_recall_gain": F.when(ready, (best - F.col("review_error_count")) / errors),
            "fraction_of_oracle_error_count": F.when(
                ready & (best > 0), F.try_divide(F.col("review_error_count"), best)
            ),
        }
    )


# --- decision thresholds ---------------------------------------------------


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    one = lambda c: F.greatest(c, F.lit(1.0))
    sensitivity, precision = tp / one(tp + fn), tp / one(tp + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "sensitivity": sensitivity,
        "specificity": tn / one(tn + fp),
        "precision": precision,
        "accuracy": (tp + tn) / one(tp + tn + fp + fn),
        "f1": 2.0 * precision * sensitivity / F.greatest(precision + sensitivity, F.lit(1.0e-8)),
        "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)),
    }


def confusion(
    rows: DataFrame, keys: Sequence[str], probability: str, label: str, threshold: float = 0.5
) -> DataFrame:
    """Counts and quality of the decision ``probability >= threshold``."""
    said, true = F.col(probability) >= threshold, F.col(label) > 0.5
    valid = rows.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    counts = valid.groupBy(*keys).agg(
        F.count_if(said & true).cast("double").alias("tp"),
        F.count_if(said & ~true).cast("double").alias("fp"),
        F.count_if(~said & true).cast("double").alias("fn"),
        F.count_if(~said & ~true).cast("double").alias("tn"),
    )
    return counts.withColumns(confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def mcc_threshold(rows: DataFrame, keys: Sequence[str], probability: str, label: str) -> DataFrame:
    """Best of 181 thresholds 0.05..0.95 by MCC, the first one on ties."""
    keys = list(keys)
    steps = 180
    slot = F.floor(F.round((F.col(probability) - 0.05) / 0.005, 9))
    valid = rows.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    slots = valid.groupBy(
        *keys, F.least(F.greatest(slot, F.lit(-1)), F.lit(steps)).cast("int").alias("slot")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    # every threshold up to its slot is passed by a row: at most 182 values per group
    wide = slots.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    passed = F.col("slot") >= F.col("step")
    table = wide.groupBy(*keys, "step").agg(
        F.sum(F.when(passed, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(passed, F.col("n") - F.col("pos")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~passed, F.col("pos")).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~passed, F.col("n") - F.col("pos")).otherwise(0.0)).alias("tn"),
    )
    mcc = confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["mcc"]
    ranked = table.withColumn("mcc", F.round(mcc, 12))
    return ranked.groupBy(*keys).agg(
        F.round(0.05 + 0.005 * F.max_by("step", F.struct("mcc", -F.col("step"))), 3).alias("threshold"),
        F.max("mcc").alias("mcc"),
    )


def rate_steps(rows: DataFrame, keys: Sequence[str], score: str, label: str, following: bool = False) -> DataFrame:
    """True and false positive rate at every distinct score."""
    steps = ranked_thresholds(rows, keys, score, label, following=following)
    return steps.withColumns(
        {
            "tpr": F.try_divide(F.col("cum_pos"), F.col("total_pos")),
            "fpr": F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("total_n") - F.col("total_pos")),
        }
    )


def youden_threshold(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Score with the largest tpr - fpr, the highest score on ties."""
    gain = F.round(F.col("tpr") - F.col("fpr"), 12)
    return (
        rate_steps(rows, keys, score, label)
        .withColumn("youden", gain)
        .groupBy(*keys)
        .agg(
            F.max_by(score, F.struct(F.col("youden"), F.col(score))).alias("threshold"),
            F.max("youden").alias("youden"),
        )
    )


def f1_threshold(rows: DataFrame, keys: Sequence[str], score: str, label: str, skip: int = 5) -> DataFrame:
    """Score with the best F1 built from rates, leaving out the first thresholds.

    The curve keeps its ends and its corners: a score between two steps of equal
    size and mix is dropped. It starts with one threshold above every score, so
    the first ``skip - 1`` kept scores are passed over.
    """
    keys = list(keys)
    precision = F.try_divide(F.col("tpr"), F.col("tpr") + F.col("fpr"))
    f1 = F.round(2.0 * precision * F.col("tpr") / (F.col("tpr") + precision + 0.00001), 12)
    steps = rate_steps(rows, keys, score, label, following=True)
    ends = (F.col("cum_n") == F.col("n")) | (F.col("cum_n") == F.col("total_n"))
    corner = (F.col("next_pos") != F.col("pos")) | (F.col("next_n") != F.col("n"))
    steps = steps.where(ends | corner).withColumn("f1", f1)
    # only the first scores of a group survive the partial limit of this window
    head = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    cut = (
        steps.withColumn("_r", F.row_number().over(head))
        .where(F.col("_r") <= skip - 1)
        .groupBy(*keys)
        .agg(F.min(score).alias("_cut"))
    )
    late = steps.join(cut, keys).where(F.col(score) < F.col("_cut"))
    return late.groupBy(*keys).agg(
        F.max_by(score, F.struct("f1", score)).alias("threshold"), F.max("f1").alias("f1")
    )
