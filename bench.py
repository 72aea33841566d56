"""Headline queries at one scale: prints one JSON line with seconds per query.

The derived input tables are written once before the clock of the first query
starts (an audit reads stored predictions); that time is reported as ``prepare``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import CHECKS  # noqa: E402
from checks.fixture import Tables  # noqa: E402

HEADLINE = [
    "residual_review",
    "uncertainty_first_deferral",
    "policy_coverage",
    "calibration_diagnostics",
    "evaluate_ranking",
    "average_precision",
    "count_lookups",
    "leave_one_out_counts",
    "cosine_knn_support",
    "tanimoto_knn_support",
    "direct_sequence_neighbours",
    "joint_neighbour_distance",
    "pair_deduplication_diagnostics",
    "grouped_stratified_folds",
    "platt_fit",
    "cross_fitted_calibration",
    "fit_support_features",
    "column_permutation",
    "parameter_grid_candidates",
    "one_standard_error_selection",
    "stratified_bootstrap_interval",
    "formal_audit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    tables = Tables(spark, folder)
    rows = tables.base().count()
    tables.counted(), tables.hits(), tables.fingerprints()
    times["prepare"] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        CHECKS[name].spark(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(v for k, v in times.items() if k != "prepare"), 3)
    print(json.dumps({
        "metric": "residual_audit_total_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "predictions": rows,
    }))


if __name__ == "__main__":
    main()
