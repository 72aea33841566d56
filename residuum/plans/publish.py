"""Resumable run-level tables: compute what is missing, verify it, then publish whole runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators import quality
from residuum.sources.sinks import missing_runs, write_table
from residuum.storage import shared_folder

#: A check gets the staged rows and the keys of the runs they should hold, and returns run keys with a ``problem``.
RunCheck = Callable[[DataFrame, DataFrame], DataFrame]


def stored_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The published table, or none if nothing was published yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def each_run_has_rows(run_keys: Sequence[str]) -> RunCheck:
    """A run without any row is not complete."""
    return lambda rows, runs: runs.join(rows, list(run_keys), "left_anti").withColumn("problem", F.lit("no rows"))


def rows_are_unique(run_keys: Sequence[str], keys: Sequence[str]) -> RunCheck:
    """Rows of a run repeat no key."""

    def check(rows: DataFrame, runs: DataFrame) -> DataFrame:
        again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return again.select(*run_keys).distinct().withColumn("problem", F.lit("repeated keys"))

    return check


def rows_are_complete(run_keys: Sequence[str], keys: Sequence[str], expected: DataFrame) -> RunCheck:
    """Runs hold exactly the keys of ``expected`` (run keys and all others)."""

    def check(rows: DataFrame, runs: DataFrame) -> DataFrame:
        gaps = quality.coverage_gaps(expected.join(runs, list(run_keys), "left_semi"), rows, keys)
        return gaps.select(*[F.col(k).cast(runs.schema[k].dataType) for k in run_keys], "problem").distinct()

    return check


def publish(
    wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, run_keys: Sequence[str], checks: Sequence[RunCheck] = (),
) -> tuple[DataFrame, DataFrame]:
    """Add the missing runs of ``wanted`` to the table at ``path``; returns (published run keys, problems of the others).

    ``compute`` gets the keys of the missing runs and returns their rows, which are staged in the session's shared
    folder and judged there. Only runs that no check objects to are written, each as a whole partition; what failed, or was
    killed half way, is missing still and comes with the next call. Stored runs are never computed again.
    """
    spark = wanted.sparkSession
    run_keys = list(run_keys)
    missing = missing_runs(wanted, stored_runs(spark, path), run_keys)
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    missing.write.parquet(f"{folder}/runs")
    runs = spark.read.schema(missing.schema).parquet(f"{folder}/runs")
    rows = compute(runs)
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    problems = each_run_has_rows(run_keys)(rows, runs)
    for check in checks:
        problems = problems.unionByName(check(rows, runs))
    problems.write.parquet(f"{folder}/problems")
    problems = spark.read.schema(problems.schema).parquet(f"{folder}/problems")
    good = runs.join(problems, run_keys, "left_anti")
    whole = rows.join(good, run_keys, "left_semi")
    if not good.isEmpty():
        write_table(whole, path, precision=15, partition_by=run_keys)
    return good, problems
