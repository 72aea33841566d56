"""Checks on run-level tables: unique keys, exact coverage, equality, gates, counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ShardError(RuntimeError):
    """A run-level table is incomplete or not unique."""


def key_text(df: DataFrame, name: str) -> Column:
    """Keys compare as text; doubles at twelve significant digits."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        text = F.format_string("%.12g", F.col(name).cast("double"))
        short = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+(?=e|$)", "")).otherwise(text)
        return F.when(F.col(name).isNotNull(), short).otherwise("")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[key_text(df, k).alias(k) for k in keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str], examples: int | None = None) -> DataFrame:
    """Keys that occur more than once, with their count; a few of them on request."""
    out = key_rows(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return out if examples is None else out.orderBy(*keys).limit(examples)


def require_unique(df: DataFrame, keys: Sequence[str], label: str) -> None:
    found = duplicate_keys(df, keys, 5).collect()
    if found:
        raise ShardError(f"{label} has duplicate keys: {[r.asDict() for r in found]}")


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of small dimensions, built from one row of arrays."""
    out = spark.range(1).select()
    for name, items in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in items])).alias(name))
    return out


def coverage_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from the table and keys that should not be there."""
    want, have = key_rows(expected, keys).distinct(), key_rows(observed, keys).distinct()
    missing = want.join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(want, list(keys), "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in one of two tables, with multiplicity."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def blocked_statuses(candidates: DataFrame, profile: str) -> DataFrame:
    """Rows of a profile whose evidence was not available."""
    bad = ["diagnostic_unavailable", "profile_unavailable", "unavailable"]
    return candidates.where((F.col("profile") == profile) & F.col("model_status").isin(*bad))


def unavailable_flags(capabilities: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """One row per false availability flag."""
    long = capabilities.unpivot(list(keys), list(flags), "flag", "available")
    return long.where(~F.coalesce(F.col("available"), F.lit(False))).select(*keys, "flag")


def conditional_gaps(rows: DataFrame, coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domain rows must exist exactly for policies with a non-empty test residual."""
    return coverage_gaps(coverage.where("split = 'test' and residual_n > 0"), rows, keys)


def dataset_only_gaps(rows: DataFrame, expected: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    """Rows of one dataset complete, none of any other."""
    return coverage_gaps(expected.where(F.lower("dataset") == dataset.lower()), rows, keys)


def count_check(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Observed against expected row counts."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("observed")).select(
            F.lit(name).alias("table"), F.lit(int(expected)).cast("bigint").alias("expected"), "observed"
        )
        for name, (df, expected) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("expected") == F.col("observed"))


def merge_shards(shards: Sequence[DataFrame], keys: Sequence[str], label: str = "merged") -> DataFrame:
    """Run-level rows of all shards as one table; repeated keys are refused."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    require_unique(merged, keys, label)
    return merged


def conflicting_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose repeated rows do not agree in every column."""
    whole = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.groupBy(*keys).agg(F.min(whole).alias("_a"), F.max(whole).alias("_b")).where("_a <> _b").select(*keys)


def cardinality_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                     one_to_one: bool = False) -> DataFrame:
    """Join that refuses repeated keys on the right (and on the left for one-to-one)."""
    require_unique(right, keys, "right side")
    if one_to_one:
        require_unique(left, keys, "left side")
    return left.join(right, list(keys), how)


OUTCOMES = ("label", "y", "base_wrong", "base_correct")


def reads_no_outcome(df: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> bool:
    """True if no step of the optimised plan above the scans uses an outcome column."""
    text = df._jdf.queryExecution().optimizedPlan().toString().lower()
    steps = [line for line in text.splitlines() if not re.search(r"(logicalrdd|relation) *\[", line)]
    used = set(re.findall(r"([a-z_0-9]+)#\d+", "\n".join(steps))) | {c.lower() for c in df.columns}
    return not used.intersection(outcomes)


def needs_no_outcome(build: Callable[[DataFrame], DataFrame], source: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> bool:
    """Whether ``build`` can be resolved over ``source`` without its outcome columns: what is not there can't be read.

    Names are compared without case, as Spark resolves them.
    """
    kept = [c for c in source.columns if c.lower() not in {o.lower() for o in outcomes}]
    try:
        return bool(build(source.select(*kept)).columns)
    except AnalysisException:
        return False


def outcome_effects(build: Callable[[DataFrame], DataFrame], source: DataFrame, outcome: str, seed: int = 2026) -> DataFrame:
    """(rows, changed, moved): rows of ``build(source)``, rows that differ once outcomes are dealt anew, and outcomes that this changed.

    Each row gets the opposite of its outcome (a number from 0 to 1) or keeps it, by a hash of the row.
    """
    draw = F.pmod(F.xxhash64(*source.columns, F.lit(seed)), F.lit(2))
    dealt = source.withColumn("_before", F.col(outcome)).withColumn(outcome, F.when(draw == 1, 1 - F.col(outcome)).otherwise(F.col(outcome)))
    before, after = build(source), build(dealt.drop("_before"))
    counted = {
        "rows": before, "changed": table_difference(before, after), "moved": dealt.where(~F.col("_before").eqNullSafe(F.col(outcome))),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, parts).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted])
