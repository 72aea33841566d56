"""Readers: prediction tables, source tables, hits, vectors, phase files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import base_columns, canonical_id, exported_columns, finite_vector
from residuum.operators.ranking import auc_metrics

# Columns of the exported prediction table and of a hit file.
AUDIT_SCHEMA = (
    "data string, split string, phase string, score string, config string, checkpoint string, "
    "dr_id string, pr_id string, label double, s_score double, s_base double, s_full double, s_prior double, "
    "p_base double, p_prior double, base_pred double, base_correct double, base_confidence double, "
    "base_uncertainty double, base_prior_conflict double"
)
HIT_SCHEMA = (
    "query string, target string, identity string, alignment_length string, query_start string, query_end string, "
    "target_start string, target_end string, evalue string, bits double, query_length string, target_length string"
)
SOURCE_COLUMNS = ["dr_id", "pr_id", "drug_cluster", "target_cluster"]


def run_name(seed: Column) -> Column:
    """Seeds with and without their prefix name the same run."""
    text = seed.cast("string")
    return F.when(text.startswith("seed_"), text).otherwise(F.concat(F.lit("seed_"), text))


def display_name(model: Column, names: dict[str, str]) -> Column:
    """Display name of a model folder: the first known name it contains."""
    out = model
    for part, name in reversed(list(names.items())):
        out = F.when(F.lower(model).contains(part), F.lit(name)).otherwise(out)
    return out


def prediction_table(raw: DataFrame) -> DataFrame:
    """Run keys normalised and derived prediction columns added."""
    return base_columns(raw.withColumn("test_run", run_name(F.col("test_run"))))


def number_lines(raw: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``raw``, a file scan, with the place of each row in its file: 0, 1, 2, ... in the order of lines.

    The rows of each block of a file are counted; the sums of the counts before a block are where its numbers begin.
    Inside a block rows are numbered as they are read. So numbers are the same however
    files are split into blocks and blocks packed into tasks.
    """
    fields = raw.schema.fields
    placed = raw.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a block
    schema = T.StructType([*fields, *T.StructType.fromDDL("_file string, _block bigint, _place bigint").fields])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = None, 0
        for batch in batches:
            blocks = list(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()))
            places = []
            for block in blocks:
                if block != own:
                    own, seen = block, 0
                places.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_place"])

    numbered = placed.mapInArrow(number, schema).join(starts, ["_file", "_block"])
    return numbered.withColumn(row_id, F.col("_start") + F.col("_place")).drop("_block", "_start", "_place")


def read_predictions(spark: SparkSession, root: str, names: dict[str, str] | None = None) -> DataFrame:
    """All prediction files below ``root/model/dataset/run/`` as one table.

    Run keys come from the file path, with or without their names (``model=m``). A file's ``split`` names the source split and
    ``phase`` the part of the run: ``split`` of the table is the phase where there is
    one, the file's own is kept as ``source_split``. ``row_id`` is the place of the line in its file, from 0.
    """
    raw = number_lines(spark.read.schema(AUDIT_SCHEMA).option("header", True).option("recursiveFileLookup", True).csv(root))
    parts = F.split(F.col("_file"), "/")
    at = lambda i: F.regexp_replace(F.element_at(parts, i), "^[a-z_]+=", "")
    tagged = raw.select(
        "*", at(-4).alias("model"), at(-3).alias("dataset"), at(-2).alias("test_run")
    ).withColumns({"source_split": F.col("split"), "split": F.coalesce("phase", "split")}).drop("_file")
    return prediction_table(tagged.withColumn("model", display_name(F.col("model"), names or {})))


def source_interactions(train: DataFrame) -> DataFrame:
    """Identifier and cluster columns only: no outcome can leak into support."""
    return train.select(*[c for c in SOURCE_COLUMNS if c in train.columns])


def _split_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The source columns of files of one header, with their file and place; a missing column is null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(list(paths))
    rows = raw if set(SOURCE_COLUMNS) & set(raw.columns) else raw.limit(0)
    named = number_lines(rows) if rows is raw else rows.withColumns({"_file": F.lit(""), "row_id": F.lit(0).cast("bigint")})
    return named.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in SOURCE_COLUMNS], "_file", "row_id")


def read_split_file(spark: SparkSession, path: str, file_order: Column) -> DataFrame:
    """The source columns of one split file by its own header, with ``file_order`` (of the column _file, its path) and its place ``row_id``."""
    return _split_rows(spark, [path]).withColumn("file_order", file_order).select(*SOURCE_COLUMNS, "file_order", "row_id")


def split_headers(spark: SparkSession, folder: str, pattern: str = "*_with_id.csv") -> DataFrame:
    """(path, header, reason) of every file below ``folder``: its first line, read in tasks, and why it gives no rows (null: it does).

    Spark's readers pass over files of no bytes, so those are not listed.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    first = lines.select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("_metadata.file_block_start") == 0)
    heads = first.groupBy("path").agg(F.first("value").alias("header"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    reason = F.when(F.coalesce(F.trim("header"), F.lit("")) == "", "empty_file").when(~F.arrays_overlap(names, F.array(*map(F.lit, SOURCE_COLUMNS))), "no_source_column")
    path = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(path.alias("path")).join(heads.select(path.alias("path"), "header"), "path", "left").select("path", "header", reason.alias("reason"))


def read_related_splits(spark: SparkSession, folder: str, train_file: str, pattern: str = "*_with_id.csv", depth: int = 1) -> DataFrame:
    """Every ``*_with_id.csv`` below a folder, train first, then by name (``file_order``): the ``depth``-th part of the path from its end.

    Files may differ in their columns and column order; those of one header are one scan. A file without any source
    column gives no rows (``split_headers`` lists it). (file_order, row_id) is the order of all lines.
    """
    name = F.element_at(F.split(F.col("_file"), "/"), -depth)
    order = F.when(name == train_file, F.lit("")).otherwise(name)
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in SOURCE_COLUMNS) + ", file_order string, row_id bigint")
    good = split_headers(spark, folder, pattern).where("reason IS NULL")
    for r in good.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect():  # paths of split files
        out = out.unionByName(_split_rows(spark, r["paths"]).withColumn("file_order", order).drop("_file"))
    return out


def rejected(rows: DataFrame, reasons: dict[str, Column], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): rows that no reason applies to, and counts of the others by their first reason (and ``keep``)."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])
    tagged = rows.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL").groupBy(*keep, "reason").agg(F.count(F.lit(1)).alias("rows"))


def phase_union(frames: dict[str, DataFrame], column: str = "phase") -> DataFrame:
    out = None
    for phase, df in frames.items():
        part = df.withColumn(column, F.lit(phase))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HIT_SCHEMA).option("sep", "\t").csv(path)


def parse_hits(lines: DataFrame, column: str = "value") -> DataFrame:
    """Hit rows from tab-separated lines already in a table."""
    fields = F.split(F.col(column), "\t")
    named = [part.split() for part in HIT_SCHEMA.split(", ")]
    return lines.select(
        *[F.get(fields, F.lit(i)).try_cast(dtype).alias(name) for i, (name, dtype) in enumerate(named)]
    )


def vector_store(df: DataFrame, id_column: str, vector: str, dims: int | None = None) -> DataFrame:
    """Clean (id, vec) rows: finite, not empty, cut to ``dims`` if given."""
    return df.select(canonical_id(id_column).alias("id"), finite_vector(F.col(vector), dims).alias("vec")).where(
        "vec is not null"
    )


def preferred_text(df: DataFrame, id_column: str, choices: Sequence[str]) -> DataFrame:
    """Entity text from the first column that the table has (not row by row)."""
    chosen = next((c for c in choices if c in df.columns), None)
    text = F.lit(None).cast("string") if chosen is None else F.coalesce(F.col(chosen).cast("string"), F.lit(""))
    return df.select(canonical_id(id_column).alias("id"), text.alias("text"), F.lit(chosen).alias("text_column"))


def discover_runs(tests: DataFrame, validations: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Pairs of test and validation tables per run, with the reason of a gap.

    ``roots``: (model) expected; a model with no table at all is a missing root.
    """
    keys = ["model", "dataset", "test_run"]
    have = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = have(tests, "has_test").join(have(validations, "has_validation"), keys, "full_outer")
    if roots is not None:
        lost = roots.select("model").join(both.select("model").distinct(), "model", "left_anti")
        both = both.unionByName(lost, allowMissingColumns=True)
    reason = (
        F.when(F.col("dataset").isNull(), "missing_test_root")
        .when(F.col("has_test").isNull(), "missing_test_audit")
        .when(F.col("has_validation").isNull(), "missing_validation_audit")
    )
    return both.select(*keys, reason.alias("reason"))


def export_scored(
    df: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Score rows with a frozen model and derive the exported columns.

    ``scorer`` maps batches to batches with ``s_base`` and ``s_prior`` added. The
    second frame is the per-channel AUROC and AUPRC.
    """
    kept = [f for f in df.schema.fields if f.name not in ("s_base", "s_prior")]
    schema = T.StructType([*kept, *T.StructType.fromDDL("s_base double, s_prior double").fields])
    scored = exported_columns(base_columns(df.mapInPandas(scorer, schema)))
    scored = scored.withColumns({"s_score": F.col("s_base"), "s_full": F.col("s_base")})
    return scored, channel_summary(scored, keys)


def channel_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    channels = F.explode(
        F.array(
            F.struct(F.lit("base").alias("channel"), F.col("p_base").alias("p")),
            F.struct(F.lit("prior").alias("channel"), F.col("p_prior").alias("p")),
        )
    )
    long = scored.select(*keys, "label", channels.alias("_c")).select(*keys, "label", "_c.*")
    rows = long.groupBy(*keys, "channel").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(auc_metrics(long, [*keys, "channel"], "p", "label"), [*keys, "channel"], "left").select(
        *keys, "channel", "rows", "auroc", "auprc"
    )


def provenance(
    train: DataFrame,
    dataset: str,
    supports: dict[str, tuple[str, DataFrame | None]],
    split: str = "cluster",
) -> DataFrame:
    """One row on the frozen source reference: size, columns, metrics, availability."""
    columns = source_interactions(train).columns
    out = train.agg(F.count(F.lit(1)).alias("source_train_rows")).withColumns(
        {
            "dataset": F.lit(dataset),
            "split": F.lit(split),
            "source_reference_status": F.when(F.col("source_train_rows") > 0, "available").otherwise("unavailable"),
            "source_columns_loaded": F.lit("|".join(columns)),
            "outcome_columns_loaded": F.lit(any(c.lower() in ("y", "label") for c in columns)),
            "target_sequence_thresholds": F.lit("identity>=30|query_coverage>=0.5|evalue<=0.001"),
            "joint_support_exact_pair_excluded": F.lit(True),
        }
    )
    for name, (metric, table) in supports.items():
        there = "available" if table is not None and not table.isEmpty() else "unavailable"
        out = out.withColumns({f"{name}_metric": F.lit(metric), f"{name}_status": F.lit(there)})
    return out
