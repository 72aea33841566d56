"""Writers: rounded tables, sequence records, accession maps, missing partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import canonical_id, clean_sequence

# Columns kept from an accession table.
ACCESSION_COLUMNS = [
    "pr_id", "uniprot_id", "mapping_method", "identity", "coverage", "evalue", "reviewed", "organism", "note",
]


def rounded(df: DataFrame, precision: int) -> DataFrame:
    """All fractional columns rounded half-even."""
    wide = (T.DoubleType, T.FloatType, T.DecimalType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, wide)]
    return df.withColumns({n: F.bround(F.col(n).cast("double"), precision) for n in names})


def write_table(df: DataFrame, path: str, precision: int = 6, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write rounded rows; with ``partition_by`` an overwrite replaces only the partitions that ``df`` has."""
    writer = rounded(df, precision).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def missing_runs(wanted: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Run keys whose partition still has to be computed."""
    wanted = wanted.select(*keys).distinct()
    return wanted if stored is None else wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def fasta_records(entities: DataFrame, width: int = 80) -> DataFrame:
    """One record per entity with a sequence: header line and wrapped lines."""
    text = F.trim(F.coalesce(F.col("sequence"), F.lit("")))
    body = F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), "\n$", "")
    record = F.concat(F.lit(">pr_id="), F.col("id"), F.lit("\n"), body)
    return entities.where(text != "").select("id", record.alias("record"))


def search_records(entities: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Cleaned records of every entity once, flagged when it is a source entity."""
    clean = entities.select(canonical_id("id").alias("id"), clean_sequence("sequence").alias("sequence"))
    first = clean.where("id <> '' and sequence <> ''").groupBy("id").agg(F.min("sequence").alias("sequence"))
    flags = source_ids.select("id").distinct().withColumn("is_source", F.lit(True))
    return first.join(flags, "id", "left").select(
        "id",
        F.concat(F.lit(">pr_id="), F.col("id"), F.lit("\n"), F.col("sequence")).alias("record"),
        F.coalesce("is_source", F.lit(False)).alias("is_source"),
    )


def write_records(records: DataFrame, path: str) -> None:
    records.select(F.col("record").alias("value")).write.mode("overwrite").text(path)


def accession_map(mapping: DataFrame) -> DataFrame:
    """Known columns of an accession table, trimmed, without empty or repeated rows."""
    lost = {"pr_id", "uniprot_id"} - set(mapping.columns)
    if lost:
        raise ValueError(f"mapping lacks columns: {sorted(lost)}")
    keep = [c for c in ACCESSION_COLUMNS if c in mapping.columns]
    clean = mapping.select(*keep).withColumns(
        {"pr_id": F.col("pr_id").cast("bigint"), "uniprot_id": F.trim(F.col("uniprot_id").cast("string"))}
    )
    return clean.where("uniprot_id <> ''").dropDuplicates(["pr_id", "uniprot_id"])


def accession_coverage(mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """Mapped entities, all entities and their ratio."""
    known = mapping.agg(F.count_distinct("pr_id").alias("num_mapped_targets")).withColumn("_all", F.lit(1))
    every = entities.agg(F.count(F.lit(1)).alias("num_targets")).withColumn("_all", F.lit(1))
    return every.join(known, "_all").select(
        "num_targets", "num_mapped_targets",
        F.coalesce(F.try_divide("num_mapped_targets", "num_targets"), F.lit(0.0)).alias("coverage"),
    )
