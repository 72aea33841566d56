"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
the rows of each stage as Parquet to the session's shared folder and reads them
again as the next one's ``docs``. All stages but the last return the columns of
``documents``; rows that a stage rejects are gone, texts that it changes are changed
(n_chars follows). Null texts are empty, so the quality rules reject them. Extra
columns of ``docs`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import pii
from residuum.llm.bpe import decode, encode
from residuum.llm.decontaminate import decontaminate
from residuum.llm.near_dedup import near_duplicates
from residuum.llm.quality_rules import judge
from residuum.llm.queries import id_digest, vocabulary
from residuum.storage import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that pass."""
    judged = judge(docs.withColumn("_row", F.struct(*docs.columns))).where("kept")
    return judged.select("_row.*", "clean_text").withColumn("text", F.col("clean_text")).drop("clean_text").withColumn(
        "n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest id, a null id last; of rows that repeat that id, one. Ids link nothing."""
    keyed = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(keyed, "_row", n=5, percent=80).select(F.col("id").alias("_row"), "component_id")
    member = classes.join(keyed.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stays = member.groupBy("component_id").agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    return keyed.join(stays, "_row", "left_semi").drop("_row")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    found = pii.redact(pii.find(docs, *pii.train(docs)))
    return found.drop("base_spans", "spans").withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with their count, and whether they decode to the text."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary()), vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest().alias("ids_sha256"), "ids",
                        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark),
    ("personal data", private),
    ("tokens", tokens),
]
#: The boosted trees of the fourth stage have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
