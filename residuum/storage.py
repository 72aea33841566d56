"""Durable cuts of long plans.

A cut writes the frame as parquet into the folder the cluster names in
``spark.checkpoint.dir`` and reads it back: the plan behind it is gone, later
reads prune columns, and a lost executor costs one file read instead of the
whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local session gets a private one; on a cluster that is
    an error, since executors and driver would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
