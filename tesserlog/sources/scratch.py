"""Scratch tables in the folder that driver and executors share.

An intermediate table that is read more than once is written below ``spark.checkpoint.dir``,
so that a lost executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own on one machine, as in tests; on a cluster an error, as executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tesserlog/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage is cut there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
