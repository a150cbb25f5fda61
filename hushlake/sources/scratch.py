"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """Address of a new folder below the one that the cluster shares; only Spark itself reads and writes there.

    Where ``spark.checkpoint.dir`` is unset (tests) it is set to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="hushlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept in the shared folder: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and written as parquet to the shared folder, for operators that read them several times."""
    at = shared_folder(df.sparkSession, "stored")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
