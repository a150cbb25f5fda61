"""Reading the lake tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A parquet table of the lake; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, root: str, name: str = "documents", columns: list[str] | None = None) -> DataFrame:
    """Text table with only the columns a scan needs."""
    df = table(spark, root, name)
    return df.select(*columns) if columns else df


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over tasks; a table in one file with one row group would else be read, and worked on, by one."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
