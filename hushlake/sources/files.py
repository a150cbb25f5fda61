"""Case files and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CASES = "id string, text string, expected_type string, sensitive boolean, category string"
_BOX = "struct<x:double,y:double,width:double,height:double>"
SCREEN_CASES = (
    "scenarioId string, name string, url string, viewport struct<width:double,height:double>,"
    "elements array<struct<id:string,selector:string,tagName:string,role:string,label:string,value:string,"
    f"boundingBox:{_BOX},isSensitive:boolean,expectedPlaceholder:string,isActionable:boolean>>"
)


def text_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled texts from files that hold a JSON array each, or (``lines``) one case per line.

    Only the second form can be split, so large case sets should use it.
    """
    return spark.read.schema(TEXT_CASES).option("multiLine", not lines).json(path)


def screen_cases(spark: SparkSession, path: str) -> DataFrame:
    """Screens from JSON arrays, one row per element."""
    rows = spark.read.schema(SCREEN_CASES).option("multiLine", True).json(path)
    flat = rows.select("scenarioId", "url", F.explode("elements").alias("e"))
    return flat.select(
        "scenarioId", "url", "e.id", "e.selector", F.col("e.tagName").alias("tag"), "e.role", "e.label", "e.value",
        "e.boundingBox.*", F.col("e.isSensitive").alias("sensitive"), F.col("e.isActionable").alias("actionable"),
        F.col("e.expectedPlaceholder").alias("expected_placeholder"),
    )


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Scan reports as JSON, partitioned by website."""
    reports.write.mode(mode).partitionBy("website").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only audit or activity log; the cap is applied when the log is read."""
    rows.write.mode("append").parquet(path)


def write_evaluation(result: DataFrame, path: str) -> None:
    """Evaluation report as one JSON document per row."""
    result.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
