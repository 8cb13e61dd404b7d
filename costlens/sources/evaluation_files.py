"""Labelled question files (JSON lines) and the evaluation result document."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.schemas import EVAL_ROW


def load(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line with its verdict: ``reject_reason`` is null for usable rows.

    A line number does not exist in a split file read in parallel; a rejected row carries its
    file and its raw text instead.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", EVAL_ROW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select("value", F.col("_metadata.file_name").alias("file_name"), parsed.alias("row")).select(
        F.col("row.query").alias("query"),
        F.col("row.label").alias("label"),
        F.when(F.col("row._corrupt_record").isNotNull(), "malformed")
        .when(~F.coalesce(F.col("row.label").isin(K.TIERS), F.lit(False)), "bad label").alias("reject_reason"),
        "file_name", F.col("value").alias("raw"),
    )


def write_result(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)
