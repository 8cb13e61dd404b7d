"""The request log on Parquet, partitioned by day."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costlens.schemas import REQUEST_LOG, REQUEST_LOG_DEFAULTS

STORED_LOG = T.StructType(REQUEST_LOG.fields + [T.StructField("day", T.DateType())])


def append(rows: DataFrame, path: str) -> None:
    """Append rows, one folder per day.

    Rows are brought together by day, and adaptive execution splits large days and merges small ones by their measured
    size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): the files of a day grow with its bytes, not with the tasks.
    """
    rows.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def scan(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All rows from ``since`` on (inclusive); the day predicate prunes folders."""
    rows = spark.read.schema(STORED_LOG).parquet(path)
    if since is not None:
        bound = F.to_timestamp(F.lit(since))
        rows = rows.where((F.col("day") >= F.to_date(bound)) & (F.col("created_at") >= bound))
    return with_defaults(rows.drop("day"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fill columns that older rows lack; absent columns are added."""
    present = set(rows.columns)
    columns = []
    for field in REQUEST_LOG.fields:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in REQUEST_LOG_DEFAULTS:
            value = F.coalesce(value, F.lit(REQUEST_LOG_DEFAULTS[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("id"))
