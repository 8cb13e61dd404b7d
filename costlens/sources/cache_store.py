"""Stored answers with an expiry time: a folder of Parquet files, one sub-folder for each span of expiry.

Entries are only added; a reader sees the ones that have not expired, of the folders that can hold such; a purge removes the folders in
which everything has expired, without reading a file; compaction writes the newest entry of each question anew.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.functions import text

BUCKET_SECONDS = 600
_BUCKET = "expires_bucket"


def build(answered: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS) -> DataFrame:
    """Entries from answered requests; an empty question or answer is not stored."""
    usable = (F.coalesce(F.length("query"), F.lit(0)) > 0) & (F.coalesce(F.length("response"), F.lit(0)) > 0)
    return answered.where(usable & F.col("stored_at").isNotNull()).withColumn(
        "expires_at", F.timestamp_micros(F.unix_micros("stored_at") + ttl_seconds * 1_000_000))


def keyed(entries: DataFrame) -> DataFrame:
    """``entries`` with ``query_id``, the fingerprint of the question, and ``key``, which names the entry."""
    parts = ["query", "response", F.unix_micros("stored_at").cast("string")]
    return entries.withColumn("query_id", text.fingerprint(F.col("query"))).withColumn("key", F.sha2(F.concat_ws("\n", *parts), 256))


def _bucket(moment: Column, bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros(moment) / (bucket_seconds * 1_000_000))


def append(entries: DataFrame, path: str, bucket_seconds: int = BUCKET_SECONDS) -> None:
    """Add whole entries (query, response, tier, embedding and what else they carry). Files of one span of expiry are written by few tasks."""
    placed = entries.withColumn(_BUCKET, _bucket(F.col("expires_at"), bucket_seconds))
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")  # so that an empty store can be read
    placed.hint("rebalance", _BUCKET).write.mode("append").partitionBy(_BUCKET).parquet(path)


def visible_at(entries: DataFrame, moment: str) -> DataFrame:
    """Entries not yet expired at ``moment``."""
    return entries.where(F.col("expires_at") > F.to_timestamp(F.lit(moment)))


def read(spark: SparkSession, path: str, moment: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The entries of a store not yet expired at ``moment``; folders of earlier expiry are not opened."""
    now = F.to_timestamp(F.lit(moment))
    stored = spark.read.schema(spark.read.parquet(f"{path}/_schema").schema).parquet(path).where(F.col(_BUCKET) >= _bucket(now, bucket_seconds))
    return visible_at(stored, moment).drop(_BUCKET)


def purge(spark: SparkSession, path: str, moment: str, bucket_seconds: int = BUCKET_SECONDS) -> int:
    """Remove the folders in which everything has expired at ``moment``; returns how many."""
    bound = spark.range(1).select(_bucket(F.to_timestamp(F.lit(moment)), bucket_seconds)).first()[0]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [status.getPath() for status in files.listStatus(root) if status.isDirectory() and status.getPath().getName().startswith(f"{_BUCKET}=")]
    old = [folder for folder in folders if int(folder.getName().partition("=")[2]) < bound]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def compact(spark: SparkSession, path: str, target: str, moment: str, bucket_seconds: int = BUCKET_SECONDS) -> None:
    """Write to ``target`` the newest entry of each question that is still visible; of equally old ones the largest key."""
    rows = read(spark, path, moment, bucket_seconds)
    newest = rows.groupBy("query_id").agg(F.max(F.struct("stored_at", "key")).alias("n")).select("query_id", "n.*")
    append(rows.join(newest, ["query_id", "stored_at", "key"], "left_semi").dropDuplicates(["query_id", "key"]), target, bucket_seconds)
