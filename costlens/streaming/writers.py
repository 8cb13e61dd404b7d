"""Continuous jobs that write: the priced log and the cache."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.functions.pricing import with_costs
from costlens.operators.cache import replay
from costlens.session import materialise
from costlens.streaming.feed import _batch_path, replace_batch, run_batches


def priced_log(requests: DataFrame, log: str, quarantine: str, checkpoint: str) -> None:
    """Price each request and append it; rows that cannot be priced go to quarantine.

    Every batch owns its folder, so a batch that is run again replaces what it wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        priced = with_costs(batch).withColumn("day", F.to_date("created_at"))
        usable = F.col("theoretical_cost_usd").isNotNull()
        priced.where(usable).write.mode("overwrite").partitionBy("day").parquet(_batch_path(log, batch_id))
        priced.where(~usable).drop("day").write.mode("overwrite").parquet(_batch_path(quarantine, batch_id))

    run_batches(requests, write, checkpoint)


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")


def cached_decisions(
    requests: DataFrame, output: str, alive: str, checkpoint: str, ttl_seconds: int = K.CACHE_TTL_SECONDS,
) -> None:
    """Decide hit or miss of streamed requests against what earlier batches stored.

    ``alive`` carries the unexpired stored requests from one batch to the next, so a batch reads
    no more than that: those that were alive when its earliest request was asked, so a request with a time far ahead or
    without one ends nothing. Exact while batches arrive in time order. A batch that is run again
    rewrites its own folders from the same input.
    """
    spark = requests.sparkSession
    kept = ["request_id", "asked_at", "embedding"]

    def decide(batch: DataFrame, batch_id: int) -> None:
        stored = spark.read.parquet(_batch_path(alive, batch_id - 1)) if batch_id > 0 else None
        decisions = materialise(replay(batch, ttl_seconds, stored))
        decisions.write.mode("overwrite").parquet(_batch_path(output, batch_id))
        news = batch.join(decisions.where("stored").select("request_id"), "request_id", "left_semi").select(*kept)
        pool = news if stored is None else news.unionByName(stored)
        earliest = batch.agg(F.min(F.unix_micros("asked_at"))).first()[0]
        live = F.lit(True) if earliest is None else F.unix_micros("asked_at") > earliest - ttl_seconds * 1_000_000
        replace_batch(pool.where(live), alive, batch_id)

    run_batches(requests, decide, checkpoint)
