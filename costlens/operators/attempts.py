"""Retries, escalation and failover from a table of model calls."""

from pyspark.sql import DataFrame, Window, functions as F

from costlens import constants as K
from costlens.functions import text


def categories(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("error_text").isNotNull()).withColumn(
        "category", text.error_category(F.col("error_text")))


def backoff_schedule(attempts: DataFrame, tries: int = K.MAX_TRIES_PER_TIER) -> DataFrame:
    """Seconds waited after each rate-limited call: doubling, none after a tier's last try.

    A window holds the calls of one request on one tier, at most a handful by protocol.
    """
    in_tier = Window.partitionBy("request_id", "provider", "tier").orderBy("attempt_no")
    limited = F.coalesce(text.error_category(F.col("error_text")) == "rate_limit", F.lit(False))
    ordinal = F.row_number().over(in_tier)
    return attempts.withColumn("tier_try", ordinal.cast("long")).withColumn(
        "wait_seconds",
        F.when(limited & (F.col("provider") == "primary") & (F.col("tier_try") < tries),
               F.pow(F.lit(2.0), F.col("tier_try") - 1)).otherwise(0.0))


def rollup(attempts: DataFrame, tries: int = K.MAX_TRIES_PER_TIER) -> DataFrame:
    """One row per request: where it started and ended, what it took to get there.

    Calls are added up per tier, then per request; nothing is ordered or gathered. Rate-limited
    calls open a tier's run, so their number gives the waits: 1 + 2 + ... up to the last try.
    """
    failed = F.col("error_text").isNotNull()
    limited = F.coalesce(text.error_category(F.col("error_text")) == "rate_limit", F.lit(False))
    no = F.col("attempt_no")
    runs = attempts.groupBy("request_id", "provider", "tier").agg(
        F.min(no).alias("first_no"), F.max(no).alias("last_no"), F.max_by(~failed, no).alias("ok"),
        F.min(F.when(failed, F.struct(no.alias("no"), F.col("error_text")))).alias("error"),
        F.count_if(limited).alias("limited"), F.count("*").alias("calls"))
    waited = F.pow(F.lit(2.0), F.least(F.col("limited"), F.lit(tries - 1))) - 1
    return runs.groupBy("request_id").agg(
        F.min_by("tier", "first_no").alias("first_tier"),
        F.max_by(F.struct("tier", "provider", "ok"), "last_no").alias("last"),
        F.sum("limited").alias("retries"),
        F.sum(F.when(F.col("provider") == "primary", waited).otherwise(0.0)).alias("wait_seconds"),
        F.min("error").alias("error"), F.sum("calls").alias("calls"),
    ).select(
        "request_id", "first_tier",
        # the local provider answers under the tier the request started with
        F.when(F.col("last.provider") == "local", F.col("first_tier")).otherwise(F.col("last.tier")).alias("tier_used"),
        ((F.col("last.provider") != "local") & (F.col("first_tier") != F.col("last.tier"))).alias("escalated"),
        ((F.col("last.provider") == "local") & F.col("last.ok")).alias("fallback_used"),
        F.col("last.ok").alias("answered"), "calls", "retries", "wait_seconds", F.col("error.error_text").alias("first_error"),
    )


def escalated_confidence(classified: DataFrame, rolled: DataFrame) -> DataFrame:
    """Confidence after routing: cut where another tier answered than the one graded.

    ``classified``: ``request_id, tier, confidence``.
    """
    moved = F.coalesce(F.col("tier_used") != F.col("tier"), F.lit(False))
    return classified.join(rolled.select("request_id", "tier_used"), "request_id", "left").select(
        "request_id", F.col("tier").alias("graded_tier"),
        F.coalesce("tier_used", "tier").alias("final_tier"),
        F.when(moved, F.col("confidence") * K.ESCALATION_FACTOR).otherwise(F.col("confidence")).alias("confidence"),
    )
