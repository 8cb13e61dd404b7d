"""Supplied Parquet tables and the working tables derived from them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as K
from costlens.functions import pricing, text
from costlens.functions.vectors import as_doubles
from costlens.session import fixed_table, prepare


# Columns of the supplied tables; a known schema spares a job that reads file footers.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "user_id", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def events_by_time(spark: SparkSession, folder: str, condition=None, rows_per_range: int = 250_000) -> DataFrame:
    """The events (those with ``condition`` on ``created_at``) dealt into ranges of time, before anything is derived from them.

    The cut points come from a sample, for which Spark runs all that stands before the exchange once more: so far only the
    supplied columns. The key ends in the id, so no moment is too full.
    """
    events = _events(spark, folder)
    events = events if condition is None else events.where(condition)
    ranges = max(spark.sparkContext.defaultParallelism, -(-events.count() // rows_per_range))
    return events.repartitionByRange(ranges, "created_at", "id")


def _tier_of(number):
    """0 simple, 1 medium, 2 complex."""
    return F.when(number % 3 == 0, "simple").when(number % 3 == 1, "medium").otherwise("complex")


def requests(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Unpriced requests: what the service knows before it computes costs. Of ``events``, or of all."""
    kind = F.col("event_type")
    question = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("k").cast("string"))
    hit, fallback = kind == "purchase", kind == "error"
    tier = (
        F.when(kind == "click", "simple").when(kind == "view", "medium").when(kind == "signup", "complex")
        .when(hit, "cache").otherwise(_tier_of(F.col("id")))
    )
    models = _tier_models(spark)
    return (
        (_events(spark, folder) if events is None else events)
        .withColumn("tier", tier)
        .join(F.broadcast(models), "tier")
        .select(
            "id", "created_at",
            text.request_id(F.col("id")).alias("request_id"),
            text.fingerprint(question).alias("query_id"),
            "tier",
            F.when(fallback, F.col("local_model")).otherwise(F.col("primary_model")).alias("model_used"),
            hit.alias("cache_hit"),
            fallback.alias("fallback_used"),
            text.routing_reason(hit, fallback, F.col("tier")).alias("routing_reason"),
            F.when(hit, F.lit(1.0)).otherwise(F.round(F.col("k") / 100, 4)).alias("classifier_confidence"),
            F.col("value").alias("latency_ms"),
            (10 + F.col("k") * 5).cast("long").alias("input_tokens"),
            F.floor(F.col("value") * 4).cast("long").alias("output_tokens"),
        )
    )


def _tier_models(spark: SparkSession) -> DataFrame:
    """Four fixed rows: the model each tier uses per provider."""
    by_key = {(tier, provider): model for tier, provider, model, *_ in K.RATE_CARD}
    rows = [(t, by_key[t, "primary"], by_key[t, "local"]) for t in K.TIERS] + [("cache", "cache", "cache")]
    return fixed_table(spark, rows, "tier string, primary_model string, local_model string")


def request_logs(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """The priced fact table, one row per request. Of ``events``, or of all."""
    return pricing.with_costs(requests(spark, folder, events)).select(
        "id", "created_at", "request_id", "query_id", "tier", "model_used", "cache_hit", "fallback_used",
        "routing_reason", "classifier_confidence", "latency_ms", "input_tokens", "output_tokens",
        "actual_cost_usd", "theoretical_cost_usd", "baseline_cost_usd", "savings_usd", "savings_source",
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def _first_moment():
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


def after_start(seconds):
    return F.timestamp_micros(F.unix_micros(_first_moment()) + seconds * 1_000_000)


def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One answered question a minute; a few answers are empty."""
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        key.alias("cache_id"),
        as_doubles(F.col("embedding")).alias("embedding"),
        F.when(key % 25 == 24, F.lit("")).otherwise(F.concat(F.lit("answer "), key.cast("string"))).alias("response"),
        _tier_of(F.col("label")).alias("tier"),
        after_start(key * 60).alias("stored_at"),
    )


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """One question per entry: its vector blended with the next one by (id mod 10) / 10."""
    base = table(spark, folder, "embeddings")
    total = base.agg(F.count("*")).scalar()
    nearby = base.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next_embedding"))
    key = F.col("vec_id")
    weight = (key % 10) / F.lit(10.0)
    return base.join(nearby, F.col("next_id") == (key + 1) % total).select(
        key.alias("query_id"),
        F.zip_with(as_doubles(F.col("embedding")), as_doubles(F.col("next_embedding")),
                   lambda x, y: x + y * weight).alias("embedding"),
        _tier_of(F.col("label")).alias("label"),
        after_start(key * 60 + key % 8 * 600).alias("asked_at"),
    )


def exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled example vectors."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("exemplar_id"),
        _tier_of(F.col("label")).alias("tier"),
        as_doubles(F.col("embedding")).alias("embedding"),
    )


def example_questions(spark: SparkSession) -> DataFrame:
    rows = [(question, tier) for tier in K.TIERS for question in K.EXAMPLE_QUESTIONS[tier]]
    return fixed_table(spark, rows, "utterance string, tier string")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Model calls of the requests that met an error.

    A rate limit stays on its tier, any other error moves one tier up, and past the top tier
    the call goes to the local provider at the first tier.
    """
    failed = _events(spark, folder).where("event_type = 'error'").select("id", (1 + F.col("k") % 4).alias("n"))
    tries = failed.withColumn("tries", F.transform(
        F.sequence(F.lit(1), F.col("n")), lambda j: F.struct(j.alias("no"), ((F.col("id") + j) % 3).alias("kind"))))
    first = F.col("id") % 3
    moved = F.size(F.filter("tries", lambda t: (t["no"] < F.col("try.no")) & (t["kind"] != 0)))
    level = first + moved
    kind = F.col("try.kind")
    return tries.withColumn("try", F.explode("tries")).select(
        text.request_id(F.col("id")).alias("request_id"),
        F.col("try.no").alias("attempt_no"),
        F.when(level >= 3, "local").otherwise("primary").alias("provider"),
        _tier_of(F.when(level >= 3, first).otherwise(level)).alias("tier"),
        F.when(F.col("try.no") == F.col("n"), F.lit(None).cast("string"))
        .when(kind == 0, "Rate limit hit: 429").when(kind == 1, "Timeout calling model")
        .otherwise("Connection error").alias("error_text"),
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Judged answers: equal to the premium baseline or not."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("request_id"),
        _tier_of(F.col("doc_id")).alias("tier"),
        (F.col("quality") == 1).alias("equivalent"),
    )
