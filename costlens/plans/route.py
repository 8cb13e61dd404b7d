"""From chat messages to priced log rows, as one batch job."""

from pyspark.sql import DataFrame, functions as F

from costlens import constants as K
from costlens.functions import text
from costlens.functions.embedding import embed_text
from costlens.functions.pricing import rate_card, with_costs
from costlens.operators import attempts as A, cache, conversations, evaluation, grading
from costlens.operators.skew import salted_join
from costlens.session import materialise
from costlens.sources.tables import example_questions


def example_vectors(spark) -> DataFrame:
    """The fixed example questions as vectors of the default encoder."""
    made = embed_text(example_questions(spark), "utterance")
    return made.select(F.col("utterance").alias("exemplar_id"), "tier", "embedding")


def failed_requests(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """``id, request_id, first_error`` of the requests that no tier and no local provider answered."""
    rolled = A.rollup(attempts).where(~F.col("answered")).select("request_id", "first_error")
    return requests.select("id", text.request_id(F.col("id")).alias("request_id")).join(rolled, "request_id").select("id", "request_id", "first_error")


def route_batch(requests: DataFrame, attempts: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Log rows of a batch of requests; those that failed are not logged and never stored.

    ``requests``: ``id`` (integer), ``created_at, question, answer, estimated_tokens, embedding,
    latency_ms``, ``joined_tokens`` (the estimate of all messages joined) and, where calls reported one, ``usage``
    with ``prompt_tokens, completion_tokens``. Models are not called: their answers and attempts are input.
    A request that was sent to a model is billed by its usage record, else by the joined estimate; a hit by ``estimated_tokens``.
    """
    if "usage" not in requests.columns:
        requests = requests.withColumn("usage", F.lit(None).cast("struct<prompt_tokens:long,completion_tokens:long>"))
    requests = conversations.usage_or_estimate(requests.withColumns({
        "estimated_input": F.col("joined_tokens"), "estimated_output": F.coalesce(F.floor(F.length("answer") / 4), F.lit(0))}))
    failed = A.rollup(attempts).where(~F.col("answered")).select("request_id")
    all_asked = requests.withColumn("request_id", text.request_id(F.col("id")))
    asked = materialise(all_asked.join(failed.withColumn("failed", F.lit(True)), "request_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False))))
    decisions = materialise(cache.replay(asked.select(
        F.col("id").alias("request_id"), F.col("created_at").alias("asked_at"), "embedding",
        ((F.length("answer") > 0) & (F.length("question") > 0) & ~F.col("failed")).alias("answered"))))
    served = cache.replay_answers(
        asked.select(F.col("id").alias("request_id"), F.col("created_at").alias("asked_at"), "embedding"), decisions)
    # one stored answer may serve most hits
    served_answers = salted_join(
        served.select(F.col("query_id").alias("id"), "cache_id"),
        asked.select(F.col("id").alias("cache_id"), F.col("answer").alias("served_answer")), ["cache_id"], "id").drop("cache_id")
    graded = grading.grade(
        asked.select(F.col("id").alias("query_id"), "embedding"), exemplars
    ).select(F.col("query_id").alias("id"), F.col("predicted").alias("graded"), F.col("confidence").alias("graded_confidence"))
    rolled = A.rollup(attempts).select("request_id", "tier_used", F.col("fallback_used").alias("fell_back"))
    models = rate_card(requests.sparkSession).groupBy("tier").pivot("provider", ["primary", "local"]).agg(F.first("model"))

    hit = F.col("hit")
    blank = text.is_blank(F.col("question"))
    tier = F.when(blank, K.DEFAULT_TIER).otherwise(F.col("graded"))
    confidence = F.when(blank, 0.0).otherwise(F.col("graded_confidence"))
    final = F.coalesce("tier_used", tier)
    fallback = ~hit & F.coalesce("fell_back", F.lit(False))
    served = F.when(hit, "cache").otherwise(final)
    rows = (
        asked.join(decisions.select(F.col("request_id").alias("id"), "hit"), "id")
        .join(graded, "id")
        .join(served_answers, "id", "left")
        .join(rolled, "request_id", "left")
        .where(hit | ~F.col("failed"))  # a hit makes no call
        .select(
            "id", "created_at", "request_id",
            text.fingerprint(F.col("question")).alias("query_id"),
            served.alias("tier"), hit.alias("cache_hit"), fallback.alias("fallback_used"),
            F.when(hit, 1.0).when(final != tier, confidence * K.ESCALATION_FACTOR).otherwise(confidence).alias("classifier_confidence"),
            F.round("latency_ms", 2).alias("latency_ms"),
            F.when(hit, F.col("estimated_tokens")).otherwise(F.col("input_tokens")).alias("input_tokens"),
            F.when(hit, text.estimated_tokens(F.coalesce("served_answer", "answer"))).otherwise(F.col("output_tokens")).alias("output_tokens"),
        )
        .withColumn("routing_reason", text.routing_reason(F.col("cache_hit"), F.col("fallback_used"), F.col("tier")))
    )
    # three fixed rows
    named = rows.join(F.broadcast(models), "tier", "left").withColumn(
        "model_used", F.when(F.col("cache_hit"), "cache").when(F.col("fallback_used"), F.col("local")).otherwise(F.col("primary"))
    ).drop("primary", "local")
    return with_costs(named)


def eval_report(labelled: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Grade labelled questions and report the result as one document."""
    scored = grading.grade(labelled, exemplars).select("query_id", "label", "predicted")
    return evaluation.result_document(materialise(scored))
